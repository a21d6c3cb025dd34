"""Main text of web pages: a suffix array over each host's token streams, then an exact check by markup.

Every page is cut into blocks, those of its menus, adverts and footers too, and marked by its markup: blocks inside an
article (or main) are its text, but for menus, asides, forms, adverts and comments inside it. Inside an article a class
name that only has a part like those of such elements (share-of-market, related-work) is a hint and decides nothing: its
blocks are doubtful. So are the blocks outside menus, headers, footers and the like where a page marks no article. The
token streams of all pages of a host are concatenated, a suffix array finds runs that repeat on several pages, and blocks
that such runs cover go. The check gives articles back the passages that they repeat, and drops unique blocks of menus
and the like; on doubtful blocks the array has the last word. A host of many pages has a suffix array for each shard of
them; the shards' runs are counted together by hash.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, materialize, small_side, trimmed

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
_RAW_END = {k: re.compile(rf"</{k}\b[^>]*>?", re.I) for k in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input".split()
)
_CHROME_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
_MAIN_TAGS = frozenset(("article", "main"))
_COMMENT_WORDS = re.compile(r"(?:^|[_-])(?:comments?|discussion|disqus|remarks?|replies|responses)(?:$|[_-])", re.I)
_CHROME_WORDS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|discussion|disqus|footer|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|pagination|popup|promo|related|remarks?|replies|responses|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[_-])",
    re.I,
)
# Inside an article a name decides only if all its parts are of these, and it has a plain one, or one of two meanings that names a list of links.
_PLAIN = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|"
    r"readers?|replies|sidebar|sponsor\w*|subscribe|widget)$",
    re.I,
)
_TWO_MEANINGS = re.compile(r"(?:discussion|header|related|remarks?|responses|share|sharing|social)$", re.I)
_ALONE = re.compile(r"(?:related|share|sharing|social)$", re.I)
_LINKS = re.compile(r"(?:articles|bar|buttons?|icons|links|posts|stories)$", re.I)
_CARRIER = re.compile(r"(?:area|block|body|box|inline|inner|item|list|panel|section|site|slot|thread|unit|\d*)$", re.I)
#: Class names such as has-sidebar describe the layout around the element, not the element.
_LAYOUT_WORD = re.compile(r"^(?:has|hide|is|layout|no|page|site|with|without)[_-]|[_-](?:layout|wrap|wrapper|container|page)$", re.I)
_OWN_HEADING = re.compile(r"header|masthead", re.I)
_ROLE_CHROME = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|menu|menubar|dialog|alert|alertdialog)$", re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|style\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')")
_SPACE = re.compile(r"\s+")

# Elements that end where one of these begins: (tags that end, tags beyond which nothing ends).
_LIST, _TABLE = frozenset(("ul", "ol", "menu", "dl")), frozenset(("table",))
_ENDS = {"li": (frozenset(("li",)), _LIST), "tr": (frozenset(("td", "th", "tr")), _TABLE)}
_ENDS |= {t: (frozenset(("dt", "dd")), _LIST) for t in ("dt", "dd")} | {t: (frozenset(("td", "th")), _TABLE | {"tr"}) for t in ("td", "th")}
_ENDS |= {t: (frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption")), _TABLE) for t in ("tbody", "thead", "tfoot")}
_P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split()
)
_P_HOLDS = frozenset(("button", "td", "th", "table", "caption", "object"))

#: A run counts as repeated from so many tokens on, on so many pages of different text; a block goes if so much of it is covered.
RUN_TOKENS, RUN_PAGES, COVERED = 6, 3, 0.5
#: What the markup says of a block: text of the article, doubtful (the array decides), or none of the text.
KEPT, DOUBTFUL, OUT = 0, 1, 2
#: Pages, and characters of html, of a host whose streams one task concatenates.
SHARD_PAGES, SHARD_CHARS = 512, 4 << 20
#: Rows of one page that a task takes.
COPIES = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Blocks:
    """Blocks of a page by what the markup says of them."""

    def __init__(self):
        self.main: list[str] = []  # in an article that is in nothing else
        self.inner: list[str] = []  # in an article that a menu, a form, or an element marked by its class holds
        self.open: list[str] = []  # in nothing that the markup marks
        self.doubts: dict[str, set[int]] = {"main": set(), "inner": set(), "open": set()}  # positions of blocks that a class name hints at
        self.every: list[tuple[str, str, bool]] = []  # all blocks in page order: text, its list or "", hinted at

    def article(self) -> list[str]:
        return self.main or self.inner

    def doubtful(self) -> list[bool]:
        """For each block of the article, or of the open ones if there is none, whether repetition decides."""
        found = self.doubts["main" if self.main else "inner"]
        return [i in found for i in range(len(self.article()))] or [True] * len(self.open)

    def marks(self) -> list[int]:
        """KEPT, DOUBTFUL or OUT for each of all blocks."""
        text = "main" if self.main else "inner" if self.inner else "open"
        return [OUT if place != text else DOUBTFUL if hinted or text == "open" else KEPT for _, place, hinted in self.every]


def _place(stack: list[tuple[str, str]]) -> str:
    """Where text within these elements belongs: "main", "inner", "open", or nothing."""
    outside = inside = False
    article = False
    for _, part in stack:
        if part in ("hidden", "comment"):
            return ""
        if part == "main":
            article, outside, inside = True, outside or inside, False
        elif part == "chrome":
            if article:
                inside = True
            else:
                outside = True
    if inside:
        return ""
    return ("inner" if outside else "main") if article else "" if outside else "open"


def blocks_of(page: str) -> _Blocks:
    """The page's blocks; elements are closed where HTML's rules imply an end tag."""
    out = _Blocks()
    words: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements: (tag, "main", "chrome", "comment", "doubt", "hidden" or "")
    places: list[str] = ["open"]  # of the stack as it is

    def flush() -> None:
        if words:
            text = _SPACE.sub(" ", html.unescape("".join(words))).strip()
            words.clear()
            if text:
                hinted = any(part == "doubt" for _, part in stack)
                out.every.append((text, places[0], hinted))
                if places[0]:
                    found = getattr(out, places[0])
                    if hinted:
                        out.doubts[places[0]].add(len(found))
                    found.append(text)

    def cut(i: int) -> None:
        ended = stack[i:]
        if any(part and tag not in _INLINE for tag, part in ended):
            flush()
        del stack[i:]
        if any(part for _, part in ended):
            places[0] = _place(stack)

    def end(tags: frozenset, beyond: frozenset) -> None:
        found = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                found = i
            elif stack[i][0] in beyond:
                break
        if found is not None:
            cut(found)

    at, n = 0, len(page)
    while at < n:
        hit = _TAG.search(page, at)
        if hit is None:
            if stack and stack[-1][1] == "hidden" and stack[-1][0] in _INLINE:
                break
            words.append(page[at:])
            break
        if not (stack and stack[-1][1] == "hidden" and stack[-1][0] in _INLINE):
            words.append(page[at : hit.start()])
        at = hit.end()
        tag = hit.group(2)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(hit.group(1)), hit.group(3)
        inline = tag in _INLINE
        if not inline:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    cut(i)
                    break
                if inline and stack[i][0] not in _INLINE:
                    break
            continue
        if tag in _RAW_END and not attributes.rstrip().endswith("/"):
            raw = _RAW_END[tag].search(page, at)
            at = raw.end() if raw else n
            continue
        if tag in _VOID:
            if tag == "hr":
                end(frozenset(("p",)), _P_HOLDS)
            continue
        if inline:
            if attributes and _is_hidden(attributes):
                stack.append((tag, "hidden"))
            elif any(t == tag for t, _ in stack):
                stack.append((tag, stack[-1][1] if stack[-1][0] in _INLINE else ""))
            continue
        while stack and stack[-1][0] in _INLINE:  # an inline element ends with its block
            cut(len(stack) - 1)
        if tag in _P_ENDS:
            end(frozenset(("p",)), _P_HOLDS)
        if tag in _ENDS:
            end(*_ENDS[tag])
        part = _part(tag, attributes, any(p == "main" for _, p in stack))
        stack.append((tag, part))
        if part:
            places[0] = _place(stack)
    flush()
    return out


def _is_hidden(attributes: str) -> bool:
    return "hidden" in attributes.lower() and bool(_HIDDEN.search(_QUOTED.sub("=x", attributes))) or "style" in attributes.lower() and bool(_HIDDEN.search(attributes))


def _part(tag: str, attributes: str, inside: bool) -> str:
    """"main", "chrome", "comment", "doubt", "hidden" or nothing, by the tag and its class, id, role and style; inside: within an article."""
    if tag in _MAIN_TAGS:
        found = "main"
    elif tag in _CHROME_TAGS and not (inside and tag == "header"):
        found = "chrome"
    else:
        found = ""
    if not attributes or tag in ("html", "body"):
        return found
    if _is_hidden(attributes):
        return "hidden"
    if "=" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            value, name = a or b or c, name.lower()
            if name == "role":
                if _ROLE_CHROME.match(value):
                    return "chrome"
                if value.lower() in ("main", "article") and not found:
                    found = "main"
            elif name in ("class", "id"):
                for word in value.split():
                    if inside:
                        word = _OWN_HEADING.sub("", word)  # an article's own heading
                        if (_CHROME_WORDS.search(word) or _COMMENT_WORDS.search(word)) and not _LAYOUT_WORD.search(word) and not _decides(word):
                            found = found or "doubt"
                            continue
                    if _COMMENT_WORDS.search(word) and not _LAYOUT_WORD.search(word):
                        return "comment"
                    if _CHROME_WORDS.search(word) and not _LAYOUT_WORD.search(word):
                        found = "chrome"
    return found


def _decides(name: str) -> bool:
    """Whether a class name within an article means one thing: ad, comments, cookie-notice, share-buttons, not share-of-market."""
    parts = re.split(r"[_-]+", name)
    plain, two, links = ([bool(rule.match(x)) for x in parts] for rule in (_PLAIN, _TWO_MEANINGS, _LINKS))
    known = all(p or t or k or _CARRIER.match(x) for x, p, t, k in zip(parts, plain, two, links))
    return known and (any(plain) or any(two) and any(links)) or bool(_ALONE.match(name))


def packed(blocks: list[str], marks: list[int]) -> bytes:
    """Blocks of a page and their marks, compressed."""
    if not blocks:
        return b""
    plain = bytes(48 + m for m in marks) + b"\n" + "\n".join(blocks).encode()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def unpacked(page: bytes) -> tuple[list[str], list[int]]:
    if not page:
        return [], []
    marks, *blocks = pa.decompress(page[8:], int.from_bytes(page[:8], "little"), "zstd", asbytes=True).decode().split("\n")
    return blocks, [int(m) for m in marks]


def _identity(digest: bytes, blocks: list[str], marks: list[int]) -> bytes:
    """The same for pages of a host that differ only in what the markup takes for no text."""
    import xxhash

    text = [(x, m) for x, m in zip(blocks, marks) if m != OUT]
    return xxhash.xxh3_128_digest("\n".join(x for x, _ in text).encode() + bytes(m for _, m in text)) if text else digest


def _streams(outside: bool = False):
    """page_id, url, host, digest, same and packed of a partition's pages (page_id, url, host, digest, html), copies within
    the partition once: all blocks, or those that aren't surely of an article."""

    def run(parts):
        seen: set[tuple] = set()
        for part in parts:
            at, rows = [], []
            for i, (host, digest, page) in enumerate(zip(*(c.to_pylist() for c in part.columns[2:]))):
                if (host, digest) not in seen:
                    seen.add((host, digest))
                    found = blocks_of(page or "")
                    blocks, marks = [text for text, _, _ in found.every], found.marks()
                    same = _identity(digest, blocks, marks)
                    if outside:
                        blocks, marks = [x for x, m in zip(blocks, marks) if m != KEPT], [m for m in marks if m != KEPT]
                    at.append(i)
                    rows.append((same, packed(blocks, marks)))
            whole = part.select(range(4)).take(pa.array(at, pa.int64()))
            made = [pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*whole.columns, *made], names=["page_id", "url", "host", "digest", "same", "packed"])

    return run


def _texts(parts):
    """page_id, url and text of pages (page_id, url, packed, gone): what the array left, after the check by markup."""
    for part in parts:
        text = []
        for page, gone in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
            text.append("\n".join(x for x, m, g in zip(*unpacked(page), gone) if m == KEPT or m == DOUBTFUL and not g))
        yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a token sequence in order, and the length of the prefix that each shares with the one before.

    Prefix doubling that sorts only what is still tied; common prefixes from the ranks of each doubling.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    spot = np.arange(n)

    def heads(new: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, at, 0))

    rank = np.zeros(n, np.int64)
    rank[order] = heads(np.r_[True, np.diff(tokens[order]) != 0][:n], spot)
    ranks, step = [], 1
    while True:
        ranks.append(rank.astype(np.int32))
        ordered = rank[order]
        same = ordered[1:] == ordered[:-1]
        tied = np.flatnonzero(np.r_[same, False][:n] | np.r_[False, same][:n])
        if not len(tied):
            break
        of = order[tied]
        then = of + step
        key = rank[of] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        sort = np.argsort(key)
        of, key = of[sort], key[sort]
        order[tied] = of
        rank[of] = heads(np.r_[True, key[1:] != key[:-1]], tied)
        step *= 2
    shared = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        i, j = order[:-1] + shared[1:], order[1:] + shared[1:]
        fits = np.flatnonzero((i < n) & (j < n))
        shared[1 + fits[ranks[level][i[fits]] == ranks[level][j[fits]]]] += 1 << level
    return order, shared


def _stream(pages: list[list[str]]):
    """Words, and for each place its token (an own separator ends each block), page and block; tokens of each block."""
    number: dict[str, int] = {}
    stream, page_at, block_at, flat = [], [], [], []
    for p, blocks in enumerate(pages):
        for text in blocks:
            b = len(flat)
            tokens = text.split()
            flat.append(len(tokens))
            stream += [number.setdefault(t, len(number)) for t in tokens] + [-1 - b]
            page_at += [p] * (len(tokens) + 1)
            block_at += [b] * (len(tokens) + 1)
    return list(number), *(np.array(x, np.int64) for x in (stream, page_at, block_at, flat))


class HostRuns:
    """Runs of the token streams of some pages of a host: of `size` tokens of one block, and shorter blocks whole.

    The pages' streams are concatenated, an own separator after each block; neighbours in the suffix array that share
    size tokens are one run, so every longer repeat is a chain of runs. Each page counts once for a run.

    same: an identity for each page; pages of one identity count as one. counts: for each block of each page, whether the
    page counts for its runs.
    """

    def __init__(self, pages: list[list[str]], size: int = RUN_TOKENS, same: list | None = None, counts: list[list[bool]] | None = None):
        self.pages, self.size = pages, size
        self.words, self.tokens, self.page, self.block, self.flat = _stream(pages)
        n = len(self.tokens)
        m = max(0, n - size + 1)
        place, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        kinds = 0
        if m:
            order, shared = suffix_array(self.tokens)
            fits = np.zeros(n, bool)
            fits[:m] = (self.tokens[:m] >= 0) & (self.block[:m] == self.block[size - 1 :]) & (self.tokens[size - 1 :] >= 0)
            group = np.cumsum(shared < size) - 1
            keep = fits[order]
            place.append(order[keep])
            kind.append(np.unique(group[keep], return_inverse=True)[1] if keep.any() else np.zeros(0, np.int64))
            kinds = int(kind[-1].max()) + 1 if keep.any() else 0
        start = np.r_[0, np.flatnonzero(np.diff(self.block)) + 1] if n else np.zeros(0, np.int64)
        short: dict[tuple, int] = {}
        at = [i for i in range(len(self.flat)) if 0 < self.flat[i] < size]
        place.append(start[at] if len(at) else np.zeros(0, np.int64))
        kind.append(np.array([short.setdefault(tuple(self.tokens[start[i] : start[i] + self.flat[i]].tolist()), kinds + len(short)) for i in at], np.int64))
        #: Each place where a run begins, the run there and its length; of each run the pages that have it.
        self.place, self.run = np.concatenate(place), np.concatenate(kind)
        self.length = np.minimum(size, self.flat[self.block[self.place]]) if len(self.place) else np.zeros(0, np.int64)
        self.n_runs = kinds + len(short)
        number: dict = {}
        who = np.array([number.setdefault(x, len(number)) for x in (range(len(pages)) if same is None else same)], np.int64)
        at, of = self.place, self.run
        if counts is not None:
            on = np.array([c for page in counts for c in page], bool)[self.block[at]] if len(at) else np.zeros(0, bool)
            at, of = at[on], of[on]
        both = np.unique(of * max(1, len(pages)) + who[self.page[at]]) if len(at) else np.zeros(0, np.int64)
        self._held, self._who = both // max(1, len(pages)), both % max(1, len(pages))
        self.times = np.bincount(self._held, minlength=self.n_runs)

    def holders(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs, and the numbers of the first `most` identities that have each."""
        start = np.cumsum(self.times) - self.times
        few = np.arange(len(self._held)) - start[self._held] < most
        return self._held[few], self._who[few]

    def hashes(self, which: np.ndarray | None = None) -> np.ndarray:
        """A 128-bit hash of each run's words, or of those runs."""
        import xxhash

        word = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.encode()) for w in self.words), np.uint64).reshape(-1, 2)
        first = np.zeros(self.n_runs, np.int64)
        first[self.run] = np.arange(len(self.run))
        if which is not None:
            first = first[which]
        at, length = self.place[first], self.length[first]
        key = np.repeat(length.astype(np.uint64)[:, None], 2, axis=1)
        for j in range(self.size):
            on = np.flatnonzero(length > j)
            with np.errstate(over="ignore"):
                x = key[on] * _STEP + word[self.tokens[at[on] + j]]
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                key[on] = x ^ (x >> np.uint64(27))
        return key.view("V16").ravel()

    def repeated(self, run: np.ndarray, covered: float = COVERED) -> list[list[bool]]:
        """For each block of each page, whether the runs marked in `run` cover so much of it."""
        hit = run[self.run] if len(self.run) else np.zeros(0, bool)
        cover = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(cover, self.place[hit], 1)
        np.add.at(cover, self.place[hit] + self.length[hit], -1)
        on = np.cumsum(cover[:-1]) > 0
        gone = np.bincount(self.block[on], minlength=len(self.flat)) >= covered * np.maximum(1, self.flat)
        out, b = [], 0
        for blocks in self.pages:
            out.append([bool(x) for x in gone[b : b + len(blocks)]])
            b += len(blocks)
        return out


def repeated_blocks(pages: list[list[str]], run_tokens: int = RUN_TOKENS, run_pages: int = RUN_PAGES, covered: float = COVERED) -> list[list[bool]]:
    """For each block of each page (pages of different text), whether runs that run_pages pages have cover it."""
    runs = HostRuns(pages, run_tokens)
    return runs.repeated(runs.times >= run_pages, covered)


def _opened(rows: pa.Table) -> tuple[pa.Table, list[list[str]], list[list[int]]]:
    """A shard's different pages in the order of their digests, their blocks and marks."""
    digests = rows.column("digest").to_pylist()
    first = dict(zip(reversed(digests), range(len(digests) - 1, -1, -1)))
    rows = rows.take(pa.array([first[d] for d in sorted(first)], pa.int64()))
    pages = [unpacked(x) for x in rows.column("packed").to_pylist()]
    return rows, [x for x, _ in pages], [m for _, m in pages]


def _binary16(values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _counted(run_tokens: int, run_pages: int):
    """Runs of a shard outside articles, each with run_pages identities of pages at most."""

    def run(key, rows):
        rows, blocks, _ = _opened(rows)
        same = rows.column("same").to_pylist()
        runs = HostRuns(blocks, run_tokens, same)
        held, who = runs.holders(run_pages)
        names = list(dict.fromkeys(same))
        host, shard = (pa.repeat(k, len(held)) for k in key)
        return pa.table([host, shard, _binary16(runs.hashes()[held]), pa.array([names[i] for i in who.tolist()], pa.binary())], names=["host", "shard", "run", "same"])

    return run


def _judged(run_tokens: int, run_pages: int, covered: float):
    """For each page of a shard, which of its blocks repeat; `shared` has the runs of a host of several shards."""

    def run(key, rows, shared):
        rows, blocks, marks = _opened(rows)
        runs = HostRuns(blocks, run_tokens, rows.column("same").to_pylist(), [[m != KEPT for m in page] for page in marks])
        many = runs.times >= run_pages
        if shared.num_rows:
            some = np.flatnonzero(runs.times)
            many[some] |= np.isin(runs.hashes(some), np.frombuffer(b"".join(shared.column("run").to_pylist()), "V16"))
        gone = [bytes(x) for x in runs.repeated(many, covered)]
        return rows.select(["page_id", "url", "host", "digest", "packed"]).append_column("gone", pa.array(gone, pa.binary()))

    return run


def judged(pages: DataFrame, id_col: str, url_col: str, html_col: str, run_tokens: int, run_pages: int, covered: float, shard_pages: int, shard_chars: int) -> DataFrame:
    """page_id, url, packed and gone of every row: its blocks with their marks, and a byte for each, 1 if the host's array finds it repeated."""
    spark = pages.sparkSession
    limit_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host).withColumn("digest", F.expr("substring(unhex(sha2(coalesce(html, ''), 256)), 1, 16)"))
    named = materialize(rows.select("page_id", "url", "host", "digest", F.expr("length(html)").alias("chars")), "html-pages")
    shards = F.expr(f"greatest(ceil(count(*) / {shard_pages}), ceil(coalesce(sum(chars), 0) / {shard_chars}))")
    large = materialize(named.groupBy("host").agg(shards.alias("shards")).filter("shards > 1"), "html-hosts", 1 << 20)
    hosts = small_side(large, large.count(), 100)
    # Copies of a page combine before the shuffle, but for one of each partition; what is dealt are different pages.
    html = rows.select("page_id", "url", "host", "digest", "html")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, digest binary, "

    def dealt(streams: DataFrame) -> DataFrame:
        return streams.join(hosts, "host", "left").withColumn("shard", F.expr("pmod(xxhash64(digest), coalesce(shards, 1L))")).drop("shards")

    # Of hosts of several shards, a shard names run_pages pages of each run at most: enough to know whether the host has so many.
    outside = dealt(html.join(hosts, "host", "left_semi").select(html.columns).mapInArrow(trimmed(_streams(True)), f"{schema}same binary, packed binary"))
    found = outside.groupBy("host", "shard").applyInArrow(_counted(run_tokens, run_pages), "host string, shard long, run binary, same binary")
    found = materialize(found, "html-runs")
    many = found.select("host", "run", "same").distinct().groupBy("host", "run").count().filter(f"count >= {int(run_pages)}").select("host", "run")
    shared = found.select("host", "shard", "run").distinct().join(many, ["host", "run"]).select("host", "shard", "run")
    every = dealt(html.mapInArrow(trimmed(_streams()), f"{schema}same binary, packed binary")).groupBy("host", "shard")
    verdicts = every.cogroup(shared.groupBy("host", "shard")).applyInArrow(_judged(run_tokens, run_pages, covered), f"{schema}packed binary, gone binary")
    # A page without copies is its row's; rows of copies meet their page's verdict, in several tasks if they are very many.
    key = ["host", "digest"]
    counts = materialize(named.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1"), "html-copies")
    part = F.expr(f"pmod(xxhash64(page_id, url), copies div {COPIES} + 1)")
    copies = named.join(counts, key).select(*key, F.col("page_id").alias("of_id"), F.col("url").alias("of_url"), part.alias("part"), F.lit(True).alias("met"))
    copies = materialize(copies, "html-copy-rows")
    most = copies.agg(F.expr("coalesce(sum(120 + octet_length(host) + coalesce(octet_length(of_url), 0)), 0)")).first()[0]
    often = counts.filter(f"copies >= {COPIES}").select(*key, F.expr(f"copies div {COPIES} + 1 AS parts"))
    split = verdicts.join(small_side(often, often.count(), 150), key, "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1)")))
    out = split.join(small_side(copies, 1, most), [*key, "part"], "left").filter("met OR parts IS NULL")
    return out.selectExpr("CASE WHEN met THEN of_id ELSE page_id END AS page_id", "CASE WHEN met THEN of_url ELSE url END AS url", "packed", "gone")


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    run_tokens: int = RUN_TOKENS,
    run_pages: int = RUN_PAGES,
    covered: float = COVERED,
    shard_pages: int = SHARD_PAGES,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """page_id, url, text, n_chars of every row: blocks joined by one line feed, character references decoded.

    All blocks of all pages of a host go through its suffix array: what runs of run_tokens tokens (and shorter blocks)
    cover that run_pages pages of the host have outside their articles repeats. A repeated block goes, but for blocks that
    the page's article surely has; a unique one stays, but for those that the markup takes for no text. So the array
    decides blocks that a class name only hints at and, of pages that mark no article, those that no markup places. Pages
    of one host with the same text and doubtful blocks count as one, so copies of a page all keep their text. A
    host's pages are dealt to shards of about shard_pages pages and shard_chars characters; the shards' runs are counted
    together by hash, so the result is the same for any shards and any order of rows. Null and empty html give the
    empty text. Null urls are one host; repeated rows come back each. Other columns are not read; an empty table gives an
    empty table.
    """
    found = judged(pages, id_col, url_col, html_col, run_tokens, run_pages, covered, shard_pages, shard_chars)
    kind = found.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(trimmed(_texts), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def _tallied(parts):
    for part in parts:
        n = np.zeros((3, 2), np.int64)
        for page, gone in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            np.add.at(n, (np.array(unpacked(page)[1], int), np.frombuffer(gone, np.uint8).astype(int)), 1)
        at = [(m, g) for m in (KEPT, DOUBTFUL, OUT) for g in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int32()), pa.array([bool(a[1]) for a in at]), pa.array([int(n[a]) for a in at])], names=["mark", "repeated", "n"])


def block_counts(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """mark, repeated, n: blocks of all pages (page_id, url, html) by what the markup says of them and whether the host's
    array finds them repeated: what each of the two removes, and what the check gives back."""
    found = judged(pages, "page_id", "url", "html", RUN_TOKENS, RUN_PAGES, COVERED, shard_pages, SHARD_CHARS)
    return found.select("packed", "gone").mapInArrow(trimmed(_tallied), "mark int, repeated boolean, n long").groupBy("mark", "repeated").agg(F.sum("n").alias("n"))
