"""WARC archives: writing with segmentation and chunked framing, reading with segment reassembly.

A record whose block is longer than a segment is written as a first segment and continuation records; the reader
groups segments by the origin's record id, orders them by segment number, verifies the total length and decodes
the chunked transfer framing of the HTTP message. Archives are gzip files of one member per record, rolled by
size, in the shared folder; a manifest that Spark commits lists those of the tasks that ended well, so files that
a lost executor or a repeated task left behind are never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, materialize, new_path, small_side

#: Bytes of a record block in one segment; of an HTTP chunk; of an archive before the next one begins.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 4 << 10, 1 << 10, 32 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message body; chunk extensions and trailers are skipped. ValueError if it breaks off."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line breaks off")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk breaks off")
        out.append(part)
        at = end + 4 + size


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def record_id(page_id, number: str = "") -> str:
    """Of a page's record. number tells rows apart that repeat an id; a revisit of such an id names the first form."""
    return f"<urn:trackweave:page:{'' if page_id is None else page_id}{':' if number else ''}{number}>"


def page_records(page_id, url, payload: bytes, refers_to, number: str, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it takes."""
    origin = record_id(page_id, number=number)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20") or "urn:trackweave:none"
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": origin,
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": "sha1:" + hashlib.sha1(payload).hexdigest(),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to)}
        return [record(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record(headers, block)]
    out = [record(headers | {"WARC-Segment-Number": "1"}, block[:segment])]
    for i, at in enumerate(range(segment, len(block), segment), 2):
        more = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"{origin[:-1]}/{i}>",
            "WARC-Date": headers["WARC-Date"],
            "WARC-Target-URI": target,
            "WARC-Segment-Origin-ID": origin,
            "WARC-Segment-Number": str(i),
        }
        if at + segment >= len(block):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record(more, block[at : at + segment]))
    return out


def _open_write(folder: str, name: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system.open_output_stream(f"{path}/{name}", compression=None)


def _write(folder: str, segment: int, archive: int):
    def run(parts):
        part_id, run_id, n, names, sizes, counts, out = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, [], [], [], None
        for part in parts:
            ids, urls, texts, refers, repeated = (part.column(i).to_pylist() for i in range(5))
            for page_id, url, html, refers_to, again in zip(ids, urls, texts, refers, repeated):
                if out is None:
                    names.append(f"part-{part_id:05d}-{run_id}-{len(names):05d}.warc.gz")
                    out, size, count = _open_write(folder, names[-1]), 0, 0
                for rec in page_records(page_id, url, (html or "").encode(), refers_to, f"{part_id}-{run_id}-{n}" if again else "", segment):
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = member.compress(rec) + member.flush()
                    out.write(data)
                    size += len(data)
                    count += 1
                n += 1
                if size >= archive:
                    out.close()
                    out = None
                    sizes.append(size)
                    counts.append(count)
        if out is not None:
            out.close()
            sizes.append(size)
            counts.append(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["path", "bytes", "records"],
        )

    return run


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    segment: int = SEGMENT_BYTES,
    archive: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per page and returns the manifest (path, bytes, records) of the archives.

    Of pages with equal payloads of at least 1000 bytes the one with the largest id is a response, the others are
    revisits of it; rows that repeat that id are responses too, and a null id revisits any id (a class without ids
    is all responses). A record's id is that of its page, which revisits refer to; where rows repeat an id, each
    record's id has more than that. A null html is an empty payload. Other columns are not read, whatever their names.
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    limit_batches(spark, 64)
    folder = folder or new_path(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("digest", F.when(F.col("size") >= REVISIT_BYTES, F.sha2(F.col("html").cast("binary"), 256)))
    copies = rows.filter("digest IS NOT NULL").groupBy("size", "digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    copies = copies.filter("n > 1 AND last IS NOT NULL").select(F.col("size").alias("s"), F.col("digest").alias("d"), "last")
    copies = materialize(copies, "warc-copies")
    # Ids that several rows have (or none): their records need more than the id for a name.
    again = rows.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1 OR page_id IS NULL").select(F.col("page_id").alias("p"))
    again = materialize(again, "warc-again").withColumn("again", F.lit(True))
    joined = rows.join(small_side(copies, copies.count(), 80), F.expr("digest = d AND size = s"), "left")
    joined = joined.join(small_side(again, again.count(), 16), F.expr("page_id <=> p"), "left")
    refers = F.when(~F.expr("page_id <=> last"), F.col("last"))
    out = joined.select("page_id", "url", "html", refers.alias("refers_to"), F.coalesce("again", F.lit(False)).alias("again"))
    return materialize(out.mapInArrow(_write(folder, segment, archive), "path string, bytes long, records long"), "warc-manifest")


def parse_records(stream):
    """(headers, block) of each record of a file-like stream of gzip members; headers have lower-case names."""
    buffer, inflate, ended = bytearray(), zlib.decompressobj(31), False

    def more() -> bool:
        nonlocal inflate, ended
        while not ended:
            data = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            data = data or stream.read(1 << 20)
            if not data:
                ended = True
                return False
            got = inflate.decompress(data)
            if got:
                buffer.extend(got)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("archive breaks off in a header")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(buffer) < end + 8 + size:
            if not more():
                raise ValueError("archive breaks off in a block")
        yield headers, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and decoded payload of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding") == "chunked" else body


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, declared string"
_SEGMENT = "origin string, segment int, total long, block binary"


def _described(headers: dict[str, str], payload: bytes | None, http: dict[str, str], keep: bool) -> dict:
    page, refers = headers.get("x-page-id", ""), headers.get("warc-refers-to", "")
    revisit = headers["warc-type"] == "revisit"
    return {
        "page_id": int(page) if page else None,
        "url": headers.get("warc-target-uri"),
        "record_type": headers["warc-type"],
        "refers_to": int(refers.rstrip(">").rpartition(":")[2]) if refers else None,
        "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload_digest": headers["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha1(payload).hexdigest(),
        "declared": headers.get("warc-payload-digest", "").partition(":")[2],
        "payload": payload if keep and not revisit else None,
    }


def _schema(keep: bool, segments: bool) -> str:
    return _FIELDS + ", payload binary" + (", " + _SEGMENT if segments else "")


def _read(keep: bool):
    kinds = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("declared", pa.string()), ("payload", pa.binary()), ("origin", pa.string()), ("segment", pa.int32()),
         ("total", pa.int64()), ("block", pa.binary())]
    )

    def run(parts):
        from pyarrow import fs

        empty = dict.fromkeys(kinds.names)
        for part in parts:
            for path in part.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_stream(inner, compression=None) as stream:
                    for headers, block in parse_records(stream):
                        if "warc-segment-number" in headers:
                            row = {
                                "origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]),
                                "segment": int(headers["warc-segment-number"]),
                                "total": int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None,
                                "block": block,
                            }
                            if headers["warc-type"] != "continuation":
                                row |= {k: v for k, v in _described(headers, b"", {"content-length": "0"}, False).items() if k != "payload"}
                            held += len(block)
                        else:
                            http, payload = payload_of(block)
                            row = _described(headers, payload, http, keep)
                            held += len(payload) if keep else 64
                        rows.append(empty | row)
                        if len(rows) >= 4096 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def _reassemble(keep: bool):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "declared", "payload"]

    def run(parts):
        for part in parts:
            rows = []
            for row in part.to_pylist():
                segments = sorted(row["segments"], key=lambda s: s["segment"])
                block = b"".join(s["block"] for s in segments)
                total = next((s["total"] for s in segments if s["total"] is not None), None)
                if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or total != len(block):
                    raise ValueError(f"segments of {row['origin']} are not whole: {len(block)} of {total} bytes")
                payload = payload_of(block)[1]
                digest = hashlib.sha1(payload).hexdigest()
                rows.append(
                    {k: row[k] for k in ("page_id", "url", "record_type", "refers_to", "declared")}
                    | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if keep else None}
                )
            kinds = pa.schema(
                [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                 ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared", pa.string()), ("payload", pa.binary())]
            )
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], kinds)

    return run


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per page record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Fails if an archive breaks off, if segments are missing or their length isn't the total that the last one
    declares, or if a payload doesn't have the digest in its header. payload is null for revisits, and for all
    records with payloads=False. A record is held in one task whole; archives are read by as many tasks as there
    are archives.
    """
    limit_batches(spark, 64)
    files = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    read = materialize(files.mapInArrow(_read(payloads), _schema(payloads, True)), "warc-read")
    whole = read.filter("segment IS NULL").drop("origin", "segment", "total", "block")
    first = ["page_id", "url", "record_type", "refers_to", "declared"]
    grouped = (
        read.filter("segment IS NOT NULL")
        .groupBy("origin")
        .agg(*[F.max(c).alias(c) for c in first], F.collect_list(F.struct("segment", "total", "block")).alias("segments"))
    )
    joined = grouped.mapInArrow(_reassemble(payloads), _schema(payloads, False))
    out = whole.unionByName(joined)
    sound = F.when(F.col("payload_digest") == F.col("declared"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest differs: "), F.col("url"))).cast("string")
    )
    return out.select("page_id", "url", "record_type", "refers_to", "payload_bytes", sound.alias("payload_digest"), "payload")
