"""Out-of-order session closing over a log of mini-sessions, as a Structured Streaming query.

A batch's clicks are first combined into mini-sessions, one for each client and half hour (`cell`): clicks of a cell are
within the gap by definition, so combining them loses nothing, and a client has 48 mini-sessions a day at most however
many clicks it has. The batch appends them as a sorted run, tagged with the batch. Runs of a level are compacted into one
of the next by a merge that keeps the tags. When the timer of a run is due (some mini-session in it ends more than the
gap before the watermark) all runs are merged by client and cell: sessions that can't grow any more are closed, and what
is left becomes one run. Tags tell when each mini-session came, so the merge replays which batch joined which sessions.

The state is a manifest for each batch, written last; it names the runs, so a batch that is repeated after a failure
starts from the manifest of the batch before it and writes the same rows again.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, materialize, new_path, remove, trimmed

GAP_US, LATENESS_US, HOUR_US = 30 * 60 * 1_000_000, 48 * 3600 * 1_000_000, 3600 * 1_000_000
#: Runs of a level that are merged into one of the next.
FANOUT = 4
STATE = "client_id long, cell long, tag long, lo long, hi long, first long, n long, crc long, merges long"
_NAMES = [c.split()[0] for c in STATE.split(", ")]
_NEVER = np.iinfo(np.int64).max
SESSIONS = "client_id long, first_us long, last_us long, n_clicks long, ids_crc32 long, n_merges long, close_batch long"


def micros(ts: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    second = f"CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"
    return F.expr(f"datediff(to_date({ts}), DATE'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + {second}")


def whole_hours(us: str) -> str:
    return f"(({us} - pmod({us}, {HOUR_US}L)) div {HOUR_US}L)"


def click_batches(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """client_id, ts_us, click_id, batch: each click once, in the batch of its hour of arrival.

    Rows without click_id, client_id or ts are left out; of rows that repeat a click_id the first by arrival, ts and
    client stays (without arrival last); a click without arrival is in the last batch. The hours of arrival are dealt
    evenly over the batches; a click whose client and hour have a crc32 divisible by 5 comes one batch later.
    """
    named = clicks.select("click_id", "client_id", micros("ts").alias("ts_us"), micros("arrived_at").alias("at")).dropna(subset=["click_id", "client_id", "ts_us"])
    once = named.groupBy("click_id").agg(F.min(F.struct(F.col("at").isNull().alias("lost"), "at", "ts_us", "client_id")).alias("r"))
    rows = once.select(F.col("click_id").cast("long"), F.col("r.client_id").cast("long").alias("client_id"), "r.ts_us", F.expr(whole_hours("r.at")).alias("h"))
    span = F.broadcast(named.filter("at IS NOT NULL").agg(F.expr(f"min({whole_hours('at')})").alias("lo"), F.expr(f"max({whole_hours('at')})").alias("hi")))  # one row
    dealt = rows.crossJoin(span).withColumn("batch", F.coalesce(F.expr(f"({batches}L * (h - lo)) div (hi - lo + 1)"), F.lit(batches - 1)))
    late = (F.crc32(F.concat_ws(":", "client_id", F.expr(whole_hours("ts_us")))) % 5 == 0) & (F.col("batch") < batches - 1)
    return dealt.select("client_id", "ts_us", "click_id", (F.col("batch") + F.when(late, 1).otherwise(0)).cast("long").alias("batch"))


def mini_sessions(clicks: DataFrame, tag: int, gap: int = GAP_US) -> DataFrame:
    """A row for each client and cell of clicks (client_id, ts_us, click_id)."""
    cells = clicks.withColumn("cell", F.expr(f"(ts_us - pmod(ts_us, {gap}L)) div {gap}L"))
    each = cells.groupBy("client_id", "cell").agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.count("*").alias("n"), F.sum(F.crc32(F.col("click_id").cast("string"))).alias("crc")
    )
    return each.select("client_id", "cell", F.lit(tag).cast("long").alias("tag"), "lo", "hi", F.col("lo").alias("first"), "n", "crc", F.lit(0).cast("long").alias("merges"))


def _joined_at(tag, lo, hi, cells, near, gap):
    """For each cell the first tag at which it is within the gap of the cell before it (near: there is one), or _NEVER."""
    out = np.full(len(cells) - 1, _NEVER, np.int64)
    for t in np.unique(tag):
        there = tag <= t
        first = np.minimum.reduceat(np.where(there, lo, _NEVER), cells[:-1])
        last = np.maximum.reduceat(np.where(there, hi, -1 - _NEVER), cells[:-1])
        met = np.zeros(len(out), bool)
        met[1:] = near[1:] & (first[1:] != _NEVER) & (last[:-1] != -1 - _NEVER)
        met[1:] &= np.where(met[1:], first[1:], 0) - np.where(met[1:], last[:-1], 0) <= gap
        out[met & (out == _NEVER)] = t
    return out


def replay(rows: dict[str, np.ndarray], due: int, tag: int, gap: int = GAP_US) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Mini-sessions of whole clients, by client, cell and tag, to (closed sessions, mini-sessions that stay).

    Closed are the sessions that end before `due`. Of the others, the cells that end before it and the first other one
    become one mini-session; no later click can come before that one's cell, so the later cells suffice.

    A session had as many births (components of mini-sessions of one batch that touched no older one) as sessions
    that were opened for it, and each merge takes one away, so it has seen births - 1 merges. A birth is a run of
    neighbouring cells that came with batch t and were joined by t, with neighbours that were joined later or never.
    """
    client, cell, came = rows["client_id"], rows["cell"], rows["tag"]
    new = np.r_[True, (client[1:] != client[:-1]) | (cell[1:] != cell[:-1])]
    at = np.flatnonzero(new)
    cells = np.r_[at, len(client)]
    lo, hi = np.minimum.reduceat(rows["lo"], at), np.maximum.reduceat(rows["hi"], at)
    first, born = np.minimum.reduceat(rows["first"], at), np.minimum.reduceat(came, at)
    n, crc, merges = (np.add.reduceat(rows[k], at) for k in ("n", "crc", "merges"))
    client, cell = client[at], cell[at]
    near = np.r_[False, (client[1:] == client[:-1]) & (cell[1:] == cell[:-1] + 1)]
    joined = _joined_at(came, rows["lo"], rows["hi"], cells, near, gap)

    run = np.r_[True, (born[1:] != born[:-1]) | (joined[1:] != born[1:])]
    runs = np.flatnonzero(run)
    ends = np.r_[runs[1:], len(client)]
    after = np.r_[joined[1:], _NEVER]
    births = np.zeros(len(client), np.int64)
    births[runs] = (joined[runs] > born[runs]) & (after[ends - 1] > born[runs])

    start = np.flatnonzero(joined == _NEVER)
    number = np.cumsum(joined == _NEVER) - 1
    sums = {k: np.add.reduceat(v, start) for k, v in (("n", n), ("crc", crc), ("merges", merges), ("births", births))}
    begins, last = np.minimum.reduceat(first, start), np.maximum.reduceat(hi, start)
    merged = sums["merges"] + sums["births"] - 1
    over = last < due
    closed = {"client_id": client[start], "first": begins, "hi": last, "n": sums["n"], "crc": sums["crc"], "merges": merged}
    closed = {k: v[over] for k, v in closed.items()}

    live = ~over[number]
    old = live & (hi < due)
    head = np.full(len(start), len(client))
    keep = np.flatnonzero(live & ~old)
    np.minimum.at(head, number[keep], keep)
    for values in (n, crc):
        np.add.at(values, head[number[old]], values[old])
    first[live] = begins[number[live]]
    merges = np.zeros(len(client), np.int64)
    heads = head[~over]
    merges[heads] = merged[~over]
    stay = {"client_id": client, "cell": cell, "tag": np.full(len(client), tag), "lo": lo, "hi": hi, "first": first, "n": n, "crc": crc, "merges": merges}
    return closed, {k: v[keep] for k, v in stay.items()}


def _merge(due: int, tag: int, gap: int):
    """mapInArrow over mini-sessions by client, cell and tag: closed sessions and those that stay, with `closed`."""

    def out(rows: pa.Table):
        arrays = {k: rows.column(k).to_numpy() for k in _NAMES}
        closed, stay = replay(arrays, due, tag, gap)
        zeros = np.zeros(len(closed["client_id"]), np.int64)
        closed |= {"cell": zeros, "tag": zeros, "lo": closed["first"]}
        for part, flag in ((closed, True), (stay, False)):
            if len(part["client_id"]):
                yield pa.RecordBatch.from_arrays([*(pa.array(part[k]) for k in _NAMES), pa.array(np.full(len(part["client_id"]), flag))], names=[*_NAMES, "closed"])

    def run(parts):
        held = None
        for part in parts:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
            ids = rows.column("client_id").to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last client may go on in the next batch
            if whole:
                yield from out(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None:
            yield from out(held)

    return run


class SessionLog:
    """The state of a stream in a folder that driver and executors share: runs, closed sessions, a manifest a batch."""

    def __init__(self, spark: SparkSession, folder: str, gap: int = GAP_US, lateness: int = LATENESS_US, fanout: int = FANOUT):
        self.spark, self.folder, self.gap, self.lateness, self.fanout = spark, folder.rstrip("/"), gap, lateness, fanout
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self, before: int | None = None) -> dict:
        """That of the latest batch, or of the latest one before a batch; an empty one if there is none."""
        folder = self.path(f"{self.folder}/manifest")
        found = [int(f.getPath().getName()) for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        found = [k for k in found if before is None or k < before]
        if not found:
            return {"max_us": None, "batch": None, "runs": [], "spent": []}
        stream = self.fs.open(self.path(f"{self.folder}/manifest/{max(found)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, epoch: int, manifest: dict) -> None:
        """The manifest appears under its name when it is whole."""
        part = self.path(f"{self.folder}/part-{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        self.fs.mkdirs(self.path(f"{self.folder}/manifest"))
        name = self.path(f"{self.folder}/manifest/{epoch}")
        self.fs.delete(name, False)
        self.fs.rename(part, name)

    def _run(self, rows: DataFrame, level: int) -> dict | None:
        """Writes rows as a sorted run; its timer is the earliest end of its mini-sessions."""
        path = f"{self.folder}/runs/{uuid.uuid4().hex}"
        rows.sortWithinPartitions("client_id", "cell", "tag").write.parquet(path)
        return self._described(path, level)

    def _described(self, path: str, level: int) -> dict | None:
        ends = self._read([{"path": path}]).agg(F.min("hi")).first()[0]
        return None if ends is None else {"path": path, "level": level, "ends": ends}

    def _read(self, runs: list[dict]) -> DataFrame:
        """The rows of runs; the folder of a merge also holds closed sessions, apart."""
        return self.spark.read.schema(STATE).parquet(*[r["path"] for r in runs])

    def _merged(self, runs: list[dict], due: int, tag: int, out: str) -> None:
        """Merges runs by client and cell into `out`, closed sessions apart from those that stay."""
        limit_batches(self.spark, 65536)
        rows = self._read(runs).repartition("client_id").sortWithinPartitions("client_id", "cell", "tag")
        rows.mapInArrow(trimmed(_merge(due, tag, self.gap)), STATE + ", closed boolean").write.mode("overwrite").partitionBy("closed").parquet(out)

    def step(self, clicks: DataFrame, epoch: int) -> None:
        """One batch of clicks (client_id, ts_us, click_id, batch), for foreachBatch. Clicks before the watermark of the
        batches before are dropped; sessions that are over are closed as the batch that the rows name. A batch without
        rows leaves the state as it is. A repeated epoch gives the same state again."""
        before = self.manifest(epoch)
        for path in before["spent"]:
            remove(self.spark, path)
        latest, batch = clicks.agg(F.max("ts_us"), F.max("batch")).first()
        if latest is None:
            self._commit(epoch, before | {"spent": []})
            return
        rows = clicks if before["max_us"] is None else clicks.filter(F.col("ts_us") >= before["max_us"] - self.lateness)
        runs = [*before["runs"], self._run(mini_sessions(rows, epoch, self.gap), 0)]
        runs, spent = [r for r in runs if r], []
        high = latest if before["max_us"] is None else max(latest, before["max_us"])
        due = high - self.lateness - self.gap
        if any(r["ends"] < due for r in runs):
            out = f"{self.folder}/merged/epoch={epoch}"
            self._merged(runs, due, epoch, out)
            spent += [r["path"] for r in runs]
            stay = f"{out}/closed=false"
            left = self._described(stay, self._level(runs)) if self.fs.exists(self.path(stay)) else None
            runs = [left] if left else []
        else:
            while sum(r["level"] == (level := runs[-1]["level"]) for r in runs) >= self.fanout:
                full = [r for r in runs if r["level"] == level]
                joined = self._run(self._read(full).repartition("client_id"), level + 1)
                runs = [r for r in runs if r["level"] != level] + [joined]
                spent += [r["path"] for r in full]
        labels = {**before.get("labels", {}), str(epoch): batch}
        self._commit(epoch, {"max_us": high, "batch": batch, "runs": runs, "spent": spent, "labels": labels})

    @staticmethod
    def _level(runs: list[dict]) -> int:
        return max(r["level"] for r in runs)

    def sessions(self, last: int | None = None) -> DataFrame:
        """Closed sessions, and with `last` those still open, closed as that batch."""
        now = self.manifest()
        names = [c.split()[0] for c in SESSIONS.split(", ")]
        columns = ["client_id", F.col("first").alias("first_us"), F.col("hi").alias("last_us"), F.col("n").alias("n_clicks"), F.col("crc").alias("ids_crc32"), F.col("merges").alias("n_merges"), "close_batch"]
        out = self.spark.createDataFrame([], SESSIONS)
        closed = [(e, b) for e, b in now.get("labels", {}).items() if self.fs.exists(self.path(f"{self.folder}/merged/epoch={e}/closed=true"))]
        for epoch, batch in closed:
            rows = self.spark.read.schema(STATE).parquet(f"{self.folder}/merged/epoch={epoch}/closed=true")
            out = out.union(rows.withColumn("close_batch", F.lit(batch).cast("long")).select(*columns))
        if last is not None and now["runs"]:
            path = f"{self.folder}/flushed/{uuid.uuid4().hex}"
            self._merged(now["runs"], _NEVER, 0, path)
            rows = self.spark.read.schema(STATE).parquet(f"{path}/closed=true")
            out = out.union(rows.withColumn("close_batch", F.lit(last).cast("long")).select(*columns))
        return out.select(*names)


def close_sessions(clicks: DataFrame, batches: int = 10, gap: int = GAP_US, lateness: int = LATENESS_US, folder: str | None = None) -> DataFrame:
    """client_id, first_us, last_us, n_clicks, ids_crc32, n_merges, close_batch of every session of clicks.

    The clicks are cut into batches (see click_batches), which are written into the shared folder and fed in order to a
    Structured Streaming query that is started anew for each on one checkpoint. Sessions still open after the last close
    as `batches`. Times without a zone are UTC. Ties of ts are one moment of a session; other columns are ignored. An
    empty table, or one whose rows all lack an id, a client or a time, gives an empty table. Work goes by client and half hour, merges by
    client, which has a row for each half hour and batch that isn't closed yet, however many clicks it has.
    """
    spark = clicks.sparkSession
    folder = folder or new_path(spark, "sessions")
    log = SessionLog(spark, f"{folder}/state", gap, lateness)
    dealt = click_batches(clicks, batches).hint("rebalance", F.col("batch"))
    dealt.write.partitionBy("batch").parquet(f"{folder}/dealt")
    kind = "client_id long, ts_us long, click_id long, batch long"
    log.fs.mkdirs(log.path(f"{folder}/fed"))
    for b in range(batches):
        if not log.fs.exists(log.path(f"{folder}/dealt/batch={b}")):
            continue
        log.fs.rename(log.path(f"{folder}/dealt/batch={b}"), log.path(f"{folder}/fed/batch={b}"))
        stream = spark.readStream.schema(kind).parquet(f"{folder}/fed")
        query = stream.writeStream.foreachBatch(log.step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return log.sessions(batches)


def _crc(text: str) -> str:
    """DuckDB: the CRC-32 of a string of ASCII characters, from the table `tab`."""
    steps = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, s: xor(c >> 8, tab.t[(xor(c, s) & 255) + 1])), 4294967295)"


ORACLE = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0,0,0,0,0,0,0,0]::BIGINT[]),
               lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)) AS q),
r AS (SELECT * FROM (SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) // {HOUR_US} AS h,
        row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS LAST, ts, client_id) AS k
        FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL) AS q WHERE k = 1),
f AS (SELECT r.*, coalesce((10 * (h - lo)) // (hi - lo + 1), 9) AS f0 FROM r, (SELECT min(h) AS lo, max(h) AS hi FROM r) AS z),
a AS (SELECT click_id, client_id, us, {_crc("CAST(click_id AS VARCHAR)")} AS crc,
             CASE WHEN f0 < 9 AND {_crc(f"client_id || ':' || (us // {HOUR_US})")} % 5 = 0 THEN f0 + 1 ELSE f0 END AS b FROM f, tab),
w AS (SELECT t.b, max(us) - {LATENESS_US} AS w FROM range(10) AS t(b) JOIN a ON a.b <= t.b GROUP BY 1),
k AS (SELECT a.* FROM a LEFT JOIN w ON w.b = a.b - 1 WHERE w.w IS NULL OR us >= w.w),
c AS (SELECT t, click_id, client_id, sum(brk) OVER (PARTITION BY t, client_id ORDER BY us, click_id ROWS UNBOUNDED PRECEDING) AS comp FROM (
        SELECT t.t, k.*, CASE WHEN us - lag(us) OVER (PARTITION BY t.t, client_id ORDER BY us, click_id) <= {GAP_US} THEN 0 ELSE 1 END AS brk
        FROM k JOIN range(10) AS t(t) ON k.b <= t.t) AS q),
m AS (SELECT n.t, n.client_id, n.comp, any_value(n.click_id) AS click_id, count(DISTINCT o.comp) AS old
      FROM c AS n LEFT JOIN c AS o ON o.t = n.t - 1 AND o.click_id = n.click_id GROUP BY 1, 2, 3),
j AS (SELECT c.client_id, c.comp, sum(greatest(m.old - 1, 0)) AS n_merges FROM m JOIN c ON c.t = 9 AND c.click_id = m.click_id GROUP BY 1, 2),
s AS (SELECT c.client_id, c.comp, min(us) AS first_us, max(us) AS last_us, count(*) AS n_clicks, sum(crc) AS ids_crc32, max(b) AS b
      FROM c JOIN k ON c.click_id = k.click_id WHERE c.t = 9 GROUP BY 1, 2)
SELECT s.client_id, first_us, last_us, n_clicks, CAST(ids_crc32 AS BIGINT) AS ids_crc32, CAST(n_merges AS BIGINT) AS n_merges,
       coalesce((SELECT min(w.b) FROM w WHERE w.b >= s.b AND w.w > s.last_us + {GAP_US}), 10) AS close_batch
FROM s JOIN j ON s.client_id = j.client_id AND s.comp = j.comp
"""
