"""Sinks: tables, CSV reports, label files, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ir(df: DataFrame, path: str, source: str = "", mask_store: str = "") -> None:
    """Detection table by clip, and beside it {path}.meta.json: a row a clip with source, rows, frames, out_parquet, mask_store."""
    df.write.mode("overwrite").partitionBy("clip_id").parquet(path)
    meta = df.groupBy("clip_id").agg(F.count("*").alias("rows"), F.count_distinct("frame").alias("frames"))
    write_json(meta.withColumns({"source": F.lit(source), "out_parquet": F.lit(path), "mask_store": F.lit(mask_store)}), path + ".meta.json")


def csv_ready(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, which CSV can hold."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).option("header", True).csv(path)


def append_report(df: DataFrame, path: str) -> None:
    """Adds rows to an evaluation log. Only the first call writes a header, so the log's files read one after the other are one CSV."""
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    begun = folder.getFileSystem(hadoop).exists(folder)
    # Reports have a row or a few: one file an append.
    csv_ready(df).coalesce(1).write.mode("append").option("header", not begun).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log of append_report: lines but for the header, whichever file has it."""
    names = [f.split()[0] for f in schema.split(",")]
    lines = spark.read.text(path).filter(F.col("value") != ",".join(names))
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def commit_report(df: DataFrame, path: str, epoch: int | str) -> None:
    """The rows of one epoch of a log, in a folder of their own that a repeat replaces, so doing an epoch twice adds nothing.

    Writers of different epochs don't meet. The header is one file of its own, the same whoever writes it: header.csv and
    then the files of the epochs, read one after the other, are one CSV. An empty epoch adds no rows.
    """
    jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    head = jvm.org.apache.hadoop.fs.Path(path, "header.csv")
    out = head.getFileSystem(hadoop).create(head, True)
    try:
        out.write(bytearray((",".join(df.columns) + "\n").encode()))
    finally:
        out.close()
    csv_ready(df).coalesce(1).write.mode("overwrite").csv(f"{path}/rows/epoch={epoch}")


def read_commits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log of commit_report, each with its epoch (text)."""
    return spark.read.schema(f"{schema}, epoch string").csv(f"{path}/rows")


def stream_report(df: DataFrame, path: str, checkpoint: str):
    """Adds each micro-batch of a streaming DataFrame to a log as the epoch of its number, so one replayed after a failure adds nothing; returns the writer, to be started."""
    return df.writeStream.foreachBatch(lambda rows, number: commit_report(rows, path, number)).option("checkpointLocation", checkpoint)


def markdown(df: DataFrame) -> DataFrame:
    """A table as lines of Markdown text (position, value); rows are numbered by their columns in order."""
    rule = [(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "-|" * len(df.columns))]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    body = df.select((F.row_number().over(Window.orderBy(*[F.col(f"`{c}`") for c in df.columns])) + 1).alias("position"), cells.alias("value"))
    return df.sparkSession.createDataFrame(rule, "position int, value string").union(body)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old rows whose key has no new one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_labels(df: DataFrame, path: str) -> None:
    """Label lines (split, stem, line) as text, a folder per split and stem."""
    df.select("split", "stem", F.col("line").alias("value")).write.mode("overwrite").partitionBy("split", "stem").text(path)


def save_model(spark: SparkSession, row: dict, path: str) -> None:
    """A calibration as one JSON row; never a pickle."""
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """Appends a streaming DataFrame to files of a format (json, csv, parquet); returns the running query."""
    rows = csv_ready(df) if fmt == "csv" else df
    return rows.writeStream.format(fmt).option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def dataset_text(train: str, val: str, names: list[str]) -> str:
    """A dataset description as flat YAML."""
    listed = ", ".join(f"'{n}'" for n in names)
    return f"train: {train}\nval: {val}\nnc: {len(names)}\nnames: [{listed}]\n"
