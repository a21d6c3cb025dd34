"""Scans: detection tables, label files, JSON lines, calibration rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import truncated
from ..schema import ANNOTATIONS, HOMOGRAPHY, IR, ZERODET


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet by suffix, else JSON, else CSV with a header."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.rstrip("/").endswith(".parquet"):
        return reader.parquet(path)
    if path.endswith((".json", ".jsonl")):
        return reader.json(path)
    return reader.option("header", True).csv(path)


def read_ir(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IR).parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return labelled(spark.read.schema(ANNOTATIONS).option("header", True).csv(path))


def labelled(rows: DataFrame) -> DataFrame:
    """Annotations whose label is a number; blank labels are left out."""
    return rows.withColumn("correct_team", F.expr("try_cast(trim(correct_team) AS INT)")).filter("correct_team IS NOT NULL")


def has_labels(rows: DataFrame) -> DataFrame:
    """One row: whether any label is not blank."""
    return rows.agg(F.coalesce(F.max(F.trim("correct_team") != ""), F.lit(False)).alias("has_labels"))


def read_zerodet(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).filter("trim(value) <> ''")
    return last_per_frame(lines.select("line_no", F.from_json("value", ZERODET).alias("r")).select("line_no", "r.*"), "line_no")


def last_per_frame(rows: DataFrame, order: str) -> DataFrame:
    """The last record of a frame wins; an aggregate, so no frame's records are gathered."""
    others = [c for c in rows.columns if c not in ("frame", order)]
    last = rows.groupBy("frame").agg(F.max_by(F.struct(*others), order).alias("r"))
    return last.select("frame", "r.*")


def label_tokens(lines: DataFrame) -> DataFrame:
    """Label lines (line) cut into a class and numbers."""
    tokens = "split(trim(line), '[ \\\\t]+')"
    return lines.selectExpr(
        "*", f"try_cast({tokens}[0] AS INT) AS cls", f"transform(slice({tokens}, 2, greatest(0, size({tokens}) - 1)), x -> try_cast(x AS DOUBLE)) AS v"
    )


def yolo_boxes(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Normalised centre boxes (five tokens) to pixel corners, cut to whole pixels and clipped to the image."""
    rows = label_tokens(lines).filter("size(v) = 4").selectExpr("*", "v[0] AS cx", "v[1] AS cy", "v[2] AS bw", "v[3] AS bh")

    def edge(value: str, most: int) -> str:
        return f"least({most}, greatest(0, {truncated(value)}))"

    return rows.selectExpr(
        *lines.columns,
        "cls",
        f"{edge(f'((cx - bw / 2) * {width})', width)} AS x1",
        f"{edge(f'((cy - bh / 2) * {height})', height)} AS y1",
        f"{edge(f'((cx + bw / 2) * {width})', width)} AS x2",
        f"{edge(f'((cy + bh / 2) * {height})', height)} AS y2",
    )


def polygon_boxes(lines: DataFrame, width: int, height: int) -> DataFrame:
    """Polygons (an even number of six or more coordinates) to their bounding boxes in pixels."""
    rows = label_tokens(lines).filter("size(v) >= 6 AND size(v) % 2 = 0")
    xs, ys = "filter(v, (x, i) -> i % 2 = 0)", "filter(v, (x, i) -> i % 2 = 1)"
    return rows.selectExpr(
        *lines.columns,
        "cls",
        f"array_min({xs}) * {width} AS x1",
        f"array_min({ys}) * {height} AS y1",
        f"array_max({xs}) * {width} AS x2",
        f"array_max({ys}) * {height} AS y2",
    )


def class_zero(lines: DataFrame) -> DataFrame:
    """Lines of class 0, counted for each stem; stems without any are left out."""
    return label_tokens(lines).filter("cls = 0").groupBy("stem").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def class_zero_lines(lines: DataFrame) -> DataFrame:
    """stem, line_no and line of every label line of class 0, rewritten as write_labels needs it: one space between tokens."""
    tokens = "split(trim(line), '[ \\\\t]+')"
    rows = label_tokens(lines).filter("cls = 0")
    return rows.selectExpr("stem", "line_no", f"array_join(concat(array('0'), slice({tokens}, 2, size({tokens}) - 1)), ' ') AS line")


def numbered(rows: DataFrame, key: str, order: str, name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def read_homography(spark: SparkSession, path: str) -> DataFrame:
    """H and the template's size, 1200 by 533 where the file has none."""
    rows = spark.read.schema(HOMOGRAPHY).option("multiLine", True).json(path)
    return rows.withColumns({"template_w": F.coalesce("template_w", F.lit(1200)), "template_h": F.coalesce("template_h", F.lit(533))})


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A calibration row as save_model writes it."""
    return spark.read.json(path)


def source_clip(rows: DataFrame, text: str = "value", out: str = "source") -> DataFrame:
    """rows with the clip's path from a side-car's JSON text; broken JSON or a missing path gives null."""
    return rows.withColumn(out, F.from_json(text, "source string", {"mode": "PERMISSIVE"})["source"])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of a report: its first row."""
    return read_any(spark, path).limit(1)


def images_of(rows: DataFrame) -> DataFrame:
    """Boxes (image, label, left, width, top, height) gathered for each image; an empty table raises ValueError."""
    if rows.isEmpty():
        raise ValueError("no annotations")
    return rows.groupBy("image").agg(F.count("*").alias("n"), F.collect_list(F.struct("label", "left", "top", "width", "height")).alias("boxes"))


def read_frames(spark: SparkSession, path: str, suffix: str = "png") -> DataFrame:
    """(clip_id, frame, content) of image files <clip>/<number>.<suffix>; first frames and single frames are filters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("clip_id"), F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).cast("long").alias("frame"), "content")


def split_folders(spark: SparkSession, path: str) -> DataFrame:
    """Folders under path that have files in both images/ and labels/; file contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    parts = files.select(F.regexp_extract("path", "([^/]+)/(images|labels)/[^/]+$", 1).alias("split"), F.regexp_extract("path", "/(images|labels)/[^/]+$", 1).alias("kind"))
    return parts.filter("kind <> ''").groupBy("split").agg(F.count_distinct("kind").alias("n")).filter("n = 2").select("split")


# Class names that a dataset of a task may have.
TASKS = {"seg": {"player"}, "helmet": {"helmet"}}


def dataset_checks(rows: DataFrame, text: str = "text", task: str = "task") -> DataFrame:
    """rows with `wrong`: check_dataset of each description, joined by a comma (empty: nothing), as expressions.

    Null texts lack both; an unknown or null task has no names that fit.
    """
    listed = F.regexp_extract(text, r"(?mds)^names:\s*[\[{](.*?)[\]}]", 1)
    block = F.regexp_extract(text, r"(?md)^names:\s*\n((?:[ \t-]+.*\n?)+)", 1)
    items = F.when(F.col(text).rlike(r"(?mds)^names:\s*[\[{].*?[\]}]"), F.split(listed, ",")).otherwise(F.split(block, r"\n"))
    names = F.transform(items, lambda n: F.lower(F.regexp_replace(F.regexp_replace(n, r"^\s*(-|\d+:)?\s*", ""), r"^[ '\"]+|[ '\"]+$", "")))
    fits = F.lit(False)
    for known, wanted in TASKS.items():
        fits = fits | (F.col(task).eqNullSafe(known) & F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(w) for w in sorted(wanted)])), F.lit(False)))
    one = F.coalesce(F.regexp_extract(text, r"(?md)^nc:\s*(\d+)\s*$", 1).try_cast("bigint") == 1, F.lit(False))
    return rows.withColumn("wrong", F.concat_ws(",", F.when(~one, "nc"), F.when(~fits, "names")))


def check_dataset(text: str, task: str) -> list[str]:
    """What is wrong with a dataset description (flat YAML: nc, names as a list or a map) for a task of one class."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    count = re.search(r"^nc:\s*(\d+)\s*$", text, re.M)
    inline = re.search(r"^names:\s*[\[{](.*?)[\]}]", text, re.M | re.S)
    block = re.search(r"^names:\s*\n((?:[ \t-]+.*\n?)+)", text, re.M)
    items = inline.group(1).split(",") if inline else block.group(1).splitlines() if block else []
    names = {re.sub(r"^\s*(-|\d+:)?\s*", "", n).strip(" '\"").lower() for n in items} - {""}
    wrong = [] if count and int(count.group(1)) == 1 else ["nc"]
    return wrong if names & TASKS[task] else [*wrong, "names"]
