import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of operators."""
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, base, "n", 1), (2, base + " x", "n", 2), (3, None, None, None), (4, "", "n", 4), (5, "  \n\t", "n", 5), (6, "ab", "n", 6),
        (6, "ab", "n", 6), (7, "ab\n\nab\r\n ab ", "n", 7), (None, "ab", "n", 8), (9, "é日本 " * 9000, "n", 9), (10, base.upper(), "n", 10),
        (11, "▁▁ a  b ▁c\x00d", "n", 11),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_lines long").withColumnRenamed("n_lines", "score")
