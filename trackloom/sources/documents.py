"""JSON and CSV at the edges: lines that may be damaged come in, files that others read go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON objects of the lines at ``path``, with ``bad`` for a line that is none: cut off, empty or of another kind."""
    doc = F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return spark.read.text(path).select(doc.alias("d")).select("d.*").withColumn("bad", F.col("bad").isNotNull())


def write_lines(df: DataFrame, text: Column, path: str) -> str:
    """One line a row. Line breaks inside JSON are escapes, so a document never spans lines."""
    df.select(text.alias("value")).write.text(path)
    return path


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header; quotes doubled, line breaks kept inside quotes."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("lineSep", "\n").csv(path)
