"""Scans and sinks with explicit schemas (never schema inference).

CSV follows the reference's reader: a header line, empty text and ``NA``
read as missing, the text ``NULL`` kept as text (it is turned into a missing
value by ``clean.null_text_to_null`` where the reference does so).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str = "csv", null_value: str = "NA") -> DataFrame:
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV needs an explicit schema")
        return (spark.read.schema(schema).option("header", True)
                .option("nullValue", null_value).option("emptyValue", None)
                .option("mode", "PERMISSIVE").csv(path))
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.format(fmt).load(path)


def with_row_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """Leading 1..n row index in ``order`` (a numeric column that makes the
    order total), from the two-phase global rank (no one-partition window)."""
    from tallystack.operators.ordered import ordered_prefix
    r = ordered_prefix(df, order, order, descending=False, rank_col=name, total_col=None)
    return r.select(name, *df.columns)


def with_file_position(df: DataFrame, name: str = "position") -> DataFrame:
    """``df``, a scan straight from files (before any filter, join or
    shuffle), with the 1..n position of each row: files in order of their path,
    rows in their order inside the file.

    A row's place inside its split is its distance from the split's first row;
    the splits' row counts form a table of one row per split, whose prefix sums
    in the order of (path, start of the split) give the offsets. Only that
    table is ordered, the rows are neither sorted nor shuffled beyond the join
    on the split. The result does not depend on how splits are packed into
    tasks. An empty scan stays empty; a column called ``name`` is replaced.
    Splits without rows need no rule."""
    keep = [c for c in df.columns if c.lower() != name.lower()]
    at = df.select(*keep, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                   F.monotonically_increasing_id().alias("__row"))
    splits = at.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)     # one row per split
    splits = splits.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return (at.join(splits, ["__file", "__start"])
              .select(*keep, (F.col("__offset") + F.col("__row") - F.col("__first") + 1).alias(name)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by=None, null_value: str = "NA", index_by: str | None = None,
                index_name: str = "row_index") -> None:
    """Write ``df``. With ``index_by`` a leading 1..n index column ordered by
    that column is written first (as a CSV export with row numbers has)."""
    if index_by:
        df = with_row_index(df, index_by, index_name)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("nullValue", null_value).csv(path)
    else:
        w.format(fmt).save(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
