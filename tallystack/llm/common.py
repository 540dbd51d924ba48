"""Helpers shared by the corpus operators: session set-up, table access,
written intermediate tables and connected components."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystack.session import ensure_checkpoint_dir, shared_dir, ship_package

#: separators of words (space, tab, newline, vertical tab, form feed, return)
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and settle the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # whole texts pass through Arrow batches: fewer rows each, less memory per Python worker
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ARROW_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, ARROW_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, name + ".parquet"))


def two_columns(df: DataFrame, id_col: str, text_col: str, kind: str = "long") -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text`` (null text becomes
    empty): other columns, whatever their names, never clash. Ids that pass
    through pandas go as strings (``kind``): a null among longs would turn
    them into doubles, which hold no id above 2**53."""
    return df.select(F.col(id_col).cast("long").cast(kind).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BITS = 28                                    # the bitmaps have at most 2**BITS bits
_CELL = 12                                   # words of 64 bits that reach the driver as one row: 2**_CELL


def bitmap(keys: DataFrame, rows: int):
    """Bitmap of the column ``key`` (long): eight bits a row up to 2**BITS bits
    (32 MB). It reaches the driver in packed rows, a partition at a time."""
    bits = min(max(rows * 8, 64).bit_length(), BITS)
    bit = keys.select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = (bit.groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("x"))
             .withColumn("cell", F.shiftright("at", _CELL)))
    size = 1 << max(min(bits - 6, _CELL), 0)

    def packed(pdf):
        x = np.zeros(size, np.int64)
        x[pdf["at"].to_numpy() % size] = pdf["x"].to_numpy()
        return pd.DataFrame([{"cell": int(pdf["cell"].iloc[0]), "x": x.tobytes()}])
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.groupBy("cell").applyInPandas(packed, "cell long, x binary").toLocalIterator():
        out[r["cell"] * size:(r["cell"] + 1) * size] = np.frombuffer(r["x"], np.uint64)
    return out


def maybe(bits, keys):
    """False where ``keys`` are certainly not in the bitmap."""
    b = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def held_bitmap(keys: DataFrame):
    """The bitmap of the column ``key`` as all tasks hold it."""
    return keys.sparkSession.sparkContext.broadcast(bitmap(keys, keys.count()))


def perhaps_in(held):
    """Column function: whether a long may be among the keys of a ``held_bitmap``
    (false: certainly not)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def among(key: pd.Series) -> pd.Series:
        return pd.Series(maybe(held.value, key.to_numpy().view(np.uint64)))
    return among


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (columns ``a``, ``b``,
    any comparable type): alternating large-star / small-star contraction
    (Kiveris et al., 2014), whose rounds grow with the logarithm of the path
    length. Returns (node, component). Links stay distributed; every round is
    a written table, and groups are only aggregated (min), never collected.

    Self links count as nodes; null ends are ignored."""
    spark = edges.sparkSession
    e = (edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = written(e, "cc")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = e.where(F.col("a") != F.col("b"))
    state = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # small star: smaller neighbours and u itself point to the least smaller neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.a", "x.b").where("a <> b").distinct())
        links = written(small, "cc")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = links.groupBy("a").agg(F.min("b").alias("r")).withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("r", "node").alias("component"))
