"""Scans and sinks: CSV round trips through the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.operators import clean, relate
from tallystack.plans.registry import query
from tallystack.plans.tables import T
from tallystack.session import shared_dir
from tallystack.sources.io import read_table, with_file_position, write_table

NATION_CSV_SCHEMA = "idx long, n_nationkey int, n_name string, n_regionkey int"
CUSTOMER_CSV_SCHEMA = ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                       "c_mktsegment string")


@query("scan_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv(spark, sf):
    """nation exported as CSV with a leading index column, read back with an
    explicit schema, index dropped by name."""
    path = shared_dir(spark, "scan_csv")
    nat = T(spark, sf, "nation")
    write_table(nat.select((F.col("n_nationkey") + 1).cast("long").alias("idx"), "*"), path, "csv")
    back = read_table(spark, path, NATION_CSV_SCHEMA, "csv")
    return clean.drop_index_col(back, "idx")


@query("drop_index_col", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def drop_index_col(spark, sf):
    """Same export; the index column is dropped by position (the first)."""
    path = shared_dir(spark, "drop_index_col")
    nat = T(spark, sf, "nation")
    write_table(nat.select((F.col("n_nationkey") + 1).cast("long").alias("idx"), "*"), path, "csv")
    return clean.drop_index_col(read_table(spark, path, NATION_CSV_SCHEMA, "csv"), 0)


@query("sink_csv", """SELECT row_number() OVER (ORDER BY c_custkey) AS row_index, c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer""")
def sink_csv(spark, sf):
    """customer (with missing balances) written as CSV with a leading row
    index (missing -> NA) and read back: the round trip keeps values, missing
    cells and the 1..n index."""
    path = shared_dir(spark, "sink_csv")
    c = T(spark, sf, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
    write_table(c, path, "csv", index_by="c_custkey")
    return read_table(spark, path, "row_index long, " + CUSTOMER_CSV_SCHEMA, "csv")


@query("bind_cols", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM customer""")
def bind_cols(spark, sf):
    """customer exported twice in key order, once with the key and once, in
    another number of files, without it; the key is bound back by position."""
    c = T(spark, sf, "customer").withColumn(
        "c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
    parts = []
    for files, schema in ((5, "c_custkey long, c_name string"), (3, "c_acctbal double, c_mktsegment string")):
        path = shared_dir(spark, "bind_cols")
        write_table(c.repartitionByRange(files, "c_custkey").sortWithinPartitions("c_custkey")
                    .select(*[x.split()[0] for x in schema.split(", ")]), path, "csv")
        parts.append(with_file_position(read_table(spark, path, schema, "csv")))
    return relate.bind_cols(*parts).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
