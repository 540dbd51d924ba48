"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination,
personal data, packing. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes it as Parquet below the shared checkpoint folder and
rereads it for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystack.llm.common import prepare, read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    from tallystack.llm.quality import quality_rules
    return quality_rules(docs).where("quality.kept").select(docs.columns)


def _few(ids: DataFrame, max_broadcast: int = 2_000_000) -> bool:
    return ids.limit(max_broadcast + 1).count() <= max_broadcast


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id; ``ids`` is broadcast up to a checked size."""
    return docs.join(F.broadcast(ids) if _few(ids) else ids, "doc_id", how).select(docs.columns)


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """Anti join on _row, likewise."""
    return keyed.join(F.broadcast(rows) if _few(rows) else rows, "_row", "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity 0.8 or more): the one with the least id. Rows are judged by id
    and text; of rows that repeat both, one stays. Rows without an id stay."""
    from tallystack.llm.minhash import near_duplicates as operator
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text", F.col("text").isNull()))
    row = written(docs.select(key.alias("_row"), "doc_id").where("_row IS NOT NULL")
                  .groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "rows")
    found = written(operator(docs.select(key.alias("doc_id"), "text").where("doc_id IS NOT NULL"), k=5, percent=80)
                    .select(F.col("doc_id").alias("_row"), "component_id").distinct(), "groups")
    first = (found.join(row, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("x"))
             .select(F.col("x._row").alias("_row")))
    gone = written(found.join(first, "_row", "left_anti").select("_row"), "gone")
    again = written(row.where("n > 1").select("_row").join(gone, "_row", "left_anti"), "again")
    keyed = docs.withColumn("_row", key)
    once = _without(keyed, gone.unionByName(again)).select(docs.columns)
    few = _few(again)
    whole = F.struct(*docs.columns)
    one = (keyed.join(F.broadcast(again) if few else again, "_row", "left_semi").groupBy("_row")
           .agg(F.min_by(whole, F.to_json(whole)).alias("x")).select("x.*"))
    return once.unionByName(one.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from tallystack.llm.decontaminate import containment_search
    found = containment_search(docs, read_table(spark, sf_dir, "benchmark"))
    return _only(docs, written(found.select("doc_id").distinct(), "leaks"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    from tallystack.llm.pii import personal_data as operator
    return operator(docs, redact=True).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the training sequences."""
    from tallystack.llm.packing import pack
    return pack(docs)


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_duplicates),
          ("benchmark_decontamination", decontaminate), ("pii", personal_data), ("best_fit_packing", packing)]

#: the near-duplicate, boosted-tree and tokenizer stages have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
