"""Benchmark decontamination by size-partitioned MinHash containment search,
in DataFrame functions only.

A short test item inside a long document has a tiny Jaccard similarity, so the
sketch is taken on the item's side only: items are partitioned by the size of
their shingle set (powers of two), and every item keeps the s shingles that
are least under one hash permutation (a bottom-s MinHash). A document holds at
least ``percent`` % of an item's n shingles only if it misses at most
n - need of them, so s = (what an item of its partition's largest size may
miss) + ``margin`` guarantees ``margin`` hits: candidates are complete, not
just probable. Candidates are then verified by exact containment on whole
shingle sets.

Document shingles are exploded and meet the index in one hash join; nothing is
grouped by shingle, and pair counts are aggregated partially before the
shuffle, so a shingle held by a third of all documents is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallystack.llm.common import SPACE_CLASS, prepare, two_columns, written


def shingle_sets(df: DataFrame, k: int, text: str = "text", out: str = "grams") -> DataFrame:
    """``df`` with the array of distinct hashes of its lower-cased k-word
    shingles in ``out`` (empty without words, one for fewer than k words)."""
    parts = ", ".join(f"w[i + {j}]" for j in range(k))
    # the words are a lambda variable: they are made once per text, whatever
    # the optimizer does with the column
    return df.withColumn(out, F.expr(
        f"transform(array(filter(split(lower({text}), '{SPACE_CLASS.replace(chr(92), chr(92) * 2)}+'), x -> x <> '')), w -> array_distinct("
        f"CASE WHEN size(w) >= {k} THEN transform(sequence(0, size(w) - {k}), i -> xxhash64({parts})) "
        f"WHEN size(w) > 0 THEN array(xxhash64(size(w), concat_ws(' ', w))) "
        f"ELSE CAST(array() AS array<bigint>) END))[0]"))


def containment_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80,
                       margin: int = 4, max_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_common): every pair in which the document
    holds at least ``percent`` % of the item's distinct ``k``-word shingles.

    Null or empty documents and items match nothing; items (documents) with
    fewer than k words have one shingle, their whole sequence. Items with equal sets are
    searched once and reported each; repeated rows of a document id count as
    one document; rows with a null document or item id are left out."""
    spark = docs.sparkSession
    prepare(spark)
    d = two_columns(docs, id_col, text_col).where("doc_id IS NOT NULL AND text <> ''")
    it = (items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
          .where("item_id IS NOT NULL AND text <> ''").distinct())
    sets = written(shingle_sets(it, k).withColumn("grams", F.sort_array("grams")).where(F.size("grams") > 0)
                   .select("item_id", "grams"), "items")
    # one class per distinct set; its smallest item id names it
    classes = written(sets.groupBy("grams").agg(F.min("item_id").alias("class")), "classes")
    may_miss = F.floor(F.col("top") * (100 - percent) / 100).cast("int")
    grams = (classes.select("class", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
             .withColumn("top", (F.lit(2) * F.pow(F.lit(2.0), F.floor(F.log2("n"))) - 1).cast("int")))
    grams = written(grams, "grams")
    least = Window.partitionBy("class").orderBy(F.xxhash64("gram", F.lit(7)), "gram")
    index = (grams.withColumn("place", F.row_number().over(least))
             .withColumn("s", F.least("n", may_miss + margin)).where("place <= s")
             # of the s sampled shingles at most n - need can be missing
             .withColumn("hits", F.greatest(F.lit(1), F.col("s") - F.floor(F.col("n") * (100 - percent) / 100).cast("int")))
             .select("gram", "class", "hits"))
    index = written(index, "index")

    def small(df):
        return F.broadcast(df) if df.limit(max_broadcast + 1).count() <= max_broadcast else df

    # explode_outer: no filter on the array is inferred, which would make it twice
    probes = shingle_sets(d, k).select("doc_id", F.explode_outer("grams").alias("gram"))
    cand = (probes.join(small(index), "gram").groupBy("doc_id", "class")
            .agg(F.count_distinct("gram").alias("found"), F.first("hits").alias("hits"))
            .where("found >= hits").select("doc_id", "class"))
    cand = written(cand, "candidates")
    ids = cand.select("doc_id").distinct()
    own = (shingle_sets(d.join(small(ids), "doc_id", "left_semi"), k)
           .select("doc_id", F.explode_outer("grams").alias("gram")).join(small(grams), "gram")
           .groupBy("doc_id", "class", "n").agg(F.count_distinct("gram").alias("n_common"))
           .where(F.col("n_common") * 100 >= F.col("n") * percent))
    own = own.join(cand, ["doc_id", "class"], "left_semi")
    names = sets.join(classes, "grams").select("class", "item_id")
    return (own.join(small(names), "class")
            .select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), "n_common"))
