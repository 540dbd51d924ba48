"""Near-duplicate documents by fast similarity sketching.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): ``T`` coordinates are filled in
rounds. In round i < T every shingle is thrown into a hashed bin with value
i + u, u in [0, 1); in round T + j every shingle goes to bin j. A coordinate
keeps its least value, and the rounds stop when every bin is filled, so all
coordinates are filled and the share of equal coordinates is concentrated
around the Jaccard similarity. Coordinates are banded; documents that agree in
a band are candidates, and candidates are confirmed on their full sets.

Copies (equal sets) collapse to one representative before banding. Inside a
band bucket no pair list is built: every member is compared with one hub of
the bucket (star), confirmed links contract into components, and only buckets
that still hold several components go on. In later rounds a block of hubs is
taken per bucket, members of small components first, until every bucket holds
one component or all of its members have been hubs: no link is lost, and a
bucket of thousands of near copies costs little more comparisons than
members. Before texts are fetched, four bits of every coordinate tell pairs
that are far from the limit (a pair at the limit fails this with probability
1e-7).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallystack.llm import arrays as A
from tallystack.llm.common import connected_components, prepare, two_columns, written

T, ROWS, BANDS = 512, 4, 32      # 32 bands of 4: a pair at similarity 0.8 is missed with probability 5e-8
SIGMAS = 5.2                     # four bits of each coordinate: a pair at the limit fails the pre-check at this distance
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sketch(g, d, n_docs: int, t: int = T):
    """(n_docs, t) array of coordinates for the sets given as (hash, document
    index) sorted by document; rows of empty sets hold the largest value."""
    out = np.full((n_docs, t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    base = d.astype(np.int64) * t
    active = np.arange(len(g))
    empty = np.iinfo(np.uint64).max
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(active):
                break
            x = A.mix(g[active] + np.uint64(i + 1) * _STEP)
            if i < t:
                cell = base[active] + (A.mix(x) % np.uint64(t)).astype(np.int64)
            else:
                cell = base[active] + (i - t)
            # values grow with the rounds: a cell that an earlier one filled keeps its value
            free = np.flatnonzero(flat[cell] == empty)
            np.minimum.at(flat, cell[free], (np.uint64(i) << np.uint64(48)) | (x[free] >> np.uint64(16)))
            if i < t and (i == 0 or i % 4 == 3) or i >= t:
                open_ = (out == empty).any(axis=1)
                active = active[open_[d[active]]]
    return out


def _sketches(k: int, t: int, rows: int, bands: int):
    def run(frames):
        for pdf in frames:
            raw = [x.encode("utf-8") for x in pdf["text"]]
            ids = pdf["doc_id"].to_numpy()
            for i, j in A.blocks(raw):
                h, doc, _s, _e = A.words(raw[i:j])
                g, d = A.shingles(h, doc, j - i, k)
                n = np.bincount(d, minlength=j - i)
                with np.errstate(over="ignore"):
                    p1 = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(g))])
                    p2 = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(g ^ np.uint64(0x5851F42D4C957F2D)))])
                    at = np.concatenate([[0], np.cumsum(n)])
                    f1, f2 = p1[at[1:]] - p1[at[:-1]], p2[at[1:]] - p2[at[:-1]]
                    sk = sketch(g, d, j - i, t)
                    four = (A.mix(sk) & np.uint64(15)).astype(np.uint8)
                    bits = (four[:, ::2] << 4 | four[:, 1::2]).view(np.int64)
                    sk = sk[:, :bands * rows].reshape(j - i, bands, rows)
                    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (j - i, bands)).copy()
                    for r in range(rows):
                        key = A.mix(key * np.uint64(0xFF51AFD7ED558CCD) + sk[:, :, r])
                yield pd.DataFrame({"doc_id": ids[i:j], "n_shingles": n.astype(np.int64),
                                    "f1": f1.view(np.int64), "f2": f2.view(np.int64),
                                    "bits": list(bits), "bands": list(key.view(np.int64))})
    return run


def _confirm(k: int, percent: int):
    """Keep the pairs whose full sets have 100 * common >= percent * union.
    The sets of a batch's distinct documents are made once."""
    def run(frames):
        for pdf in frames:
            a, b, ta, tb = (pdf[c].to_numpy() for c in ("a", "b", "ta", "tb"))
            raw_len = np.fromiter((len(x) + len(y) for x, y in zip(ta, tb)), np.int64, len(a))
            cut = np.searchsorted(np.cumsum(raw_len), np.arange(1, 2 + int(raw_len.sum()) // (4 << 20)) * (4 << 20))
            for i, j in zip([0, *cut], [*cut, len(a)]):
                if i >= j:
                    continue
                texts = dict(zip(a[i:j], ta[i:j])) | dict(zip(b[i:j], tb[i:j]))
                names, sets = list(texts), {}
                raw = [texts[x].encode("utf-8") for x in names]
                for p, q in A.blocks(raw):
                    h, doc, _s, _e = A.words(raw[p:q])
                    g, d = A.shingles(h, doc, q - p, k)
                    at = np.searchsorted(d, np.arange(q - p + 1))
                    for x in range(q - p):
                        sets[names[p + x]] = g[at[x]:at[x + 1]]
                keep = np.zeros(j - i, bool)
                for x in range(i, j):
                    s, u = sets[a[x]], sets[b[x]]
                    both = len(np.intersect1d(s, u, assume_unique=True))
                    keep[x - i] = 100 * both >= percent * (len(s) + len(u) - both)
                yield pd.DataFrame({"a": a[i:j], "b": b[i:j], "linked": keep})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80, t: int = T, rows: int = ROWS, bands: int = BANDS, hubs: int = 512,
                    max_broadcast: int = 2_000_000) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Words are maximal runs of non-space characters, A-Z lower-cased; a
    document's set holds its distinct ``k``-word shingles (the whole sequence
    when it has fewer words). Documents with 100 * |common| >= ``percent`` *
    |union| are linked; ``component_id`` is the least id reachable and
    ``kept`` marks the document that carries it.

    Null and wordless texts have an empty set and stand alone. ``id_col``
    identifies documents; repeated rows give repeated result rows. Rows with a
    null id stay, kept, with a null component. An empty table gives none.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = two_columns(docs, id_col, text_col)

    def small(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.limit(max_broadcast + 1).count() <= max_broadcast else ids

    made = written(two_columns(docs, id_col, text_col, "string").mapInPandas(
        _sketches(k, t, rows, bands), "doc_id string, n_shingles long, f1 long, f2 long, bits array<long>, bands array<long>")
        .withColumn("doc_id", F.col("doc_id").cast("long")), "sketch")
    same = ["n_shingles", "f1", "f2"]
    least = written(made.where("n_shingles > 0 and doc_id is not null")
                    .groupBy(*same).agg(F.min("doc_id").alias("rep")), "least")
    # one representative per set of equal documents carries the bands
    reps = written(made.join(least, same).where("doc_id = rep")
                   .select(F.col("rep").alias("id"), "n_shingles", "bits", "bands"), "reps")
    keys = reps.select("id", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = written(keys.join(full, "key").distinct(), "buckets")
    ids = written(members.select("id").distinct(), "ids")
    size = written(reps.join(small(ids), "id", "left_semi").dropDuplicates(["id"])
                   .select("id", "n_shingles", "bits", "bands"), "sizes")
    members = written(members.join(size, "id"), "members")
    text = written(d.join(small(ids), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"]), "texts")

    # equal groups of four bits: similarity + (1 - similarity) / 16 of them, give or take
    p = percent / 100 + (1 - percent / 100) / 16
    differ = int(t * (1 - p) + SIGMAS * (t * p * (1 - p)) ** 0.5)

    def plausible(a: str, b: str):
        apart = F.expr("aggregate(zip_with({0}.bits, {1}.bits, (p, q) -> p ^ q), 0, (n, x) -> n + bit_count("
                       "(x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441L))".format(a, b))
        sizes = [F.col(f"{x}.n_shingles") for x in (a, b)]
        return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (apart <= differ)

    def confirm(pairs: DataFrame) -> DataFrame:
        ta, tb = (text.join(small(pairs.select(F.col(x).alias("doc_id")).distinct()), "doc_id", "left_semi").toDF(x, f"t{x}")
                  for x in "ab")
        return (pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
                .mapInPandas(_confirm(k, percent), "a long, b long, linked boolean"))

    live = members.withColumn("comp", F.col("id")).withColumn("weight", F.lit(1).cast("long"))
    tested = comp = None
    turn = 0
    while True:
        if turn < 2:       # one hub per bucket: the least member, then another
            order = F.struct("id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)), "id")
            hub = live.groupBy("key").agg(F.min_by(F.struct("id", "n_shingles", "bits", "bands", "comp"), order).alias("h")).select("key", "h.*")
        else:              # blocks of hubs, members of small components first; limited before the shuffle
            w = Window.partitionBy("key").orderBy("weight", F.xxhash64("id", F.lit(turn)), "id")
            hub = (live.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= hubs)
                   .select("key", "id", "n_shingles", "bits", "bands", "comp"))
        hub = written(hub, "hubs")
        wanted = (F.col("x.comp") != F.col("h.comp")) & plausible("x", "h")
        if turn >= 2:      # a pair belongs to the bucket of the first band that it shares
            wanted &= F.expr("array_position(zip_with(x.bands, h.bands, (p, q) -> p = q), true) = array_position(x.bands, key)")
        pairs = (live.alias("x").join(hub.alias("h"), "key").where(wanted)
                 .select(F.greatest("x.id", "h.id").alias("a"), F.least("x.id", "h.id").alias("b")).distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        links = written(confirm(pairs).where("linked").select("a", "b"), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not links.isEmpty():
            if comp is None:
                comp = connected_components(links).toDF("id", "component")
            else:          # links between components of the turn before
                at = comp.select(F.col("id"), F.col("component"))
                for x in "ab":
                    links = (links.join(at.withColumnRenamed("id", x), x, "left")
                             .withColumn(f"c{x}", F.coalesce("component", x)).drop("component"))
                up = written(connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "up")
                old = comp.join(up.toDF("component", "new"), "component", "left")
                fresh = up.toDF("id", "component").join(comp, "id", "left_anti")
                comp = old.select("id", F.coalesce("new", "component").alias("component")).unionByName(fresh)
            comp = written(comp, "comp")
        # a hub has met the other components in its bucket; buckets of one component are settled
        rest = live.drop("comp", "weight")
        if turn >= 2:
            rest = rest.join(hub.select("key", "id"), ["key", "id"], "left_anti")
        if comp is None:
            rest = rest.withColumn("comp", F.col("id")).withColumn("weight", F.lit(1).cast("long"))
        else:
            sized = comp.join(comp.groupBy("component").agg(F.count(F.lit(1)).alias("w")), "component")
            rest = (rest.join(sized, "id", "left").withColumn("comp", F.coalesce("component", "id"))
                    .withColumn("weight", F.coalesce("w", F.lit(1))).drop("component", "w"))
        rest = written(rest, "rest")
        mixed = (rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .where("lo < hi").select("key"))
        live = written(rest.join(mixed, "key", "left_semi"), "live")
        if live.isEmpty():
            break
        turn += 1
    out = made.select("doc_id", *same).join(least, same, "left")
    if comp is not None:
        out = out.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    c = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", c.alias("component_id"),
                      F.coalesce(c == F.col("doc_id"), F.lit(True)).alias("kept"))
