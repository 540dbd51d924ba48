"""SimHash fingerprints and permuted block tables.

Every distinct word and word pair of a text votes with its weight (1 + log2 of
its occurrences) on each of ``BITS`` bits, for or against by the bits of its
hash; a fingerprint holds the majorities. The share of equal bits of two
fingerprints follows the angle between the texts' term weights.

Fingerprints within ``radius`` bits are found by tables: the bits are cut into
blocks, at most ``radius`` of which can differ, so ``agree`` = blocks - radius
agree. With the blocks dealt to agree - 1 groups, two agreeing ones share a
group, and a table per pair of blocks of a group, keyed by those two blocks
(the permutation that puts them first), holds every pair in some table. A pair
is judged in its first table alone. Equal fingerprints are one row with a
count; queries meet a key's rows in blocks of bounded size, as whole arrays.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm import arrays as A
from tallystack.llm.common import prepare, tasks, written

BITS = 256
LANES = BITS // 64
TERMS = 1 << 10                 # terms that vote at once
RADIUS, BLOCKS = 8, 13
ROWS, QUERIES = 2048, 256       # fingerprints per block of a key
_STEP = np.uint64(0xFF51AFD7ED558CCD)


def fingerprints(texts) -> np.ndarray:
    """One row of LANES 64-bit numbers per text; without words all zero."""
    out = np.zeros((len(texts), LANES), np.uint64)
    raw = [x.encode("utf-8") for x in texts]
    for i, j in A.blocks(raw):
        h, text, _s, _e = A.words(raw[i:j])
        if not len(h):
            continue
        with np.errstate(over="ignore"):
            pair = A.mix(h[:-1] * _STEP + h[1:])
        inner = text[:-1] == text[1:]
        term = np.concatenate([h, pair[inner]])
        owner = np.concatenate([text, text[:-1][inner]])
        order = np.argsort(A.mix(term ^ A.mix(owner + 1)), kind="stable")     # equal terms of a text side by side
        term, owner = term[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]))
        weight = np.round(64 * (1 + np.log2(np.diff(np.append(new, len(term)))))).astype(np.float32)
        order = np.argsort(owner[new], kind="stable")
        term, owner, weight = term[new][order], owner[new][order], weight[order]
        with np.errstate(over="ignore"):
            lanes = np.stack([A.mix(term + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k in range(LANES)], 1)
        lanes = lanes.view(np.uint8).reshape(len(term), BITS // 8)
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        votes = np.zeros((j - i, BITS))
        for k in range(j - i):
            for a in range(cut[k], cut[k + 1], TERMS):      # sums of whole numbers below 2**24: exact
                z = min(a + TERMS, cut[k + 1])
                votes[k] += weight[a:z] @ np.unpackbits(lanes[a:z], axis=1, bitorder="little").astype(np.float32)
        total = np.bincount(owner, weight, j - i)
        out[i:j] = np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def likeness(x, y):
    """Share of equal bits."""
    return 1 - np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) / BITS



def _edited(texts, nexts):
    out = []
    for x, y in zip(texts, nexts):
        k = len(x) // 2
        out.append(x[:len(x) - k] + y[:k])
    return out


def _compare(ids, texts, own, nexts, following):
    """Complete rows of texts with their next ones and both fingerprints."""
    made = _edited(texts, nexts)
    f = fingerprints(made)
    return pd.DataFrame({"doc_id": ids, "n_chars": [len(x) for x in texts], "fp": [r.tobytes() for r in own], "edited_fp": [r.tobytes() for r in f],
                         "edited_sha256": [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in made],
                         "near_edited": likeness(own, f), "near_next": likeness(own, following)})


ROW = "doc_id string, n_chars long, fp binary, edited_fp binary, edited_sha256 string, near_edited double, near_next double"
EDGE = "part long, first boolean, last boolean, text string"


def _chain(frames):
    """Rows of a partition in order: all but the last know their next one.
    The first and the last also carry their text, to be linked with other partitions."""
    part, held, started = TaskContext.get().partitionId(), None, False
    for pdf in frames:
        if not len(pdf):
            continue
        ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
        f = fingerprints(texts)
        if held is not None:
            ids, texts, f = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], f])
        held = ids[-1], texts[-1], f[-1:]
        if len(ids) > 1:
            done = _compare(ids[:-1], texts[:-1], f[:-1], texts[1:], f[1:])
            done["part"], done["first"], done["last"], done["text"] = part, False, False, None
            if not started:
                done.loc[0, "first"], done.loc[0, "text"] = True, texts[0]
                started = True
            yield done
    if held is not None:
        yield pd.DataFrame({"doc_id": [held[0]], "n_chars": len(held[1]), "fp": [held[2][0].tobytes()], "edited_fp": None, "edited_sha256": None,
                            "near_edited": np.nan, "near_next": np.nan, "part": part, "first": not started, "last": True, "text": held[1]})


def _array(column):
    return np.frombuffer(b"".join(map(bytes, column)), np.uint64).reshape(-1, LANES)


def _link(frames):
    for pdf in frames:
        if len(pdf):
            yield _compare(pdf["doc_id"].tolist(), pdf["text"].tolist(), _array(pdf["fp"]), pdf["next_text"].tolist(), _array(pdf["next_fp"]))


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the likeness of its fingerprint to that of its
    edited text, whose second half (n_chars // 2 code points) is taken from
    the start of the next document in descending order of id (after the last
    the first), and to that of the next document itself: ROW. Rows of one id
    follow each other by the md5 of their text, null ids come last."""
    from pyspark.sql import Window
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("tie", F.md5("text"))
    order = [F.col("id").desc_nulls_last(), F.col("tie").asc()]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("doc_id"), "text")
    out = written(d.mapInPandas(_chain, f"{ROW}, {EDGE}"), "edits")
    # one row per partition: which one follows, and after the last the first
    firsts = out.where("first").select("part", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    w = Window.orderBy("part")
    following = (out.where("first").select("part")
                 .withColumn("to", F.coalesce(F.lead("part").over(w), F.min("part").over(Window.partitionBy()))))
    ends = out.where("last").select("part", "doc_id", "text", "fp").join(following, "part")
    linked = ends.join(firsts.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "fp", "next_text", "next_fp")
    names = [x.split()[0] for x in ROW.split(", ")]
    return out.where("not last").select(names).unionByName(linked.mapInPandas(_link, ROW))


def block_tables(bits: int = BITS, radius: int = RADIUS, blocks: int = BLOCKS):
    """Bounds of the blocks, and the pairs of blocks that key the tables."""
    groups = blocks - radius - 1
    if groups < 1:
        raise ValueError("needs at least radius + 2 blocks")
    edge = [bits * k // blocks for k in range(blocks + 1)]
    pairs = [p for g in range(groups) for p in itertools.combinations(range(g, blocks, groups), 2)]
    return list(zip(edge[:-1], edge[1:])), pairs


def block_values(f, bounds):
    """Value of every block: one column per block."""
    out = np.empty((len(f), len(bounds)), np.uint64)
    for k, (a, b) in enumerate(bounds):
        lane, shift, width = a // 64, a % 64, b - a
        v = f[:, lane] >> np.uint64(shift)
        if shift + width > 64:
            v = v | f[:, lane + 1] << np.uint64(64 - shift)
        out[:, k] = v & np.uint64((1 << width) - 1)
    return out


def _keys(radius, blocks):
    def run(frames):
        bounds, pairs = block_tables(BITS, radius, blocks)
        for pdf in frames:
            if not len(pdf):
                continue
            v = block_values(_array(pdf["fp"]), bounds)
            for t, (a, b) in enumerate(pairs):
                key = A.mix(v[:, a] << np.uint64(32) | v[:, b])
                yield pd.DataFrame({"t": np.int32(t), "key": key.view(np.int64), "fp": pdf["fp"], "n": pdf["n"]})
    return run


def _count(radius, blocks):
    def run(frames):
        bounds, pairs = block_tables(BITS, radius, blocks)
        for pdf in frames:
            for t, asked, rows in zip(pdf["t"], pdf["asked"], pdf["rows"]):
                q, x = _array(asked), _array([r["fp"] for r in rows])
                n = np.array([r["n"] for r in rows], np.int64)
                far = np.zeros((len(q), len(x)), np.uint16)
                for lane in range(LANES):
                    far += np.bitwise_count(q[:, lane, None] ^ x[None, :, lane])
                a, b = np.nonzero(far <= radius)
                vq, vx = block_values(q, bounds), block_values(x, bounds)
                for u, v in pairs[:t]:                      # a pair counts in its first table only
                    later = (vq[a, u] != vx[b, u]) | (vq[a, v] != vx[b, v])
                    a, b = a[later], b[later]
                    if not len(a):
                        break
                c = np.bincount(a, n[b], len(q)).astype(np.int64)
                yield pd.DataFrame({"fp": [bytes(z) for z, k in zip(asked, c) if k], "near": c[c > 0]})
    return run


def near_counts(found: DataFrame, asked, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, near): for every fingerprint of the rows of ``found`` (column
    ``fp``) where ``asked`` holds, the number of all rows within ``radius``
    bits, its own included."""
    kinds = written(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(asked.cast("int")).alias("asked")), "kinds")
    keyed = "t int, key long, fp binary, n long"
    ask = written(kinds.where("asked = 1").mapInPandas(_keys(radius, blocks), keyed), "asked")
    rows = kinds.mapInPandas(_keys(radius, blocks), keyed).join(ask.select("t", "key").distinct(), ["t", "key"], "left_semi")
    rows = written(rows, "rows")

    def packed(df, what, size, name):
        """Rows of a key in blocks of about ``size``, dealt by hash."""
        much = df.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > size)
        block = F.pmod(F.xxhash64("fp"), F.coalesce(F.ceil(F.col("m") / size), F.lit(1)))
        return (df.join(much, ["t", "key"], "left").groupBy("t", "key", block.alias("block"))
                .agg(F.collect_list(what).alias(name)).drop("block"))
    met = packed(ask, F.col("fp"), QUERIES, "asked").join(packed(rows, F.struct("fp", "n"), ROWS, "rows"), ["t", "key"])
    met = met.select("t", "asked", "rows").repartition(4 * tasks(found.sparkSession))     # few bytes, much work each
    return met.mapInPandas(_count(radius, blocks), "fp binary, near long").groupBy("fp").agg(F.sum("near").alias("near"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 20,
                          radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_near). Fingerprints are in
    hexadecimal; ``near_edited`` and ``near_next`` are the shares of bits that
    the document's has in common with that of its edited text and of the next
    document; ``n_near`` is the number of other documents within ``radius``
    bits, for ids divisible by ``every`` (others: null).

    A null text is empty; texts without words have the zero fingerprint and
    equal each other; repeated rows are documents of their own; null ids stay
    null, come last in the order and are not asked; other columns are ignored;
    an only document follows itself; an empty table gives none."""
    prepare(docs.sparkSession)
    out = written(edited_documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    near = near_counts(out.select("fp", "doc_id"), asked, radius, blocks)
    counted = out.where(asked).join(near, "fp", "left").withColumn("n_near", F.col("near") - 1).drop("near")
    whole = counted.unionByName(out.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
    return whole.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"),
                        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
