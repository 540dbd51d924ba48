"""Repeated passages by column-wise construction of the Burrows-Wheeler
transform of a document collection.

Every byte that lies in a string of ``length`` bytes occurring elsewhere is
found. The collection is made of segments: the starts of all ``length``-byte
windows are divided into runs whose windows share their least ``gram``-byte
hash (a minimizer), and a segment holds the bytes of one run. Equal windows
have their minimizer at the same offset, so they lie in segments with the same
anchor hash, and aligned on the anchor they start in the same column. Only
segments whose anchor occurs twice are carried on, and equal segments collapse
to one with a count.

Per anchor, the transform is then built column by column from the right, as in
Bauer, Cox and Rosone: each round puts one symbol in front of every segment's
suffix, and updates the order of the suffixes (a stable sort by symbol of the
order before), which is the transform's column, and the common prefix of
neighbours (one more than the least between them). Since equal windows share
their column, rounds only merge suffixes of one column. A window is repeated
when its common prefix with a neighbour reaches ``length``. Rounds are bounded
by the segment size, whatever the documents' lengths; groups pass through
Spark's sorted shuffle files sequentially, in batches of bounded size. Anchors with more than
``max_group`` different segments are split instead: their windows are counted
by a 128-bit hash with partial aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm import arrays as A
from tallystack.llm.common import held_bitmap, maybe, perhaps_in, prepare, tasks, written

CHUNK = 400_000            # window starts of a long text that are handled at once
SEGMENT = "rk binary, start long, n int, a int, anchor long, h1 long, h2 long"


def _pieces(raw, length):
    """(text index, first byte) of parts of CHUNK starts that overlap by length - 1."""
    for i, x in enumerate(raw):
        for c in range(0, len(x) - length + 1, CHUNK):
            yield i, c


def segments_of(raw, length: int, gram: int):
    """Arrays (text index, start, n, a, anchor, h1, h2) of all segments."""
    parts = list(_pieces(raw, length))
    out = [[] for _ in range(7)]
    data = [raw[i][c:c + CHUNK + length - 1] for i, c in parts]
    for p, q in A.blocks(data, CHUNK):
        buf, at = A.lay(data[p:q], b"")
        n = len(buf)
        pa, pb = A.ROLL_A.prefix(buf), A.ROLL_B.prefix(buf)
        pos = np.arange(n - gram + 1)
        with np.errstate(over="ignore"):
            g = A.mix(A.ROLL_A.ranges(pa, pos, pos + gram))
        bits = 20                                # a block has fewer than 2**20 bytes; the same everywhere
        low = ((g >> np.uint64(bits)) << np.uint64(bits)) | pos.astype(np.uint64)
        span, done = length - gram + 1, 1
        while done < span:                       # least of every `span` neighbours, by doubling
            step = min(done, span - done)
            low = np.minimum(low[:len(low) - step], low[step:])
            done += step
        p_min = (low & np.uint64((1 << bits) - 1)).astype(np.int64)     # one per window start
        lens = np.diff(at)
        starts = np.concatenate([np.arange(s, s + m - length + 1) for s, m in zip(at[:-1], lens)])
        anchor_at = p_min[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        s0 = starts[first]
        count = np.diff(np.append(first, len(starts)))
        e0 = s0 + count + length - 1
        doc = np.searchsorted(at, s0, "right") - 1
        with np.errstate(over="ignore"):
            h1 = A.mix(A.ROLL_A.ranges(pa, s0, e0) + (e0 - s0).astype(np.uint64))
            h2 = A.mix(A.ROLL_B.ranges(pb, s0, e0) ^ np.uint64(0xA0761D6478BD642F))
        text = np.array([i for i, _ in parts[p:q]])
        base = np.array([c for _, c in parts[p:q]])
        for c, v in zip(out, (text[doc], s0 - at[doc] + base[doc], count, anchor_at[first] - s0, g[anchor_at[first]], h1, h2)):
            c.append(v)
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def _segments(length, gram):
    def run(frames):
        for pdf in frames:
            raw = [x.encode("utf-8") for x in pdf["text"]]
            rk = pdf["rk"].to_numpy()
            for i, j in A.blocks(raw, 4 * A.BLOCK):
                t, s, n, a, g, h1, h2 = segments_of(raw[i:j], length, gram)
                if len(t):
                    yield pd.DataFrame({"rk": rk[i:j][t], "start": s, "n": n.astype(np.int32), "a": a.astype(np.int32),
                                        "anchor": g.view(np.int64), "h1": h1.view(np.int64), "h2": h2.view(np.int64)})
    return run


def column_wise(group, data, a, n, length: int):
    """Column-wise collection transform of the segments ``data`` (bytes),
    aligned on their anchors and sorted by ``group``; for each segment the
    boolean array of its starts whose window occurs in another one of its group."""
    m, left = len(data), int(a.max())
    width = left + max(len(x) - int(k) for x, k in zip(data, a))
    x = np.full((width, m), -1, np.int16)             # one row per column: read sequentially, right to left
    for i, (seg, k) in enumerate(zip(data, a)):
        x[left - k:left - k + len(seg), i] = np.frombuffer(seg, np.uint8)
    hit = np.zeros((width, m), bool)
    order, common = np.arange(m), np.zeros(m, np.int32)
    base = group.astype(np.int64) * 257
    most = int(np.bincount(group).max())
    for j in range(width - 1, -1, -1):
        symbol = x[j, order]
        key = base[order] + symbol + 1
        put = np.argsort(key, kind="stable")
        # least common prefix between neighbours of the new order, in the old one
        levels, step = [common], 1
        while 2 * step <= most:
            last = levels[-1]
            nxt = last.copy()
            nxt[:len(nxt) - step] = np.minimum(last[:len(last) - step], last[step:])
            levels.append(nxt)
            step *= 2
        lo, hi = put[:-1] + 1, put[1:]                # old positions lo..hi between two neighbours
        same = (key[put[1:]] == key[put[:-1]]) & (symbol[put[1:]] >= 0)
        span = np.where(same, hi - lo + 1, 1)
        lv = np.frexp(span)[1] - 1
        fresh = np.zeros(m, np.int32)
        for v in np.unique(lv[same]):
            k = np.flatnonzero(same & (lv == v))
            t = levels[v]
            fresh[k + 1] = np.minimum(t[lo[k]], t[hi[k] - (1 << int(v)) + 1]) + 1
        order, common = order[put], np.minimum(fresh, length)
        full = common >= length
        if full.any():
            either = full.copy()
            either[:-1] |= full[1:]
            hit[j, order[either]] = True
    return [hit[left - k:left - k + c, i] for i, (k, c) in enumerate(zip(a, n))]


def _ranges(flags):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2])]


def _compare(length, batch_rows):
    """Groups arrive sorted by anchor; whole groups are gathered to batches."""
    def solve(pdf):
        group = pd.factorize(pdf["anchor"])[0]
        found = column_wise(group, list(pdf["data"]), pdf["a"].to_numpy(), pdf["n"].to_numpy(), length)
        rows = [(i, s, e) for i, f in enumerate(found) for s, e in _ranges(f)]
        out = pdf[["anchor", "h1", "h2"]].iloc[[r[0] for r in rows]].reset_index(drop=True)
        out["s"], out["e"] = [r[1] for r in rows], [r[2] for r in rows]
        return out

    def run(frames):
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            while len(pdf):
                # the last group of the rows at hand may go on in the next frame
                anchors = pdf["anchor"].to_numpy()
                ends = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                ends = ends[ends <= batch_rows] if len(ends) and ends[0] <= batch_rows else ends[:1]
                if not len(ends) or (len(pdf) < batch_rows and ends[-1] < len(pdf) // 2 and len(pdf) < batch_rows // 2):
                    break
                yield solve(pdf.iloc[:ends[-1]].reset_index(drop=True))
                pdf = pdf.iloc[ends[-1]:].reset_index(drop=True)
            rest = pdf
        if rest is not None and len(rest):
            yield solve(rest)
    return run


def _windows(length):
    """Hash of every window of the segments of very frequent anchors."""
    def run(frames):
        for pdf in frames:
            for x in pdf.itertuples(index=False):
                buf = np.frombuffer(x.data, np.uint8)
                pa, pb = A.ROLL_A.prefix(buf), A.ROLL_B.prefix(buf)
                i = np.arange(x.n)
                with np.errstate(over="ignore"):
                    w1 = A.mix(A.ROLL_A.ranges(pa, i, i + length)).view(np.int64)
                    w2 = A.mix(A.ROLL_B.ranges(pb, i, i + length)).view(np.int64)
                yield pd.DataFrame({"anchor": x.anchor, "h1": x.h1, "h2": x.h2, "i": i.astype(np.int32), "w1": w1, "w2": w2})
    return run


def _slice(length):
    def run(frames):
        for pdf in frames:
            rows = []
            for text, want in zip(pdf["text"], pdf["want"]):
                raw = text.encode("utf-8")
                for w in want:
                    rows.append((w["anchor"], w["h1"], w["h2"], w["n"], w["a"], raw[w["start"]:w["start"] + w["n"] + length - 1]))
            yield pd.DataFrame(rows, columns=["anchor", "h1", "h2", "n", "a", "data"])
    return run


def _cut(length, others=None):
    """Documents without their spans; with a bitmap ``others`` those whose key is not in it, which have none."""
    def run(frames):
        for pdf in frames:
            if others is not None:
                pdf = pdf[~maybe(others.value, pdf["key"].to_numpy().view(np.uint64))].assign(spans=None)
            if not len(pdf):
                continue
            n_bytes, n_removed, n_spans, sha = [], [], [], []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                raw = text.encode("utf-8")
                h, at, removed, runs, end = hashlib.sha256(), 0, 0, 0, -1
                for s, e in sorted((x["s"], x["e"]) for x in spans) if spans is not None else ():
                    e += length - 1                   # starts s..e-1 cover these bytes
                    if s > end:                       # touching runs are one
                        h.update(raw[at:s])
                        runs, removed, at = runs + 1, removed + e - s, e
                        end = e
                    elif e > end:
                        removed, at, end = removed + e - end, e, e
                h.update(raw[at:])
                for c, v in zip((n_bytes, n_removed, n_spans, sha), (len(raw), removed, runs, h.hexdigest())):
                    c.append(v)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": n_bytes, "n_removed": n_removed,
                                "n_spans": n_spans, "kept_sha256": sha})
    return run


#: rows of a table of anchors that is broadcast
MAX_BROADCAST = 200_000


def _by_rk(docs: DataFrame, lists: DataFrame):
    """(documents with their row of ``lists``, or null, of all that may have one; the
    bitmap that tells): lists have no bound, so they are never broadcast, and the
    other documents are not shuffled."""
    held = held_bitmap(lists.select(F.xxhash64("rk").alias("key")))
    return docs.where(perhaps_in(held)(F.xxhash64("rk"))).join(lists.hint("merge"), "rk", "left"), held


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 200, max_group: int = 2000, batch_rows: int = 8192,
                   max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(rk, spans): for rows (rk, text), the ranges (s, e) of byte starts
    whose ``length``-byte window also starts elsewhere. Rows without any are left out."""
    def small(df):
        return F.broadcast(df) if df.limit(max_broadcast + 1).count() <= max_broadcast else df
    key = ["anchor", "h1", "h2"]
    segs = written(docs.select("rk", "text").mapInPandas(_segments(length, gram), SEGMENT), "segments")
    again = written(segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "anchors")
    near = small(again)
    if near is again:                                 # too many to broadcast: fewer segments are shuffled
        segs = segs.where(perhaps_in(held_bitmap(again.select(F.col("anchor").alias("key"))))("anchor"))
    segs = written(segs.join(near, "anchor", "left_semi"), "repeated")
    stat = written(segs.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rk", "start", "n", "a")).alias("r"))
                   .select(*key, "c", "r.*"), "distinct")
    per = stat.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    per = written(per, "kinds")
    open_ = stat.join(small(per), "anchor")
    want = open_.groupBy("rk").agg(F.collect_set(F.struct(*key, "n", "a", "start")).alias("want"))
    want = written(want, "wanted")
    # repeated rows give the same slices again
    data = (_by_rk(docs, want)[0].where("want IS NOT NULL").select("text", "want")
            .mapInPandas(_slice(length), "anchor long, h1 long, h2 long, n int, a int, data binary"))
    data = written(data.dropDuplicates(key), "data")
    few = data.join(small(per.where(F.col("kinds") <= max_group)), "anchor", "left_semi")
    few = (few.repartition(tasks(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "h1", "h2")
           .mapInPandas(_compare(length, batch_rows), "anchor long, h1 long, h2 long, s int, e int"))
    many = data.join(small(per.where(F.col("kinds") > max_group)), "anchor", "left_semi").mapInPandas(
        _windows(length), "anchor long, h1 long, h2 long, i int, w1 long, w2 long")
    many = written(many, "windows")
    twice = many.groupBy("anchor", "w1", "w2").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")) \
                .where("x <> y").select("anchor", "w1", "w2")
    hot = many.join(written(twice, "twice"), ["anchor", "w1", "w2"]).select(*key, F.col("i").alias("s"), (F.col("i") + 1).alias("e"))
    whole = stat.where("c > 1").select(*key, F.lit(0).alias("s"), F.col("n").alias("e"))
    once = stat.where("c = 1").select(*key)
    found = written(whole.unionByName(few.unionByName(hot).join(once, key, "left_semi")), "found")
    spans = segs.join(found, key).select("rk", F.struct((F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e")).alias("x"))
    return written(spans.groupBy("rk").agg(F.collect_set("x").alias("spans")), "spans")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 200,
          max_broadcast: int = MAX_BROADCAST, **options) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans,
    kept_sha256). Removed is every byte of the UTF-8 text (null: empty) that a
    string of ``length`` bytes covers which also starts elsewhere in the
    collection, the same document included; overlaps count, and strings are
    judged on the input. ``n_spans`` counts maximal removed runs;
    ``kept_sha256`` is over the remaining bytes.

    Shorter texts lose nothing. Repeated rows are documents of their own and
    so repeat each other; null ids stay null; other columns are ignored; an
    empty table gives none."""
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("rk", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))))
    spans = repeated_spans(d.where(F.octet_length("text") >= length), length, gram, max_broadcast=max_broadcast, **options)
    d = d.withColumn("key", F.xxhash64("rk")).withColumn("doc_id", F.col("doc_id").cast("string"))
    touched, held = _by_rk(d, spans)
    out = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    whole = (touched.select("doc_id", "text", "spans").mapInPandas(_cut(length), out)
             .unionByName(d.select("doc_id", "text", "key").mapInPandas(_cut(length, held), out)))
    return whole.withColumn("doc_id", F.col("doc_id").cast("long"))
