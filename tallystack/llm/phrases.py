"""Collocations by prefix-free parsing.

The words of a document are cut where their content says so: a window of
``OVERLAP`` words whose hash is divisible by ``spread`` ends one chunk and
starts the next, so that equal passages are cut alike wherever they stand and
consecutive chunks overlap by that window. Distinct chunks with the number of
their occurrences form the dictionary; every phrase of up to ``OVERLAP + 1``
words lies in some chunk, and counting phrases inside distinct chunks, weighted
by occurrences, counts the corpus. A phrase inside an overlap belongs to the
chunk that starts there: only starts before the closing window count.

Phrases are counted by length. A phrase can only reach ``least`` occurrences if
both phrases one word shorter do, so each length counts only those; a bit table
of the shorter frequent phrases (``max_bits`` at most, so a broadcast of fixed
size) tells. Hits of unrelated phrases on a set bit cost rows, never results:
candidates are counted again by their text.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystack.llm import arrays as A
from tallystack.llm.common import prepare, written

LONGEST = 5
OVERLAP = LONGEST - 1
BLOCK = 1 << 21
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 9]] = True
#: floor(1000 a n / (l r)) in decimals of up to 38 digits (a n below 1e34)
SCORE = """(cast(1000 as decimal(4, 0)) * cast(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) as decimal(34, 0)))
           div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"""
_STEP = np.uint64(0xFF51AFD7ED558CCD)


def parse(raw):
    """(bytes, hash, text index, piece number, start, end) of every word;
    pieces are numbered through and never span two texts."""
    buf, starts = A.lay(raw)
    non = np.zeros(len(buf) + 2, np.int8)
    non[1:-1] = ~_GAP[buf]
    edge = np.diff(non)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = A.ROLL_A.prefix(buf)
    with np.errstate(over="ignore"):
        h = A.mix(A.ROLL_A.ranges(p, s, e) + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    piece = np.cumsum(_BREAK[buf])[s] if len(s) else s
    return buf, h, np.searchsorted(starts, s, "right") - 1, piece, s, e


def _grown(g, h, n):
    """Hashes of the n-word phrases from those of one word less."""
    with np.errstate(over="ignore"):
        return A.mix(g[:len(h) - n + 1] * _STEP + h[n - 1:])


def cuts(h, text, spread: int):
    """First word of every chunk: the first word of each text and every word
    that starts a closing window."""
    first = np.ones(len(h), bool)
    first[1:] = text[1:] != text[:-1]
    if len(h) >= OVERLAP:
        g = h.copy()
        for n in range(2, OVERLAP + 1):
            g = _grown(g, h, n)
        whole = text[:len(g)] == text[OVERLAP - 1:]
        first[:len(g)] |= whole & (g % np.uint64(spread) == 0)
    return np.flatnonzero(first)


def chunks(raw, spread: int):
    """(text index, first byte, end byte, last in its text) of all chunks, and the bytes."""
    buf, h, text, _piece, s, e = parse(raw)
    if not len(h):
        return buf, text, s, e, np.empty(0, bool)
    at = cuts(h, text, spread)
    nxt = np.append(at[1:], len(h))
    last = np.append(text[at[1:]] != text[at[:-1]], True)
    end = np.where(last, nxt, np.minimum(nxt + OVERLAP, len(h)))
    return buf, text[at], s[at], e[end - 1], last


def _cut_texts(spread):
    def run(frames):
        for pdf in frames:
            raw = [x.encode("utf-8") for x in pdf["text"]]
            lang = pdf["lang"].to_numpy()
            for i, j in A.blocks(raw, BLOCK):
                buf, text, s, e, last = chunks(raw[i:j], spread)
                if not len(s):
                    continue
                data = buf.tobytes()
                made = pd.DataFrame({"lang": lang[i:j][text], "chunk": [data[a:b] for a, b in zip(s, e)], "last": last})
                yield made.groupby(["lang", "chunk", "last"], sort=False).size().rename("c").reset_index()
    return run


@functools.lru_cache(maxsize=4096)
def _lang_key(lang: str):
    x = lang.encode("utf-8")
    return A.mix(np.array([zlib.crc32(x) << 32 | zlib.adler32(x)], np.uint64))[0]


def _sums(g, weight):
    """Distinct hashes, the place of one of each, and the sums of their weights."""
    order = np.argsort(g)
    sorted_ = g[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], order[first], np.add.reduceat(weight[order], first)


def _known(bits, g):
    """Whether the bit of each hash is set."""
    at = (g & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _phrases(pdf, lengths, filters):
    """For each block and wanted length: (n, phrase hashes, positions of the
    starts, weight of each start, chunk index, word starts, word ends, bytes).
    ``filters`` maps a length to the bit table of its frequent phrases."""
    raw = [bytes(x) for x in pdf["chunk"]]
    last, weight = pdf["last"].to_numpy(), pdf["c"].to_numpy()
    key = np.array([_lang_key(x) for x in pdf["lang"]], np.uint64)
    for i, j in A.blocks(raw, BLOCK):
        buf, h, text, piece, s, e = parse(raw[i:j])
        if not len(h):
            continue
        # words that start a counted phrase: not those of a closing window
        ends = np.searchsorted(text, np.arange(j - i), "right")
        own = (np.arange(len(h)) < ends[text] - OVERLAP) | last[i:j][text]
        lang = key[i:j][text]
        g, ok = h, np.ones(len(h), bool)
        for n in range(1, max(lengths) + 1):
            if n > 1:
                g = _grown(g, h, n)
                shorter = ok
                ok = (piece[:len(g)] == piece[n - 1:]) & (text[:len(g)] == text[n - 1:])
                ok &= shorter[:len(g)] & shorter[1:len(g) + 1]
            if n in lengths:
                at = np.flatnonzero(ok & own[:len(g)])
                yield n, g[at] ^ lang[at], at, weight[i:j][text[at]], text[at] + i, s, e, buf
            if n in filters:
                ok = ok & _known(filters[n], g ^ lang[:len(g)])


def _count(lengths, filters):
    """Partial counts (lang, n, hash) of the phrases whose parts pass the
    filters; words come with their text."""
    def run(frames):
        tables = {n: np.frombuffer(b.value, np.uint8) for n, b in filters.items()}
        for pdf in frames:
            names = pdf["lang"].to_numpy()
            for n, g, at, weight, row, s, e, buf in _phrases(pdf, lengths, tables):
                if not len(g):
                    continue
                u, one, c = _sums(g, weight)
                out = pd.DataFrame({"lang": names[row[one]], "n": np.int32(n), "h": u.view(np.int64), "c": c})
                if n == 1:
                    data = buf.tobytes()
                    out["phrase"] = [data[x:y].decode("utf-8") for x, y in zip(s[at[one]], e[at[one]])]
                yield out
    return run


def _texts(lengths, filters):
    """Partial counts by text of the phrases whose own bit is set."""
    def run(frames):
        tables = {n: np.frombuffer(b.value, np.uint8) for n, b in filters.items()}
        for pdf in frames:
            names = pdf["lang"].to_numpy()
            for n, g, at, weight, row, s, e, buf in _phrases(pdf, lengths, tables):
                keep = _known(tables[n], g)
                g, at, weight, row = g[keep], at[keep], weight[keep], row[keep]
                if not len(g):
                    continue
                data = buf.tobytes()
                u, one, c = _sums(g, weight)
                text = [b" ".join(data[s[i]:e[i]] for i in range(a, a + n)).decode("utf-8") for a in at[one]]
                yield pd.DataFrame({"lang": names[row[one]], "n": np.int32(n), "phrase": text, "c": c})
    return run


def _bit_table(frequent: DataFrame, max_bits: int):
    """Broadcast bit table of the column ``h``: 16 bits an entry, rounded up to
    a power of two, between 2**20 and ``max_bits``; made in segments of 8 KB."""
    size = 1 << 20
    rows = frequent.count()
    while size < 16 * rows and size < max_bits:
        size *= 2

    def pack(frames):
        for pdf in frames:
            out = []
            for places in pdf["places"]:
                seg = np.zeros(1 << 16, np.uint8)
                seg[np.asarray(places, np.int64)] = 1
                out.append(np.packbits(seg, bitorder="little").tobytes())
            yield pd.DataFrame({"seg": pdf["seg"], "bits": out})
    at = frequent.select(F.col("h").bitwiseAND(F.lit(size - 1)).alias("at"))
    segs = (at.groupBy(F.shiftright("at", 16).alias("seg")).agg(F.collect_set(F.col("at").bitwiseAND(F.lit(65535)).cast("int")).alias("places"))
            .mapInPandas(pack, "seg long, bits binary"))
    table = bytearray(size // 8)
    for r in segs.toLocalIterator():
        table[r.seg << 13:(r.seg + 1) << 13] = r.bits
    return frequent.sparkSession.sparkContext.broadcast(bytes(table))


def dictionary(docs: DataFrame, spread: int = 64) -> DataFrame:
    """Distinct chunks (lang, chunk, last, c) of rows (lang, text)."""
    made = docs.select("lang", "text").mapInPandas(_cut_texts(spread), "lang string, chunk binary, last boolean, c long")
    return made.groupBy("lang", "chunk", "last").agg(F.sum("c").alias("c"))


def phrase_counts(docs: DataFrame, least: int = 100, spread: int = 64, max_bits: int = 1 << 28):
    """(phrases, words): exact counts (lang, n, phrase, c) of all phrases of
    one to five words with ``least`` occurrences or more, and the number of
    words (lang, words) of rows (lang, text)."""
    parsed = written(dictionary(docs, spread), "chunks")
    filters, words, one = {}, None, None
    for lengths in ((1,), (2,), (3,), (4, 5)):
        key = ["lang", "n", "h", "phrase"] if lengths == (1,) else ["lang", "n", "h"]
        n = parsed.mapInPandas(_count(lengths, filters), "lang string, n int, h long, c long" + ", phrase string" * (lengths == (1,)))
        n = written(n.groupBy(*key).agg(F.sum("c").alias("c")), "counts")
        if words is None:
            one = n.where(F.col("c") >= least).select("lang", "n", "phrase", "c")
            words = written(n.groupBy("lang").agg(F.sum("c").alias("words")), "words")
        filters = dict(filters)
        for k in lengths:
            filters[k] = _bit_table(n.where((F.col("n") == k) & (F.col("c") >= least)).select("h"), max_bits)
    exact = parsed.mapInPandas(_texts((2, 3, 4, 5), filters), "lang string, n int, phrase string, c long")
    exact = exact.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    return written(exact.unionByName(one), "phrases"), words


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000,
                 covered: int = 100, spread: int = 64, max_bits: int = 1 << 28) -> DataFrame:
    """Each language's first ``top`` phrases of two to five words:
    (lang, rank, phrase, a, l, r, n, score). Texts are lower-cased (A-Z), cut
    into pieces at ``.,;:!?`` and line ends, and those into words at spaces and
    tabs; phrases lie within pieces. ``a`` is the phrase's number of
    occurrences, at least ``least``, ``n`` the language's words, ``l`` and ``r``
    the occurrences of the two parts of the cut that scores lowest
    (floor(1000 a n / (l r)); ties: the first cut). Phrases inside a longer
    candidate with at least ``covered`` percent of their occurrences are left out.

    A null language is ``und``, a null text empty; empty texts have no words;
    repeated rows count again; other columns are ignored; a text without a
    closing window is one chunk; an empty table gives no rows."""
    prepare(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                    F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                "abcdefghijklmnopqrstuvwxyz").alias("text"))
    f, words = phrase_counts(d, least, spread, max_bits)
    cand = f.where("n > 1").select("lang", "phrase", "n", F.col("c").alias("a"))
    parts = F.split("phrase", " ")
    # phrases one word shorter: if a longer one covers, so does one of these in between
    inside = (cand.where("n > 2").withColumn("w", parts)
              .select("lang", "a", F.explode(F.expr("array(slice(w, 1, n - 1), slice(w, 2, n - 1))")).alias("x"))
              .select("lang", F.array_join("x", " ").alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = (cand.join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)))
    cut = (left.withColumn("w", parts).withColumn("k", F.explode(F.expr("sequence(1, n - 1)")))
           .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("p1"),
                   F.expr("array_join(slice(w, k + 1, n - k), ' ')").alias("p2")))
    f1 = f.select("lang", F.col("phrase").alias("p1"), F.col("c").alias("l"))
    f2 = f.select("lang", F.col("phrase").alias("p2"), F.col("c").alias("r"))
    total = words.withColumnRenamed("words", "n")
    cut = cut.join(f1, ["lang", "p1"]).join(f2, ["lang", "p2"]).join(total, "lang")
    cut = cut.withColumn("score", F.expr(SCORE))
    best = (cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
            .select("lang", "phrase", "a", "n", "x.score", "x.l", "x.r"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
