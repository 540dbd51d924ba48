"""Best-fit-decreasing packing of tokenized documents into sequences.

Bins with the same remaining capacity are interchangeable and piece lengths
are at most ``size``, so the packing needs only the histogram of lengths: at
most ``size`` rows whatever the corpus. On it, best-fit decreasing runs with a
segment tree over remaining capacities; the tightest open class of bins is
found in logarithmic time and filled by as many equal pieces as the classical
rule, one document at a time, would put there. The result is a table of slot
ranges per length, and every piece finds its slot from its rank among the
pieces of its length. Ranks come from counts per (bucket, length) and prefix
sums, so a length shared by a third of all pieces is spread over all buckets.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallystack.llm.common import prepare, two_columns, written


class SegmentTree:
    """Which remaining capacities 0..size have open bins; least one >= x."""

    def __init__(self, size: int):
        self.n = 1
        while self.n < size + 1:
            self.n *= 2
        self.any = bytearray(2 * self.n)

    def set(self, i: int, on: bool):
        i += self.n
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def least(self, x: int) -> int:
        """Least open capacity >= x, or -1."""
        i = x + self.n
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return -1


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first rank, pieces, first sequence, pieces per
    sequence, offset in the sequence) for ``histogram[length] = pieces``.

    Piece r of a range, counted from its first rank, goes to sequence first +
    r // per at offset + (r % per) * length. Equal to placing the pieces one
    by one, longest first, each into the open sequence with the least
    sufficient room, ties between equal rooms aside."""
    tree, open_, out, fresh = SegmentTree(size), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            room = tree.least(length)
            if room < 0:
                first, bins, room = fresh, -(-left // (size // length)), size
            else:
                first, bins = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            per = room // length
            full, rest = divmod(min(left, bins * per), per)
            if full:
                out.append((length, at, full * per, first, per, size - room))
            if rest:
                out.append((length, at + full * per, rest, first + full, per, size - room))
            used = full + (rest > 0)
            if room == size and first == fresh:
                fresh += used
                bins = used
            for f, n, r in ((first, full, room - per * length), (first + full, int(rest > 0), room - rest * length),
                            (first + used, bins - used, room)):
                if n and r:
                    open_.setdefault(r, []).append((f, n))
                    tree.set(r, True)
            placed = full * per + rest
            at, left = at + placed, left - placed
    return out


_STATE: dict = {}


#: a word that is one run of Latin letters and then ASCII marks: two pre-tokens, normalised by lower case alone
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)").fullmatch


def _byte_letters() -> dict:
    """The printable stand-ins of byte-level tokenizers: bytes that are
    printable Latin-1 stand for themselves, the others follow from 256 on."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class WordIds(dict):
    """Word -> its ids as little-endian bytes, encoded when first asked for.
    Plain words go to the tokenizer's model as their pre-tokens, each distinct
    one once; all others through the whole tokenizer."""

    table = _byte_letters()

    def __init__(self, tok):
        self.whole, self.model = tok.encode, tok.model.tokenize

    def piece(self, text):
        got = self.get(text)
        if got is None:
            raw = text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(self.table)
            ids = [k.id for k in self.model(raw)]
            got = self[text] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def __missing__(self, w):
        m = PLAIN(w)
        if m is None:
            ids = self.whole(w, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = self.piece(m[1].lower())
            if m[2]:
                out += self.piece(m[2])
        self[w] = out
        return out


def _encode(path: str, end_id: int, size: int, limit: int = 1_000_000):
    """Tokenize in Arrow batches. The tokenizer drops white space and never
    joins across it, so a worker encodes each distinct word once; it forgets
    its words beyond ``limit`` of them (bounded memory, same result)."""
    def run(frames):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if _STATE.get("path") != path:
            from tokenizers import Tokenizer
            _STATE.update(path=path, ids=WordIds(Tokenizer.from_file(path)))
        known, end = _STATE["ids"], np.array([end_id], "<u4").tobytes()
        ids_of = known.__getitem__
        for pdf in frames:
            cols = [[] for _ in range(5)]
            for doc, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                if len(known) > limit:
                    known.clear()
                ws = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
                raw = b"".join(map(ids_of, ws)) + end
                n = len(raw) // 4
                for p, start in enumerate(range(0, n, size)):
                    part = raw[4 * start:4 * (start + size)]
                    for c, v in zip(cols, (doc, p, start, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            yield pd.DataFrame({"doc_id": cols[0], "piece": np.array(cols[1], np.int32),
                                "start": np.array(cols[2], np.int64), "length": np.array(cols[3], np.int64),
                                "ids_crc32": np.array(cols[4], np.int64)})
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         size: int = 4096, end_id: int = 1, buckets: int = 64) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset).

    A document is the ids of its text and then ``end_id``; only documents
    longer than ``size`` are cut, into pieces of ``size`` ids and a last
    shorter one. Null and empty texts are the end id alone. Every row is
    packed: repeated rows and rows with a null id are documents of their own.
    ``tokenizer`` is the path of a file of the ``tokenizers`` library, the same on
    every machine. An empty table gives no rows."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    prepare(spark)
    made = two_columns(docs, id_col, text_col, "string").mapInPandas(
        _encode(tokenizer, end_id, size), "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))
    made = written(made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")), "pieces")
    counts = {(r.bucket, r.length): r.n for r in                     # at most buckets * size rows
              made.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, before = {}, []
    for (b, length), n in sorted(counts.items()):
        before.append((b, length, total.get(length, 0)))
        total[length] = total.get(length, 0) + n
    slots = best_fit_decreasing(total, size)
    base = spark.createDataFrame(before, "bucket int, length long, base long")
    by_length: dict = {}
    for s in slots:
        by_length.setdefault(s[0], []).append(s[1:])
    plan = spark.createDataFrame(sorted(by_length.items()), "length long, slots array<struct<at:long,n:long,first:long,per:long,off:long>>")
    # both tables are bounded by the histogram (lengths, buckets), not by the corpus
    w = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (made.withColumn("r", F.row_number().over(w) - 1).join(F.broadcast(base), ["bucket", "length"])
              .withColumn("r", F.col("r") + F.col("base")).join(F.broadcast(plan), "length"))
    # binary search would need a loop: ranges of a length are few (filter keeps the one that holds r)
    slot = F.expr("filter(slots, s -> s.at <= r AND r < s.at + s.n)[0]")
    return (ranked.withColumn("s", slot)
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.expr("s.first + (r - s.at) DIV s.per").alias("sequence_id"),
                    F.expr("s.off + ((r - s.at) % s.per) * length").alias("offset")))
