import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import __spark_entry__ as E
from tallystack.llm import packing

SF = "/root/testdata/sf0.01"


def plain_bfd(lengths, size):
    import bisect
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        if i == len(rooms):
            bins += 1
            room = size
        else:
            room = rooms.pop(i)
        if room - n:
            bisect.insort(rooms, room - n)
    return bins, sorted(rooms)


def test_histogram_packing_equals_one_by_one():
    rnd = random.Random(1)
    for size in (1, 7, 64, 500):
        for _ in range(60):
            lengths = [rnd.choice([size, 1, rnd.randint(1, size), rnd.randint(1, max(1, size // 4))])
                       for _ in range(rnd.randrange(400))]
            slots = packing.best_fit_decreasing(collections.Counter(lengths), size)
            used, spans = collections.Counter(), collections.defaultdict(list)
            seen = collections.Counter()
            for n, at, count, first, per, off in slots:
                assert at == seen[n]
                seen[n] += count
                for r in range(count):
                    spans[first + r // per].append((off + r % per * n, n))
                    used[first + r // per] += n
            assert seen == collections.Counter(lengths)
            for s in spans.values():                      # gapless from 0
                at = 0
                for off, n in sorted(s):
                    assert off == at
                    at += n
            bins, rooms = plain_bfd(lengths, size)
            assert len(used) == bins and sorted(size - u for u in used.values() if size > u) == rooms


def check(rows, texts, size):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, s in enumerate(range(0, len(ids), size)):
            part = ids[s:s + size]
            want[(i, p, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= size
    assert len(seqs) == plain_bfd([r.length for r in rows], size)[0]


def test_query_against_tokenizer_and_plain_packing(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(E.queries()["op6_best_fit_packing"](spark, SF).collect(), texts, 4096)


def test_odd_texts(spark):
    texts = [(0, None), (1, ""), (2, " \t\r\n"), (3, "a\xa0b c <|endoftext|> d<|startoftext|>e I'll"), (4, "x" * 9000),
             (5, "Ünï ﬁ é ́a ΑΣ ß İ\x1c\x85 z"), (6, "w " * 9000), (6, "w " * 9000), (None, "null id"), (7, "\U0001f600 !!!? 123"), (2**62 + 1, "big id, THE. end,.")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS slots", "3 AS r")
    check(packing.pack(df, size=64, buckets=3).collect(), texts, 64)
    assert packing.pack(df.limit(0)).count() == 0


def test_words_encode_as_the_whole_tokenizer_does():
    rnd = random.Random(7)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    marks, letters = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "abcXYZéÀßÿñçöÖØ"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) + "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 4)))
             for _ in range(4000)]
    words += ["<|endoftext|>", "a<|startoftext|>.", "I'll", "x's", "2024", "a1.", "É́x", "ΑΣ.", "İ", "ªº", "\U0001f600.", "don't.", "l'été,", "ǆ"]
    known = packing.WordIds(tok)
    for w in words:
        assert np.frombuffer(known[w], "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids, w
