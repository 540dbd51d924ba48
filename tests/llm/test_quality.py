import collections
import random

import brute

import __spark_entry__ as E
SF_ORACLE = "/root/testdata/sf0.01"
from oracle import compare, duck
from tallystack.llm import quality


def measure(t):
    t = t or ""
    w = brute.words(t, lower=False)
    win = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if win[tuple(w[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if brute.words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_query_matches_sql(spark):
    ok, msg = compare(spark, duck(SF_ORACLE), "op8", E.queries()["op8_quality_rules"],
                      E.oracle_sql()["op8_quality_rules"], SF_ORACLE)
    assert ok, msg


def test_measures_on_odd_texts(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 300, "l\nl\n l\nl\n\n",
             "ß\U0001f600 é#|<> \xa0 z", "## **", "\x0b\x0ca\rb"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(60)]
    texts.append(" ".join(f"w{i % 4000}" for i in range(20000)))      # a long one
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(0, None, "h"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS quality", "2 AS host", "3 AS n_words", "4 AS `_0`")
    got = quality.quality_rules(df)
    assert got.columns == ["doc_id", "text", "source", "host", "n_words", "_0", "quality"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == measure(r.text)
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_host_verdicts_are_shrunk(spark):
    """A host whose pages repeat their lines loses them; the same page on a
    sound host, or on a host seen once among many sound ones, is kept."""
    rnd = random.Random(9)

    def page(bad):
        lines = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(6)) for _ in range(8)]
        return "\n".join(lines + (["\n".join([f"menu{rnd.randrange(99)}"] * 9)] if bad else []))
    rows = [(page(True), "farm") for _ in range(60)] + [(page(False), f"s{i % 40}") for i in range(2000)]
    rows += [(page(True), "s0"), (page(True), "once")]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, text string, source string")
    out = quality.quality_rules(df).collect()
    assert all(q.quality.failed == ["lines"] and not q.quality.kept for q in out if q.source == "farm")
    assert all(q.quality.kept for q in out if q.source != "farm")
