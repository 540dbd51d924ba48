import os
import sys

import brute
import pytest

import __spark_entry__ as E
import corpus_pipeline as C
from tallystack.llm.common import written

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_packing import check  # noqa: E402
from test_pii import base  # noqa: E402
from test_quality import measure  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark, stages):
    docs, good, single, clean, redacted, packed = stages
    assert good.columns == single.columns == clean.columns == redacted.columns == docs.columns
    all_, kept = texts(docs), texts(good)
    for i, t in all_.items():
        n, _c, sym, _d, rep = measure(t)
        if n < 10 or 100 * rep > 20 * n or 100 * sym > 30 * n:
            assert i not in kept
    assert len(kept) > 0.6 * len(all_)
    comp = brute.components(kept, 5, 80)
    assert set(texts(single)) == {i for i, (_n, c) in comp.items() if c == i}
    items = [brute.shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts(single).items() if any(g and 100 * len(g & brute.shingles(t, 5)) >= 80 * len(g) for g in items)}
    assert set(texts(clean)) == set(texts(single)) - leaks and leaks
    before, after = texts(clean), texts(redacted)
    assert set(before) == set(after)
    for i, t in before.items():
        spans = base(t)
        assert (after[i] == t) or spans or "[" in after[i]
        assert not base(after[i]) if spans else True
    check(packed.collect(), list(after.items()), 4096)


def test_run_is_the_stages(spark, stages):
    got = E.queries()["pipeline"](spark, SF)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(got) == key(stages[-1])


def test_odd_rows_pass_every_stage(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text + " x", "de", "s", 5), (2, None, "de", "s", 5),
            (3, "", "de", "s", 0), (4, text + " mail me at a@b.cd now", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "1 AS quality", "2 AS pii", "3 AS component_id", "4 AS kept")
    for frame in (df, df.limit(0)):
        d = frame
        for name, stage in C.STAGES:
            d = written(stage(spark, d, SF), f"odd-{name}")
            assert d.columns == df.columns or name == "best_fit_packing"
        assert d.count() >= (2 if frame is df else 0)


def test_near_duplicates_go_by_row(spark):
    """Repeated rows become one; a duplicate text does not take another text of its id along."""
    text, other = (" ".join(f"{w}{i}" for i in range(40)) for w in ("word", "term"))
    rows = [(1, text, "s")] * 3 + [(2, other, "s"), (2, text + " end", "s"), (3, other, "s"), (None, "no id " + text, "s"), (4, "alone " * 3, "a"), (4, "alone " * 3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id or 0, r.text, r.source) for r in C.near_duplicates(spark, df, SF).collect()))
    assert got == sorted([(1, text, "s"), (2, other, "s"), (0, "no id " + text, "s"), (4, "alone " * 3, "a")])
