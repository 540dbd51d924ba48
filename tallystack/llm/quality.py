"""Text quality rules with host-level evidence, in DataFrame functions only.

Every document is measured row by row (no shuffle of words). Rule failures are
aggregated per host (partial aggregation, so a host with a third of all rows
is no hot task), each host's failure rate of a rule is shrunk towards the
corpus with a beta prior fitted to the host rates by moments, and the verdicts
of untrusted hosts are joined back to their documents.

Rules: ``short`` and ``repeats`` (base rules, always decisive), ``symbols``
(more than ``symbol_percent`` symbols per 100 words, decisive), ``lines``
(more than ``line_percent`` % of lines repeat an earlier one) and ``length``
(mean word length outside ``word_length``). ``lines`` and ``length`` only
count against documents of hosts whose shrunk failure rate of that rule
exceeds ``host_limit``: a single odd page of a sound host is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm.common import SPACE_CLASS, SPACES, prepare, written

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "lines", "length")
SOFT = ("lines", "length")
WINDOW = 5


def _measured(docs: DataFrame, text_col: str, pre: str) -> DataFrame:
    """``docs`` with the measures of every text in a struct column ``pre``.
    Each step is a column of its own that the next one uses more than once,
    so that the optimizer does not repeat it per element."""
    t, w, h, d, p, ln = (f"{pre}_{x}" for x in ("text", "words", "hash", "twice", "pos", "lines"))
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn(w, F.filter(F.split(t, f"{SPACE_CLASS}+"), lambda x: x != ""))
    df = df.withColumn(ln, F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    parts = ", ".join(f"{w}[i + {j}]" for j in range(WINDOW))
    df = df.withColumn(h, F.expr(f"CASE WHEN size({w}) >= {WINDOW} THEN transform(sequence(0, size({w}) - {WINDOW}), "
                                 f"i -> xxhash64({parts})) ELSE array() END"))
    # windows that occur again: neighbours in hash order; positions only where there are any
    df = df.withColumn(d, F.expr(
        f"CASE WHEN size(array_distinct({h})) < size({h}) THEN "
        f"sort_array(transform({h}, (x, i) -> struct(x AS x, i AS i))) END"))
    df = df.withColumn(p, F.expr(
        f"sort_array(transform(filter({d}, (y, i) -> (i > 0 AND {d}[i - 1].x = y.x) "
        f"OR get({d}, i + 1).x = y.x), y -> y.i))"))
    repeats = F.expr(f"coalesce(aggregate(transform({p}, (y, i) -> least({WINDOW}, "
                     f"coalesce(get({p}, i + 1) - y, {WINDOW}))), 0L, (s, y) -> s + y), 0L)")
    made = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        F.size(ln).cast("long").alias("n_lines"),
        repeats.alias("n_repeat_words"))
    return df.withColumn(pre, made).drop(t, w, h, d, p, ln)


def _failures(m: str, min_words: int, repeat_percent: int, symbol_percent: int, line_percent: int, word_length):
    n = F.col(f"{m}.n_words")
    return {"short": n < min_words,
            "repeats": 100 * F.col(f"{m}.n_repeat_words") > repeat_percent * n,
            "symbols": 100 * F.col(f"{m}.n_symbols") > symbol_percent * n,
            "lines": 100 * F.col(f"{m}.n_dup_lines") > line_percent * F.col(f"{m}.n_lines"),
            "length": (F.col(f"{m}.word_chars") < word_length[0] * n) | (F.col(f"{m}.word_chars") > word_length[1] * n)}


def host_rates(failures: DataFrame, host: str = "host", rules=RULES, min_prior: float = 10.0) -> DataFrame:
    """Shrunk failure rates per host from rows of (host, one boolean per
    rule): (host, rule, n, x, rate). With host rates x/n, corpus mean m and
    between-host variance v (weighted variance less its binomial part), the
    prior is Beta(m*M, (1-m)*M), M = m(1-m)/v - 1 but at least ``min_prior``
    documents, and rate = (x + m*M) / (n + M). A null host is a host of its own."""
    per = failures.groupBy(host).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.count_if(F.col(r)).alias(f"x_{r}") for r in rules])
    per = written(per.select(host, "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"x_{r}").alias("x")) for r in rules])).alias("z"))
        .select(host, "n", "z.rule", "z.x"), "hosts")
    m = F.col("sx") / F.col("sn")
    # sum n (p - m)^2 = sum x^2/n - m * sum x
    v = (F.col("sxx") - m * F.col("sx")) / F.col("sn") - m * (1 - m) * F.col("hosts") / F.col("sn")
    prior = (per.groupBy("rule").agg(F.sum("n").alias("sn"), F.sum("x").alias("sx"),
                                     F.sum(F.col("x") * F.col("x") / F.col("n")).alias("sxx"),
                                     F.count(F.lit(1)).alias("hosts"))
             .select("rule", m.alias("mean"),
                     F.greatest(F.lit(float(min_prior)), m * (1 - m) / F.greatest(v, F.lit(1e-9)) - 1).alias("weight")))
    # the prior has one row per rule: a bounded broadcast
    return (per.join(F.broadcast(prior), "rule")
            .select(host, "rule", "n", "x", 
                    ((F.col("x") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate")))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_words: int = 10,
                  repeat_percent: int = 20, symbol_percent: int = 30, line_percent: int = 30,
                  word_length=(2, 20), host_limit: float = 0.5, carry=None, max_broadcast: int = 100_000) -> DataFrame:
    """``docs`` (its columns ``carry``, all by default) with one more struct
    column ``quality``: n_words, word_chars,
    n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, kept and
    ``failed`` (names of the rules that the text fails).

    Null and empty texts have no words and fail ``short``. Rows are judged
    each for itself, so repeated rows, ties and null ids need no rule; a null
    host is one host. A column of ``docs`` called ``quality`` is replaced.
    ``docs`` with its measures is written once to the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    m = "quality"
    keep = [c for c in (carry or docs.columns) if c.lower() != m]
    # positional names for the work, so that no column of the input can clash
    src = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"),
                      F.col(host_col).alias("_host"))
    df = _measured(src, "_text", m).drop("_text")
    fails = _failures(m, min_words, repeat_percent, symbol_percent, line_percent, word_length)
    df = written(df.withColumn(m, F.col(m).withField("failed", F.filter(
        F.array(*[F.when(c, F.lit(r)) for r, c in fails.items()]), lambda x: x.isNotNull()))), "quality")
    flags = df.select(F.col("_host").alias("host"), *[F.array_contains(f"{m}.failed", r).alias(r) for r in RULES])
    bad = written(host_rates(flags).where((F.col("rate") > host_limit) & F.col("rule").isin(*SOFT))
                  .groupBy(F.col("host").alias("_bad_host")).agg(F.collect_set("rule").alias("_bad_rules")), "badhosts")
    # few hosts as a rule; beyond the limit the join shuffles instead
    small = bad.limit(max_broadcast + 1).count() <= max_broadcast
    df = df.join(F.broadcast(bad) if small else bad, F.col("_host").eqNullSafe(F.col("_bad_host")), "left")
    failed = F.col(f"{m}.failed")
    base = F.array_contains(failed, "short") | F.array_contains(failed, "repeats")
    verdict = ~(base | F.array_contains(failed, "symbols")
                | F.coalesce(F.arrays_overlap(failed, "_bad_rules"), F.lit(False)))
    return df.withColumn(m, F.col(m).withField("base_failed", base).withField("kept", verdict)).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], m)
