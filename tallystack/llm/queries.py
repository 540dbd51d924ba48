"""Queries of the corpus operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystack.llm.common import read_table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_llm() -> dict:
    return dict(QUERIES)


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark, sf):
    from tallystack.llm.minhash import near_duplicates
    return near_duplicates(read_table(spark, sf, "documents"), k=4, percent=80)


# the same measures, moments and verdicts in SQL; DuckDB's strlen-like
# functions on code points are length(), list functions are 1-based
OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text,
        list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        100 * n_symbols > 30 * n_words AS f_symbols, 100 * n_dup_lines > 30 * n_lines AS f_lines,
        word_chars < 2 * n_words OR word_chars > 20 * n_words AS f_length FROM m),
h AS (SELECT source, 'lines' AS rule, count(*) AS n, count(*) FILTER (f_lines) AS x FROM f GROUP BY source
      UNION ALL SELECT source, 'length', count(*), count(*) FILTER (f_length) FROM f GROUP BY source),
p AS (SELECT rule, sx / sn AS m, (sxx - sx / sn * sx) / sn - sx / sn * (1 - sx / sn) * k / sn AS v
      FROM (SELECT rule, sum(n) AS sn, sum(x) AS sx, sum(x * x / n) AS sxx, count(*) AS k FROM h GROUP BY rule)),
s AS (SELECT source, h.rule, (x + m * mm) / (n + mm) AS rate
      FROM h JOIN (SELECT *, greatest(10.0, m * (1 - m) / greatest(v, 1e-9) - 1) AS mm FROM p) p ON h.rule = p.rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR f_symbols
            OR (f_lines AND EXISTS (SELECT 1 FROM s WHERE s.source IS NOT DISTINCT FROM f.source AND rule = 'lines' AND rate > 0.5))
            OR (f_length AND EXISTS (SELECT 1 FROM s WHERE s.source IS NOT DISTINCT FROM f.source AND rule = 'length' AND rate > 0.5))) AS kept
FROM f"""


@query("op8_quality_rules", OP8_SQL)
def op8_quality_rules(spark, sf):
    from tallystack.llm.quality import quality_rules
    q = quality_rules(read_table(spark, sf, "documents"), carry=["doc_id"])
    return q.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


OP10_SQL = r"""
WITH w AS (SELECT doc_id AS id, false AS item, text FROM documents UNION ALL
           SELECT item_id, true, text FROM benchmark),
ws AS (SELECT id, item, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
       FROM w),
g AS (SELECT DISTINCT id, item, list_slice(ws, i, i + 4) AS gram
      FROM (SELECT id, item, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM ws WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n_item FROM g WHERE item GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_common
      FROM g d JOIN g b ON d.gram = b.gram AND b.item AND NOT d.item GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_common FROM c JOIN n ON c.item_id = n.id WHERE n_common * 100 >= n_item * 80"""


@query("op10_benchmark_decontamination", OP10_SQL)
def op10_benchmark_decontamination(spark, sf):
    from tallystack.llm.decontaminate import containment_search
    return containment_search(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query("op9_pii_boosting")
def op9_pii_boosting(spark, sf):
    from tallystack.llm.pii import KINDS, personal_data
    p = personal_data(read_table(spark, sf, "documents"), carry=["doc_id"])

    def joined(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    counts = [F.expr(f"size(filter(pii.base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return p.select("doc_id", *counts, F.sha2(joined("pii.base"), 256).alias("base_sha256"), joined("pii.spans").alias("spans"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark, sf):
    from tallystack.llm.packing import pack
    return pack(read_table(spark, sf, "documents"))


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


# without canonical links or redirects in a page, the method allows what no
# rule names; the twin repeats that only when no page states an alias
OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, h, p, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (SELECT page_id, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
      FROM p JOIN r ON (host = r.h OR ends_with(host, '.' || r.h))
        AND starts_with(p.path, r.p))
SELECT p.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1"""


@query("op5_url_filters", OP5_SQL)
def op5_url_filters(spark, sf):
    from tallystack.llm.urls import url_verdicts
    return url_verdicts(read_table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op2_license_scan")
def op2_license_scan(spark, sf):
    from tallystack.llm.licenses import license_scan
    return license_scan(read_table(spark, sf, "documents"))


@query("op7_secret_forest")
def op7_secret_forest(spark, sf):
    from tallystack.llm.secrets import secret_scan
    return secret_scan(read_table(spark, sf, "documents"))


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, sf):
    from tallystack.llm.suffixes import dedup
    return dedup(read_table(spark, sf, "documents"), length=400)


@query("op4_suffix_tree_scores")
def op4_suffix_tree_scores(spark, sf):
    from tallystack.llm.suffixtree import lm_scores
    return lm_scores(read_table(spark, sf, "documents"))


# phrases by self-joined word positions; HUGEINT keeps the products exact
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
            FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
s AS (SELECT lang, a, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
      FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2))),
x AS (SELECT lang, phrase, max(a) AS longer FROM s GROUP BY ALL),
k AS (SELECT c.lang, c.phrase, c.a, c.m, c.ws, unnest(range(1, m)) AS k
      FROM c LEFT JOIN x ON c.lang = x.lang AND c.phrase = x.phrase WHERE longer IS NULL OR longer < c.a),
t AS (SELECT k.lang, k.phrase, k.a, k, f1.c AS l, f2.c AS r, n.n,
             CAST((1000::HUGEINT * k.a * n.n) // (f1.c::HUGEINT * f2.c) AS BIGINT) AS score
      FROM k JOIN f f1 ON f1.lang = k.lang AND f1.phrase = array_to_string(list_slice(ws, 1, k), ' ')
             JOIN f f2 ON f2.lang = k.lang AND f2.phrase = array_to_string(list_slice(ws, k + 1, k.m), ' ')
             JOIN n ON n.lang = k.lang),
b AS (SELECT lang, phrase, a, l, r, n, score FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@query("op13_phrase_collocations", OP13_SQL)
def op13_phrase_collocations(spark, sf):
    from tallystack.llm.phrases import collocations
    return collocations(read_table(spark, sf, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf):
    from tallystack.llm.runs import periodic_runs, planted
    found = periodic_runs(planted(read_table(spark, sf, "documents")))
    best = F.expr("""aggregate(runs, cast(null as struct<start:long,period:long,length:long>),
        (x, y) -> if(x is null or y.length > x.length, y, x))""")    # runs come by start, then period
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_simhash_fingerprints")
def op12_simhash_fingerprints(spark, sf):
    from tallystack.llm.simhash import document_fingerprints
    return document_fingerprints(read_table(spark, sf, "documents"))
