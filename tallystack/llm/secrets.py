"""Secrets in documents: wide generators propose candidate values, a random
forest removes the false positives. DataFrame functions and Spark ML only.

Candidates are values assigned to a name, quoted or up to white space or a
delimiter, and bare tokens of at least 20 characters with a digit. The forest sees length, character classes and the
transitions between them, entropy, how much of the value a dictionary covers,
the path, and the neighbouring words. The dictionary is counted over the words
around all candidates of the corpus (the ``dictionary_size`` most frequent, a
bounded table).

Labelled findings may be given (doc_id, s, e, label). Without them, clear
cases label themselves: a random-looking value assigned to a credential name
is a secret, as is, named or not, one with the prefix that an issuer gives its keys or one
of mixed characters with a high entropy; a value that dictionary words cover, that a placeholder word
marks, or that has one kind of character only and no credential name, is not.
The forest is fitted on at most ``max_rows`` of them (a documented bound,
chosen by hash) and judges every candidate.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm.common import prepare, written
from tallystack.llm.pii import found

_HEAD = r"(?<![A-Za-z0-9_.-])[A-Za-z_][A-Za-z0-9_.-]{1,40}[\"']?[\x20\x09]{0,3}(?:=>|:=|[:=])[\x20\x09]{0,3}"
ASSIGNED = _HEAD + r"(?:\"[^\"\s]{6,}+\"|'[^'\s]{6,}+')"
#: without quotes: any value of a credential name, else one with a digit; no links
_OPEN = r"[^\s\"'`,;(){}\[\]<>|&]"
OPEN = (r"(?<![A-Za-z0-9_.-])(?:(?=[A-Za-z0-9_.-]{0,40}(?i:@NAMES@))[A-Za-z_][A-Za-z0-9_.-]{1,40}[\"']?[\x20\x09]{0,3}(?:=>|:=|[:=])[\x20\x09]{0,3}"
        rf"(?!//){_OPEN}{{6,}}+|[A-Za-z_][A-Za-z0-9_.-]{{1,40}}[\"']?[\x20\x09]{{0,3}}(?:=>|:=|[:=])[\x20\x09]{{0,3}}(?!//)(?=[^\s0-9\"'`,;(){{}}\[\]<>|&]*+[0-9]){_OPEN}{{6,}}+)")
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
# fixed values: words of credential names, of placeholders, of test paths
NAMES = "token|secret|passw|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private"
OPEN = OPEN.replace("@NAMES@", NAMES)
#: prefixes that issuers give their keys, and tokens in three parts
PREFIXES = ("^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|ya29[.]|npm_|pypi-|SG[.]|eyJ[A-Za-z0-9_-]+[.]eyJ)"
            "[A-Za-z0-9._-]{12,}")
PLACEHOLDERS = "example|sample|dummy|changeme|placeholder|your|xxxx|test|todo|redacted|123456"
TEST_PATHS = "test|example|sample|mock|fixture|doc"
FEATURES = ("length", "transitions", "lowers", "uppers", "digits", "others", "hex", "distinct", "entropy", "longest_word",
            "coverage", "assigned", "named", "prefixed", "placeholder", "test_path", "names_near", "placeholders_near", "words_near")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def candidates(df: DataFrame) -> DataFrame:
    """One row per candidate value of ``_t``: (_key, path, s, e, value, name,
    near). A value found both ways keeps its name."""
    def spans(pattern, name, value, quote=0):
        return (f"transform({found('_t', pattern)}, x -> named_struct('e', x.e - {quote}, 'v', {value}, 'n', {name}, "
                f"'near', concat(substring(_t, greatest(x.s - 59, 1), least(x.s, 60)), ' ', substring(_t, x.e + 1, 40))))")
    c = df.select("_key", "path", "_t", F.expr(f"concat({spans(ASSIGNED, _name(), _value(_QUOTED), 1)}, "
                                               f"{spans(OPEN, _name(), _value(_UNQUOTED))})").alias("_named"),
                  F.expr(spans(BARE, _null(), "x.m")).alias("_bare"))
    # a bare token that overlaps an assigned value is that find
    both = "concat(_named, filter(_bare, b -> NOT exists(_named, y -> y.e - length(y.v) < b.e AND b.e - length(b.v) < y.e)))"
    c = c.select("_key", "path", F.explode_outer(F.expr(both)).alias("c")).select("_key", "path", "c.*").where("v <> ''")
    return (c.withColumn("s", F.expr("e - length(v)")).groupBy("_key", "path", "s", "e")
            .agg(F.first("v").alias("value"), F.max("n").alias("name"), F.max("near").alias("near")))


def _name():
    return f"regexp_extract(x.m, {_q('^[A-Za-z0-9_.-]+')}, 0)"


_SIGN = r"""^[A-Za-z0-9_.-]+["']?[\x20\x09]*(?:=>|:=|[:=])[\x20\x09]*"""
_QUOTED, _UNQUOTED = _SIGN + r"""["'](.*)["']$""", _SIGN + "(.*)$"


def _value(pattern):
    return f"regexp_extract(x.m, {_q(pattern)}, 1)"


def _null():
    return "CAST(NULL AS STRING)"


def described(c: DataFrame, dictionary_size: int) -> DataFrame:
    """``c`` with the features and ``words``, the share covered by the dictionary."""
    near = F.regexp_extract_all(F.lower("near"), F.lit("[a-z]{4,}"), 0)
    common = (c.select(F.explode_outer(near).alias("w")).where("w IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "w").limit(dictionary_size).collect())          # at most dictionary_size words
    c = c.withColumn("_dictionary", F.lit([r["w"] for r in common]) if common else F.expr("CAST(array() AS array<string>)"))
    classes = ("translate(value, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', "
               f"'{'a' * 26}{'A' * 26}{'0' * 10}')")
    c = (c.withColumn("_c", F.expr(classes)).withColumn("_v", F.split("value", "")).withColumn("_low", F.lower("value")))
    c = c.withColumn("_parts", F.regexp_extract_all("_low", F.lit("[a-z]{4,}"), 0)).withColumn("_kinds", F.array_distinct("_v"))
    e = {"length": "length(value)",
         "transitions": "size(filter(sequence(1, greatest(length(_c), 2) - 1), i -> substring(_c, i, 1) <> substring(_c, i + 1, 1)))",
         "lowers": "length(regexp_replace(_c, '[^a]', ''))", "uppers": "length(regexp_replace(_c, '[^A]', ''))",
         "digits": "length(regexp_replace(_c, '[^0]', ''))", "others": "length(regexp_replace(_c, '[aA0]', ''))",
         "hex": "int(rlike(value, '^[0-9a-fA-F]+$'))", "distinct": "size(_kinds)",
         "entropy": "aggregate(transform(_kinds, k -> size(filter(_v, y -> y = k)) / size(_v)), 0D, (a, p) -> a - p * log2(p))",
         "longest_word": "coalesce(array_max(transform(regexp_extract_all(value, '[A-Za-z]+', 0), p -> length(p))), 0)",
         "coverage": "aggregate(filter(_parts, p -> array_contains(_dictionary, p)), 0D, (a, p) -> a + length(p)) / length(value)",
         "assigned": "int(name IS NOT NULL)", "named": f"int(coalesce(rlike(name, {_q('(?i)' + NAMES)}), false))",
         "prefixed": f"int(rlike(value, {_q(PREFIXES)}))", "placeholder": f"int(rlike(_low, '{PLACEHOLDERS}'))", "test_path": f"int(coalesce(rlike(lower(path), '{TEST_PATHS}'), false))",
         "names_near": f"size(regexp_extract_all(near, {_q('(?i)' + NAMES)}, 0))",
         "placeholders_near": f"size(regexp_extract_all(lower(near), '{PLACEHOLDERS}', 0))",
         "words_near": "size(regexp_extract_all(near, '[A-Za-z]{2,}', 0))"}
    return (c.select("_key", "path", "s", "e", "value", "name", *[F.expr(f"double({x})").alias(n) for n, x in e.items()]))


WEAK = """CASE WHEN named = 1 AND placeholder = 0 AND coverage < 0.3 AND entropy >= 3 AND digits > 0 AND length >= 16 THEN 1D
 WHEN placeholder = 0 AND placeholders_near = 0 AND coverage < 0.3 AND (prefixed = 1 OR
  (lowers > 0 AND uppers > 0 AND digits > 1 AND entropy >= 4 AND transitions >= 0.4 * length AND length >= 20)) THEN 1D
 WHEN named = 1 AND placeholder = 0 AND coverage < 0.3 AND longest_word < 12 AND digits > 0 AND lowers + uppers > 0 AND length >= 8 AND distinct > 5 THEN 1D
 WHEN placeholder = 1 OR coverage >= 0.6 OR (named = 0 AND (digits = length OR digits = 0 OR distinct <= 6 OR longest_word >= 16
  OR (hex = 0 AND uppers = 0 AND longest_word >= 5 AND digits <= 0.1 * length))) THEN 0D END"""


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
                labelled: DataFrame | None = None, max_rows: int = 20_000, dictionary_size: int = 2_000, trees: int = 20,
                depth: int = 6, limit: float = 0.5, seed: int = 3, max_broadcast: int = 1_000_000) -> DataFrame:
    """One row per candidate: (doc_id, s, e, name, value_sha256, probability,
    secret). Spans are code points of the value, without its quotes; the value
    itself is not returned.

    Null and empty texts have no candidates; repeated rows give repeated
    results; null ids stay null; a null path is no test path. With one kind of
    label only there is nothing to learn: candidates are then judged by their weak label alone
    (unlabelled ones count as secrets, since recall comes first), with a null probability."""
    spark = docs.sparkSession
    prepare(spark)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).cast("string").alias("_t"))
    key = F.concat_ws(":", F.xxhash64("_t"), F.xxhash64(F.lit(1), "_t"), F.length("_t"), "path")
    src = src.where("_t <> ''").withColumn("_key", key)
    c = written(candidates(src.select("_key", "path", "_t")), "secrets")
    c = written(described(c, dictionary_size).withColumn("label", F.expr(WEAK)), "described")
    ids = src.select("doc_id", "_key")
    if labelled is not None:
        told = (ids.join(labelled.select("doc_id", "s", "e", F.col("label").cast("double").alias("told")), "doc_id")
                .groupBy("_key", "s", "e").agg(F.max("told").alias("told")))
        c = written(c.drop("label").join(told, ["_key", "s", "e"], "left").withColumnRenamed("told", "label"), "described")
    order = F.xxhash64("_key", "s", F.lit(seed))
    sample = written(c.where("label IS NOT NULL").orderBy(order, "_key", "s").limit(max_rows), "findings")
    kinds = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(kinds) == 2:
        vec = VectorAssembler(inputCols=list(FEATURES), outputCol="_x", handleInvalid="keep")
        forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
        model = forest.fit(vec.transform(sample).select("_x", "label").coalesce(4))
        judged = model.transform(vec.transform(c.drop("label"))).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    else:
        judged = c.withColumn("probability", F.lit(None).cast("double"))
    judged = judged.withColumn("secret", F.coalesce(F.col("probability") >= limit, F.coalesce("label", F.lit(1.0)) > 0)
                               if len(kinds) < 2 else F.col("probability") >= limit)
    judged = written(judged.select("_key", "s", "e", "name", F.sha2("value", 256).alias("value_sha256"), "probability", "secret"), "judged")
    few = judged.limit(max_broadcast + 1).count() <= max_broadcast
    return (ids.join(F.broadcast(judged) if few else judged, "_key")
            .select("doc_id", "s", "e", "name", "value_sha256", "probability", "secret"))
