"""Personal data in texts, in DataFrame functions and Spark ML only.

Base detectors (e-mail, ip, card, phone) are regular expressions with checks;
their spans always stand. The method adds to them: high-recall generators
propose overlapping candidate spans (numbers in card or phone shape without a
plus sign, obfuscated addresses, dotted or colon-separated addresses; national
phone numbers are judged where a word before them speaks of a call), boosted
trees judge each candidate from its format and its context, and a threshold
calibrated on held-out candidates selects the spans to add.

Labels come from the corpus itself: what the checks confirm (Luhn sum, parts
of at most 255, a complete domain, a plus sign) against look-alikes that the checks refuse.
The trees and the threshold come from all labelled candidates: equal feature
rows are counted and take part with their number as weight. Generation, checks
and scoring cover every text whole.

Positions are code points. A text's matches come from one extraction and one
split with the same expression, whose gaps give the positions; expressions use
possessive quantifiers and start at run boundaries, so that time is linear in
the text and no long run overflows the stack.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm.common import prepare, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: generators of further candidates, wide on purpose
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?: ?@ ?| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?:\G|(?<![0-9.]))[0-9]++(?:\.[0-9]++)++",
    "card": r"[0-9](?:[ ./_-]?[0-9])++",
    "phone": r"(?:\+|\b00)?[(0-9][ ().0-9/-]+[0-9]",
}
FEATURES = ("n_chars", "n_digits", "n_groups", "n_marks", "n_kinds_of_digit", "longest_digits", "luhn", "small_parts",
            "n_letters", "glued_before", "glued_after", "hint", "digits_near", "kind_no")
HINTS = (r"(?i)(mail|e-mail|correo|courriel|tel|phone|call|fon|mobil|ruf|llam|appel|card|karte|tarjeta|carte|visa|iban|"
         r"konto|ip|addr|host|server|contact|kontakt)[^\n]{0,12}$")


#: matches per block of ``found`` and ``in_blocks``
BLOCK = 128
_SPAN = "struct<s:int,e:int,m:string>"


def found(text: str, pattern: str) -> str:
    """SQL for the matches of ``pattern`` as array<struct<s, e, m>>, leftmost
    and without overlap, in code points.

    Positions are running sums of gap and match lengths, taken inside blocks of
    ``BLOCK`` matches and then over the blocks, so that appending to an array
    stays cheap however many matches a text has."""
    q = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    none = f"CAST(array() AS array<{_SPAN}>)"
    parts = f"CAST(array() AS array<struct<at:int,part:array<{_SPAN}>>>)"
    sized = (f"transform(array(named_struct('m', regexp_extract_all({text}, {q}, 0), 'g', split({text}, {q}, -1))), "
             f"y -> zip_with(y.m, slice(y.g, 1, size(y.m)), (p, r) -> named_struct('m', p, 'g', length(r), 'l', length(p))))")
    block = (f"aggregate(slice(z, k * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'out', {none}), (a, x) -> named_struct("
             f"'at', a.at + x.g + x.l, 'out', array_append(a.out, named_struct('s', a.at + x.g, 'e', a.at + x.g + x.l, 'm', x.m))))")
    placed = (f"aggregate(transform(sequence(0, int((size(z) - 1) div {BLOCK})), k -> {block}), named_struct('at', 0, 'out', {parts}), "
              f"(a, b) -> named_struct('at', a.at + b.at, 'out', array_append(a.out, named_struct('at', a.at, 'part', b.out))), a -> a.out)")
    return (f"CASE WHEN regexp_like({text}, {q}) THEN transform({sized}, z -> flatten(transform({placed}, "
            f"b -> transform(b.part, x -> named_struct('s', x.s + b.at, 'e', x.e + b.at, 'm', x.m)))))[0] ELSE {none} END")


def in_blocks(spans: str) -> str:
    """SQL: spans in order of their start as blocks (lo, hi, part), for ``meets``."""
    return (f"CASE WHEN size({spans}) > 0 THEN transform(sequence(0, int((size({spans}) - 1) div {BLOCK})), k -> "
            f"transform(array(slice({spans}, k * {BLOCK} + 1, {BLOCK})), p -> named_struct('lo', p[0].s, 'hi', element_at(p, -1).e, "
            f"'part', p))[0]) ELSE CAST(array() AS array<struct<lo:int,hi:int,part:array<{_SPAN}>>>) END")


def meets(blocks: str) -> str:
    """SQL: x shares a character with one of the spans of ``in_blocks``."""
    return f"exists({blocks}, k -> k.lo < x.e AND x.s < k.hi AND exists(k.part, b -> b.s < x.e AND x.s < b.e))"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(m: str) -> str:
    """SQL: the digits of ``m`` pass the Luhn sum."""
    d = f"reverse({digits(m)})"
    return (f"(aggregate(zip_with(split({d}, ''), sequence(0, greatest(length({d}) - 1, 0)), (c, i) -> "
            f"CASE WHEN c IS NULL OR c = '' THEN 0 WHEN i % 2 = 0 THEN ascii(c) - 48 WHEN c > '4' THEN 2 * (ascii(c) - 48) - 9 "
            f"ELSE 2 * (ascii(c) - 48) END), 0, (s, y) -> s + y) % 10 = 0)")


def small_parts(m: str) -> str:
    return (f"forall(transform(split({m}, '\\\\.'), p -> regexp_replace(p, '^0+', '')), p -> p = '' "
            f"OR (length(p) <= 3 AND coalesce(try_cast(p AS INT), 999) <= 255))")


def checked(kind: str) -> str:
    """SQL of the check of a base match x."""
    n = f"length({digits('x.m')})"
    return {"email": "true", "ip": small_parts("x.m"), "card": f"{n} BETWEEN 16 AND 19 AND {luhn('x.m')}",
            "phone": f"{n} BETWEEN 8 AND 15"}[kind]


#: words before a national number
PHONE_HINT = r"(?i)\b(tel|phone|call|fon|fax|mobil|ruf|llam|appel|contact|kontakt)[^\n]{0,12}$"
DATE = r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})(?![0-9])"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plausible(kind: str) -> str:
    """SQL: what any candidate x of the kind must be, whatever its marks. A
    number in phone shape contradicts the kind by its count of digits, by
    letters or digits glued to it, or as a date."""
    n = f"length({digits('x.m')})"
    return {"email": "rlike(x.m, '[A-Za-z0-9](\\\\.| ?.dot. ?)[A-Za-z]{2,}$')",
            "ip": f"rlike(x.m, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AND {small_parts('x.m')} OR x.m LIKE '%:%:%:%'",
            "card": f"{n} BETWEEN 16 AND 19 AND {luhn('x.m')}",
            "phone": f"{n} BETWEEN 8 AND 15 AND NOT rlike(x.before, '[A-Za-z0-9]$') AND NOT rlike(x.after, '^[A-Za-z0-9]') "
                     f"AND NOT rlike(x.m, {quoted(DATE)})"}[kind]


def proposed(kind: str) -> str:
    """SQL: match x is put before the trees. A number in phone shape needs a
    start (+, 00, a bracket) or a word before it that speaks of a call; it is
    then judged without these, so that the trees see both forms alike."""
    return f"rlike(x.m, '^([+]|00|[(])') OR rlike(x.before, {quoted(PHONE_HINT)})" if kind == "phone" else "true"


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one array of (s, e, m) per kind: ``_email`` ... ``_phone``."""
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", F.expr(found(text, BASE[kind])))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, x -> {checked(kind)})"))
    return df


def candidates(df: DataFrame, text: str) -> DataFrame:
    """One row per candidate: (_key, kind, s, e, features..., label). Label 1:
    a base span of the kind; 0: a look-alike that fails what any datum of the
    kind fulfils; null: left for the trees to judge."""
    for kind in KINDS:
        df = df.withColumn(f"_{kind}_in", F.expr(in_blocks(f"_{kind}")))
    arrays = []
    for kind in KINDS:
        others = " OR ".join(meets(f"_{k}_in") for k in KINDS if k != kind)
        # a phone's sign and country code are masked, they are what its label comes from; its separators count alike
        shown = ("trim(regexp_replace(regexp_replace(regexp_replace(x.m, '^([+]|00)[0-9]{1,3}[ .-]+(?=[(0-9])', ''), '^[+]', ''), '[^0-9]+', ' '))"
                 if kind == "phone" else "x.m")
        refused = f"NOT ({plausible(kind)})" + (f" OR {others}" if kind == "phone" else "")
        arrays.append(f"transform(filter(transform({found(text, WIDE[kind])}, x -> named_struct('s', x.s, 'e', x.e, 'm', x.m, "
                      f"'before', substring({text}, greatest(x.s - 23, 1), least(x.s, 24)), "
                      f"'after', substring({text}, x.e + 1, 12))), x -> {proposed(kind)}), x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'm', {shown}, "
                      f"'label', CASE WHEN {meets(f'_{kind}_in')} THEN 1 WHEN {refused} THEN 0 END, "
                      f"'over', {meets(f'_{kind}_in')} OR {others}, 'before', x.before, 'after', x.after))")
    # explode_outer: an inferred filter on the array would repeat the base detectors per candidate
    c = df.select("_key", F.explode_outer(F.expr(f"concat({', '.join(arrays)})")).alias("c")).select("_key", "c.*")
    c = c.where("kind IN ('email', 'ip') OR length(regexp_replace(m, '[^0-9]', '')) >= 7")
    e = {"n_chars": "length(m)", "n_digits": f"length({digits('m')})",
         "n_groups": "size(regexp_extract_all(m, '[0-9]+', 0))", "n_marks": "length(regexp_replace(m, '[0-9A-Za-z]', ''))",
         "n_kinds_of_digit": f"size(array_distinct(split({digits('m')}, '')))",
         "longest_digits": "coalesce(array_max(transform(split(m, '[^0-9]+'), p -> length(p))), 0)",
         "luhn": f"int({luhn('m')})", "small_parts": f"int({small_parts('m')})",
         "n_letters": "length(regexp_replace(m, '[^A-Za-z]', ''))",
         "glued_before": "int(rlike(before, '[A-Za-z0-9]$'))", "glued_after": "int(rlike(after, '^[A-Za-z0-9]'))",
         "hint": f"int(kind <> 'phone' AND rlike(before, '{HINTS.replace(chr(92), chr(92) * 2)}'))",
         "digits_near": f"length({digits('before')}) + length({digits('after')})",
         "kind_no": "CASE kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 ELSE 3 END"}
    return c.select("_key", "kind", "s", "e", "label", "over", *[F.expr(f"double({x})").alias(n) for n, x in e.items()])


def boosted_extra(cand: DataFrame, precision: float = 0.98, rounds: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """Candidates that the boosted trees add: (_key, kind, s, e). Trees are fitted on four
    hash folds of all labelled candidates, equal ones as one row with their number as
    weight; the threshold is the least probability at which the fifth fold reaches ``precision``.
    Candidates over a base span are never added again. With one label only,
    or no threshold that reaches the precision, nothing is added."""
    order = F.xxhash64("_key", "kind", "s", F.lit(seed))
    known = written(cand.where("label IS NOT NULL").withColumn("_held", F.pmod(order, F.lit(5)) == 0)
                    .groupBy("label", "_held", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("_n")), "candidates")
    labels = {(r["label"], r["_held"]) for r in known.select("label", "_held").distinct().collect()}
    none = cand.select("_key", "kind", "s", "e").limit(0)
    if not {(0, False), (1, False), (1, True)} <= labels:
        return none
    vec = VectorAssembler(inputCols=list(FEATURES), outputCol="_x", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_n", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.2)
    model = gbt.fit(vec.transform(known.where("NOT _held")).select("_x", F.col("label").cast("double").alias("label"), "_n"))

    def score(df):
        return (model.transform(vec.transform(df.withColumnRenamed("label", "_label")))
                .withColumn("p", F.round(vector_to_array("probability")[1], 3)))
    held = score(known.where("_held")).groupBy("p").agg(F.sum(F.col("_label") * F.col("_n")).alias("good"), F.sum("_n").alias("n"))
    good = n = 0
    cut = None
    for r in sorted(held.collect(), key=lambda r: -r["p"]):     # at most 1001 rounded probabilities
        good, n = good + r["good"], n + r["n"]
        if good >= precision * n:
            cut = r["p"]
    if cut is None or cut <= 0.5:
        cut = max(cut or 2.0, 0.5)
    return score(cand.where("label IS NULL AND NOT over")).where(F.col("p") >= cut).select("_key", "kind", "s", "e")


def personal_data(docs: DataFrame, text_col: str = "text", carry=None, max_broadcast: int = 1_000_000,
                  redact: bool = False, **fit) -> DataFrame:
    """``docs`` (its columns ``carry``, all by default) with a struct column
    ``pii``: ``base`` and ``spans``, arrays of (kind_no, s, e, kind) in order
    of kind and start; ``spans`` holds the base spans and the added ones. With
    ``redact``, the text column has every span (overlaps merged) replaced by
    ``[KIND]``.

    Null and empty texts have no spans (a null text stays null). Equal texts get equal spans, so
    repeated rows, null ids and ties need no rule; a column ``pii`` of the
    input is replaced."""
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in (carry or docs.columns) if c.lower() != "pii"]
    src = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    # the text itself names its candidates, 128 bits
    src = src.withColumn("_key", F.concat_ws(":", F.xxhash64("_t"), F.xxhash64(F.lit(1), "_t"), F.length("_t")))
    cand = written(candidates(base_spans(src.select("_key", "_t"), "_t"), "_t").distinct(), "spans")
    extra = boosted_extra(cand, **fit)
    extra = written(extra.groupBy(F.col("_key").alias("_text_key")).agg(
        F.collect_set(F.struct("kind", "s", "e")).alias("_more")), "extra")
    few = extra.limit(max_broadcast + 1).count() <= max_broadcast
    df = base_spans(src, "_t")
    as_span = ", ".join(f"transform(_{kind}, x -> named_struct('kind_no', {i}, 's', x.s, 'e', x.e, 'kind', '{kind}'))"
                        for i, kind in enumerate(KINDS))
    df = df.withColumn("_base", F.expr(f"concat({as_span})")).drop(*[f"_{kind}" for kind in KINDS])
    df = df.join(F.broadcast(extra) if few else extra, F.col("_key") == F.col("_text_key"), "left")
    number = "array_position(array({}), x.kind)".format(", ".join(f"'{x}'" for x in KINDS))
    df = df.withColumn("_all", F.expr(
        f"sort_array(concat(_base, coalesce(transform(_more, x -> named_struct('kind_no', int({number}) - 1, "
        f"'s', x.s, 'e', x.e, 'kind', x.kind)), CAST(array() AS array<struct<kind_no:int,s:int,e:int,kind:string>>))))"))
    out = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)]
    if redact:
        by_place = "sort_array(transform(_all, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
        clean = F.expr(
            f"CASE WHEN size(_all) = 0 THEN _t ELSE aggregate({by_place}, named_struct('at', 0, 'out', ''), (a, x) -> CASE "
            f"WHEN x.s >= a.at THEN named_struct('at', x.e, 'out', concat(a.out, substring(_t, a.at + 1, x.s - a.at), "
            f"'[', upper(x.kind), ']')) ELSE named_struct('at', greatest(a.at, x.e), 'out', a.out) END, "
            f"a -> concat(a.out, substring(_t, a.at + 1))) END")
        out = [F.when(F.col(f"_{i}").isNotNull(), clean).alias(c) if c == text_col else F.col(f"_{i}").alias(c)
               for i, c in enumerate(keep)]
    return df.select(*out, F.struct(F.col("_base").alias("base"), F.col("_all").alias("spans")).alias("pii"))
