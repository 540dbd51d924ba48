"""URL verdicts: block and allow rules on hosts and paths, and their spread
over redirects.

URLs that redirect to each other or name each other as canonical are aliases:
connected components over those edges, found by distributed contraction. A
rule's own verdict on a URL always stands. A URL without a rule of its own
takes its component's: allowed if any alias is explicitly allowed (allow has
precedence over block), blocked if any alias is blocked, else allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm.common import connected_components, prepare, written

#: (rule, verdict); a rule is host/path-start
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``host`` and ``path`` of the URL: after the first ``://``
    up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end.
    Both are empty for null URLs and URLs without ``://``."""
    rest = F.coalesce(F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) END"), F.lit(""))
    df = df.withColumn("_rest", rest)
    return (df.withColumn("host", _lower(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("_rest"))


def judge(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (with host and path) with ``rule`` and ``rule_verdict`` of the
    longest rule that fits: its host or a subdomain, and a path that starts
    with the rule's (an empty path starts with no rule's). Ties of
    length go to allow, then to the lesser rule. The rules are a short given
    list and become one expression; long lists belong in a table joined on the
    host's suffixes."""
    path = F.col("path")
    rule = verdict = None
    for r, v in sorted(rules, key=lambda x: (-len(x[0]), x[1] != "allow", x[0])):
        h, p = r.split("/", 1)
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def alias_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b) URL pairs that pages state: canonical links and immediate
    redirects (meta refresh with an address). Relative addresses are resolved
    against the page's URL; fragments are cut."""
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
    tag2 = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    href = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
    refresh = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
    found = F.concat(*[F.expr(f"transform(regexp_extract_all({html}, {_q(t)}, 0), x -> regexp_extract(x, {_q(g)}, 1))")
                       for t, g in ((tag, href), (tag2, refresh))])
    e = (pages.where(F.col(html).isNotNull() & F.col(url).isNotNull() & (F.locate("://", F.col(url)) > 0))
         .select(F.col(url).alias("u"), F.explode_outer(found).alias("to")).where("to IS NOT NULL AND to <> ''"))
    to = F.regexp_replace("to", "&amp;", "&")
    origin = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("u", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    scheme = F.regexp_extract("u", r"(?s)^(.*?:)//", 1)
    full = (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, to))
            .when(to.startswith("/"), F.concat(origin, to))
            .when(to.startswith("?"), F.concat(F.regexp_extract("u", r"(?s)^([^?#]*)", 1), to))
            .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), to)))
    return e.select(F.col("u").alias("a"), full.alias("b"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def node(url):
    """Identity of a URL: without scheme and fragment, host lower-cased."""
    c = F.col(url)
    rest = F.regexp_replace(F.regexp_replace(c, r"(?s)^.*?://", ""), r"(?s)#.*$", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)
    tail = F.regexp_replace(rest, r"(?s)^[^/?]*", "")
    return F.concat(_lower(host), F.when(tail == "", "/").otherwise(tail))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, component_id).

    ``redirects`` may add edges (columns a, b: URLs), for example from crawl
    logs. ``component_id`` is the least alias, null for URLs that are in no
    edge. Null URLs and URLs without ``://`` have no rule and no aliases and are allowed; null html
    has no edges. Repeated rows give repeated result rows; an empty table
    none; other columns are ignored."""
    spark = pages.sparkSession
    prepare(spark)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    edges = alias_edges(p, "url", "html")
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("a").cast("string"), F.col("b").cast("string")))
    edges = written(edges.where("locate('://', a) > 0 AND locate('://', b) > 0"), "edges")
    linked = edges.select(node("a").alias("a"), node("b").alias("b"))
    base = judge(parts(p.select("page_id", "url"), "url"), rules)
    if linked.isEmpty():
        return base.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("string").alias("component_id"))
    comp = written(connected_components(linked), "aliases")
    # every URL of an edge is judged, whether or not it is a page of the table
    urls = edges.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    told = judge(parts(urls, "url"), rules).where("rule IS NOT NULL").select(node("url").alias("node"), "rule_verdict")
    # many-to-one aggregation (max), partial before the shuffle: a component of any size is no hot group
    verdicts = written(comp.join(told, "node").groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("allowed")), "verdicts")
    known = comp.join(verdicts, "component", "left").select("node", "component", "allowed")
    judged = base.withColumn("node", F.when(F.locate("://", F.col("url")) > 0, node("url"))).join(known, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("allowed"), "allow").when(~F.col("allowed"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("component_id"))
