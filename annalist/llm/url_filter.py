"""Operator 8, URL filters with redirect equivalence. DataFrame functions only.

A rule is ``host/path``; it fits its host and all subdomains where the url's path starts with the rule's, and the longest
rule that fits decides. Urls that redirects or canonical links join are one resource: a url without a rule takes the
decision of its component, allow before block where aliases have both; without any, allow. A url's own rule always stands.

Components are found on the links alone, by distributed contraction; pages without a link never enter it. Few rules are one
expression; many are joined by the url's host and what it is a subdomain of, and by what its path begins with. A url that
very many pages share is not shuffled: its verdict is broadcast.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule, and is no alias. All canonical and
refresh links of a page count; relative ones, with or without a host, are resolved against the page's url. Links that are
empty or of a scheme without ``://`` (mailto:) are ignored. A link's target need not be a page; its rule counts all the same. Null html has no link.
Repeated rows give repeated rows. Fragments don't tell urls apart in links. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table, written
from .graph import connected_components
from .near_dedup import HOT

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Up to so many rules are compiled into one expression; more are joined.
COMPILED = 500

_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\s\"'>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\s\"'>]+)"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with the columns host and path."""
    x = F.coalesce(F.col(url), F.lit(""))
    rest = F.substring(x, F.instr(x, "://") + 3, F.length(x))
    rest = F.when(F.instr(x, "://") > 0, rest).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": lower_ascii(host), "path": path})


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, a struct of rule and verdict, or null."""
    out = None
    for rule, verdict in sorted(set(rules), key=_order):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _order(r: tuple[str, str]) -> tuple:
    return -len(r[0]), r


def with_rule(df: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """df (with host and path) and the columns rule and verdict, of the longest rule that fits, or null."""
    if len(set(rules)) <= COMPILED:
        return df.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_r.rule"), "verdict": F.col("_r.verdict")}).drop("_r")
    cut = [(r.partition("/")[0], "".join(r.partition("/")[1:]), r, v, n) for n, (r, v) in enumerate(sorted(set(rules), key=_order))]
    table_ = df.sparkSession.createDataFrame(cut, "_h string, _p string, rule string, verdict string, nth long")
    lengths = F.array(*[F.lit(n) for n in sorted({len(c[1]) for c in cut})])
    urls = df.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    begins = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.left("path", n))
    each = urls.withColumn("_h", F.explode(above)).withColumn("_p", F.explode(begins))
    found = each.join(table_, ["_h", "_p"]).groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "nth").alias("_r"))
    return df.join(found, ["host", "path"], "left").withColumns({"rule": F.col("_r.rule"), "verdict": F.col("_r.verdict")}).drop("_r").select(*df.columns, "rule", "verdict")


def resolved(base: Column, ref: Column) -> Column:
    """The url that a link (ref) of a page (base, with ``://``) leads to; null for a link of a scheme without ``://``."""
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    own, rest = F.regexp_extract(ref, r"(?s)^([^?#]*)", 1), F.regexp_extract(ref, r"(?s)^[^?#]*(.*)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    steps = F.split(F.substring(joined, F.lit(2), F.length(joined)), "/")
    last = F.element_at(steps, -1)
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    within = F.concat(site, F.lit("/"), F.concat_ws("/", kept), rest)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), ref)
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(own == "", F.concat(site, path, rest))
        .otherwise(within)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """src and dst, urls without fragment, of all canonical links and meta refreshes of each page."""
    to = [F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(x), F.lit(1)) for x in (_LINK, _REFRESH)]
    bare = lambda c: F.substring_index(c, "#", 1)
    e = pages.where("url like '%://%'").select(bare(F.col("url")).alias("src"), F.explode(F.concat(*to)).alias("d"))
    e = e.where("d <> ''").withColumn("ref", bare(F.regexp_replace("d", "&amp;", "&"))).where("ref <> ''")
    e = e.select("src", bare(resolved(F.col("src"), F.col("ref"))).alias("dst"))
    return e.where("src like '%://%' and dst like '%://%' and src <> dst").distinct()


def judge(pages: DataFrame, links: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict; links has src and dst."""
    p = with_rule(split_url(pages.select("page_id", "url")), rules)
    links = written(links, "links")
    if links.isEmpty():
        return p.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    roots = written(connected_components(links), "aliases")
    ruled = with_rule(split_url(roots.withColumnRenamed("node", "url")), rules).groupBy("root").agg(F.min("verdict").alias("v"))
    alias = roots.join(ruled.where("v is not null"), "root").select(F.col("node").alias("_u"), F.col("v").alias("of_alias"))
    p = p.withColumn("_u", F.substring_index("url", "#", 1))
    counts = written(p.groupBy("_u").agg(F.count(F.lit(1)).alias("n")).where("_u is not null"), "urls")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = written(counts.where(F.col("n") * HOT > total).select("_u").join(alias, "_u", "left"), "hot")  # HOT rows at most
    found = p.join(F.broadcast(hot), "_u").unionByName(p.join(F.broadcast(hot.select("_u")), "_u", "left_anti").join(alias, "_u", "left"))
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "of_alias", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, page_links(pages))
