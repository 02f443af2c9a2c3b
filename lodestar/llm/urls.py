"""URL filters: host rules, and a tree of path templates judged by labelled purity.

For each host, path segments are generalised: digits and long hexadecimal words
become wildcards by their form, and below a node of the tree with too many
children, or mostly rare ones, the rare children become one wildcard; children
with ``RARE_FROM`` urls or more stay apart however many siblings they have.
Sibling templates whose share of bad labels does not differ significantly from
that of their siblings together are merged and share their labels. A template is
rejected when the smoothed share of good labels is below ``LEAST_PURITY``: the
share is smoothed towards that of its host, the host's towards that of all hosts.

Defined cases: a null url or one without ``://`` has an empty host and path and
is judged by the method like a host of its own; empty segments do not count;
paths deeper than ``MAX_DEPTH`` share one wildcard for their rest; without labels
everything the rules do not block is allowed; labels without an id or a value are
not used; repeated rows are judged each and count each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import join_sized, stage
from .common import table

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Children of a node of the template tree that may stay apart though they are rare.
MAX_BRANCHES = 32
#: With so many urls below a node, most children must come more than once; a child with so many is not rare.
RARE_FROM = 20
MAX_DEPTH = 12
#: Two-sided 5 % point of the normal distribution.
SIGNIFICANT = 1.96
#: Weight, in labels, of the purity of what is above.
SMOOTHING = 10.0
LEAST_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule (host, path, verdict) that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """Path segments with what is variable by its form replaced."""

    def shape(s: Column) -> Column:
        hexadecimal = F.rlike(s, F.lit(r"^[0-9A-Fa-f-]{8,}(\.\w+)?$")) & F.rlike(s, F.lit("[0-9]"))
        return F.when(hexadecimal & ~F.rlike(s, F.lit(r"^[0-9]+(\.\w+)?$")), F.regexp_replace(s, r"^[0-9A-Fa-f-]{8,}", "{hex}")).otherwise(
            F.regexp_replace(s, "[0-9]+", "{n}")
        )

    found = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    deep = F.concat(F.slice(found, 1, MAX_DEPTH), F.array(F.lit("{rest}")))
    return F.when(F.size(found) > MAX_DEPTH, deep).otherwise(found)


def templates(leaves: DataFrame) -> DataFrame:
    """Add ``template`` to the leaves ``(host, parts, n, good, bad)``, level by level of the tree."""
    tree = leaves.withColumn("template", F.array().cast("array<string>"))
    depth = leaves.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(depth):
        child = F.get("parts", F.lit(level))
        below = tree.where(F.size("parts") > level)
        children = below.groupBy("host", "template", child.alias("child")).agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("_d"), F.sum("n").alias("_n"))
        wide = nodes.where((F.col("_d") > MAX_BRANCHES) | ((F.col("_n") >= RARE_FROM) & (2 * F.col("_d") > F.col("_n"))))
        wide = stage(wide.select("host", "template", F.lit(True).alias("_wide")))
        fixed = children.where(F.col("n") >= RARE_FROM).join(wide.drop("_wide"), ["host", "template"], "left_semi")
        fixed = fixed.select("host", "template", F.col("child").alias("_child"), F.lit(True).alias("_fixed"))
        marked = tree.withColumn("_child", child).join(wide, ["host", "template"], "left").join(fixed, ["host", "template", "_child"], "left")
        joined = F.col("_wide") & F.col("_fixed").isNull()
        step = F.when(child.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.when(joined, F.lit("{*}")).otherwise(child)))
        tree = stage(marked.withColumn("template", F.concat("template", step)).select(*leaves.columns, "template"))
    return tree


def purities(tree: DataFrame) -> DataFrame:
    """``(host, template, purity)`` of each template after merging and smoothing."""
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    found = tree.groupBy("host", "template").agg(*sums)
    found = found.withColumn("parent", F.slice("template", 1, F.greatest(F.size("template") - 1, F.lit(0))))
    siblings = found.groupBy("host", "parent").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    hosts = found.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    every = found.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    all_good, all_bad = every["good"] or 0, every["bad"] or 0
    rows = found.join(siblings, ["host", "parent"]).join(hosts, "host")
    n, rest = F.col("good") + F.col("bad"), F.col("_g") + F.col("_b") - F.col("good") - F.col("bad")
    share = F.try_divide(F.col("_b"), F.col("_g") + F.col("_b"))
    spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest)))
    z = F.try_divide(F.try_divide(F.col("bad"), n) - F.try_divide(F.col("_b") - F.col("bad"), rest), spread)
    # Without a difference that could be tested, there is none.
    rows = rows.withColumn("merged", F.abs(F.coalesce(z, F.lit(0.0))) < SIGNIFICANT)
    pooled = rows.where("merged").groupBy("host", "parent").agg(F.sum("good").alias("_pg"), F.sum("bad").alias("_pb"))
    rows = rows.join(pooled, ["host", "parent"], "left")
    good = F.when(F.col("merged"), F.col("_pg")).otherwise(F.col("good"))
    bad = F.when(F.col("merged"), F.col("_pb")).otherwise(F.col("bad"))
    overall = (all_good + 1.0) / (all_good + all_bad + 1.0)
    host = (F.col("host_good") + F.lit(SMOOTHING * overall)) / (F.col("host_good") + F.col("host_bad") + SMOOTHING)
    return rows.select("host", "template", ((good + SMOOTHING * host) / (good + bad + SMOOTHING)).alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` for pages ``(page_id, url)``.

    ``labels`` is ``(page_id, good)``, a boolean; pages with contradicting labels count as bad.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = named.withColumns({"rule": rule, "_ruled": ruled, "parts": segments(F.col("path"))})
    known = labels.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    parsed = stage(parsed)
    labelled = parsed.join(known, "page_id", "left")
    leaves = stage(
        labelled.groupBy("host", "parts").agg(
            F.count("*").alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")
        )
    )
    tree = templates(leaves)
    judged = tree.select("host", "parts", "n", "template").join(purities(tree), ["host", "template"])
    total = parsed.count()
    rows = join_sized(parsed, judged, ["host", "parts"], "n", total)
    own = F.when(F.col("purity") < LEAST_PURITY, F.lit("block")).otherwise(F.lit("allow"))
    template = F.concat(F.lit("/"), F.concat_ws("/", "template"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_ruled", own).alias("verdict"), template.alias("template"), "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages from those of documents ``(doc_id, quality, toxic)``: the last number of a path names its document."""
    _, path = host_and_path(F.col("url"))
    document = F.element_at(F.regexp_extract_all(path, F.lit(r"([0-9]{1,18})"), F.lit(1)), -1)
    named = pages.select("page_id", F.when(F.rlike(path, F.lit("[0-9]")), document).cast("long").alias("doc_id"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return named.join(labels.select("doc_id", good.alias("good")), "doc_id").select("page_id", "good")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, page_labels(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


# Levels of the tree that the SQL twin unrolls: all, with the wildcard of deeper ones.
SQL_LEVELS = MAX_DEPTH + 1


def _sql() -> str:
    rule, verdict = "NULL", "NULL"
    for host, path, decision in sorted(RULES, key=lambda r: (len(r[0] + r[1]), r)):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{decision}' ELSE {verdict} END"
    levels = "".join(
        f"""
c{k} AS MATERIALIZED (SELECT host, template, parts[{k + 1}] AS child, sum(n) AS n FROM t{k} WHERE len(parts) > {k} GROUP BY ALL),
n{k} AS MATERIALIZED (SELECT host, template FROM c{k} GROUP BY ALL
         HAVING count(*) > {MAX_BRANCHES} OR (sum(n) >= {RARE_FROM} AND 2 * count(*) > sum(n))),
x{k} AS MATERIALIZED (SELECT c.* FROM c{k} c JOIN n{k} w ON w.host = c.host AND w.template = c.template WHERE c.n >= {RARE_FROM}),
t{k + 1} AS MATERIALIZED (
  SELECT t.host, parts, t.n, good, bad,
         list_concat(t.template, CASE WHEN len(parts) <= {k} THEN CAST([] AS VARCHAR[])
                                      WHEN w.host IS NOT NULL AND x.host IS NULL THEN ['{{*}}'] ELSE [parts[{k + 1}]] END) AS template
  FROM t{k} t LEFT JOIN n{k} w ON w.host = t.host AND w.template = t.template
  LEFT JOIN x{k} x ON x.host = t.host AND x.template = t.template AND x.child = parts[{k + 1}]),"""
        for k in range(SQL_LEVELS)
    )
    return rf"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
shaped AS (
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
           CASE WHEN regexp_matches(s, '^[0-9A-Fa-f-]{{8,}}(\.\w+)?$') AND regexp_matches(s, '[0-9]')
                     AND NOT regexp_matches(s, '^[0-9]+(\.\w+)?$') THEN regexp_replace(s, '^[0-9A-Fa-f-]{{8,}}', '{{hex}}')
                ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) AS parts FROM h),
parsed AS (
  SELECT page_id, host, path, rule, ruled,
         CASE WHEN len(parts) > {MAX_DEPTH} THEN list_append(parts[:{MAX_DEPTH}], '{{rest}}') ELSE parts END AS parts FROM shaped),
known AS (
  SELECT page_id, bool_and(quality = 1 AND coalesce(toxic, 0) = 0) AS good
  FROM h JOIN labels ON labels.doc_id = CAST(regexp_extract_all(path, '([0-9]{{1,18}})', 1)[-1] AS BIGINT)
  WHERE quality IS NOT NULL GROUP BY page_id),
t0 AS MATERIALIZED (
  SELECT host, parts, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad,
         CAST([] AS VARCHAR[]) AS template
  FROM parsed LEFT JOIN known USING (page_id) GROUP BY host, parts),{levels}
f AS (SELECT host, template, template[:-2] AS parent, sum(good) AS good, sum(bad) AS bad FROM t{SQL_LEVELS} GROUP BY ALL),
siblings AS (SELECT host, parent, sum(good) AS g, sum(bad) AS b FROM f GROUP BY ALL),
hosts AS (SELECT host, sum(good) AS hg, sum(bad) AS hb FROM f GROUP BY host),
every AS (SELECT (sum(good) + 1.0) / (sum(good) + sum(bad) + 1.0) AS overall FROM f),
z AS (
  SELECT f.*, hg, hb,
         (bad / (good + bad) - (b - bad) / (g + b - good - bad))
           / nullif(sqrt((b / (g + b)) * (1 - b / (g + b)) * (1.0 / (good + bad) + 1.0 / (g + b - good - bad))), 0) AS z
  FROM f JOIN siblings USING (host, parent) JOIN hosts USING (host)),
m AS (SELECT *, NOT coalesce(isfinite(z) AND abs(z) >= {SIGNIFICANT}, false) AS merged FROM z),
pooled AS (SELECT host, parent, sum(good) AS pg, sum(bad) AS pb FROM m WHERE merged GROUP BY ALL),
judged AS (
  SELECT m.host, m.template,
         ((CASE WHEN merged THEN pg ELSE good END) + {SMOOTHING} * (hg + {SMOOTHING} * overall) / (hg + hb + {SMOOTHING}))
           / ((CASE WHEN merged THEN pg + pb ELSE good + bad END) + {SMOOTHING}) AS purity
  FROM m LEFT JOIN pooled USING (host, parent), every)
SELECT page_id, c.host, path, rule, coalesce(ruled, CASE WHEN purity < {LEAST_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       '/' || array_to_string(t.template, '/') AS template
FROM parsed c JOIN t{SQL_LEVELS} t ON t.host = c.host AND t.parts = c.parts
JOIN judged j ON j.host = t.host AND j.template = t.template"""


OP8_SQL = _sql()
