"""URL filters: longest-rule verdicts, and a path-template tree for the urls that no rule fits.

Plan.  A url's path is generalised segment by segment (numbers, dates, hex, slugs), so urls of a host fall into shapes, and
counts by (host, shape), staged once, are all that later steps read: a host with a third of all pages is combined before
any shuffle.  Shapes of a host are a tree, walked from its root a level a round.  Under one parent, labelled branches that a
two-proportion test can't tell from their siblings merge into '*', those that are purer into '*+', those less pure into
'*-', and rare branches under a parent with very many into '*'; the children of what merged are pooled in the next round.
Shapes that share their place with no other leave the walk, so rounds are as many as the levels on which hosts branch.
A template's purity is its share of allowed labelled pages, smoothed to the share of its shapes over all hosts and to its
host's; impure templates are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quandrel.llm.staging import staged

#: Rules of the query: action and pattern, host then path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A table of at most so many (host, shape) rows is broadcast.
BROADCAST_ROWS = 200_000
FANOUT, RARE, Z, WEIGHT, LEAST_PURITY = 20, 0.05, 1.96, 5.0, 0.5
#: Shares are kept in millionths, so that sums of them don't depend on their order.
SCALE = 1_000_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.when(F.octet_length(host) == F.length(host), F.lower(host)).otherwise(F.translate(host, UPPER, UPPER.lower()))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def longest_rule(rules, host: Column, path: Column) -> Column:
    """The longest rule that fits, a struct (length, rule, action), or null.  A rule list is a parameter, so it is a literal."""
    if not rules:
        return F.lit(None).cast("struct<length: int, rule: string, action: string>")
    table = F.array(*(F.struct(F.lit(len(p)).alias("length"), F.lit(p).alias("rule"), F.lit(a).alias("action")) for a, p in rules))
    rule_host = lambda r: F.substring_index(r["rule"], "/", 1)
    fits = lambda r: ((host == rule_host(r)) | F.endswith(host, F.concat(F.lit("."), rule_host(r)))) & F.startswith(path, F.substring(r["rule"], F.length(rule_host(r)) + 1, F.length(r["rule"])))
    return F.array_max(F.filter(table, fits))


def general(segment: Column) -> Column:
    return (
        F.when(segment.rlike("^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(segment.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(segment.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
        .when((segment.rlike("[0-9]") & (F.length(segment) >= 12)) | (F.length(segment) > 40), F.lit("{slug}"))
        .otherwise(segment)
    )


def segments_of(path: Column) -> Column:
    """Generalised segments, all of them."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), general)


def named(rows: DataFrame) -> DataFrame:
    """``rows`` (host, prefix, segs, n, good, bad, ...) with the name of their first segment under (host, prefix)."""
    rows = rows.withColumn("seg", F.col("segs")[0])
    branch = rows.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("bn"), F.sum("good").alias("bg"), F.sum("bad").alias("bb"))
    parent = branch.groupBy("host", "prefix").agg(F.sum("bn").alias("pn"), F.sum("bg").alias("pg"), F.sum("bb").alias("pb"), F.count("*").alias("branches"))
    m, all_m = F.col("bg") + F.col("bb"), F.col("pg") + F.col("pb")
    one, rest, share = F.col("bg") / m, (F.col("pg") - F.col("bg")) / (all_m - m), F.col("pg") / all_m
    apart = F.abs(one - rest) > Z * F.sqrt(share * (1 - share) * (1 / m + 1 / (all_m - m)))
    rare = (F.col("branches") > FANOUT) & (F.col("bn") < RARE * F.col("pn"))
    known = (m > 0) & (all_m > m)
    kind = F.when(F.startswith("seg", F.lit("{")), F.lit(None)).when(rare, "*").when(~known, F.lit(None)).when(~apart, "*").when(one > rest, "*+").otherwise("*-")
    classed = branch.join(parent, ["host", "prefix"]).select("host", "prefix", "seg", kind.alias("kind"))
    sizes = classed.filter("kind is not null").groupBy("host", "prefix", "kind").agg(F.count("*").alias("together"))
    names = classed.join(sizes, ["host", "prefix", "kind"], "left").select("host", "prefix", "seg", F.when(F.col("together") > 1, F.col("kind")).otherwise(F.col("seg")).alias("name"))
    return rows.join(names, ["host", "prefix", "seg"]).drop("seg")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) for ``shapes`` (host, shape, segs, n, good, bad): the tree's merges."""
    now, done = shapes.select("host", "shape", "n", "good", "bad", "segs", F.lit("").alias("prefix")), []
    while True:
        alone = now.groupBy("host", "prefix").agg(F.count("*").alias("shapes"))
        marked = staged(now.join(alone, ["host", "prefix"]).withColumn("over", (F.col("shapes") == 1) | (F.size("segs") == 0)).drop("shapes"), "level")
        ending = F.array_join(F.concat(F.array("prefix"), F.col("segs")), "/")
        done.append(marked.filter("over").select("host", "shape", F.when(ending == "", "/").otherwise(ending).alias("template")))
        going = marked.filter("not over").drop("over")
        if going.isEmpty():
            break
        now = named(going).select("host", "shape", "n", "good", "bad", F.slice("segs", 2, F.size("segs")).alias("segs"), F.concat("prefix", F.lit("/"), "name").alias("prefix"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def millionths(good: Column, all_: Column, prior) -> Column:
    """good of all_ with WEIGHT more at the share ``prior``, in millionths."""
    return F.round((good + WEIGHT * prior) / (all_ + WEIGHT) * SCALE).cast("long")


def template_purity(shapes: DataFrame, placed: DataFrame) -> DataFrame:
    """(host, template, purity) from ``shapes`` and ``placed`` (host, shape, template)."""
    total = shapes.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (total.good + 1) / (total.good + total.bad + 2)
    g, m = F.sum("good"), F.sum("good") + F.sum("bad")
    anywhere = shapes.groupBy("shape").agg(millionths(g, m, overall).alias("anywhere"))
    hosts = shapes.groupBy("host").agg(millionths(g, m, overall).alias("of_host"), m.alias("host_m"))
    rows = shapes.join(placed, ["host", "shape"]).join(anywhere, "shape")
    by = rows.groupBy("host", "template").agg(g.alias("good"), m.alias("m"), (F.sum(F.col("n") * F.col("anywhere")) / F.sum("n") / SCALE).alias("elsewhere")).join(hosts, "host")
    host_weight = WEIGHT * F.col("host_m") / (F.col("host_m") + WEIGHT)
    purity = (F.col("good") + WEIGHT * F.col("elsewhere") + host_weight * F.col("of_host") / SCALE) / (F.col("m") + WEIGHT + host_weight)
    return by.select("host", "template", F.round(purity, 6).alias("purity"))


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity added.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest that fits decides.  Where none
    fits, the verdict is that of the url's template.  ``labels`` (host, path, good) are the labelled urls; without them, the
    pages that a rule decides are.  template and purity are null where a rule decides.

    Null urls and urls without '://' have an empty host and path, and the template '/' of that host.  Rows that repeat a
    url count each.  Without any label every purity is 0.5 and the verdict allow.  Paths of any depth are read whole.
    Columns of those six names are replaced, all others pass through, for the work is done beside them.
    """
    added = ("host", "path", "rule", "verdict", "template", "purity")
    columns = [c for c in pages.columns if c not in added]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    mine = pages.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("page"), host.alias("host"), path.alias("path"))
    mine = mine.withColumn("fits", longest_rule(rules, F.col("host"), F.col("path"))).withColumn("segs", segments_of(F.col("path")))
    keyed = mine.select("page", "host", "path", "fits", F.array_join(F.concat(F.array(F.lit("")), F.col("segs")), "/").alias("shape"))
    if labels is None:
        good, bad = F.col("fits.action") == "allow", F.col("fits.action") == "block"
        counted = keyed.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    else:
        marked = labels.select("host", F.array_join(F.concat(F.array(F.lit("")), segments_of(F.col("path"))), "/").alias("shape"), F.lit(0).alias("one"), F.col("good").cast("int").alias("g"), (1 - F.col("good").cast("int")).alias("b"))
        rows = keyed.select("host", "shape", F.lit(1).alias("one"), F.lit(0).alias("g"), F.lit(0).alias("b")).unionByName(marked)
        counted = rows.groupBy("host", "shape").agg(F.sum("one").alias("n"), F.sum("g").alias("good"), F.sum("b").alias("bad")).filter("n > 0 or good + bad > 0")
    segs = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("shape", 2, 2**31 - 1), "/", -1))
    shapes = staged(counted.withColumn("segs", segs), "shapes")
    placed = staged(templates(shapes), "placed")
    table = placed.join(template_purity(shapes, placed), ["host", "template"]).select(F.col("host").alias("of_host"), F.col("shape").alias("of_shape"), "template", "purity")
    small = shapes.count() <= BROADCAST_ROWS
    found = keyed.join(F.broadcast(table) if small else table, (F.col("host") == F.col("of_host")) & (F.col("shape") == F.col("of_shape")), "left")
    free = F.col("fits").isNull()
    return found.select(
        "page.*",
        "host",
        "path",
        F.col("fits.rule").alias("rule"),
        F.when(~free, F.col("fits.action")).when(F.col("purity") >= LEAST_PURITY, "allow").otherwise("block").alias("verdict"),
        F.when(free, F.col("template")).alias("template"),
        F.when(free, F.col("purity")).alias("purity"),
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


OP2_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS id FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(action, rh, rp)),
fit AS (
  SELECT id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY id),
cut AS (
  SELECT id, [CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}'
      WHEN regexp_matches(s, '^[0-9]+\.[A-Za-z0-9]{1,5}$') THEN '{n}' || regexp_extract(s, '(\.[A-Za-z0-9]+)$', 1)
      WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') THEN '{date}'
      WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}$') THEN '{hex}'
      WHEN (regexp_matches(s, '[0-9]') AND length(s) >= 12) OR length(s) > 40 THEN '{slug}' ELSE s END FOR s IN string_split(path, '/') IF s <> ''] AS segs
  FROM p),
page AS (SELECT p.*, segs, array_to_string(list_concat([''], segs), '/') AS shape, rule, action FROM p JOIN cut USING (id) LEFT JOIN fit USING (id)),
shapes AS (
  SELECT host, shape, segs, count(*) AS n, count(*) FILTER (WHERE action = 'allow') AS good, count(*) FILTER (WHERE action = 'block') AS bad
  FROM page GROUP BY ALL),
walk AS (
  SELECT host, shape, n, good, bad, segs, '' AS prefix FROM shapes
  UNION ALL
  SELECT host, shape, n, good, bad, segs[2:], prefix || '/' || CASE WHEN kind IS NOT NULL AND together > 1 THEN kind ELSE seg END
  FROM (SELECT *, count(DISTINCT seg) OVER (PARTITION BY host, prefix, kind) AS together
    FROM (SELECT *, CASE WHEN starts_with(seg, '{') THEN NULL WHEN branches > 20 AND bn < 0.05 * pn THEN '*'
        WHEN m = 0 OR am = m THEN NULL
        WHEN NOT abs(bg / m - (pg - bg) / (am - m)) > 1.96 * sqrt(pg / am * (1 - pg / am) * (1 / m + 1 / (am - m))) THEN '*'
        WHEN bg / m > (pg - bg) / (am - m) THEN '*+' ELSE '*-' END AS kind
      FROM (SELECT *, segs[1] AS seg, sum(n) OVER b AS bn, sum(good) OVER b AS bg, sum(good + bad) OVER b AS m,
          sum(n) OVER w AS pn, sum(good) OVER w AS pg, sum(good + bad) OVER w AS am, count(DISTINCT segs[1]) OVER w AS branches
        FROM walk WHERE len(segs) > 0
        WINDOW b AS (PARTITION BY host, prefix, segs[1]), w AS (PARTITION BY host, prefix))))),
placed AS (SELECT host, shape, CASE WHEN prefix = '' THEN '/' ELSE prefix END AS template FROM walk WHERE len(segs) = 0),
overall AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(good), 0) + coalesce(sum(bad), 0) + 2) AS o FROM shapes),
anywhere AS (SELECT shape, CAST(round((sum(good) + 5.0::DOUBLE * any_value(o)) / (sum(good + bad) + 5.0::DOUBLE) * 1000000) AS BIGINT) AS a FROM shapes, overall GROUP BY shape),
hosts AS (SELECT host, CAST(round((sum(good) + 5.0::DOUBLE * any_value(o)) / (sum(good + bad) + 5.0::DOUBLE) * 1000000) AS BIGINT) AS h, sum(good + bad) AS hm FROM shapes, overall GROUP BY host),
summed AS (
  SELECT host, template, sum(good) AS good, sum(good + bad) AS m, sum(n * a) / sum(n) / 1000000 AS e
  FROM shapes JOIN placed USING (host, shape) JOIN anywhere USING (shape) GROUP BY host, template),
purity AS (
  SELECT host, template, round((good + 5.0::DOUBLE * e + w * h / 1000000) / (m + 5.0::DOUBLE + w), 6) AS purity
  FROM (SELECT *, 5.0::DOUBLE * hm / (hm + 5.0::DOUBLE) AS w FROM summed JOIN hosts USING (host)))
SELECT page_id, page.host, path, rule, CASE WHEN rule IS NOT NULL THEN action WHEN purity >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN template END AS template, CASE WHEN rule IS NULL THEN purity END AS purity
FROM page JOIN placed USING (host, shape) JOIN purity USING (host, template)
"""
