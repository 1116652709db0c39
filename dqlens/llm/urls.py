"""URL filters: host and path rules, and association rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut

# Host, path and verdict of the rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Least share of labelled rows with a combination and least number of them, least share of bad ones among its rows, items of a combination at most.
SUPPORT, LEAST_ROWS, CONFIDENCE, MOST_TOKENS = 0.002, 3, 0.8, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


def host(url: Column) -> Column:
    """What follows the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as host and path together; null if none does. A rule fits its host and that one's subdomains."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for h, p, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        out = out.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(h + p))
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """A URL's tokens: labels of its host from the end on, parts of its path by place, names of query fields, scheme."""
    labels = F.transform(F.reverse(F.filter(F.split(host, r"\."), lambda x: x != "")), lambda x, i: F.concat(F.lit("host"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x, i: F.concat(F.lit("path"), F.least(i, F.lit(3)).cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.transform(F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("field="), F.substring_index(x, "=", 1)))
    scheme = F.filter(F.array(F.concat(F.lit("scheme="), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(\w+)://", 1))), lambda x: x != "scheme=")
    return F.array_distinct(F.concat(labels, parts, query, scheme))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int = MOST_TOKENS) -> DataFrame:
    """rule, size, slot, token: rules of FP-growth whose consequence is a bad label, one row for each slot of a rule and token that fills it.

    labelled: tokens (array), bad (boolean); all rows are used. Tokens that too few rows have are left out before, and tokens that the same rows have are one
    item, so a long URL that comes often is no combination of many items. Rules are pruned by support and confidence, by size, and where a part of a rule's
    tokens is a rule as sure as it.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule long, size int, slot string, token string")
    rows = cut(labelled.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if not n:
        return empty
    least = min(1.0, max(support, LEAST_ROWS / n))
    each = rows.select("row", F.explode("tokens").alias("token")).distinct()
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where(F.col("c") >= least * n)
    named = marks.groupBy("c", "x", "y").agg(F.min("token").alias("item"))
    slots = cut(marks.join(named, ["c", "x", "y"]).select("token", "item"))
    items = each.join(slots.where("token = item"), "token").groupBy("row").agg(F.collect_list("item").alias("items"))
    items = items.join(rows.select("row", "bad"), "row", "right").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad")
    items = cut(items.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(F.size("antecedent") <= most)
    rules = cut(rules.select(F.array_sort("antecedent").alias("set"), "confidence", "lift").where("lift > 1"))
    # a rule goes if one of its proper subsets is at least as sure
    subsets = rules.select(F.col("set").alias("whole"), F.col("confidence").alias("c"), F.explode("set").alias("t"))
    smaller = subsets.withColumn("less", F.array_remove("whole", F.col("t")))
    weak = smaller.join(rules.select(F.col("set").alias("less"), F.col("confidence").alias("d")), "less").where("d >= c").select("whole").distinct()
    single = smaller.join(rules.where(F.size("set") == 1).select(F.col("set")[0].alias("t"), F.col("confidence").alias("d")), "t").where("size(whole) > 1 AND d >= c").select("whole").distinct()
    kept = rules.join(weak.unionByName(single).distinct(), F.col("set") == F.col("whole"), "left_anti")
    parts = kept.select(F.xxhash64("set").alias("rule"), F.size("set").alias("size"), F.explode("set").alias("slot"))
    return cut(parts.join(slots.withColumnRenamed("item", "slot"), "slot").select("rule", "size", "slot", "token"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """key of each row of urls (key, tokens) that has a token for each slot of some rule. rules: an inverted index, see mined().

    The index is counted first: small, it is broadcast; else the URLs' tokens are salted and the index is repeated for each salt, so a hot token is dealt out.
    """
    index = rules.select("token", "rule", "size", "slot")
    hits = bounded(urls.select("key", F.explode("tokens").alias("token")), index, ["token"])
    return hits.groupBy("key", "rule", "size").agg(F.count_distinct("slot").alias("n")).where("n = size").select("key").distinct()


def judged(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row: id, host, path, rule (the longest that fits, else null), verdict (the rule's, else block if a mined rule matches, else allow).

    labels: id, quality; a URL is bad where quality is 0; of several labels of an id, one bad one is enough. A null URL has an empty host and path and no tokens, so it is allowed. Repeated rows get a
    row each. Empty tables give an empty result or no mined rules. Other columns are not read.
    """
    u = F.col("url")
    base = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url")).withColumn("host", host(u)).withColumn("path", path(u))
    base = cut(base.withColumn("tokens", tokens(F.col("host"), F.col("path"), u)).withColumn("key", F.xxhash64("host", "path", "tokens")).drop("url"))
    bad = labels.select(F.col("id"), (F.col("quality") == 0).alias("bad")).where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.max("bad").alias("bad"))
    index = mined(base.join(bad, "id").select("tokens", "bad"), support, confidence)
    # equal URLs are matched once: a hot URL is one row here
    hit = matched(base.groupBy("key").agg(F.first("tokens").alias("tokens")), index).withColumn("hit", F.lit(True))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for h, p, v in rules:
        verdict = verdict.when(F.col("rule") == h + p, F.lit(v))
    out = bounded(base.withColumn("rule", rule), hit, ["key"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.otherwise(F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def sql(pages: str = "pages", labels: str = "labels", support: float = SUPPORT, confidence: float = CONFIDENCE) -> str:
    """judged() in DuckDB's SQL, for labels (doc_id, quality): all combinations of up to three tokens are counted, and pruning, which changes no verdict, is left out."""
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in rules)
    given = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    return f"""
    WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u FROM {pages}),
    h AS (SELECT *, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(u, '(?s)\\?([^#]*)', 1) AS query, regexp_extract(u, '(?s)^(\\w+)://', 1) AS scheme FROM p),
    t AS (SELECT *, list_distinct(list_concat(list_concat(
        list_transform(list_filter(list_reverse(string_split(host, '.')), lambda x: x <> ''), lambda x, i: 'host' || least(i - 1, 3) || '=' || x),
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x, i: 'path' || least(i - 1, 3) || '=' || regexp_replace(x, '[0-9]+', '0', 'g'))), list_concat(
        list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'field=' || string_split(x, '=')[1]),
        CASE WHEN scheme = '' THEN [] ELSE ['scheme=' || scheme] END))) AS tokens, CASE {fits} END AS rule FROM h),
    b AS (SELECT doc_id AS page_id, bool_or(quality = 0) AS bad FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    l AS (SELECT r, tokens, bad FROM t JOIN b USING (page_id)),
    o AS (SELECT count(*) AS n, avg(CAST(bad AS INT)) AS rate FROM l),
    e AS (SELECT r, unnest(tokens) AS k FROM t),
    f AS (SELECT k FROM e JOIN l USING (r) GROUP BY k HAVING count(*) >= greatest({support} * (SELECT n FROM o), least({LEAST_ROWS}, (SELECT n FROM o)))),
    g AS (SELECT e.* FROM e JOIN f USING (k)),
    c AS (SELECT r, [k] AS s FROM g UNION ALL SELECT x.r, [x.k, y.k] FROM g x JOIN g y ON x.r = y.r AND x.k < y.k
        UNION ALL SELECT x.r, [x.k, y.k, z.k] FROM g x JOIN g y ON x.r = y.r AND x.k < y.k JOIN g z ON y.r = z.r AND y.k < z.k),
    m AS (SELECT s FROM c JOIN l USING (r) GROUP BY s HAVING count_if(bad) >= greatest({support} * (SELECT n FROM o), least({LEAST_ROWS}, (SELECT n FROM o))) AND avg(CAST(bad AS INT)) >= {confidence} AND avg(CAST(bad AS INT)) > (SELECT rate FROM o)),
    d AS (SELECT DISTINCT r FROM c WHERE s IN (SELECT s FROM m))
    SELECT page_id, host, path, rule, CASE {given} WHEN r IN (SELECT r FROM d) THEN 'block' ELSE 'allow' END AS verdict FROM t"""
