"""The engine's operators as named queries over the driver's tables, each with SQL that gives the same rows.

Tables without dirt get some from expressions that are written the same way in both.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates as A
from ..operators import drift as D
from ..operators import target as G
from ..operators import temporal as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def ev(s: SparkSession, d: str) -> DataFrame:
    """events with missing values by group and from a day on."""
    gone = ((F.col("event_type") == "error") & (F.col("event_id") % 10 < 7)) | ((F.col("ts") >= F.lit("2024-01-22").cast("timestamp_ntz")) & (F.col("event_id") % 2 == 0))
    return read(s, d, "events").withColumn("score", F.when((F.col("event_type") != "click") | (F.col("event_id") % 3 > 0), F.col("value") * 2)).withColumn("value", F.when(~gone, F.col("value")))


EV = """ev AS (SELECT event_id, ts, user_id, event_type, CASE WHEN NOT ((event_type = 'error' AND event_id % 10 < 7) OR (ts >= TIMESTAMP '2024-01-22' AND event_id % 2 = 0)) THEN value END AS value,
    CASE WHEN event_type <> 'click' OR event_id % 3 > 0 THEN value * 2 END AS score FROM events)"""


def dup(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return e.unionByName(e.where("event_id % 50 = 0"))


DUP = "dup AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)"


def cu(s: SparkSession, d: str) -> DataFrame:
    k, m = F.col("c_custkey") % 20, F.col("c_mktsegment")
    return read(s, d, "customer").withColumn("seg", F.when(k == 0, F.lower(m)).when(k == 1, F.concat(F.lit(" "), m)).when(k == 2, "N/A").when(k == 3, "").when(k == 4, F.concat(m, F.lit("​"))).when(k == 5, F.concat(F.lit("\t"), m, F.lit("  "))).otherwise(m))


CU = """cu AS (SELECT *, CASE c_custkey % 20 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN ' ' || c_mktsegment WHEN 2 THEN 'N/A' WHEN 3 THEN '' WHEN 4 THEN c_mktsegment || chr(8203)
    WHEN 5 THEN chr(9) || c_mktsegment || '  ' ELSE c_mktsegment END AS seg FROM customer)"""


def tx(s: SparkSession, d: str) -> DataFrame:
    """orders with prices and dates as text."""
    k, p, t = F.col("o_orderkey") % 10, F.col("o_totalprice").cast("decimal(12,2)"), F.col("o_orderdate")
    price = F.when(k < 5, F.concat(F.lit("$"), p)).when(k == 5, F.concat(F.lit("("), p, F.lit(")"))).when(k == 6, F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit("%"))).when(k == 7, "n/a").otherwise(p.cast("string"))
    day = F.when(k < 6, F.date_format(t, "yyyy-MM-dd")).when(k == 6, F.date_format(t, "MM/dd/yyyy")).when(k == 7, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T10:00:00Z"))).when(k == 8, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit(" 10:00:00+02:00"))).otherwise("soon")
    flag = F.when(k < 4, "Yes").when(k < 6, "no").when(k == 6, "Y").when(k == 7, "maybe").otherwise("FALSE")
    return read(s, d, "orders").select("o_orderkey", price.alias("price"), day.alias("day"), flag.alias("flag"))


TX = """tx AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 5 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) WHEN o_orderkey % 10 = 5 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || ')'
      WHEN o_orderkey % 10 = 6 THEN CAST(o_orderkey % 90 AS VARCHAR) || '%' WHEN o_orderkey % 10 = 7 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS price,
    CASE WHEN o_orderkey % 10 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 10 = 6 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 10 = 7 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z'
      WHEN o_orderkey % 10 = 8 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00+02:00' ELSE 'soon' END AS day,
    CASE WHEN o_orderkey % 10 < 4 THEN 'Yes' WHEN o_orderkey % 10 < 6 THEN 'no' WHEN o_orderkey % 10 = 6 THEN 'Y' WHEN o_orderkey % 10 = 7 THEN 'maybe' ELSE 'FALSE' END AS flag FROM orders)"""

SPLIT = "1998-07-01"


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = read(s, d, "orders").withColumn("label", F.when((F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz")) & (F.col("o_orderkey") % 7 == 0), "new").otherwise(F.col("o_orderpriority"))).withColumn("part", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")))
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderdate") >= cut, F.col("o_totalprice") * 1.2).otherwise(F.col("o_totalprice")))
    return o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut).withColumn("part", F.when(F.col("o_orderkey") % 2 > 0, F.col("part")))


SIDES = f"""o AS (SELECT *, o_orderdate >= TIMESTAMP '{SPLIT}' AS late FROM orders), sides AS (SELECT late, CASE WHEN late THEN o_totalprice * 1.2 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN late AND o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END AS label, CASE WHEN o_orderkey % 5 > 0 AND (NOT late OR o_orderkey % 2 > 0) THEN o_totalprice END AS part FROM o)"""

LI = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _profile_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, CAST(0 AS BIGINT) AS n_infinite, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max,
        count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, bool_and({c} = floor({c})) AS integer_valued, round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM {t}"""


@query(" UNION ALL ".join(_profile_sql("lineitem", c) for c in LI))
def numeric_profile(s, d):
    return A.numeric_profile(read(s, d, "lineitem"), LI)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem" for c in LI for p in A.QUANTILES))
def numeric_quantiles(s, d):
    return A.numeric_quantiles(read(s, d, "lineitem"), LI)


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 0.005) AS lo, quantile_cont(o_totalprice, 0.995) AS hi FROM orders)
    SELECT CAST(least(floor((least(greatest(o_totalprice, lo), hi) - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def histogram_30(s, d):
    return A.histogram(read(s, d, "orders"), "o_totalprice")


@query(f"WITH {EV} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS missing_ratio FROM ev" for c in ("ts", "value", "score")))
def missing_by_column(s, d):
    return A.missing_by_column(ev(s, d), ("ts", "value", "score"))


@query(f"WITH {EV} SELECT CAST((value IS NULL)::INT + (score IS NULL)::INT AS BIGINT) AS n_missing, count(*) AS n_rows FROM ev GROUP BY 1")
def missing_by_row(s, d):
    return A.missing_by_row(ev(s, d), ("value", "score"))


@query(f"WITH {EV} " + " UNION ALL ".join(f"SELECT event_type AS level, count(*) AS n_rows, '{c}' AS column_name, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 6) AS missing_ratio FROM ev GROUP BY event_type" for c in ("value", "score")))
def missing_by_group(s, d):
    return A.missing_by_group(ev(s, d), "event_type", ("value", "score"))


CRAMER = """p AS (SELECT a, b, count(*) AS o FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b), w AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM p),
    s AS (SELECT CAST(sum(o) AS DOUBLE) AS n, sum(CAST(o AS DOUBLE) * o / (CAST(ra AS DOUBLE) * cb)) AS q, CAST(count(DISTINCT a) AS DOUBLE) AS r, CAST(count(DISTINCT b) AS DOUBLE) AS k FROM w),
    u AS (SELECT n * (q - 1) AS chi2, greatest(0, q - 1 - (k - 1) * (r - 1) / (n - 1)) AS phi, least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1 AS low FROM s)
    SELECT round(chi2, 4) AS chi2, round(CASE WHEN low > 0 THEN sqrt(phi / low) ELSE 0 END, 6) AS cramers_v FROM u"""


@query(f"WITH {EV}, t AS (SELECT event_type AS a, CAST(value IS NULL AS VARCHAR) AS b FROM ev), {CRAMER}")
def missing_cramers_v(s, d):
    e = ev(s, d)
    return A.cramers_v(e.withColumn("gone", C.is_missing(e, "value").cast("string")), "event_type", "gone")


@query(f"WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b FROM orders), {CRAMER}")
def cramers_v(s, d):
    return A.cramers_v(read(s, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH {EV} SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n, CASE WHEN count(value) >= 5 THEN round(median(value), 6) END AS median_value, CASE WHEN count(*) >= 5 THEN round(avg((value IS NULL)::INT), 6) END AS missing_value FROM ev GROUP BY 1""")
def missing_rate_by_period(s, d):
    return T.period_medians(ev(s, d), "ts", "day", ("value",))


@query(f"WITH {EV} SELECT 'value' AS a, 'score' AS b, round(corr((value IS NULL)::INT, (score IS NULL)::INT), 6) AS r, count(*) AS n FROM ev")
def missing_phi_matrix(s, d):
    return A.phi_matrix(ev(s, d), ("value", "score"))


KS = """v AS (SELECT v, sum(r) AS r, sum(c) AS c FROM t WHERE v IS NOT NULL GROUP BY v), g AS (SELECT v, abs(sum(r) OVER (ORDER BY v) / sum(r) OVER () - sum(c) OVER (ORDER BY v) / sum(c) OVER ()) AS gap, coalesce(lead(v) OVER (ORDER BY v) - v, 0) AS step FROM v),
    q AS (SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM t WHERE r = 1)
    SELECT round(max(gap), 6) AS ks, round(sum(gap * step), 4) AS wasserstein, round(sum(gap * step) / any_value(iqr), 6) AS wasserstein_scaled FROM g, q"""


@query(f"WITH {EV}, t AS (SELECT score AS v, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS r, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS c FROM ev), {KS}")
def missing_related_ks(s, d):
    e = ev(s, d)
    return D.ks_wasserstein(e.where("value IS NOT NULL"), e.where("value IS NULL"), "score")


@query(f"WITH {SIDES}, t AS (SELECT o_totalprice AS v, CASE WHEN late THEN 0 ELSE 1 END AS r, CASE WHEN late THEN 1 ELSE 0 END AS c FROM sides), {KS}")
def drift_ks_wasserstein(s, d):
    return D.ks_wasserstein(*sides(s, d), "o_totalprice")


SHARES = """n AS (SELECT greatest(r / (SELECT sum(r) FROM b), 0.0001) AS e, greatest(c / (SELECT sum(c) FROM b), 0.0001) AS a FROM b), m AS (SELECT e / (SELECT sum(e) FROM n) AS e, a / (SELECT sum(a) FROM n) AS a FROM n)"""


@query(f"""WITH {SIDES}, x AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM sides WHERE NOT late),
    k AS (SELECT late, len(list_filter(e, lambda z: z < o_totalprice)) AS bin FROM sides, x), b AS (SELECT i AS bin, coalesce(sum((NOT late)::INT), 0) AS r, coalesce(sum(late::INT), 0) AS c FROM range(11) AS z(i) LEFT JOIN k ON bin = i GROUP BY i), {SHARES}
    SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM m""")
def drift_psi(s, d):
    return D.numeric_psi(*sides(s, d), "o_totalprice")


@query(f"""WITH {SIDES}, b AS (SELECT label, count(*) FILTER (NOT late) AS r, count(*) FILTER (late) AS c FROM sides GROUP BY label), {SHARES}, u AS (SELECT r, c, r / (SELECT sum(r) FROM b) AS p, c / (SELECT sum(c) FROM b) AS q FROM b),
    j AS (SELECT round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS jsd, count(*) FILTER (r = 0 AND c > 0) AS n_unseen, count(*) FILTER (c = 0 AND r > 0) AS n_vanished,
      round(sum(CASE WHEN r = 0 THEN q ELSE 0 END), 6) AS unseen_share FROM u)
    SELECT j.*, round((SELECT sum((a - e) * ln(a / e)) FROM m), 6) AS psi FROM j""")
def drift_categorical(s, d):
    return D.categorical_drift(*sides(s, d), "label")


@query(f"WITH {SIDES}, l AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM sides WHERE NOT late) SELECT count(*) AS n, count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) AS n_outside FROM sides, l WHERE late")
def drift_out_of_range(s, d):
    return D.out_of_range(*sides(s, d), "o_totalprice")


@query(f"WITH {SIDES} SELECT 'part' AS column_name, round(avg((part IS NULL)::INT) FILTER (NOT late), 6) AS reference_ratio, round(avg((part IS NULL)::INT) FILTER (late), 6) AS current_ratio FROM sides")
def drift_missingness(s, d):
    return D.missingness(*sides(s, d), ("part",))


@query(f"WITH {DUP}, g AS (SELECT count(*) AS n FROM dup GROUP BY ALL event_id, ts, user_id, event_type, value, props) SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (n > 1) AS n_groups FROM g".replace("GROUP BY ALL ", "GROUP BY "))
def exact_duplicates(s, d):
    return A.exact_duplicates(dup(s, d))


@query("WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey, l_quantity) SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(*) FILTER (n > 1) AS n_groups FROM g")
def dup_except_ids(s, d):
    return A.exact_duplicates(read(s, d, "lineitem"), ("l_partkey", "l_suppkey", "l_quantity"))


@query(f"WITH {DUP}, g AS (SELECT event_id, count(*) AS n FROM dup GROUP BY event_id HAVING count(*) > 1) SELECT count(*) AS n_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM g")
def duplicate_keys(s, d):
    return A.duplicate_keys(dup(s, d), "event_id")


@query("""WITH g AS (SELECT conv_id, min(role) = max(role) AS a, min(text) = max(text) AS b FROM conversations GROUP BY conv_id HAVING count(*) > 1)
    SELECT 'role' AS column_name, count(*) AS n_keys, count(*) FILTER (NOT a) AS n_conflicts FROM g UNION ALL SELECT 'text', count(*), count(*) FILTER (NOT b) FROM g""")
def entity_conflict(s, d):
    return A.entity_conflicts(read(s, d, "conversations"), "conv_id", ("role", "text"))


VC = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 2" for c in ("p_brand", "p_type", "p_size"))
PART = ("p_brand", "p_type", "p_size")


@query(VC)
def value_counts(s, d):
    return A.value_counts(read(s, d, "part"), PART)


@query(f"WITH v AS ({VC}) SELECT column_name, min(value) FILTER (n = m) AS top_value, any_value(m) AS top_count, round(any_value(m) / sum(n), 6) AS top_share, count(*) AS n_unique FROM (SELECT *, max(n) OVER (PARTITION BY column_name) AS m FROM v) GROUP BY column_name")
def top_share(s, d):
    return A.top_share(read(s, d, "part"), PART)


@query(f"WITH v AS ({VC}), p AS (SELECT column_name, n / sum(n) OVER (PARTITION BY column_name) AS p FROM v) SELECT column_name, round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised, count(*) AS n_unique FROM p GROUP BY column_name")
def label_entropy(s, d):
    return A.entropy(read(s, d, "part"), PART)


@query("SELECT user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY user_id HAVING count(*) < 0.006 * (SELECT count(*) FROM events)")
def rare_labels(s, d):
    return A.rare_labels(read(s, d, "events"), "user_id", 0.006)


@query("SELECT CAST(min(length(text)) AS BIGINT) AS min_length, CAST(max(length(text)) AS BIGINT) AS max_length, round(avg(length(text)), 6) AS mean_length, CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_length FROM documents")
def text_lengths(s, d):
    return A.text_lengths(read(s, d, "documents"), "text")


SHAPE = r"regexp_replace(regexp_replace(substr({c}, 1, 40), '\p{{L}}', 'A', 'g'), '\p{{Nd}}', '9', 'g') || CASE WHEN length({c}) > 40 THEN '…' ELSE '' END"


@query(f"SELECT {SHAPE.format(c='c_name')} AS shape, count(*) AS n FROM customer GROUP BY 1")
def shapes(s, d):
    return read(s, d, "customer").groupBy(C.shape(F.col("c_name")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT regexp_replace(regexp_replace({SHAPE.format(c='o_orderpriority')}, 'A{{2,}}', 'A+', 'g'), '9{{2,}}', '9+', 'g') AS shape, count(*) AS n FROM orders GROUP BY 1")
def compact_shapes(s, d):
    return read(s, d, "orders").groupBy(C.compact_shape(F.col("o_orderpriority")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
KIND = f"CASE WHEN regexp_matches(s, '{C.PLAIN}') THEN 'plain' WHEN regexp_matches(s, '{C.THOUSANDS}') THEN 'thousands' WHEN regexp_matches(s, '{C.CURRENCY}') THEN 'currency' WHEN regexp_matches(s, '{C.PERCENT}') THEN 'percent' END"


@query(f"WITH {TX}, t AS (SELECT {STRIP.format(c='price')} AS s FROM tx) SELECT {KIND} AS kind, count(*) AS n FROM t GROUP BY 1")
def number_kinds(s, d):
    return tx(s, d).groupBy(C.number_kind(F.col("price")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TX}, t AS (SELECT o_orderkey, {STRIP.format(c='price')} AS s, regexp_replace(price, '[$€£¥₹,%()\\s]', '', 'g') AS b FROM tx)
    SELECT o_orderkey, round(CASE WHEN regexp_matches(s, '%$') THEN x / 100 ELSE x END, 6) AS value FROM (SELECT *, CASE WHEN regexp_matches(b, '{C.PLAIN}') THEN CASE WHEN regexp_matches(s, '^\\(.*\\)$') THEN -TRY_CAST(b AS DOUBLE) ELSE TRY_CAST(b AS DOUBLE) END END AS x FROM t)""")
def text_to_number(s, d):
    return tx(s, d).select("o_orderkey", F.round(C.to_number(F.col("price")), 6).alias("value"))


@query(f"WITH {TX}, t AS (SELECT {SHAPE.format(c='day')} AS s FROM tx) SELECT CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in C.DATE_SHAPES) + " END AS format, count(*) AS n FROM t GROUP BY 1")
def date_formats(s, d):
    return tx(s, d).groupBy(C.date_shape(F.col("day")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TX} SELECT count(*) AS n, count(*) FILTER (day <> 'soon') AS n_parsed, min(CASE WHEN day <> 'soon' THEN date_trunc('day', o_orderdate) END)::TIMESTAMP AS first_day FROM tx JOIN orders USING (o_orderkey)")
def datetime_parse(s, d):
    t = C.to_datetime(F.col("day"))
    return tx(s, d).agg(F.count(F.lit(1)).alias("n"), F.count(t).alias("n_parsed"), F.min(F.date_trunc("day", t).cast("timestamp_ntz")).alias("first_day"))


@query(f"WITH {TX} SELECT CASE WHEN regexp_matches(day, '[0-9]Z$') THEN 'Z' WHEN regexp_matches(day, ':[0-9]{{2}}(\\.[0-9]+)?\\s?[+-][0-9]{{2}}:?[0-9]{{2}}$') THEN 'offset' ELSE 'none' END AS style, count(*) AS n FROM tx GROUP BY 1")
def tz_styles(s, d):
    return tx(s, d).groupBy(C.timezone_style(F.col("day")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TX} SELECT CASE WHEN lower(flag) IN {C.TRUE_TOKENS} THEN 'true' WHEN lower(flag) IN {C.FALSE_TOKENS} THEN 'false' ELSE 'other' END AS value, count(*) AS n FROM tx GROUP BY 1")
def boolean_tokens(s, d):
    return tx(s, d).groupBy(F.coalesce(C.boolean_token(F.col("flag")).cast("string"), F.lit("other")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CU}, n AS (SELECT seg, trim(regexp_replace(regexp_replace(lower(seg), '[\\s_\\-./]+', ' ', 'g'), '[^\\w ]', '', 'g')) AS k FROM cu WHERE seg <> '')
    SELECT k AS normalised, count(DISTINCT seg) AS n_variants, count(*) AS n FROM n GROUP BY k HAVING count(DISTINCT seg) > 1""")
def label_variants(s, d):
    return cu(s, d).where("seg <> ''").groupBy(C.normalize_label(F.col("seg")).alias("normalised")).agg(F.count_distinct("seg").alias("n_variants"), F.count(F.lit(1)).alias("n")).where("n_variants > 1")


@query(f"WITH {CU}, s AS (SELECT seg, {STRIP.format(c='seg')} AS t FROM cu) SELECT count(*) FILTER (t = '') AS n_empty, count(*) FILTER (lower(t) IN {C.PLACEHOLDERS}) AS n_placeholder, count(*) FILTER (t <> seg AND t <> '') AS n_padded, count(*) FILTER (contains(seg, chr(8203))) AS n_unusual FROM s")
def label_hygiene(s, d):
    n, x = lambda c: F.count(F.when(c, 1)), F.col("seg")
    return cu(s, d).agg(n(C.is_blank(x)).alias("n_empty"), n(C.is_placeholder(x)).alias("n_placeholder"), n(C.is_padded(x)).alias("n_padded"), n(C.has_unusual(x)).alias("n_unusual"))


@query(f"WITH {EV} SELECT count(*) FILTER (value < 10) AS n_min, count(*) FILTER (value > 90) AS n_max, count(*) FILTER (event_type NOT IN ('view', 'click')) AS n_allowed, count(*) FILTER (NOT regexp_full_match(event_type, '[a-m].*')) AS n_pattern, count(*) FILTER (value IS NULL) AS n_nullable FROM ev")
def rules(s, d):
    from ..operators.rules import Rule, violations

    r = {"value": Rule(min=10, max=90, nullable=False), "event_type": Rule(allowed=("view", "click"), pattern="[a-m].*")}
    return violations(ev(s, d), r).groupBy().pivot("kind", ["min", "max", "allowed", "pattern", "nullable"]).agg(F.sum("n")).select(*[F.col(k).alias(f"n_{k}") for k in ("min", "max", "allowed", "pattern", "nullable")])


@query("SELECT l_discount AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def value_spikes(s, d):
    t = read(s, d, "lineitem")
    g = t.groupBy(F.col("l_discount").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share")).orderBy(F.desc("n"), "value").limit(5)


SENT = "sen AS (SELECT CASE WHEN c_custkey % 30 = 0 THEN -999.0 ELSE c_acctbal END AS v FROM customer)"


@query(f"WITH {SENT} SELECT CAST(v AS DOUBLE) AS code, count(*) AS n FROM sen WHERE v IN {tuple(C.SENTINELS)} GROUP BY 1")
def sentinels(s, d):
    t = read(s, d, "customer").select(F.when(F.col("c_custkey") % 30 == 0, -999.0).otherwise(F.col("c_acctbal")).alias("v"))
    return t.where(F.col("v").isin(*C.SENTINELS)).groupBy(F.col("v").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _tukey_sql(t: str, c: str) -> str:
    return f"SELECT '{c}' AS column_name, round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper, count(*) FILTER (iqr > 0 AND ({c} < lo OR {c} > hi)) AS n_outliers FROM {t}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"


@query(" UNION ALL ".join(_tukey_sql("lineitem", c) for c in ("l_extendedprice", "l_tax")))
def iqr_outliers(s, d):
    return A.tukey_outliers(read(s, d, "lineitem"), ["l_extendedprice", "l_tax"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - m) > 2 * s) AS n_outliers FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)" for c in ("l_extendedprice", "l_quantity")))
def zscore_outliers(s, d):
    return A.zscore_outliers(read(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], 2.0)


def _mad_sql(limit: float) -> str:
    return f"WITH v AS (SELECT value * value AS x FROM events), m AS (SELECT median(x) AS m FROM v), d AS (SELECT median(abs(x - m)) AS mad FROM v, m) SELECT 'x' AS column_name, count(*) FILTER (abs(0.6745 * (x - m) / mad) > {limit}) AS n_outliers FROM v, m, d"


@query(_mad_sql(1.5))
def modified_z_outliers(s, d):
    return A.modified_z_outliers(read(s, d, "events").select((F.col("value") * F.col("value")).alias("x")), ["x"], 1.5)


@query(f"WITH k AS (SELECT {NormalDist().inv_cdf(0.95)!r} AS k) " + _mad_sql(1.0).replace("WITH v", ", v").replace("> 1.0", "> k").replace("FROM v, m, d", "FROM v, m, d, k"))
def size_adjusted_outliers(s, d):
    return A.modified_z_outliers(read(s, d, "events").select((F.col("value") * F.col("value")).alias("x")), ["x"], NormalDist().inv_cdf(0.95))


@query("""WITH c AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS p, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT unnest(generate_series((SELECT min(p) FROM c), (SELECT max(p) FROM c), INTERVAL 1 MONTH)) AS p)
    SELECT k.p AS period, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (p)""")
def time_volume(s, d):
    return T.volume(read(s, d, "orders"), "o_orderdate", "month")


@query("""WITH e AS (SELECT * FROM events WHERE day(ts) NOT IN (5, 17)), c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS p FROM e GROUP BY 1), k AS (SELECT unnest(generate_series((SELECT min(p) FROM c), (SELECT max(p) FROM c), INTERVAL 1 DAY)) AS p) SELECT p AS period FROM k ANTI JOIN c USING (p)""")
def empty_periods(s, d):
    return T.empty_periods(read(s, d, "events").where(~F.dayofmonth("ts").isin(5, 17)), "ts", "day")


@query("SELECT 'o_orderdate' AS column_name, min(o_orderdate) AS min_time, max(o_orderdate) AS max_time, count(DISTINCT o_orderdate) AS n_unique, count(*) FILTER (o_orderdate > TIMESTAMP '2000-06-01') AS n_future, round(avg((o_orderdate = date_trunc('day', o_orderdate))::INT), 6) AS midnight_share, 'day' AS granularity FROM orders")
def datetime_profile(s, d):
    return T.datetime_profile(read(s, d, "orders"), ("o_orderdate",), "2000-06-01")


@query(f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS value, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') IN {C.DEFAULT_DATES} GROUP BY 1")
def placeholder_dates(s, d):
    return T.default_dates(read(s, d, "orders"), "o_orderdate")


@query("WITH t AS (SELECT DISTINCT ts FROM events), g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1000000.0 AS x FROM t) SELECT count(x) AS n_steps, round(median(x), 3) AS median_step, round(max(x), 3) AS longest_step FROM g")
def interval_stats(s, d):
    return T.intervals(read(s, d, "events"), "ts")


@query("SELECT event_type AS label, min(date_trunc('day', ts))::TIMESTAMP AS first_period, max(date_trunc('day', ts))::TIMESTAMP AS last_period, count(*) AS n FROM events GROUP BY 1")
def category_lifecycle(s, d):
    return T.lifecycle(read(s, d, "events"), "ts", "day", "event_type")


@query("SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, count(*) AS n, CASE WHEN count(o_totalprice) >= 5 THEN round(median(o_totalprice), 6) END AS median_o_totalprice, CASE WHEN count(*) >= 5 THEN 0.0::DOUBLE END AS missing_o_totalprice FROM orders GROUP BY 1")
def period_medians(s, d):
    return T.period_medians(read(s, d, "orders"), "o_orderdate", "quarter", ("o_totalprice",))


PAIRS = [(a, b) for i, a in enumerate(LI) for b in LI[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM lineitem" for a, b in PAIRS))
def pearson_matrix(s, d):
    return A.pearson_matrix(read(s, d, "lineitem"), LI)


def _avg_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("WITH r AS (SELECT " + ", ".join(f"{_avg_rank(c)} AS {c}" for c in LI) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM r" for a, b in PAIRS))
def spearman_matrix(s, d):
    return A.spearman_matrix(read(s, d, "lineitem"), LI)


@query("WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY 1), t AS (SELECT sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum(n * v) AS w FROM g) SELECT round(sqrt(b / (b + w)), 6) AS eta FROM t")
def correlation_ratio(s, d):
    return A.correlation_ratio(read(s, d, "part"), "p_brand", "p_retailprice")


_BIN = "len(list_filter(list_distinct((SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM lineitem)), lambda z: z < {c}))"


@query(f"""WITH b AS (SELECT {_BIN.format(c='l_quantity')} AS a, {_BIN.format(c='l_extendedprice')} AS b FROM lineitem), p AS (SELECT a, b, count(*) AS o FROM b GROUP BY a, b), w AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM p),
    s AS (SELECT sum(o / n * ln(o * n / (ra * cb))) AS mi, -sum(o / n * ln(ra / n)) AS ha, -sum(o / n * ln(cb / n)) AS hb FROM w) SELECT round(greatest(0, least(1, mi / sqrt(ha * hb))), 6) AS nmi FROM s""")
def mutual_information(s, d):
    return A.mutual_information(read(s, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("WITH t AS (SELECT l_extendedprice AS x, CASE WHEN l_orderkey % 100 = 0 THEN l_extendedprice * 100 + 5 ELSE l_extendedprice * 100 END AS y FROM lineitem) SELECT count(*) AS n, count(*) FILTER (abs(x * 100 - y) <= 1e-6 * greatest(abs(x * 100), abs(y)) + 1e-9) AS n_equal FROM t")
def linear_identity(s, d):
    t = read(s, d, "lineitem").withColumn("y", F.col("l_extendedprice") * 100 + F.when(F.col("l_orderkey") % 100 == 0, 5).otherwise(0))
    return A.identity(t, F.col("l_extendedprice") * 100, F.col("y"))


@query("WITH t AS (SELECT l_quantity AS a, l_tax AS b, CASE WHEN l_orderkey % 50 = 0 THEN l_quantity ELSE l_quantity + l_tax END AS z FROM lineitem) SELECT count(*) AS n, count(*) FILTER (abs(a + b - z) <= 1e-6 * greatest(abs(a + b), abs(z)) + 1e-9) AS n_equal FROM t")
def sum_identity(s, d):
    t = read(s, d, "lineitem").withColumn("z", F.col("l_quantity") + F.when(F.col("l_orderkey") % 50 == 0, 0.0).otherwise(F.col("l_tax")))
    return A.identity(t, F.col("l_quantity") + F.col("l_tax"), F.col("z"))


@query("SELECT count(*) AS n_pairs, count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b, count(*) = count(DISTINCT a) AND count(*) = count(DISTINCT b) AS one_to_one FROM (SELECT DISTINCT n_nationkey AS a, n_name AS b FROM nation)")
def one_to_one(s, d):
    return A.one_to_one(read(s, d, "nation"), "n_nationkey", "n_name")


@query("SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels WHERE quality IS NOT NULL), 6) AS share FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def target_classes(s, d):
    return G.classes(read(s, d, "labels"), "quality")


@query("""WITH t AS (SELECT l.doc_id, lang AS level, quality AS y FROM labels l JOIN documents d USING (doc_id)), m AS (SELECT level, avg(y) AS m FROM t WHERE doc_id % 2 = 0 GROUP BY level),
    p AS (SELECT round(coalesce(m, (SELECT avg(y) FROM t WHERE doc_id % 2 = 0)), 12) AS prediction, sum(y) AS pos, count(*) - sum(y) AS neg FROM t LEFT JOIN m USING (level) WHERE doc_id % 2 = 1 GROUP BY 1),
    b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prediction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 8) AS auc FROM b""")
def target_single_feature(s, d):
    t = read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return G.feature_auc(t, F.col("lang"), F.col("quality"), F.col("doc_id") % 2 == 0)


@query()
def schema_inference(s, d):
    from ..engine import inspect_schema

    rows = [(t, n, c["semantic_type"], c["dtype"], c["n_missing"], c["n_unique"]) for t in ("orders", "customer", "part") for n, c in inspect_schema(read(s, d, t)).items()]
    return s.createDataFrame(rows, "table_name string, column_name string, semantic_type string, dtype string, n_missing long, n_unique long")


@query()
def inspect_findings(s, d):
    from ..engine import inspect

    return inspect(cu(s, d), reference_time="2026-10-01").frame(s)


@query()
def drift_findings(s, d):
    from ..engine import compare

    a, b = sides(s, d)
    cols = ["o_totalprice", "label", "o_orderstatus", "part"]
    return compare(a.select(*cols), b.select(*cols)).frame(s)


@query()
def change_points(s, d):
    days = [(r.period, r.n) for r in T.volume(read(s, d, "events").where((F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")) | (F.col("event_id") % 3 == 0)), "ts", "day").orderBy("period").collect()]
    found = T.change_points([float(n) for _, n in days[1:-1]])
    return s.createDataFrame([(days[c["index"] + 1][0], c["before"], c["after"], c["statistic"], c["p_value"]) for c in found], "period timestamp_ntz, before double, after double, statistic double, p_value double")


@query("""WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION SELECT DISTINCT lower(unnest(string_split(o_orderpriority, '-'))) FROM orders)
SELECT a.w AS a, b.w AS b FROM w a JOIN w b ON a.w < b.w AND damerau_levenshtein(a.w, b.w) <= 2""")
def similar_labels(s, d):
    words = read(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).unionByName(read(s, d, "orders").select(F.explode(F.split("o_orderpriority", "-")).alias("w")))
    return A.similar_labels(words.select(F.lower("w").alias("w")), "w", 2)


@query()
def isolation_forest(s, d):
    from ..operators.forest import scored

    return scored(read(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"]).select("l_quantity", "l_extendedprice", "l_discount", F.round("score", 6).alias("score"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, {f'round(avg({c}), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS mean, {f'round(stddev_samp({c}), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS std, {f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS least, {f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS largest, CASE WHEN count(DISTINCT {c}) <= 3481 THEN count(DISTINCT {c}) END AS n_unique FROM events" for c, num in (("event_id", True), ("event_type", False), ("value", True))))
def streaming_profile(s, d):
    from ..streaming import profile as P

    e = read(s, d, "events").select("event_id", "event_type", "value")
    parts = [P.state(e.where(F.col("event_id") % 3 == k)) for k in range(3)]
    p = P.profile(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return p.withColumn("n_unique", F.when(F.col("distinct_exact"), F.col("distinct_estimate"))).drop("distinct_estimate", "distinct_exact")
