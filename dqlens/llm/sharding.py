"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Atomic groups: equal texts share one, as it is picked by a digest of the text. There are so many
#: at most, however large the corpus is, so the ordered sizes are one bounded array.
GROUPS_BITS = 16
#: Rows of a group that one task numbers.
ROWS_PER_TASK = 1_000
OVERHEAD = 8


def capacity_sql(sizes: str, shards: int) -> str:
    """SQL for the smallest capacity for which a greedy pass over the array needs at most that many shards."""
    check = f"""aggregate({sizes}, struct(1L AS n, 0L AS fill), (a, x) -> if(a.fill + x <= mid, struct(a.n AS n, a.fill + x AS fill), struct(a.n + 1 AS n, x AS fill)), a -> a.n)"""
    return f"""aggregate(sequence(1, 62),
        struct(greatest(array_max({sizes}), cast(ceil(aggregate({sizes}, 0L, (a, x) -> a + x) / {shards}) AS bigint)) AS lo, aggregate({sizes}, 0L, (a, x) -> a + x) AS hi),
        (s, i) -> if(s.lo >= s.hi, s, element_at(transform(array((s.lo + s.hi) div 2), mid -> if({check} <= {shards}, struct(s.lo AS lo, mid AS hi), struct(mid + 1 AS lo, s.hi AS hi))), 1)),
        s -> s.hi)"""


def cuts(sizes: DataFrame, shards: int) -> DataFrame:
    """One row: capacity, and starts: the first group of each shard. sizes: group, z, at most 2 ** GROUPS_BITS rows.

    The sizes become one sorted array; binary search over capacities, each checked greedily, runs on it inside an expression. Under the
    capacity found, a greedy pass from the end gives the first place from which the rest fits into 1, 2, ... shards; a pass from the
    start then ends each shard as near to an even part of what is left as those places and the capacity allow, so no slack gathers in the last one.
    """
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("group", "z"))).alias("a")).where(F.size("a") > 0)
    one = one.withColumn("z", F.expr("transform(a, x -> x.z)"))
    one = one.withColumn("capacity", F.expr(capacity_sql("z", shards))).withColumn("total", F.expr("aggregate(z, 0L, (s, x) -> s + x)"))
    # firsts[m - 1]: the least index from which m shards hold the rest
    back = "(s, x) -> if(s.fill + x > capacity, struct(concat(s.firsts, array(s.i)) AS firsts, s.i - 1 AS i, x AS fill), struct(s.firsts AS firsts, s.i - 1 AS i, s.fill + x AS fill))"
    one = one.withColumn("firsts", F.expr(f"aggregate(reverse(z), struct(cast(array() AS array<int>) AS firsts, size(z) AS i, 0L AS fill), {back}, s -> concat(s.firsts, array(0)))"))
    # k: shards begun; left: what comes from the current one's start on; m, those that may follow, hold the rest from get(firsts, m - 1) on
    m = f"({shards} - s.k)"
    even = f"(2 * s.fill + y.x.z) * ({m} + 1) > 2 * s.left AND {m} > 0 AND y.i >= coalesce(get(firsts, {m} - 1), 0)"
    begin = "struct(concat(s.starts, array(cast(y.x.group AS bigint))) AS starts, s.k + 1 AS k, s.left - s.fill AS left, y.x.z AS fill)"
    more = "struct(s.starts AS starts, s.k AS k, s.left AS left, s.fill + y.x.z AS fill)"
    step = f"(s, y) -> if(s.k = 0 OR s.fill + y.x.z > capacity OR ({even}), {begin}, {more})"
    start = "struct(cast(array() AS array<bigint>) AS starts, 0 AS k, total AS left, 0L AS fill)"
    return one.select("capacity", F.expr(f"aggregate(transform(a, (x, i) -> struct(x AS x, i AS i)), {start}, {step}, s -> s.starts)").alias("starts"))


def group_of(text: Column) -> Column:
    """The atomic group of a text: the first bits of its MD5 digest; null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, GROUPS_BITS // 4), 16, 10).cast("long")


def shard(df: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """Puts every row into one of the shards so that the largest shard is as small as contiguous groups allow.

    Returns id, size (UTF-8 bytes and 8 more; a null text has none), text_crc32, law ('bytes'), shard, slot
    (gapless from 0 in each shard), grown_shard (null: this law has none). Rows with equal texts share a group
    and so a shard; groups keep the order of their digests and are never split. A shard holds more than its
    even part only if a group is large: a text that fills a third of the corpus fills one shard. Repeated rows
    keep a slot each. Groups are coarser than equal texts: 65,536 of them by digest, so that sizes of groups are one bounded array; capacity is the least for those. Null ids come first in their group. An empty table gives an empty result. Other columns
    are not read. With fewer groups than shards, some shards stay empty.
    """
    t = F.col(text)
    narrow = cut(df.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"), group_of(t).alias("group")))
    groups = narrow.groupBy("group").agg(F.sum("size").alias("z"), F.count(F.lit(1)).alias("rows"))
    found = cuts(groups.select("group", "z"), shards).head()
    starts = F.array(*[F.lit(x).cast("long") for x in found.starts]) if found else F.array(F.lit(0).cast("long"))
    place = F.size(F.filter(starts, lambda x: x <= F.col("group"))) - 1
    # at most 2 ** GROUPS_BITS rows of two numbers: a bounded broadcast
    counts = F.broadcast(groups.select("group", F.ceil(F.col("rows") / ROWS_PER_TASK).cast("int").alias("parts")))
    dealt = narrow.join(counts, "group").withColumn("shard", place.cast("int"))
    part = F.pmod(F.xxhash64("id", "crc"), F.col("parts"))
    out = numbered(dealt, ["shard"], ["id", "crc", "size"], F.struct("group", part.alias("part")), "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
