"""Document fingerprints: canonical exact digests, grouped, with a comparison of bytes in equal buckets."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut
from .sketch import id_filter

#: Rows of a range that are read in order together, and ranges at most: a row for each reaches the driver. At 100 TB a task streams 1 GB.
ROWS_PER_RANGE, MOST_RANGES = 5_000, 100_000


def canonical(text: str | None) -> str:
    """Compatibility form, case and white space folded: runs of white space are one space, none at the ends. Null is empty.

    Folding case can undo the normal form, so that is restored after it.
    """
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(canon: str) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 if they are equal, else 0. A digest keeps nothing of how near texts are."""
    return float(a == b)


def order_key(key: Column, kind: str) -> Column:
    """A whole number that doesn't fall as ids rise: of numbers their floor, of strings their first seven bytes; else one for all."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if re.match("tinyint|smallint|int|bigint|float|double|decimal", kind):
        return F.floor(key).cast("long")
    return F.when(key.isNotNull(), F.lit(0).cast("long"))


def over_neighbours(df: DataFrame, id_col: str, text: str, make: Callable[[object, str, str], tuple], schema: str) -> DataFrame:
    """make(id, text, text of the next row) for each row, in ascending order of ids; the first comes after the last. schema: of what make returns.

    Rows with equal ids are ordered by a hash of their texts; null ids come first. Ids may be numbers or strings. Ranges of ids are cut at quantiles; each gets its rows and a copy of the
    first row of the next range. So texts move once, and a task holds one row and the one before.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("o", order_key(F.col("id"), kind))
    n = rows.select("id").count()
    ranges = int(min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS_PER_RANGE + 1)))
    cuts = [] if n == 0 else sorted({int(x) for x in rows.agg(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).head()[0] or []}) if ranges > 1 else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        known = x.fillna(-(2**63)).to_numpy(np.int64) if x.isna().any() else x.to_numpy(np.int64)
        return pd.Series(np.searchsorted(bounds, known, "right").astype(np.int32))

    # one row a range: its least id, and among equal ones the least hash
    heads = rows.select("id", "h", "o").withColumn("r", place("o")).groupBy("r").agg(F.min(F.struct("id", "h")).alias("m")).select("r", "m.*").orderBy("r").collect()  # at most MOST_RANGES rows
    if not heads:
        return spark.createDataFrame([], schema)
    before = {heads[i].r: heads[i - 1].r for i in range(len(heads))}
    keys = spark.createDataFrame([(x.id, x.h, before[x.r]) for x in heads], f"hid {kind}, hh long, r int")
    first = rows.join(F.broadcast(keys), F.col("id").eqNullSafe(F.col("hid")) & (F.col("h") == F.col("hh"))).dropDuplicates(["hid", "hh"]).select("id", "text", "h", "o", "r", F.lit(True).alias("head"))
    dealt = rows.withColumn("r", place("o")).withColumn("head", F.lit(False)).unionByName(first)
    parts = len(heads)
    placed = dealt.repartition(parts, "r").sortWithinPartitions("r", "head", F.col("id").asc_nulls_first(), "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            out = []
            for key, t, r, head in zip(pdf["id"], pdf["text"], pdf["r"], pdf["head"], strict=True):
                if last is not None and last[2] == r:
                    out.append(make(last[0], last[1], t))
                last = None if head else (key, t, r)
            if out:
                yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in schema.split(", ")]
    # ids go as text: numbers with nulls among them would be rounded
    out = placed.select(F.col("id").cast("string").alias("id"), "text", "r", "head").mapInPandas(run, schema.replace(f"id {kind}", "id string", 1))
    return out.withColumn("id", F.col("id").cast(kind))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the next text's start."""
    m = len(text) // 2
    return text[: len(text) - m] + following[:m]


def collisions(df: DataFrame, id_col: str, text: str, marks: DataFrame) -> DataFrame:
    """fingerprint, canon, number: canonical texts that share a digest with another one, numbered in their order from 0.

    marks: fingerprint, one row a document. Only texts whose digest occurs twice are sent to others (a filter of fixed size
    picks them first), copies are put together before they are, and then bytes are compared. A digest of 128 bits makes this empty in
    practice.
    """
    many = marks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    keep = id_filter(many.select(F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("long").alias("k")), "k")

    def canon(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [canonical(t) for t in pdf["text"]]
            out = pd.DataFrame({"fingerprint": [digest(t) for t in texts], "canon": texts})
            yield out[keep(np.array([int(d[:15], 16) for d in out["fingerprint"]], np.int64))]

    picked = df.select(F.col(text).alias("text")).mapInPandas(canon, "fingerprint string, canon string")
    one = picked.distinct()
    twice = one.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fingerprint")
    return one.join(twice, "fingerprint").withColumn("number", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id.

    Equal canonical texts have equal fingerprints, others different ones: where a digest is shared by different texts,
    all but the first in their order get its number appended. group_id is the smallest id with the same fingerprint. A null text is
    empty. Ids may be numbers or strings, null ones come first. Repeated rows get a row each. An empty table gives an empty result. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make(key, t: str, following: str) -> tuple:
        e = edited(t, following)
        a, b, c = canonical(t), canonical(e), canonical(following)
        # bytes are compared where digests are made, so a collision can't make texts alike
        return key, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(a), digest(b), likeness(a, b), likeness(a, c)

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    marks = cut(over_neighbours(df, id_col, text, make, schema))
    twins = collisions(df, id_col, text, marks)
    if twins.limit(1).count():
        marks = _apart(df, id_col, text, marks, twins)
    groups = marks.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint", "group_id")
    out = bounded(marks, groups, ["fingerprint"], "left")  # a group of many copies is dealt out
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("group_id", "id").alias("group_id"))


def _apart(df: DataFrame, id_col: str, text: str, marks: DataFrame, twins: DataFrame) -> DataFrame:
    """marks with numbers appended to the digests of the texts in twins but for the first of each."""

    @F.pandas_udf("string")
    def canon(t: pd.Series) -> pd.Series:
        return t.map(canonical)

    shared = twins.select("fingerprint").distinct()
    ids = marks.join(shared, "fingerprint").select("id", "fingerprint").distinct()
    texts = df.select(F.col(id_col).alias("id"), canon(F.col(text)).alias("canon")).join(ids, "id").join(twins.where("number > 0"), ["fingerprint", "canon"])
    new = texts.select("id", "fingerprint", F.concat_ws("-", "fingerprint", "number").alias("__new")).dropDuplicates(["id", "fingerprint"])
    return marks.join(new, ["id", "fingerprint"], "left").withColumn("fingerprint", F.coalesce("__new", "fingerprint")).drop("__new")
