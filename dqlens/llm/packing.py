"""Best-fit packing of tokenized documents, certified by lower bounds and repacked where a gap is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import word_ids

#: Tokens of a sequence, rows of a bucket that are packed together, rounds of exchanges at most, bins whose room a bucket with a gap gives up.
CAPACITY, ROWS_PER_BUCKET, ROUNDS, SLACK = 4096, 50_000, 12, 4
END = (1).to_bytes(4, "little")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each length, and the fill of each bin.

    Bins are kept by what is free in them; bit f of a number says whether some bin has f free, so the
    tightest bin that fits is its lowest bit from the length on.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_free: dict[int, list[int]] = {}
    free, fill = 0, []
    for i in order.tolist():
        n = int(lengths[i])
        rest = free >> n
        if rest:
            f = n + (rest & -rest).bit_length() - 1
            stack = by_free[f]
            b = stack.pop()
            if not stack:
                free ^= 1 << f
        else:
            f, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, capacity - f
        fill[b] += n
        f -= n
        if f:
            stack = by_free.setdefault(f, [])
            if not stack:
                free |= 1 << f
            stack.append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins that any packing needs, by dual feasible functions: the best over two families.

    The first rounds lengths over capacity - k up to a whole bin and those under k down to nothing; the second
    takes floor((j + 1) * x) / j of each share x of a bin (and x itself, where that is whole).
    """
    return bound_of(dict(enumerate(np.bincount(lengths).tolist())) if len(lengths) else {}, capacity)


def bound_of(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """lower_bound() of as many lengths as counts says."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    n, z = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    k = np.arange(1, capacity // 2 + 1)
    large = n[capacity + 1] - n[capacity - k + 1]
    middle = z[capacity - k + 1] - z[k]
    best = max(best, int((large - (-middle // capacity)).max()))
    for j in range(1, 101):
        whole = (j + 1) * size % capacity == 0
        value = np.where(whole, size * j, (j + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * j)))
    return best


def tokenized(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, copy, piece, start, length, ids_crc32 and one row for each piece of each text.

    A text's ids are those of the tokenizer in the file at path (which every executor can read), then id 1. Only what is longer than a
    sequence is cut, into full pieces and a last one. A null text is an empty one: one id. copy tells rows
    with the same id apart by the text's checksum.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = word_ids(path)
        try:
            for pdf in batches:
                rows = []
                for key, t in zip(pdf["id"], pdf["text"], strict=True):
                    buf = ids.packed(t or "") + END
                    n = len(buf) // 4
                    whole = zlib.crc32(buf)
                    rows.extend((key, whole, k, s, min(capacity, n - s), zlib.crc32(buf[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity)))
                yield pd.DataFrame(rows, columns=["id", "copy", "piece", "start", "length", "ids_crc32"])
        finally:
            ids.clear()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, copy long, piece int, start long, length long, ids_crc32 long")


def _pack(capacity: int, slack: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        # certified: no packing of these rows alone has fewer bins; the room that is left may still serve rows of others
        gap = len(fill) - lower_bound(lengths, capacity)
        order = np.argsort(fill, kind="stable")
        room = np.cumsum(capacity - fill[order])
        given = order[: int(np.searchsorted(room, (slack if gap else 1) * capacity)) + 1]
        pdf["bin"], pdf["offset"], pdf["open"] = bins, offsets, np.isin(bins, given[fill[given] < capacity])
        return pdf

    return run


def packed(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = ROWS_PER_BUCKET, rounds: int = ROUNDS, slack: int = SLACK) -> DataFrame:
    """pieces (length and other columns) with sequence_id and offset.

    Full pieces are sequences of their own. The others are dealt to buckets of about per_bucket rows by hash and packed
    there. A bucket keeps its full bins and gives up its emptiest: those with room for slack bins if its lower bound leaves a gap, for one bin if it is
    certified. The rows of those meet in fewer buckets, in another mixture, and are packed again. That
    ends when the lower bound of all rows is met, when one bucket is left, or when a round saves no bin (the packing before it stays then). Every
    round writes narrow rows to the shared folder, and only given-up rows go on.
    """
    cols = pieces.columns
    keyed = pieces.withColumn("__key", F.xxhash64(*cols))
    full = F.struct(F.lit(-1).alias("round"), F.lit(0).cast("long").alias("bucket"), F.monotonically_increasing_id().alias("bin")).alias("__seq")
    done = [keyed.where(F.col("length") >= capacity).select(*cols, F.lit(0).cast("long").alias("offset"), full)]
    rest, given, bins = keyed.where(F.col("length") < capacity), None, 0
    counts = rest.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # fewer than capacity rows
    n, least = sum(r.n for r in counts), bound_of({r.length: r.n for r in counts}, capacity)
    kept = 0
    for k in range(rounds if n else 0):
        buckets = -(-n // per_bucket)
        dealt = rest.withColumn("__bucket", F.pmod(F.xxhash64("__key", F.lit(k)), F.lit(buckets)).cast("long"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", bin long, offset long, open boolean"
        got = cut(dealt.groupBy("__bucket").applyInPandas(_pack(capacity, slack), schema))
        per = got.groupBy("__bucket").agg((F.max("bin") + 1).alias("bins"), F.count_distinct(F.when(F.col("open"), F.col("bin"))).alias("given"), F.count(F.when(F.col("open"), 1)).alias("rows"))
        now = per.agg(F.sum("bins").alias("bins"), F.sum("given").alias("given"), F.sum("rows").alias("rows")).head()
        if given is not None and now.bins >= bins:
            done.append(given)
            break
        seq = F.struct(F.lit(k).alias("round"), F.col("__bucket").alias("bucket"), F.col("bin").alias("bin")).alias("__seq")
        if not now.rows or buckets == 1 or k == rounds - 1 or kept + now.bins <= least:
            done.append(got.select(*cols, "offset", seq))
            break
        done.append(got.where("NOT open").select(*cols, "offset", seq))
        given, bins, n, kept = got.where("open").select(*cols, "offset", seq), now.given, now.rows, kept + now.bins - now.given
        rest = got.where("open").select(*cols, "__key")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # a number that keeps rounds, buckets and bins apart
    s = F.col("__seq")
    number = F.when(s["round"] < 0, -1 - s["bin"]).otherwise(s["round"] * F.lit(1 << 56) + s["bucket"] * F.lit(1 << 24) + s["bin"])
    return out.withColumn("sequence_id", number.cast("long")).drop("__seq")


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset. See tokenized() and packed().

    Repeated rows are packed a time each. An empty table gives an empty result. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    # ids go as text: numbers with nulls among them would be rounded
    pieces = cut(tokenized(df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")), path, "id", "text", capacity))
    out = packed(pieces, capacity)
    return out.select(F.col("id").cast(kind).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
