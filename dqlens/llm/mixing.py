"""Mixing sources to target weights: blocks of tokens, drawn for output shards through index permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded, cut, n_words, numbered

#: Words of a block, blocks of an output shard on average, rows or blocks that one task numbers.
BLOCK, SHARD_BLOCKS, ROWS_PER_TASK = 256, 1024, 1_000
#: Weights of the sources in their order, repeating; no source is repeated more often than this.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, total, rows: one row each) with rank, target, whole epochs and the words left after those.

    Targets share the sum of all totals by weight, but stop at most * total; what is over is shared again by
    weight until none is above. In the order of most * total / weight those that stop come first, so running
    sums give the common level at once: one window over one row for each source.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(x) for x in weights])
    s = sources.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).withColumn("weight", F.element_at(choices, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("total") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("total").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", free / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that isn't above its cap, at the level of those from it on, fixes the level
    s = s.withColumn("fixed", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    s = s.withColumn("target", F.when(F.col("ratio") <= F.col("fixed"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("fixed")))
    s = s.withColumn("want", F.round("target").cast("long"))
    s = s.withColumn("epochs", F.when(F.col("total") > 0, F.floor(F.col("want") / F.col("total"))).otherwise(F.lit(0)).cast("long"))
    return s.select("source", "rank", "total", "rows", "target", "epochs", (F.col("want") - F.col("epochs") * F.col("total")).alias("left"))


def _bucket(h: Column, n: Column) -> Column:
    """One of as many buckets as n rows need, by the first bits of a hash, in the order of the hash."""
    return F.floor(F.shiftrightunsigned(h, 34) * F.greatest(F.ceil(n / ROWS_PER_TASK), F.lit(1)) / 2**30).cast("long")


def permuted(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """rank, epoch, block, place and the source's figures: for each epoch of each source a pseudorandom permutation of its block numbers.

    Blocks are ordered by hash; buckets of hashes are counted, and only rows of one bucket are sorted together.
    The last block, which may be shorter, keeps the last place, so place * block words come before any place.
    """
    zero = F.lit(0).cast("long")
    s = sources.where("total > 0").select("rank", "epochs", "left", "total", F.ceil(F.col("total") / block).cast("long").alias("blocks"))
    s = s.withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("blocks") - 1) / ROWS_PER_TASK)))).repartition("rank", "part")
    first = F.col("part") * ROWS_PER_TASK
    s = s.withColumn("block", F.explode(F.sequence(first, F.least(F.col("blocks"), first + ROWS_PER_TASK) - 1)))
    s = s.withColumn("epoch", F.explode(F.sequence(zero, F.col("epochs") - F.when(F.col("left") > 0, 0).otherwise(1))))
    s = s.withColumn("h", F.xxhash64("rank", "epoch", "block", F.lit(seed))).withColumn("tail", F.col("block") == F.col("blocks") - 1)
    return numbered(s, ["rank", "epoch"], ["h", "block"], F.struct("tail", _bucket(F.col("h"), F.col("blocks")).alias("b")), "place")


def drawn(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """rank, blocks, shard, n, offset: how many slots of each source each output shard draws, and how many the shards before it have.

    Each slot that a source is to fill falls on a shard, all being alike, so the counts of the sources in a shard are multinomial, given that each
    source's sum meets its target. (Free multinomial draws would let the sums miss the targets by chance, and pass the cap.)
    """
    s = sources.where("total > 0").select("rank", F.ceil(F.col("total") / block).cast("long").alias("blocks"), "epochs", F.ceil(F.col("left") / block).cast("long").alias("more"))
    s = s.withColumn("slots", F.col("epochs") * F.col("blocks") + F.col("more")).where("slots > 0")
    shards = sources.agg(F.greatest(F.ceil(F.sum("total") / (block * shard_blocks)), F.lit(1))).head()[0] or 1
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / ROWS_PER_TASK)))).repartition("rank", "part")
    first = F.col("part") * ROWS_PER_TASK
    s = s.withColumn("slot", F.explode(F.sequence(first, F.least(F.col("slots"), first + ROWS_PER_TASK) - 1)))
    counts = s.groupBy("rank", "blocks", F.pmod(F.xxhash64("rank", "slot", F.lit(seed + 1)), F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, ["rank"], ["shard"], F.floor(F.col("shard") / ROWS_PER_TASK), "k", F.col("n"), "offset").drop("k")


def slots(sources: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """The mix as slots: shard, rank, epoch, block, words (those that it takes from the block's start).

    The counts drawn by the shards are laid end to end: they give each shard its slots of a source. A source's slots are whole epochs
    and the first places of a last one; a pseudorandom permutation of each epoch maps a slot's place to the block.
    """
    s = drawn(sources, block, shard_blocks, seed)
    s = s.withColumn("slot", F.explode(F.sequence("offset", F.col("offset") + F.col("n") - 1)))
    s = s.select("rank", F.floor(F.col("slot") / F.col("blocks")).alias("epoch"), F.pmod("slot", "blocks").alias("place"), "shard")
    p = permuted(sources, block, seed).join(s.hint("merge"), ["rank", "epoch", "place"])
    want = F.when(F.col("epoch") < F.col("epochs"), F.col("total")).otherwise(F.col("left"))
    taken = F.least(F.lit(block), F.col("total") - F.col("block") * block, want - F.col("place") * block)
    return p.select("shard", "rank", "epoch", "block", taken.alias("words"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0, whole: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents as they are packed, and the pieces that the mix takes of them.

    Documents: id, src, digest (of the text), whole (a mark of the row, if given), size, source_size, target, rank (of the source), row (number inside
    it), start (words before it there). Pieces: rank, row, shard, epoch, block, from_word, n_words.

    A source's documents, in the order of hashed ids, are one run of words cut into blocks; slots pick blocks by
    number. A null source is a source of its own, after the others. Null and empty texts have size 0 and nothing is
    taken of them. Repeated rows are documents of their own. No word is taken more than three times. Sizes are read
    once; all later steps work on narrow rows. An empty table gives empty results. Other columns are not read.
    """
    t = F.col(text)
    sized = cut(df.select(F.col(id_col).alias("id"), F.col(source).alias("src"), n_words(t).alias("size"), F.xxhash64(t).alias("digest"), (F.lit(0).cast("long") if whole is None else whole).alias("whole")))
    totals = sized.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows"))
    sources = cut(targets(totals))
    docs = bounded(sized, sources.select(F.col("source").alias("src"), "rank", "total", "target", "rows"), ["src"])
    docs = docs.withColumn("h", F.xxhash64("id", "digest", F.lit(seed)))
    docs = numbered(docs, ["rank"], ["h", "id", "digest", "whole"], _bucket(F.col("h"), F.col("rows")), "row", F.col("size"), "start")
    docs = cut(docs.select("id", "src", "digest", "whole", "size", F.col("total").alias("source_size"), "target", "rank", "row", "start"))
    end = F.col("start") + F.col("size")
    parts = docs.where("size > 0").select("rank", "row", "start", end.alias("end"), F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    got = parts.join(slots(sources, block, seed=seed).select("shard", "rank", "epoch", "block", "words").hint("merge"), ["rank", "block"])
    got = got.withColumn("n_words", F.least(F.col("end"), F.col("block") * block + F.col("words")) - first).where("n_words > 0")
    return docs, got.select("rank", "row", "shard", "epoch", "block", (first - F.col("start")).alias("from_word"), "n_words")


def taken(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per row: id, size, source_size, target, taken (words that the mix takes of it, repeats counted), shards (output shards that got some of them). See mix()."""
    docs, pieces = mix(df, id_col, text, source, block, seed)
    sums = pieces.groupBy("rank", "row").agg(F.sum("n_words").alias("taken"), F.size(F.collect_set("shard")).cast("long").alias("shards"))
    out = docs.join(sums, ["rank", "row"], "left")
    none = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("shards", none).alias("shards"))


def mixed(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as rows with df's columns: a document comes once for each epoch that takes words of it.

    The text of such a row is the document's own where all its words are taken, else the runs of words taken, in their order with
    their white space, put together. An n_chars column is counted anew. Rows that are equal in all columns (but maps) are interchangeable:
    their takes are joined to one of them. An empty table gives an empty result; rows without words are in no mix.
    """
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    # nulls leave the hash as it was, so they are hashed as well
    whole = F.xxhash64(*plain, *[c.isNull() for c in plain])
    docs, pieces = mix(df, id_col, text, source, block, seed, whole)
    spans = pieces.groupBy("rank", "row", "epoch").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("__spans"), F.sum("n_words").alias("__n"))
    plan = spans.join(docs.select("rank", "row", "id", "src", "digest", "whole", "size"), ["rank", "row"]).select("id", "src", "digest", "whole", "size", "__spans", "__n")
    key = [F.col(id_col).alias("__id"), F.col(source).alias("__src"), F.xxhash64(F.col(text)).alias("__digest"), whole.alias("__whole")]
    own = df.select(*key, F.struct(*df.columns).alias("__row")).groupBy("__id", "__src", "__digest", "__whole").agg(F.first("__row").alias("__row"))
    both = own.join(plan, F.col("__id").eqNullSafe(F.col("id")) & F.col("__src").eqNullSafe(F.col("src")) & (F.col("__digest") == F.col("digest")) & (F.col("__whole") == F.col("whole")))
    t = F.col(f"__row.`{text}`")
    tokens = F.regexp_extract_all(t, F.lit(f"[^\\x20\\x09-\\x0D]+{SPACE}*"), F.lit(0))
    cut_out = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(tokens, s["from_word"] + 1, s["n_words"]))), "")
    new = F.when(F.col("__n") == F.col("size"), t).otherwise(F.rtrim(cut_out))
    rows = both.withColumn("__new", new)
    out = {c: F.col("__new") if c == text else F.length("__new").cast("long") if c == "n_chars" else F.col(f"__row.`{c}`") for c in df.columns}
    return rows.select(*[e.alias(c) for c, e in out.items()])
