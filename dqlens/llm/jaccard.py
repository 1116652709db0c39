"""N-gram Jaccard join: an exact similarity join of shingle sets as points of a metric space.

1. Cells. Nearly all pairs of texts are at Jaccard distance 1, and so is a text from nearly every pivot: windows around its bisectors would copy each
   text into every region. So the first pivots are single shingles. They are ordered by the number of sets that have them, rarest first; a set belongs to its
   first one, and it is copied to the next ones as far as a linked set may belong there: two sets of similarity s or more share one of
   the first |x| - ceil(s |x|) + 1 shingles of each. A set whose first shingles are all its own has no link and no cell. This is done with a part of
   the hash range first, over all sets, and with all shingles of the sets that it leaves.
2. Regions. Each cell offers a set of it as a pivot; those that aren't connected to a better one stay. Each set belongs to the region of a pivot nearby (Voronoi). Sets at the
   boundary are copied: a set visits the regions of all sets in its cells, unless the triangle inequality says that it is too far from the pivot to have
   a link there. Sets within reach of a pivot are linked to it.
3. Rings. Inside a region, sets are in rings by their distance from the pivot, each as wide as a link may be long; by the
   triangle inequality linked sets are in the same ring or in neighbouring ones. Those that aren't connected yet are compared, unless what they share with
   the pivot, and outside of it with anyone, rules a link out.
4. Recursion. A region with too much to compare draws pivots among its sets that aren't connected yet, and is divided into regions again.

Exact copies of a set are one point throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .sketch import id_filter

WORDS, SIMILARITY = 5, 80
#: Share of the hash range whose shingles are counted; a set's first shingles are nearly always among them, else the next ones are taken as well.
COUNTED = 0.35
BOUND = np.uint64(int(COUNTED * 2**64))
#: Entries that one task sorts; pairs with one pivot, or rows of a region, that go to one place.
ENTRIES, DEALT = 1_500_000, 500
#: Pairs of rows of a region from which it is divided; pivots that divide it; how often (beyond that its rows are compared in blocks of DEALT).
WORK, PIVOTS, LEVELS = 2_000_000, 8, 4
#: Links that one task joins.
ONE_TASK = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The distinct hashes of a whole text's shingles of k words, ascending; of all its words if there are fewer; none without words.

    A-Z are lower-cased; words end at ASCII white space.
    """
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    s = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        s = (s ^ h[i : len(words) - n + 1 + i]) * MULTIPLIER
        s ^= s >> np.uint64(29)
    return np.unique(s)


def node_of(s: np.ndarray) -> int | None:
    """The digest that a set is known by; None for an empty set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None


def prefix(n, percent: int = SIMILARITY):
    """How many of its first shingles a set of n must offer."""
    return n - (percent * n + 99) // 100 + 1


def signatures(df: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """id, n (size of the set), node (digest of the set), counted (its shingles under BOUND), more (the next ones, if those are too few)."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                s = shingles(t, k)
                n, c = len(s), int(np.searchsorted(s, BOUND))
                want = prefix(n, percent)
                rows.append((n, node_of(s), c, s[c:want].view(np.int64).tolist() if n and c < want else None))
            yield pd.DataFrame({"n": [r[0] for r in rows], "node": pd.array([r[1] for r in rows], "Int64"), "counted": [r[2] for r in rows], "more": [r[3] for r in rows]})

    made = F.pandas_udf(run, "n long, node long, counted long, more array<long>")
    return df.select(F.col(id_col).alias("id"), made(F.col(text)).alias("made")).select("id", "made.*")


def _blobs(part: np.ndarray, columns: list[np.ndarray]) -> pd.DataFrame:
    """One row for each part: its entries, column after column, as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    ends = np.flatnonzero(np.diff(part)) + 1
    starts = np.concatenate([[0], ends]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
    ends = np.concatenate([ends, [len(part)]]) if len(part) else ends
    columns = [c[order] for c in columns]
    return pd.DataFrame({"part": part[starts].astype(np.int64), "blob": [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(starts, ends, strict=True)]})


def _unblob(blobs, kinds: list) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n = len(b) // (8 * len(kinds))
        for i, kind in enumerate(kinds):
            out[i].append(np.frombuffer(b, kind, n, 8 * n * i))
    return [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, kinds, strict=True)]


def shared_shingles(df: DataFrame, text: str, k: int, parts: int, bound: np.uint64 | None = BOUND, keep=None) -> DataFrame:
    """part (of the node), blob (nodes, shingles, counts): the shingles under bound (None: all) that two sets or more have, with how many have them.

    keep: which nodes to read, as a function on an array; a few others may come along. Entries travel as blobs, one for each part and task, and are sorted in numpy; single ones, most of all, end there.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush():
            s, node = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            return _blobs((s % np.uint64(parts)).astype(np.int64), [s, node])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()  # copies of a set go here already, as far as memory allows
        size = 0
        for pdf in batches:
            for t in pdf["text"]:
                s = shingles(t, k)
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(node)
                if keep is not None and not keep(np.array([node]))[0]:
                    continue
                c = s if bound is None else s[: np.searchsorted(s, bound)]
                held.append((c, np.full(len(c), node, np.int64)))
                size += len(c)
                if size >= ENTRIES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        s, node = _unblob(pdf["blob"], [np.uint64, np.int64])
        order = np.lexsort((node, s))
        s, node = s[order], node[order]
        if len(s):
            first = np.concatenate([[True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])])
            s, node = s[first], node[first]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.diff(np.concatenate([starts, [len(s)]]))
            n = np.repeat(n, n)
            many = n > 1
            s, node, n = s[many], node[many], n[many].astype(np.int64)
        else:
            n = np.zeros(0, np.int64)
        return _blobs(node % parts, [node, s.view(np.int64), n])

    tokens = df.select(F.col(text).alias("text")).mapInPandas(emit, "part long, blob binary")
    return tokens.groupBy("part").applyInPandas(count, "part long, blob binary")


def cells(nodes: DataFrame, shared: DataFrame, parts: int, percent: int) -> DataFrame:
    """s, node, have: the shingles among the first of a set that other sets have, and how many of its counted ones others have. nodes: node, n, counted, more."""

    def choose(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        node, s, many = _unblob(right["blob"], [np.int64, np.int64, np.int64])
        left = left.sort_values("node")
        ids, n, counted = left["node"].to_numpy(np.int64), left["n"].to_numpy(np.int64), left["counted"].to_numpy(np.int64)
        want = prefix(n, percent)
        order = np.lexsort((s, many, node))
        s, node = s[order], node[order]
        at = np.searchsorted(ids, node)
        known = at < len(ids)
        known[known] = ids[at[known]] == node[known]
        s, node, at = s[known], node[known], at[known]
        have = np.bincount(at, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        left_over = want - (counted - have)  # what the shingles of its own leave
        rank = np.arange(len(node)) - (np.cumsum(have) - have)[at]
        take = rank < left_over[at]
        out = [pd.DataFrame({"s": s[take], "node": node[take], "have": have[at[take]]})]
        extra = [(x, i, h) for i, h, more in zip(ids.tolist(), have.tolist(), left["more"], strict=True) if more is not None for x in more]
        if extra:
            out.append(pd.DataFrame(extra, columns=["s", "node", "have"]))
        return pd.concat(out, ignore_index=True)

    by = nodes.withColumn("part", F.pmod("node", F.lit(parts))).groupBy("part")
    return by.cogroup(shared.groupBy("part")).applyInPandas(choose, "s long, node long, have long")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, root: the smallest node that each node of links (a, b) reaches.

    The links are counted first. Up to one_task of them meet in a single task, which joins them in its memory; beyond, large and small
    stars are alternated until nothing changes. Both give the same rows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def facts(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())

    before = facts(edges)
    if before[0] <= one_task:
        return edges.coalesce(1).mapInPandas(_joined, "node long, root long")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(edges)
        edges, after = new, facts(new)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(up), "root": [root(x) for x in list(up)]}, dtype="int64")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (node, p), each once, with n and pn (sizes of their sets) and inter (size of the intersection). sets: node, n, set.

    A pivot p of many pairs is dealt out: its set goes to one place for every DEALT of them.
    """
    hot = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts")).where("parts > 1")
    left = pairs.join(hot, "p", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    left = left.join(sets.select("node", "n", F.col("set").alias("x")), "node")
    right = sets.select(F.col("node").alias("p"), F.col("n").alias("pn"), F.col("set").alias("y")).join(hot, "p", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["p", "part"]).select("node", "p", "n", "pn", F.size(F.array_intersect("x", "y")).cast("long").alias("inter"))


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the measured pairs that are links, as a and b."""
    return pairs.where((F.col("node") != F.col("p")) & (100 * F.col("inter") >= percent * (F.col("n") + F.col("pn") - F.col("inter")))).select(F.col("node").alias("a"), F.col("p").alias("b"))


def _ring(percent: int) -> Column:
    """The distance of a measured pair in whole lengths of the longest link, in integers: from any pivot, linked sets differ in it by 1 at most."""
    return F.expr(f"cast((100 * (n + pn - 2 * inter)) div ({100 - percent} * (n + pn - inter)) AS int)")


def regions(offers: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the first regions, and the links to their pivots. offers: s, node, have, deg.

    Rows: region (its pivot), node, n, have, own (the region that the set belongs to), o (what it shares with the pivot), ring.

    Each cell offers the set of most cells, the text that others are edited from. Of sets that links to those connect, the one with most links stays
    a pivot and has them all in its region; other sets follow the nearest one that they were offered. Linked sets share a cell, so each of them visits the
    region of the other if it visits those of all sets in its cells. Cells whose sets belong to the same regions are of one kind; sets
    are joined with kinds of cells, not with each cell.
    """
    pivots = offers.groupBy("s").agg(F.max(F.struct("deg", F.xxhash64("node").alias("h"), "node"))["node"].alias("p"))
    near = cut(measured(offers.join(pivots, "s").where("node <> p").select("node", "p").distinct(), sets))
    links = _linked(near, percent)
    roots = components(links)
    rank = offers.groupBy("node").agg(F.first("deg").alias("deg"), F.first("have").alias("have")).join(links.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("linked")), "node", "left")
    rank = cut(rank.join(roots, "node", "left").withColumn("rank", F.struct(F.coalesce("linked", F.lit(0)).alias("linked"), "deg", F.xxhash64("node").alias("h"), "node")))
    leaders = rank.where("root IS NOT NULL").groupBy("root").agg(F.max("rank")["node"].alias("leader"))
    nearest = near.groupBy("node").agg(F.max(F.struct((F.col("inter") / (F.col("n") + F.col("pn") - F.col("inter"))).alias("likeness"), F.xxhash64("p").alias("h"), "p"))["p"].alias("nearest"))
    up = cut(rank.join(leaders, "root", "left").join(nearest, "node", "left").select("node", F.coalesce("leader", "nearest", "node").alias("own")))
    own = cut(up.join(up.select(F.col("node").alias("own"), F.col("own").alias("next")), "own").select("node", F.col("next").alias("own")))
    belong = offers.join(own, "node").select("s", "own").distinct()
    kinds = belong.groupBy("s").agg(F.bit_xor(F.xxhash64("own")).alias("x"), F.count(F.lit(1)).alias("c")).select("s", F.xxhash64("x", "c").alias("kind"))
    there = belong.join(kinds, "s").select("kind", F.col("own").alias("p")).distinct()
    visits = offers.join(kinds, "s").select("node", "kind").distinct().join(there, "kind").select("node", "p").distinct()
    sizes = sets.select("node", "n")
    itself = visits.where("node = p").join(sizes, "node").select("node", "p", "n", F.col("n").alias("pn"), F.col("n").alias("inter"))
    every = near.join(visits, ["node", "p"], "left_semi").unionByName(measured(visits.where("node <> p").join(near, ["node", "p"], "left_anti"), sets)).unionByName(itself)
    every = cut(every.withColumn("ring", _ring(percent)).join(own, "node").join(rank.select("node", "have"), "node"))
    reach = every.where("own = p").groupBy("p").agg(F.max("ring").alias("reach"))
    rows = every.join(reach, "p").where("ring <= reach + 1")
    return rows.select(F.col("p").alias("region"), "node", "n", "have", "own", F.col("inter").alias("o"), "ring"), links.unionByName(_linked(every, percent))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows of regions with two components or more, with root, minor (not of the main component), work (pairs to look at) and parts."""
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sums = rows.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c"))
    facts = sums.groupBy("region").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    facts = facts.select("region", F.col("main.root").alias("main"), ((F.col("m") - F.col("main.c")) * F.col("m")).alias("work"), F.ceil(F.col("m") / DEALT).cast("int").alias("parts"))
    return cut(rows.join(facts, "region").withColumn("minor", F.col("root") != F.col("main")).drop("main"))


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, p) of sets in one region that may be links and aren't connected. rows: of _rooted().

    Two sets share at most the lesser of what each has in common with the pivot and the lesser of what each shares with anyone outside of it.
    """
    rest = F.greatest(F.col("have") - F.col("o"), F.lit(0))
    x = rows.where("minor").select("region", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("o").alias("oa"), rest.alias("ea"), F.col("own").alias("wa"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ring")
    x = x.withColumn("ring", F.explode(F.sequence(F.col("ring") - 1, F.col("ring") + 1)))
    y = rows.select("region", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("o").alias("ob"), rest.alias("eb"), F.col("own").alias("wb"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "ring", F.col("minor").alias("mb"))
    most = F.least("oa", "ob") + F.least("ea", "eb")
    once = F.col("region") == F.least("wa", "wb")  # linked sets visit each other's regions: one of the two is enough
    fit = (F.col("ra") != F.col("rb")) & (~F.col("mb") | (F.col("a") > F.col("b"))) & once & (100 * most >= percent * (F.col("na") + F.col("nb") - most))
    return x.join(y, ["region", "ring", "part"]).where(fit).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("p")).distinct()


def divided(rows: DataFrame, sets: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows of large regions: the rows of smaller ones, the rows of those that can't be divided, the links found.

    Pivots are drawn among the sets that aren't connected to the main component. Each set of the region goes to the nearest one and is
    copied to the others whose ring is at most two rings farther out. A pivot, compared with all sets of the region, is done with.
    Where the copies make more than half of the work anew, since all sets are far from all pivots, the region stays whole.
    """
    drawn = rows.where("minor").groupBy("region", F.pmod(F.xxhash64("node", F.lit(level)), F.lit(PIVOTS)).alias("b")).agg(F.min(F.struct(F.xxhash64("node", F.lit(level + 100)).alias("h"), "node"))["node"].alias("p"))
    pairs = rows.select("region", "node", "n", "have", "minor").join(drawn.select("region", "p"), "region")
    got = cut(measured(pairs.where("node <> p").select("node", "p").distinct(), sets))
    near = pairs.join(got.withColumn("ring", _ring(percent)).select("node", "p", "inter", "ring"), ["node", "p"], "left")
    near = near.select("node", "n", "have", "minor", F.coalesce("inter", "n").alias("o"), F.coalesce("ring", F.lit(0)).alias("ring"), (F.col("node") == F.col("p")).alias("pivot"), F.col("region").alias("whole"), F.xxhash64("region", "p").alias("region"))
    nearest = near.groupBy("whole", "node").agg(F.min(F.struct("ring", "region")).alias("own"), F.max("pivot").alias("done"))
    near = cut(near.join(nearest.where("NOT done"), ["whole", "node"]).where("ring <= own.ring + 2").select("whole", "region", "node", "n", "have", "minor", F.col("own.region").alias("own"), "o", "ring"))
    each = near.groupBy("whole", "region").agg((F.sum(F.col("minor").cast("long")) * F.count(F.lit(1))).alias("work"))
    before = rows.groupBy("region").agg(F.max("work").alias("before")).withColumnRenamed("region", "whole")
    good = cut(each.groupBy("whole").agg(F.sum("work").alias("work")).join(before, "whole").where("2 * work <= before").select("whole"))
    stay = rows.join(good.withColumnRenamed("whole", "region"), "region", "left_anti")
    return near.join(good, "whole", "left_semi").drop("whole", "minor"), stay, _linked(got, percent)


def links_in(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) of nodes that connect all that the links of the cells' sets connect; None if there are no cells. found: s, node, have (how many shingles it shares with anyone)."""
    offers = cut(found.join(found.groupBy("node").agg(F.count(F.lit(1)).alias("deg")), "node"))
    if percent >= 100 or offers.limit(1).count() == 0:  # the sets differ
        return None
    rows, links = regions(offers, sets, percent)
    for level in range(LEVELS + 1):
        rows = _rooted(rows, components(links))
        now, large = rows.where(f"work <= {WORK}"), rows.where(f"work > {WORK}")
        if again := level < LEVELS and large.limit(1).count() > 0:
            large, stay, new = divided(large, sets, percent, level)
            now, links = now.unionByName(stay), links.unionByName(new)
        links = links.unionByName(cut(_linked(measured(candidates(now if again else rows, percent), sets), percent)))
        if not again:
            break
        rows = large
    return links


def _live(rows: DataFrame) -> DataFrame:
    """The rows of cells with two members or more."""
    rows = cut(rows)
    out = cut(rows.join(rows.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("s"), "s"))
    discard(rows)
    return out


def jaccard(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two rows link when 100 * intersection >= percent * union of their shingle sets; see shingles(). Null, empty and blank texts have no shingles and no
    links. Equal sets are linked. Repeated rows get a row each. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    info = cut(signatures(df, id_col, text, k, percent))
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * COUNTED / ENTRIES) + 1)
    nodes = cut(info.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("counted").alias("counted"), F.first("more").alias("more")))
    first = _live(cells(nodes.select("node", "n", "counted", "more"), shared_shingles(df, text, k, parts), parts, percent))
    # The sets that are left are ordered once more, by all their shingles and counted among themselves: a passage
    # that many texts share then comes last, and most sets that have little else in common leave their cells.
    some = cut(first.select("node").distinct().join(nodes.select("node", "n"), "node"))
    left = some.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(left / ENTRIES) + 1)
    again = shared_shingles(df, text, k, parts, None, id_filter(some, "node"))
    found = _live(cells(some.select("node", "n", F.col("n").alias("counted"), F.lit(None).cast("array<bigint>").alias("more")), again, parts, percent))
    discard(first)
    wanted = cut(found.select("node").distinct().join(nodes.select("node", "id", "n"), "node"))
    keep = id_filter(wanted.select(F.xxhash64("id").alias("key")), "key")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[keep(pdf["key"].to_numpy())]
            if not len(pdf):
                continue
            sets = [shingles(t, k) for t in pdf["text"]]
            # rows that share an id may have other texts, so sets are known by their digests
            yield pd.DataFrame({"node": pd.array([node_of(s) for s in sets], "Int64"), "set": [s.view(np.int64) for s in sets]})

    all_sets = df.select(F.xxhash64(F.col(id_col)).alias("key"), F.col(text).alias("text")).mapInPandas(sets_of, "node long, set array<long>")
    sets = cut(all_sets.join(wanted, "node").where(F.size("set") == F.col("n")).select("node", "n", "set").dropDuplicates(["node"]))
    links = links_in(found, sets, percent)
    least = nodes.select("node", F.col("id").alias("least"))
    if links is not None:
        roots = components(links).withColumnRenamed("root", "r")
        groups = roots.join(least, "node").groupBy("r").agg(F.min("least").alias("component"))
        least = least.join(roots.join(groups, "r").select("node", "component"), "node", "left").select("node", F.coalesce("component", "least").alias("least"))
    out = info.select("id", "n", "node").join(least, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with df's columns: that of the smallest id, rows without one coming last.

    Rows count as the same if id and text are equal, nulls included; such a row stays once. Other rows that share an id, or have none, are rows of their own.
    """
    i, t = F.col(id_col), F.col(text)
    keyed = df.withColumn("__key", F.xxhash64(i, t, i.isNull(), t.isNull()))
    found = jaccard(keyed, "__key", text).distinct().join(keyed.select("__key", i.alias("__id")).distinct(), "__key")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__key")).alias("first"))
    return keyed.join(first.select("first.__key"), "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def sql(docs: str = "documents", k: int = WORDS, percent: int = SIMILARITY) -> str:
    """jaccard() in DuckDB's SQL, for ids without nulls: all pairs with a common shingle, then all reachable ids."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) END AS gs FROM w),
    n AS MATERIALIZED (SELECT doc_id, len(gs) AS n FROM s),
    g AS MATERIALIZED (SELECT doc_id, unnest(gs) AS g FROM s),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
    m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM n LEFT JOIN m ON m.a = doc_id"""
