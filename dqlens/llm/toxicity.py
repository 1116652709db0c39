"""Toxicity: a chain of linear classifiers, one for each category, fed with the chances of those before."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Labelled rows that are read at most to fit the chain, in the order of their hashed ids.
SAMPLE_ROWS = 8_000
#: log2 of the number of hashed features; characters of the prefixes of words; folds; a score from which a row is toxic.
BITS, PREFIXES, FOLDS, THRESHOLD = 20, (3, 4, 5, 6), 3, 0.5
#: Toxic rows of the sample that have a feature, from which it may get a weight; how many times more often they have it than other rows.
LEAST_SEEN, LEAST_ODDS = 3, 2
#: Labelled rows of a category from which it gets a link of the chain.
LEAST_POSITIVE = 5
#: Words whose features are remembered.
CACHE = 100_000
WORD = re.compile(r"\w+")


@dataclass
class Chain:
    """names: the categories in their order, the last being toxic itself. weights: a row for each; chances before it are the last entries."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    links: np.ndarray

    def scores(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """The chance of each category for each row, a category after the other."""
        p = np.zeros((len(rows), len(self.names)))
        for k in range(len(self.names)):
            p[:, k] = _chance(_sums(self.weights[k], rows) + p[:, :k] @ self.links[k, :k] + self.bias[k])
        return p


def features(text: str | None, cache: dict[str, tuple[int, ...]], bits: int = BITS, only: frozenset[int] | None = None) -> np.ndarray:
    """Hashed words and prefixes of words that a whole text has (of those in only, if given), each once, in ascending order."""
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        ids = cache.get(w)
        if ids is None:
            if len(cache) > CACHE:
                cache.clear()
            own = {_hash(s) & ((1 << bits) - 1) for s in (w + "$", *(w[:n] for n in PREFIXES if len(w) >= n))}
            ids = cache[w] = tuple(own if only is None else own & only)
        if ids:
            found.update(ids)
    return np.fromiter(sorted(found), np.int32, len(found))


def _hash(s: str) -> int:
    import zlib

    b = s.encode("utf-8", "replace")
    return zlib.crc32(b) ^ (zlib.adler32(b) << 7)


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(w: np.ndarray, rows: Sequence[np.ndarray]) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    n = np.array([len(r) for r in rows])
    out = np.zeros(len(rows))
    if n.sum():
        flat = w[np.concatenate(rows)]
        np.add.at(out, np.repeat(np.arange(len(rows)), n), flat)
    return out


def fit_linear(rows: Sequence[np.ndarray], extra: np.ndarray, y: np.ndarray, bits: int = BITS, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on the presence of features and on extra columns, both classes weighing the same; gradient steps with moments.

    Only features that tell the classes apart in the sample start at all: those seen in one of 25 positive rows
    (three at least), and ten times as often there as in the others. So common words keep weight 0 and the length
    of a text doesn't move its score.
    """
    size, n = 1 << bits, len(rows)
    flat = np.concatenate(rows) if n else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    known, at = np.unique(flat, return_inverse=True)
    at = at.astype(np.int32)
    del flat
    pos, every = np.bincount(at, y[row], len(known)), np.bincount(at, minlength=len(known))
    n_pos = max(1.0, float(y.sum()))
    n_neg = max(1.0, n - n_pos)
    odds = (pos / n_pos) / ((every - pos + 0.1) / n_neg)
    used = np.flatnonzero((pos >= max(LEAST_SEEN, 0.04 * n_pos)) & (odds >= 10))
    new = np.full(len(known), -1, np.int32)
    new[used] = np.arange(len(used))
    at = new[at]
    row, at = row[at >= 0], at[at >= 0]
    k, m = len(used), extra.shape[1]
    t = np.zeros(k + m + 1)
    first, second = np.zeros_like(t), np.zeros_like(t)
    weight = np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg)
    for step in range(1, rounds + 1):
        z = np.bincount(row, t[at], n) + extra @ t[k : k + m] + t[-1]
        e = (_chance(z) - y) * weight
        g = np.concatenate([np.bincount(at, e[row], k), extra.T @ e, [e.sum()]]) + ridge * t
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        t -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    w = np.zeros(size)
    w[known[used]] = t[:k]
    return w, t[k : k + m], float(t[-1])


def fit(sample: pd.DataFrame, bits: int = BITS, folds: int = FOLDS) -> Chain:
    """The chain from rows with id, features (or text), lang and toxic.

    The labels name toxic documents only, so the categories are toxicity in each language (sorted by name), and
    toxicity at all as the last. Each link's chances for the rows that it is fitted on come from models fitted
    on the other folds; later links are fitted with those.
    """
    cache: dict[str, tuple[int, ...]] = {}
    rows = [np.asarray(x, np.int32) for x in sample["features"]] if "features" in sample else [features(t, cache, bits) for t in sample["text"]]
    y = sample["toxic"].fillna(0).to_numpy().astype(float)
    lang = sample["lang"].fillna("").to_numpy()
    names = [str(x) for x in sorted(set(lang)) if (y[lang == x]).sum() >= LEAST_POSITIVE]
    labels = [y * (lang == x) for x in names] + [y]
    names = [f"toxic_{x}" for x in names] + ["toxic"]
    fold = np.arange(len(rows)) % folds
    p = np.zeros((len(rows), len(names)))
    weights, bias, links = np.zeros((len(names), 1 << bits), np.float32), np.zeros(len(names)), np.zeros((len(names), len(names)))
    for k, target in enumerate(labels):
        if not target.sum():
            bias[k] = -30.0
            continue
        for f in range(folds):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            w, v, b = fit_linear([rows[i] for i in rest], p[rest, :k], target[rest], bits)
            p[own, k] = _chance(_sums(w, [rows[i] for i in own]) + p[own, :k] @ v + b)
        weights[k], links[k, :k], bias[k] = fit_linear(rows, p[:, :k], target, bits)
    return Chain(names, weights, bias, links)


def sampled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, bits: int = BITS) -> pd.DataFrame:
    """Labelled rows for fit(): at most rows of them, those with the lowest hashes of their ids; id, lang, toxic, features.

    Whole texts become features on the executors, where they are counted. Only features that LEAST_SEEN toxic rows have, and LEAST_ODDS times as often as others,
    reach the driver.
    Rows without id or label are left out; of several labels of an id, a toxic one is enough. Without a toxic row there is a warning.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    chosen = chosen.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(rows)

    def made(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, ...]] = {}
        for s in texts:
            yield pd.Series([features(t, cache, bits) for t in s])

    got = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(chosen), "id")
    got = cut(got.select("id", "lang", "toxic", "h", F.xxhash64("text").alias("t"), F.pandas_udf(made, "array<int>")("text").alias("features")))
    n = got.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count(F.lit(1)).alias("every")).head()
    seen = got.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("every"))
    seen = seen.where((F.col("pos") >= LEAST_SEEN) & (F.col("pos") * (n.every - n.pos) >= LEAST_ODDS * n.pos * (F.col("every") - F.col("pos")))).select("f").toPandas()  # a row a feature
    known = df.sparkSession.sparkContext.broadcast(np.sort(seen["f"].to_numpy(np.int32)))

    def only(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in lists:
            yield pd.Series([np.intersect1d(np.asarray(x, np.int32), known.value, assume_unique=True) for x in s])

    out = got.select("id", "lang", "toxic", "t", F.pandas_udf(only, "array<int>")("features").alias("features")).toPandas()
    discard(got)
    if not out["toxic"].sum():
        warnings.warn("no toxic row among the labelled rows to fit on: no text will be found toxic", stacklevel=2)
    return out.sort_values(["id", "lang", "t"], na_position="first").drop(columns="t").reset_index(drop=True)


def _shared(df: DataFrame, chain: Chain):
    """A function for executors that scores texts: the weights that aren't 0 are broadcast, of which there are fewer than 2 ** BITS."""
    used = np.flatnonzero(np.abs(chain.weights).sum(0))
    small = df.sparkSession.sparkContext.broadcast((used, chain.weights[:, used], chain.bias, chain.links, chain.names))
    bits = int(np.log2(chain.weights.shape[1]))

    def scorer():
        used, w, bias, links, names = small.value
        weights = np.zeros((len(names), 1 << bits))
        weights[:, used] = w
        own, cache, only = Chain(names, weights, bias, links), {}, frozenset(used.tolist())
        return lambda texts: own.scores([features(t, cache, bits, only) for t in texts])

    return scorer


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, toxic (boolean), score, category (the likeliest one, if toxic), chances (by category).

    Whole texts are read. A null or empty text has no features and isn't toxic. Repeated rows get a row
    each. Other columns are not read. An empty table gives an empty result.
    """
    scorer, names = _shared(df, chain), chain.names

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = scorer()
        for s in texts:
            p = scores(s)
            toxic = (p[:, -1] >= threshold) & (s.fillna("").str.len().to_numpy() > 0)
            best = p[:, :-1].argmax(1) if len(names) > 1 and len(p) else np.zeros(len(p), int)
            yield pd.DataFrame({"toxic": toxic, "score": p[:, -1], "category": [names[i] if t else None for i, t in zip(best, toxic, strict=True)], "chances": list(p)})

    made = F.pandas_udf(run, "toxic boolean, score double, category string, chances array<double>")
    out = df.select(F.col(id_col).alias("id"), made(F.col(text)).alias("made")).select("id", "made.*")
    chances = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), "chances")
    return out.select(F.col("id").alias(id_col), "toxic", "score", "category", chances.alias("chances"))


def keep_clean(df: DataFrame, chain: Chain, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that aren't toxic, with df's columns; null and empty texts stay."""
    scorer = _shared(df, chain)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = scorer()
        for s in texts:
            yield pd.Series((scores(s)[:, -1] < threshold) | (s.fillna("").str.len().to_numpy() == 0))

    return df.where(F.pandas_udf(run, "boolean")(F.col(text)))
