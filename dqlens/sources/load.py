"""Sources: what Spark reads, frames of other libraries, and adapters that a user registers."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a delimited file writes for a missing value.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
DELIMITED = {".csv": ",", ".tsv": "\t", ".tab": "\t", ".txt": ","}
PACKED = (".gz", ".bz2", ".zst", ".deflate", ".snappy", ".lz4")


class LoadError(ValueError):
    """A source can't be read."""


@dataclass
class Dataset:
    df: DataFrame
    name: str
    source: str
    sampling: dict | None = None

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """At most n rows, the same for the same seed."""
        return self.df.orderBy(F.xxhash64(*self.df.columns, F.lit(seed))).limit(n)


class Adapter(Protocol):
    name: str

    def can_load(self, source: Any) -> bool: ...

    def load(self, spark: SparkSession, source: Any, **options) -> DataFrame: ...


_ADAPTERS: list[Adapter] = []


def register_adapter(adapter: Adapter, first: bool = True) -> None:
    _ADAPTERS.insert(0 if first else len(_ADAPTERS), adapter)


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def infer_text_types(df: DataFrame) -> DataFrame:
    """Columns of text as whole numbers, numbers or booleans where all values are; one pass."""
    aggs = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        aggs += [F.struct(F.count(v).alias("n"), F.count(F.when(v.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), 1)).alias("i"), F.count(F.when(v.rlike(r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|Infinity)\s*$"), 1)).alias("f"), F.count(F.when(F.lower(v).isin("true", "false"), 1)).alias("b")).alias(f"`{c}`"[1:-1])]
    row = df.agg(*aggs).head() if aggs else None
    out = []
    for k, c in enumerate(df.columns):
        r, v = row[k], F.col(f"`{c}`")
        kind = "long" if r.n and r.i == r.n else "double" if r.n and r.f == r.n else "boolean" if r.n and r.b == r.n else None
        out.append((F.trim(v).cast(kind) if kind else v).alias(c))
    return df.select(*out)


def quoted_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether a field of a delimited file goes over several lines: its first line then has an odd number of quotes."""
    return not spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Files are split between tasks unless a quoted field has line ends: then a task reads a whole file."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("inferSchema", False)
    raw = reader.option("multiLine", quoted_line_ends(spark, path)).csv(path)
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return infer_text_types(clean)


def _read_path(spark: SparkSession, path: str) -> DataFrame:
    low = path.lower().rstrip("/")
    for p in (".zip", ".xz"):
        if low.endswith(p):
            raise LoadError(f"{path}: {p} files need a codec that Spark doesn't have; unpack the file or use gz, bz2 or zst")
    for p in PACKED:
        low = low.removesuffix(p)
    for suffix, sep in DELIMITED.items():
        if low.endswith(suffix):
            return read_delimited(spark, path, sep)
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if low.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    if low.endswith(".orc"):
        return spark.read.orc(path)
    if low.endswith((".parquet", ".pq")) or "." not in low.rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise LoadError(f"{path}: no reader for this kind of file")


def load(source: Any, *, spark: SparkSession | None = None, name: str | None = None, nrows: int | None = None, **options) -> Dataset:
    """A Dataset from a DataFrame, a path, a frame of pandas, Polars or Arrow, or what a registered adapter takes. With nrows only the first rows."""
    s = source.sparkSession if isinstance(source, DataFrame) else _session(spark)
    try:
        for a in _ADAPTERS:
            if a.can_load(source):
                df, kind = a.load(s, source, **options), a.name
                break
        else:
            if isinstance(source, Dataset):
                df, kind = source.df, source.source
            elif isinstance(source, DataFrame):
                df, kind = source, "dataframe"
            elif hasattr(source, "to_arrow"):
                df, kind = s.createDataFrame(source.to_arrow()), "polars"
            elif type(source).__module__.startswith("pyarrow"):
                df, kind = s.createDataFrame(source), "arrow"
            elif type(source).__module__.startswith("pandas"):
                df, kind = s.createDataFrame(source), "pandas"
            elif isinstance(source, str) or hasattr(source, "__fspath__"):
                df, kind = _read_path(s, str(source)), str(source)
            else:
                raise LoadError(f"no adapter for {type(source).__name__}")
    except LoadError:
        raise
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise LoadError(f"file not found: {source}") from e
        raise LoadError(f"can't load {source!r}: {e}") from e
    sampling = None
    if nrows is not None:
        df = df.limit(nrows)
        sampling = {"method": "head", "rows": nrows}
    label = name or (str(source).rstrip("/").rsplit("/", 1)[-1] if isinstance(source, str) or hasattr(source, "__fspath__") else "dataset")
    return Dataset(df, label, kind, sampling)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
