"""Rules that a user states for columns: all of them are counted in one pass."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


@dataclass(frozen=True)
class Rule:
    min: float | None = None
    max: float | None = None
    allowed: tuple[str, ...] | None = None
    pattern: str | None = None
    nullable: bool = True
    unique: bool = False


def conditions(df: DataFrame, rules: Mapping[str, Rule]) -> dict[tuple[str, str], Column]:
    """A condition for each rule of a column that df has: (column, kind) to a column that is true where the rule is broken."""
    out: dict[tuple[str, str], Column] = {}
    for name, r in rules.items():
        if name not in df.columns:
            continue
        v = C.present(df, name)
        text = v.cast("string")
        x = C.to_number(text) if isinstance(df.schema[name].dataType, T.StringType) else v.cast("double")
        if r.min is not None:
            out[name, "min"] = x < r.min
        if r.max is not None:
            out[name, "max"] = x > r.max
        if r.min is not None or r.max is not None:
            out[name, "numeric"] = v.isNotNull() & x.isNull()
        if r.allowed is not None:
            out[name, "allowed"] = ~text.isin(*map(str, r.allowed))
        if r.pattern is not None:
            out[name, "pattern"] = ~text.rlike(f"^(?:{r.pattern})$")
        if not r.nullable:
            out[name, "nullable"] = C.is_missing(df, name)
    return out


def violations(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """column_name, kind, n: how many rows break each rule."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.count(F.when(e, 1)).alias("n")) for (c, k), e in conditions(df, rules).items()]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, kind string, n long")
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
