"""Quality rules: a threshold table compiled into projections of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, words

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages served (English, German, French, Spanish).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "como", "con", "del", "el", "es", "esta", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)

#: name, numerator, denominator, least and most percent; a row is read as
#: least * denominator <= 100 * numerator <= most * denominator. None: no bound.
RULES: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("word_length", "word_chars", "n_words", 200, 2500),
    ("symbols", "n_symbols", "n_words", None, 25),
    ("exclamations", "n_bangs", "n_words", None, 40),
    ("stop_words", "n_stop_words", "n_words", 1, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 60),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 50),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) as one expression that computes value once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def _repeated(hashes: Column) -> Column:
    """The words in three-word windows found twice or more.

    Hashes of the windows are sorted with their places, equal neighbours give the places of repeated windows, and sorted
    places give the words covered. All of it stays inside the row; no rows are exploded.
    """
    windows = lambda h: F.sort_array(F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("i"))))
    same = lambda w, x, j: F.coalesce(x["k"] == F.get(w, j)["k"], F.lit(False))
    places = lambda w: F.sort_array(F.transform(F.filter(w, lambda x, i: same(w, x, i - 1) | same(w, x, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
    return F.aggregate(_once(_once(hashes, windows), places), start, step)["n"]


def measures(text: Column) -> Column:
    """A struct of the counts that the rules read, as one expression in which the text is split once."""
    count = lambda arr, test: F.size(F.filter(arr, test)).cast("long")

    def counted(s: Column) -> Column:
        t, ws, ls = s["t"], s["words"], s["lines"]
        without = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            without(SYMBOLS).alias("n_symbols"), without("!").alias("n_bangs"), count(ws, lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
            F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            count(ls, lambda x: x.rlike(f"^{SPACE}*[-*•]")).alias("n_bullet_lines"), count(ls, lambda x: x.rlike(f"(\\.\\.\\.|…){SPACE}*$")).alias("n_ellipsis_lines"),
            _repeated(F.transform(ws, lambda w: F.xxhash64(w))).alias("n_repeat_words"),
        )

    t = F.coalesce(text, F.lit(""))
    return _once(F.struct(t.alias("t"), words(text).alias("words"), F.filter(F.split(t, "\n"), _has_word).alias("lines")), counted)


def verdicts(m: Column, rules: Sequence[tuple] = RULES) -> dict[str, Column]:
    """One boolean for each rule (true: it is met) from a struct of counts, all integer arithmetic."""
    out = {}
    for name, top, bottom, least, most in rules:
        a, b, ok = 100 * m[top], m[bottom], F.lit(True)
        if least is not None:
            ok = ok & (a >= least * b)
        if most is not None:
            ok = ok & (a <= most * b)
        out[name] = ok
    return out


def judged(text: Column, rules: Sequence[tuple] = RULES) -> Column:
    """A struct of MEASURES, base_failed and kept.

    It is one expression that grows with the number of rules only: a filter on its result that is pushed below it has one copy of it.
    """

    def judge(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed
        for ok in verdicts(m, rules).values():
            kept = kept & ok
        return F.struct(*[m[x].alias(x) for x in MEASURES], failed.alias("base_failed"), kept.alias("kept"))

    return _once(measures(text), judge)


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[tuple] = RULES) -> DataFrame:
    """Measures and verdict of every row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words, as an empty one: all counts 0, base_failed. Repeated rows get a row each.
    Other columns of df are not read, so their names can't clash. An empty table gives an empty result.
    """
    out = df.select(F.col(id_col).alias("id"), judged(F.col(text), rules).alias("judged"))
    return out.select(F.col("id").alias(id_col), *[F.col("judged")[m].alias(m) for m in (*MEASURES, "base_failed", "kept")])


def keep_good(df: DataFrame, text: str = "text", rules: Sequence[tuple] = RULES) -> DataFrame:
    """The rows of df that are kept, with df's columns; rows with null or empty texts go, repeated rows stay or go together."""
    return df.where(judged(F.col(text), rules)["kept"])


def sql() -> str:
    """The same result in DuckDB's SQL."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    kept = " AND ".join(f"{100} * {a} >= {lo} * {b}" for _, a, b, lo, _ in RULES if lo is not None) + " AND " + " AND ".join(f"100 * {a} <= {hi} * {b}" for _, a, b, _, hi in RULES if hi is not None)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY r),
    m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
        coalesce(p.n, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept FROM b"""
