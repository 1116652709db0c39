"""Chat formatting: budgeted windows of whole turns, with the system turn, some history and a mask of the targets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordIds

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and of its repeated history at most.
BUDGET, HISTORY = 2048, 512
TOKEN = re.compile(r"\w+|[^\w\s]")
_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """Puts a backslash into every '<|' (and one more where there are some), so no control string is left."""
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted_turn(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


class TokenCounts:
    """How many tokens a public tokenizer makes of a text; without the path of one, words and marks are counted. Loaded once in each process."""

    loaded: dict[str, WordIds] = {}

    def __init__(self, path: str | None = None):
        self.path = path

    def __call__(self, text: str) -> int:
        if self.path is None:
            return len(TOKEN.findall(text))
        ids = self.loaded.get(self.path)
        if ids is None:
            ids = self.loaded[self.path] = WordIds(self.path)
        return len(ids.packed(text)) // 4


class Windows:
    """Windows of one conversation as its turns come, one after the other.

    A window has the system turn (the first turn, if that is its role), as many of the turns before as fit into the history's
    budget, all repeated without a loss, and then new turns up to the budget. Where the next turn needs the room, the oldest turns of the history go. A turn
    that doesn't fit beside the system turn alone is in a window of its own with that one, whole: only such a window passes the budget. Running sums of
    tokens pick the turns.
    """

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple[str, str] | None = None
        self.system_tokens = 0
        self.past: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.used = self.count = 0
        self.started = False

    def add(self, role: str, text: str) -> Iterator[dict]:
        n = self.tokens(text) + 4
        first = self.count == 0
        self.count += 1
        if self.new and self.used + n > self.budget:
            yield self.window()
        while self.past and not self.new and self.used + n > self.budget:
            self.used -= self.past.pop(0)[2]
        self.new.append((role, text, n))
        self.used += n
        if first and role == "system":
            self.system, self.system_tokens = (role, text), n

    def repeated(self) -> list[tuple[str, str]]:
        out = [self.system] if self.system and self.started else []
        return out + [(r, t) for r, t, _ in self.past]

    def window(self) -> dict:
        old = self.repeated()
        parts, spans, at = [], [], 0
        for k, (role, text) in enumerate([*old, *((r, t) for r, t, _ in self.new)]):
            x = formatted_turn(role, text)
            if k >= len(old) and role == "assistant":
                start = at + x.index("\n") + 1
                spans.append((start, at + len(x) - len(END) - 1 - start))
            parts.append(x)
            at += len(x)
        out = {"text": "".join(parts), "repeated": len(old), "spans": spans}
        # what the next window repeats: the last turns that fit into the history's budget, without the system turn
        turns = [*self.past, *self.new]
        if self.system and not self.started:
            turns = turns[1:]
        total, keep = 0, len(turns)
        while keep and total + turns[keep - 1][2] <= self.history:
            keep -= 1
            total += turns[keep][2]
        self.past = turns[keep:]
        self.new, self.used = [], total + self.system_tokens
        self.started = True
        return out

    def rest(self) -> Iterator[dict]:
        if self.new:
            yield self.window()


def windows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = TokenCounts()) -> DataFrame:
    """Per window: conv, window (from 0), text (formatted), repeated (turns at its start that were in windows before), loss_starts, loss_lengths (code points).

    Rows of a conversation are sorted on the executors and streamed, so a long one needs no more memory than a window. Null
    texts and roles are empty. Turns with equal numbers are ordered by role and text, and repeated rows stay. Every assistant turn is under the loss
    mask of one window exactly. Windows come in order within a partition. Other columns are not read.
    """
    kind = df.schema[conv].dataType.simpleString()
    rows = df.select(F.col(conv).cast("string").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own, k = None, None, 0
        columns = ["conv", "window", "text", "repeated", "loss_starts", "loss_lengths"]

        def row(w: dict) -> tuple:
            return (last[0], k, w["text"], w["repeated"], [a for a, _ in w["spans"]], [n for _, n in w["spans"]])

        for pdf in batches:
            out = []
            for c, r, t in zip(pdf["conv"], pdf["role"], pdf["text"], strict=True):
                key = (None,) if pd.isna(c) else (c,)
                if key != last:
                    for w in own.rest() if own else ():
                        out.append(row(w))
                    last, own, k = key, Windows(budget, history, tokens), 0
                for w in own.add(r, t):
                    out.append(row(w))
                    k += 1
            if out:
                yield pd.DataFrame(out, columns=columns)
        out = [row(w) for w in own.rest()] if own else []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return rows.select("conv", "role", "text").mapInPandas(run, "conv string, window long, text string, repeated long, loss_starts array<long>, loss_lengths array<long>").withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def read_back(df: DataFrame, conv: str = "conv_id", in_order: bool = False) -> DataFrame:
    """Per conversation, from windows(): conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The formatted texts are parsed by the template alone; turns that a window repeats are skipped. The digests are sums over a conversation in order, so its windows stay in one
    stream; only hash states are kept. in_order: df comes straight from windows(), which gives each conversation's windows in one partition and in their order; else they
    are dealt out and sorted here.
    """
    if not in_order:
        df = df.repartition(conv).sortWithinPartitions(F.col(conv).asc_nulls_first(), "window")
    kind = df.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        columns = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row() -> tuple:
            return (last[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for pdf in batches:
            out = []
            for c, t, old, starts, lengths in zip(pdf["conv"], pdf["text"], pdf["repeated"], pdf["loss_starts"], pdf["loss_lengths"], strict=True):
                key = (None,) if pd.isna(c) else (c,)
                if key != last:
                    if state:
                        out.append(row())
                    last, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for k, m in enumerate(_TURN.finditer(t)):
                    if k >= old:
                        state[0] += 1
                        state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                for a, n in zip(starts, lengths, strict=True):
                    x = unescape(t[a : a + n])
                    state[2] += len(x)
                    state[3].update(x.encode("utf-8", "surrogatepass"))
                state[4] += len(t)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if state:
            yield pd.DataFrame([row()], columns=columns)

    out = df.select(F.col(conv).cast("string").alias("conv"), "text", "repeated", "loss_starts", "loss_lengths").mapInPandas(run, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)
