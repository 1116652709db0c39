"""Ids of a public tokenizer, remembered by word.

The tokenizer of word_bpe_49k.json ends every token at white space, so the ids of a text are those of its
runs of other characters, one after the other. Runs that were met before are looked up.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import regex

#: Entries of one generation of a cache; the older of two goes when the newer is full.
CACHE = 400_000


class Generations:
    """A bounded dictionary: what is used stays, what two generations haven't used goes."""

    def __init__(self, make, limit: int = CACHE):
        self.make, self.limit = make, limit
        self.old: dict = {}
        self.new = _Young(self)

    def full(self) -> None:
        self.old, self.new = dict(self.new), _Young(self)

    def clear(self) -> None:
        self.old, self.new = {}, _Young(self)


class _Young(dict):
    def __init__(self, owner: Generations):
        super().__init__()
        self.owner = owner

    def __missing__(self, key):
        value = self.owner.old.get(key)
        if value is None:
            value = self.owner.make(key)
        self[key] = value
        return value


class WordIds:
    """packed(text): the ids of a whole text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        known = json.loads(self.tokenizer.to_str())
        steps = known["pre_tokenizer"]["pretokenizers"]
        #: The file's own pattern for tokens inside a run.
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in known["added_tokens"]).encode() or b"(?!)")
        # The letters that stand for bytes: printable ones for themselves, the others from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = [b for b in range(256) if b not in plain]
        self.letters = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}
        self.simple = regex.compile(r"[\x21-\x7e¡-¬®-ſ]+")
        self.tokens = Generations(self._token)
        self.runs = Generations(self._run)

    def _token(self, token: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(token.encode().decode("latin1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if self.simple.fullmatch(text) and not self.special.search(run):
            # single letters that normalisation keeps and that have one lower form
            get = self.tokens.new
            out = b"".join([get[x] for x in self.pattern.findall(text.lower().replace("i̇", "i̇"))])
            if len(get) > self.tokens.limit:
                self.tokens.full()
            return out
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        # bytes.split() cuts at ASCII white space only, which every rule of the tokenizer treats as an end
        new = self.runs.new
        out = b"".join(map(new.__getitem__, text.encode("utf-8", "replace").split()))
        if len(new) > self.runs.limit:
            self.runs.full()
        return out

    def clear(self) -> None:
        """To be called at a task's end: an idle worker would hold full caches while the executor does other work."""
        self.tokens.clear()
        self.runs.clear()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The WordIds of a file, one for a process: a Python worker keeps the tokenizer from task to task."""
    return WordIds(path)
