"""Operator 5: token counts by heap-and-linked-list pair merging, without ids.

A word starts as its bytes' symbols in a linked list. A heap holds the adjacent pairs that have a merge rule; the pair
of lowest rank, leftmost of equals, is popped again and again and merged if it still stands. The count is the number of
symbols minus the number of merges; no id is produced.

Null counts as the empty text and has no tokens; special strings inside a text are one token each, as the library has
it by default. Repeated rows give repeated results; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

from pyspark.sql import DataFrame

from gridtide.llm.bpe_tree import SPACE, spelled_out
from gridtide.llm.common import Remember, lengths, map_steps, texts_of

CACHED_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    signs, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            signs.append(chr(byte))
        else:
            signs.append(chr(spare))
            spare += 1
    return signs


class MergeCounter:
    """Counts for one tokenizer file of the library `tokenizers`, kind BPE with ends of words."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        signs = byte_symbols()
        number: dict[str, int] = {}
        self.inner = [number.setdefault(s, len(number)) for s in signs]
        self.last = [number.setdefault(s + end, len(number)) for s in signs]
        self.known = {number[s] for s in list(number) if s in model["vocab"]}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = number.setdefault(a, len(number)), number.setdefault(b, len(number))
            self.rules[pair] = rank, number.setdefault(a + b, len(number))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.starts = {s[0] for s in self.special}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(spelled_out(pattern)).findall
        self.blank = regex.compile(f"[{SPACE}]+")
        self.words = Remember(self.word, CACHED_WORDS)

    def word(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if not self.known.issuperset(symbols):  # a symbol outside the vocabulary has no token
            symbols = [s for s in symbols if s in self.known]
        return len(symbols) - self.merges(symbols)

    def merges(self, symbols: list[int]) -> int:
        """How many merges the rules make of a list of symbols."""
        rules, n, done = self.rules, len(symbols), 0
        symbol, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*rules[pair], i, *pair) for i, pair in enumerate(zip(symbol, symbol[1:], strict=False)) if pair in rules]
        heap = [(rank, i, a, b, made) for rank, made, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j], after[i], done = made, -1, after[j], done + 1
            if after[i] < n:
                before[after[i]] = i
                self._offer(heap, i, made, symbol[after[i]])
            if before[i] >= 0:
                self._offer(heap, before[i], symbol[before[i]], made)
        return done

    def _offer(self, heap: list, i: int, a: int, b: int) -> None:
        rule = self.rules.get((a, b))
        if rule:
            heapq.heappush(heap, (rule[0], i, a, b, rule[1]))

    def normal(self, text: str) -> str:
        """Composed, white space runs as one blank, lower case sign by sign (a final sigma isn't special)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.blank.sub(" ", text).lower()

    def text(self, text: str) -> int:
        if not any(sign in text for sign in self.starts):
            return sum(map(self.words.__getitem__, self.split(self.normal(text))))
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(map(self.words.__getitem__, (w for p in parts for w in self.split(self.normal(p)))))


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row of `df`; the tokenizer file is opened in the tasks."""
    key_type = df.schema[key].dataType.simpleString()

    def work():
        counter = MergeCounter(tokenizer_path)

        def do(rows):
            counts = [counter.text(t) for t in texts_of(rows.column(text))]
            return {key: rows.column(key), "n_bytes": lengths(rows.column(text)), "n_tokens": counts, "over_limit": [c > limit for c in counts]}

        return do

    return map_steps(df.select(key, text), text, f"{key} {key_type}, n_bytes bigint, n_tokens bigint, over_limit boolean", work)
