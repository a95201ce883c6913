"""Operator 3: byte-level BPE by monoid tree reduction.

A piece of text is encoded by halves. Two neighbours are joined by re-encoding a window around their seam; the window
grows on a side until its outermost token and the token next to it are *compatible*: the two tokens' bytes, encoded
alone, give the same two tokens. That proves the tokens outside stable. Take the first merge of a plain left-to-right
run over the whole piece that crosses an edge between two tokens of the result: up to then both tokens' bytes have
merged as if alone, so the run over the pair alone would have made this merge too, and the pair would be incompatible.
Hence a sequence of tokens that each encode to themselves, with all neighbours compatible, is the encoding.

Ids are encoded from and decoded to whole texts; null counts as the empty text. An empty text has no ids. Repeated rows
and ids give repeated results; only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame

from gridtide.llm.common import Remember, map_steps, texts_of

#: White space as the rank files' libraries know it (Unicode White_Space), spelled out since regex engines differ.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHED_WORDS, CACHED_PIECES, SHORT = 300_000, 200_000, 24
LEAF_IDS = 4096
LONG_WINDOW, NO_RANK = 128, 1 << 60


def spelled_out(pattern: str) -> str:
    """The split pattern with its white-space classes written as plain sets."""
    pattern = pattern.replace(r"[^\s", f"[^{SPACE}")
    return pattern.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeEncoder:
    """Bytes to ids and back, for one rank table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.short = Remember(self._halves, CACHED_PIECES)
        self.window = Remember(self._merge, CACHED_PIECES)
        self.compatible = Remember(self._compatible, CACHED_PIECES)

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern; a piece that is itself in the table is its one token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return list(self._tree(piece))

    def _tree(self, piece: bytes) -> tuple[int, ...]:
        return self.short[piece] if len(piece) <= SHORT else self._halves(piece)

    def _halves(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) <= 2:
            return self.window[piece]
        middle = len(piece) // 2
        return self.join(self._tree(piece[:middle]), self._tree(piece[middle:]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left or right
        if self.compatible[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            piece = b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j]))
            middle = self.window[piece] if len(piece) <= LONG_WINDOW else self._merge_long(piece)
            grow_left = i < len(left) and not self.compatible[left[-i - 1], middle[0]]
            grow_right = j < len(right) and not self.compatible[middle[-1], right[j]]
            if not grow_left and not grow_right:
                return left[:-i] + middle + right[j:]
            i, j = min(i << grow_left, len(left)), min(j << grow_right, len(right))

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = self.tokens[pair[0]], self.tokens[pair[1]]
        return self.window[a + b] == pair

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Plain merging, lowest rank first and leftmost of equals; for windows only."""
        if len(piece) > LONG_WINDOW:
            return self._merge_long(piece)
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(pairs)
            if least == NO_RANK:
                break
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs: a run of one sign shifts every token behind a seam, so windows can be long."""
        ranks, n = self.ranks, len(piece)
        stop = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
            for a, b in ((before[i], end), (i, stop[end] if end < n else 0)):
                if a >= 0 and b and (p := piece[a:b]) in ranks:
                    heapq.heappush(heap, (ranks[p], a, b))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return tuple(out)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row of `df`, and the `ids` themselves if asked for.

    The rank file is opened in the tasks, where the tokenizer package is installed as on the driver.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def work():
        import regex

        encoder = TreeEncoder(read_ranks(ranks_path))
        split = regex.compile(spelled_out(pattern)).findall
        packed = Remember(lambda s: np.array(encoder.encode(s.encode("utf-8", "surrogatepass")), "<u4").tobytes(), CACHED_WORDS)

        def do(rows):
            lines = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for t in texts_of(rows.column(text)):
                raw = b"".join(map(packed.__getitem__, split(t)))
                numbers = np.frombuffer(raw, "<u4").tolist()
                lines["n_tokens"].append(len(numbers))
                lines["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                lines["decoded_sha256"].append(hashlib.sha256(encoder.decode(numbers)).hexdigest())
                if ids:
                    lines["ids"].append(numbers)
            return lines | {key: rows.column(key)}

        return do

    return map_steps(df.select(key, text), text, schema, work)
