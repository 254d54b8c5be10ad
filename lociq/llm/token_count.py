"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string is merged alone; those that come back as one token
are the whole tokens. A pre-token among them counts one without any merging, which covers most of a
text; only the rest is merged.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lociq.llm.common import long_fields, map_texts
from lociq.llm.pretoken import BYTE_LEVEL_PATTERN, Held, splitter

#: Later than any merge.
NEVER = 1 << 60
#: Entries that a generation of a worker's cache may hold; they bound memory, not results.
PIECES_HELD = 200_000
#: Strings that are merged together, and the longest among them.
BATCH_ROWS = 16_384
BATCH_BYTES = 48


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabulary files write for each byte: printable bytes are themselves,
    and the others take the code points from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def read_model(spec: dict) -> tuple[dict[tuple[bytes, bytes], int], list[bytes], list[str]]:
    """Merge ranks, vocabulary strings as bytes and special strings of a byte-level ``tokenizers`` file."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normalizer, prefix space, dropout or ignored merges is supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("special strings that strip or normalize are not supported")
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    special = [t["content"] for t in spec["added_tokens"]]
    return {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(merges)}, [raw(t) for t in model["vocab"] if t not in special], special


def merged(data: bytes, merges: dict[tuple[bytes, bytes], int]) -> int:
    """How many tokens merging ``data`` leaves."""
    if len(data) > BATCH_BYTES:
        return _merged_long(data, merges)
    parts = [data[k : k + 1] for k in range(len(data))]
    ranks = [merges.get(pair, NEVER) for pair in zip(parts, parts[1:])]
    while ranks and (best := min(ranks)) < NEVER:
        k = ranks.index(best)
        parts[k] += parts.pop(k + 1)
        del ranks[k]
        if k < len(ranks):
            ranks[k] = merges.get((parts[k], parts[k + 1]), NEVER)
        if k:
            ranks[k - 1] = merges.get((parts[k - 1], parts[k]), NEVER)
    return len(parts)


def _merged_long(data: bytes, merges: dict[tuple[bytes, bytes], int]) -> int:
    """The same with a heap of neighbours, so that a long run takes little more than linear time."""
    size = len(data)
    part: list[bytes | None] = [data[k : k + 1] for k in range(size)]
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(rank, k, part[k], part[k + 1]) for k in range(size - 1) if (rank := merges.get((part[k], part[k + 1]))) is not None]
    heapq.heapify(heap)
    count = size
    while heap:
        _, k, a, b = heapq.heappop(heap)
        if part[k] != a or (right := after[k]) >= size or part[right] != b:
            continue
        part[k], part[right] = a + b, None
        count -= 1
        after[k] = after[right]
        if after[k] < size:
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] < size:
                pair = part[left], part[after[left]]
                if (rank := merges.get(pair)) is not None:
                    heapq.heappush(heap, (rank, left, *pair))
    return count


def prove_whole(merges: dict[tuple[bytes, bytes], int], vocabulary: list[bytes]) -> frozenset[bytes]:
    """The vocabulary strings whose bytes alone merge to one token."""
    return frozenset(token for token in vocabulary if token and merged(token, merges) == 1)


class MergeBatch:
    """Merges many short strings at once: in each round every row merges its lowest-ranked pair."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int]) -> None:
        ids = {bytes([b]): b for b in range(256)}
        for a, b in merges:
            for token in (a, b, a + b):
                ids.setdefault(token, len(ids))
        pairs = sorted((ids[a] << 32 | ids[b], rank, ids[a + b]) for (a, b), rank in merges.items())
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 3

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, self.ranks[at] << 32 | self.made[at], NEVER)

    def counts(self, strings: list[bytes]) -> list[int]:
        """The tokens left of each of the non-empty strings, longest first."""
        lengths = np.array([len(x) for x in strings])
        rows, width = len(strings), int(lengths[0])
        ids = np.full((rows, width + 1), -1, np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        ids[np.repeat(np.arange(rows), lengths), np.arange(flat.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        left, right = ids[:, :-1], ids[:, 1:]
        rank = np.full((rows, width), NEVER, np.int64)
        real = right >= 0
        rank[real] = self._rank(left[real], right[real])
        live, columns = np.arange(rows), np.arange(width)
        while live.size:
            at = rank.argmin(axis=1)
            best = rank[np.arange(live.size), at]
            go = best < NEVER
            if not go.all():
                live, ids, rank, at, best = live[go], ids[go], rank[go], at[go], best[go]
                if not live.size:
                    break
            lengths[live] -= 1
            row = np.arange(live.size)
            ids[row, at] = best & 0xFFFFFFFF
            behind = columns[None, :] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            for k in (at - 1, at):
                ok = k >= 0
                a, b = ids[row[ok], k[ok]], ids[row[ok], k[ok] + 1]
                rank[row[ok], k[ok]] = np.where(b >= 0, self._rank(a, np.maximum(b, 0)), NEVER)
        return lengths.tolist()


class Counter:
    def __init__(self, merges: dict[tuple[bytes, bytes], int], whole: frozenset[bytes], special: list[str]) -> None:
        self.merges, self.whole = merges, whole
        self.special = sorted(special, key=lambda s: (-len(s), s))
        self.split = splitter(BYTE_LEVEL_PATTERN)
        self.batch = MergeBatch(merges)
        self.pieces = Held(self._count_pieces, PIECES_HELD)

    def _count_pieces(self, pieces: list[str]) -> list[int]:
        data = [piece.encode() for piece in pieces]
        found = {x: 1 if x in self.whole else merged(x, self.merges) for x in data if x in self.whole or len(x) > BATCH_BYTES}
        rest = sorted((x for x in data if x not in found), key=len, reverse=True)
        for k in range(0, len(rest), BATCH_ROWS):
            found.update(zip(rest[k : k + BATCH_ROWS], self.batch.counts(rest[k : k + BATCH_ROWS])))
        return [found[x] for x in data]

    def _plain(self, texts: list[str]) -> list[int]:
        split = list(map(self.split, texts))
        counts = self.pieces.prepare(set().union(*split))
        return [sum(map(counts.__getitem__, pieces)) for pieces in split]

    def _between(self, text: str) -> list[str]:
        """What lies before, between and after the special strings in the text, the longest first where
        two start together; so there is one special string fewer than there are parts."""
        parts, at = [], 0
        found = [s for s in self.special if s in text]
        while places := [(k, -len(s), s) for s in found if (k := text.find(s, at)) >= 0]:
            k, _, s = min(places)
            parts.append(text[at:k])
            at = k + len(s)
        return [*parts, text[at:]]

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self._between(text) for text in texts]
        counts = iter(self._plain([part for row in parts for part in row]))
        return [sum(next(counts) for _ in row) + len(row) - 1 for row in parts]


_counters: dict[int, Counter] = {}


def count_tokens(df: DataFrame, model_json: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for a byte-level ``tokenizers`` file's content.

    Null and empty texts have 0 bytes and tokens. Special strings inside a text count one token each,
    as the library reads them by default. A text has to fit a Python worker; time grows with its length. Repeated rows and null ids stay; other columns are not read.
    The proof runs once on the driver over the vocabulary; it and the merges (one file, of fixed size)
    are broadcast. Nothing is shuffled.
    """
    merges, vocabulary, special = read_model(json.loads(model_json))
    shared = df.sparkSession.sparkContext.broadcast((hash(model_json), merges, prove_whole(merges, vocabulary), special))

    def make() -> Callable[[list[str]], list[tuple]]:
        key, *parts = shared.value
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(*parts)
        counter = _counters[key]

        return lambda texts: [(len(text.encode()), n, n > limit) for text, n in zip(texts, counter.counts(texts))]

    return map_texts(df, id_col, text_col, make, [*long_fields("n_bytes", "n_tokens"), T.StructField("over_limit", T.BooleanType())])
