"""Byte-level BPE encoding and decoding by dynamic programming over byte prefixes.

For every prefix of a pre-token exactly one token can end its encoding: the token ``t`` ending there
that forms a stable pair with the last token of the prefix before ``t``. A pair is stable if merging
the bytes of both again gives the same two tokens. Storing the last token of each prefix makes the
encoding of every prefix known at once, so bytes can be appended exactly and an edit only redoes the
positions from the edit to the point where old and new states agree again.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import each, long_fields, map_texts, string_fields
from lociq.llm.pretoken import BYTE_LEVEL_PATTERN, Held, splitter

#: Entries that a worker's caches may hold (of pieces, each generation); they bound memory, not results.
PIECES_HELD = 200_000
PAIRS_HELD = 500_000
#: Bits of a pair's place in a table of pairs, where a later pair takes the place of an earlier one.
PAIR_BITS = 20
#: Strings whose prefix tables are made together, and the longest among them.
BATCH_ROWS = 8_192
BATCH_BYTES = 48


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: Later than any merge.
NEVER = 1 << 60


def merge(data: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The tokens of ``data`` by merging the lowest-ranked neighbours, the leftmost of equals, again and
    again, and the pairs merged; for strings as short as tokens."""
    parts, merged = [data[k : k + 1] for k in range(len(data))], []
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], NEVER))
        if parts[best] + parts[best + 1] not in ranks:
            break
        merged.append((parts[best], parts[best + 1]))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts, merged


class Vocabulary:
    """What the prefix tables look up; built once from the ranks and small enough to broadcast.

    ``reach`` maps each prefix of a token to the id of the token that it is, -1 if it is none that
    encodes alone as itself. What stands at a token's edges while it is merged is worked out when asked for.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {missing[:5]}")
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach = {token: rank for token, rank in ranks.items() if len(merge(token, ranks)[0]) == 1}
        for token in list(self.reach):
            for end in range(1, len(token)):
                self.reach.setdefault(token[:end], -1)
        self._edges: dict[int, tuple[list, list] | None] = {}

    def edges(self, rank: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """The parts that stand at the left and at the right edge of a token while it is merged, each with the rank
        of the merge that takes it in; None if its merges don't come in the order of their ranks."""
        if rank not in self._edges:
            token = self.token[rank]
            merged = merge(token, self.ranks)[1]
            times = [self.ranks[a + b] for a, b in merged]
            self._edges[rank] = (self._edge(merged, token, 0), self._edge(merged, token, 1)) if times == sorted(times) else None
        return self._edges[rank]

    def _edge(self, merged: list[tuple[bytes, bytes]], token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Going back from the last merge, each merge that makes the part now at the edge splits it."""
        found, now = [(token, NEVER)], token
        for a, b in reversed(merged):
            if a + b == now and len(now) > 1:
                found.append(((a, b)[side], self.ranks[now]))
                now = (a, b)[side]
        return found[::-1]

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two.

        The parts at the boundary grow as each side is merged by itself. Should a merge across come
        first at any point, the pair isn't stable; of equal ranks the leftmost merge comes first.
        """
        ours_theirs = self.edges(left), self.edges(right)
        if None in ours_theirs:
            return merge(self.token[left] + self.token[right], self.ranks)[0] == [self.token[left], self.token[right]]
        ranks = self.ranks
        ours, theirs = iter(ours_theirs[0][1]), iter(ours_theirs[1][0])
        (a, until_a), (b, until_b) = next(ours), next(theirs)
        while True:
            across = ranks.get(a + b, NEVER)
            if across < until_a and across <= until_b and across < NEVER:
                return False
            if until_a == until_b == NEVER:
                return True
            if until_a <= until_b:
                a, until_a = next(ours)
            else:
                b, until_b = next(theirs)


class Pairs(dict):
    """Stable pairs by ``left << 32 | right``, as many as memory is given for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIRS_HELD:
            self.clear()
        self[pair] = found = self.vocabulary.stable(pair >> 32, pair & 0xFFFFFFFF)
        return found


class PrefixTable:
    """The last token of every prefix of some bytes, kept exact under appends and edits.

    Only one token can end a prefix, so going through the starts in order, the first token found for a
    prefix is its last one.
    """

    __slots__ = ("data", "last", "pairs")

    def __init__(self, pairs: Pairs, data: bytes = b"") -> None:
        self.pairs, self.data, self.last = pairs, data, [-1] * len(data)
        self._fill(0, 0)

    def _fill(self, start: int, done: int) -> None:
        """Set the states past the first ``done`` from tokens that begin at ``start`` or later."""
        data, last, pairs, reach = self.data, self.last, self.pairs, self.pairs.vocabulary.reach
        size = len(data)
        for at in range(start, size):
            before = last[at - 1] << 32 if at else -1
            for end in range(at + 1, size + 1):
                token = reach.get(data[at:end])
                if token is None:
                    break
                if token >= 0 and end > done and last[end - 1] < 0 and (before < 0 or pairs[before | token]):
                    last[end - 1] = token

    def append(self, more: bytes) -> None:
        size = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(max(0, size - self.pairs.vocabulary.longest), size)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes start..stop; returns how many states were worked out.

        Past the new bytes, once as many states in a row as the longest token has bytes are the old
        ones, all later states are the old ones too: a state looks no further back.
        """
        longest = self.pairs.vocabulary.longest
        old, tail = self.last[stop:], self.data[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        done = 0
        while done < len(tail):
            step = min(2 * longest, len(tail) - done)
            self.append(tail[done : done + step])
            done += step
            same = min(longest, done)
            if same == longest and self.last[-same:] == old[done - same : done]:
                self.data += tail[done:]
                self.last += old[done:]
                break
        return len(new) + done

    def ids(self) -> list[int]:
        found, end, last, token = [], len(self.data), self.last, self.pairs.vocabulary.token
        while end:
            found.append(last[end - 1])
            end -= len(token[found[-1]])
        return found[::-1]


class PrefixBatch:
    """Prefix tables of many short strings at once: the same states, one start and end at a time for all."""

    def __init__(self, pairs: Pairs) -> None:
        self.pairs = pairs
        words = pairs.vocabulary
        nodes = {b"": 0} | {prefix: k + 1 for k, prefix in enumerate(words.reach)}
        self.node_token = np.array([-1, *words.reach.values()], np.int64)
        keys = np.array([nodes[p[:-1]] << 8 | p[-1] for p in words.reach], np.int64)
        self._build(keys, np.arange(1, len(nodes)))
        self.sizes = np.array([len(words.token.get(k, b"")) for k in range(max(words.token) + 1)])
        self._known = np.full(1 << PAIR_BITS, -1, np.int64)
        self._stable = np.zeros(1 << PAIR_BITS, bool)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open hash table of the trie's edges, filled so that every probe is vectorised."""
        self._bits = max(4, int(len(keys) * 3).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.full(1 << self._bits, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = self._keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(at.size)), return_index=True)
            first = first[free[first]]
            self._keys[at[first]], self._values[at[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(left.size, bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self._bits)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self._keys[at]
        found = np.where(there == keys, self._values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            there = self._keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self._values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def _are_stable(self, asked: np.ndarray) -> np.ndarray:
        at = self._place(asked)
        found = self._stable[at]
        other = np.flatnonzero(self._known[at] != asked)
        if other.size:
            new, back = np.unique(asked[other], return_inverse=True)
            stable = np.array([self.pairs[q] for q in new.tolist()], bool)
            found[other] = stable[back]
            at, first = np.unique(self._place(new), return_index=True)
            self._known[at], self._stable[at] = new[first], stable[first]
        return found

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def pack(self, strings: list[bytes]) -> list[bytes]:
        """The packed ids of each string, for non-empty strings longest first."""
        lengths = np.array([len(x) for x in strings])
        rows, width = len(strings), int(lengths[0])
        data = np.zeros((width, rows), np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(flat.size) - np.repeat(begins, lengths)
        data[place, np.repeat(np.arange(rows), lengths)] = flat
        last = np.full((width + 1, rows), -1, np.int64)
        with_length = [int(np.searchsorted(-lengths, -k, side="right")) for k in range(width + 2)]
        for start in range(width):
            live = np.arange(with_length[start + 1])
            node = np.zeros(live.size, np.int64)
            for end in range(start + 1, width + 1):
                if live.size and live[-1] >= with_length[end]:
                    live = live[: int(np.searchsorted(live, with_length[end]))]
                    node = node[: live.size]
                node = self._step(node << 8 | data[end - 1, live])
                there = node >= 0
                live, node = live[there], node[there]
                if not live.size:
                    break
                token = self.node_token[node]
                open_ = np.flatnonzero((token >= 0) & (last[end, live] < 0))
                if start and open_.size:
                    open_ = open_[self._are_stable(last[start, live[open_]] << 32 | token[open_])]
                last[end, live[open_]] = token[open_]
        out = np.zeros((rows, width), "<u4")
        count, at, live = np.zeros(rows, np.int64), lengths.copy(), np.arange(rows)
        while live.size:
            token = last[at[live], live]
            count[live] += 1
            out[live, width - count[live]] = token
            at[live] -= self.sizes[token]
            live = live[at[live] > 0]
        raw = out.tobytes()
        return [raw[4 * (k * width + width - n) : 4 * (k + 1) * width] for k, n in enumerate(count.tolist())]


class Codec:
    """Encodes texts to ids packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = BYTE_LEVEL_PATTERN) -> None:
        self.vocabulary = vocabulary
        self.pairs = Pairs(vocabulary)
        self.batch = PrefixBatch(self.pairs)
        self.split = splitter(pattern)
        self.pieces = Held(self._pack_pieces, PIECES_HELD)
        #: A piece that is a token is that token, even if no merges lead to it.
        self.whole = vocabulary.ranks
        tokens = [vocabulary.token.get(k, b"") for k in range(max(vocabulary.token) + 1)]
        self._sizes = np.array([len(t) for t in tokens])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _pack_pieces(self, pieces: list[str]) -> list[bytes]:
        """Short pieces go through the batch in groups of like length, long ones one by one."""
        data = [piece.encode() for piece in pieces]
        found: dict[bytes, bytes] = {}
        for x in data:
            if (whole := self.whole.get(x, -1)) >= 0:
                found[x] = struct.pack("<I", whole)
            elif len(x) > BATCH_BYTES:
                ids = PrefixTable(self.pairs, x).ids()
                found[x] = struct.pack(f"<{len(ids)}I", *ids)
        rest = sorted((x for x in data if x not in found), key=len, reverse=True)
        for k in range(0, len(rest), BATCH_ROWS):
            found.update(zip(rest[k : k + BATCH_ROWS], self.batch.pack(rest[k : k + BATCH_ROWS])))
        return [found[x] for x in data]

    def pack_all(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.split, texts))
        packed = self.pieces.prepare(set().union(*split))
        return [b"".join(map(packed.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack_all([text])[0], "<u4").tolist()

    def decode(self, packed: bytes) -> bytes:
        """The tokens' bytes in a row, in steps of bounded memory; an unknown id raises IndexError."""
        ids, out = np.frombuffer(packed, "<u4"), []
        for k in range(0, len(ids), 100_000):
            part = ids[k : k + 100_000]
            sizes = self._sizes[part]
            before = np.cumsum(sizes) - sizes
            out.append(self._bytes[np.repeat(self._starts[part] - before, sizes) + np.arange(int(sizes.sum()))].tobytes())
        return b"".join(out)


class EncodedText:
    """A text with its pre-tokens' prefix tables, for exact appends without encoding it anew."""

    def __init__(self, codec: Codec, text: str = "") -> None:
        self.codec, self.text = codec, ""
        self.pieces: list[tuple[int, str, PrefixTable]] = []
        self.append(text)

    def append(self, more: str) -> None:
        """A match depends on its first three characters and on one after its end; only matches that
        come so near the old end are matched again, and one that only grows keeps its states."""
        end = len(self.text)
        redo: list[tuple[int, str, PrefixTable]] = []
        while self.pieces and (self.pieces[-1][0] + 3 > end or self.pieces[-1][0] + len(self.pieces[-1][1]) + 1 > end):
            redo.append(self.pieces.pop())
        at = redo[-1][0] if redo else end
        self.text += more
        known = {start: (piece, states) for start, piece, states in redo}
        for piece in self.codec.split(self.text[at:]):
            old, states = known.get(at, ("", None))
            if states is not None and piece.startswith(old):
                states.append(piece[len(old) :].encode())
            else:
                states = PrefixTable(self.codec.pairs, piece.encode())
            self.pieces.append((at, piece, states))
            at += len(piece)

    def ids(self) -> list[int]:
        out: list[int] = []
        for _, piece, states in self.pieces:
            whole = self.codec.whole.get(piece.encode())
            out += states.ids() if whole is None else [whole]
        return out


_codecs: dict[int, Codec] = {}


def _codec(shared: Broadcast) -> Codec:
    """A codec for each vocabulary and worker process, so that tasks share its caches."""
    if (key := shared.value["key"]) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value["vocabulary"], shared.value["pattern"])
    return _codecs[key]


def encode_texts(df: DataFrame, ranks: dict[bytes, int], pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids binary, n_tokens): each text's ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. A very long pre-token takes time in proportion to its length, and a text with its ids
    has to fit a Python worker.
    Repeated rows and null ids stay; other columns are not read. The vocabulary (one file's tokens,
    of fixed size) is broadcast; the texts are neither shuffled nor gathered.
    """
    fields = [T.StructField("ids", T.BinaryType()), *long_fields("n_tokens")]
    return _run(df, ranks, pattern, id_col, text_col, lambda codec: lambda texts: [(x, len(x) // 4) for x in codec.pack_all(texts)], fields)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the bytes of packed ids as UTF-8, with U+FFFD for what isn't; null ids: ''."""
    source = df.select(id_col, F.base64(ids_col).alias("_ids"))
    one = lambda codec, ids: (codec.decode(base64.b64decode(ids)).decode("utf-8", "replace"),)
    return _run(source, ranks, BYTE_LEVEL_PATTERN, id_col, "_ids", lambda codec: each(lambda ids: one(codec, ids)), string_fields("text"))


def token_digests(df: DataFrame, ranks: dict[bytes, int], pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): the round trip of each text in one pass.

    ``with_ids`` adds the packed ids themselves. What holds for encode_texts holds here.
    """
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def make(codec: Codec) -> Callable[[list[str]], list[tuple]]:
        return lambda texts: [(len(x) // 4, digest(x), digest(codec.decode(x)), x) for x in codec.pack_all(texts)]

    ids = [T.StructField("ids", T.BinaryType())] if with_ids else []
    return _run(df, ranks, pattern, id_col, text_col, make, [*long_fields("n_tokens"), *string_fields("ids_sha256", "decoded_sha256"), *ids])


def _run(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str, make: Callable, fields: list) -> DataFrame:
    key = hash((frozenset(ranks.items()), pattern))
    shared = df.sparkSession.sparkContext.broadcast({"key": key, "vocabulary": Vocabulary(ranks), "pattern": pattern})
    return map_texts(df, id_col, text_col, lambda: make(_codec(shared)), fields)
