"""Pairwise alignment and lossless deltas, in Arrow-batched functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lociq.functions.sequence import PROTEIN_ONLY

# Scores of nucleotides, and the cost of a gap's first and each further letter.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 10, -5, -20, -10
# The BLOSUM62 scores of the twenty amino acids, each with those before it and itself.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
#: Characters of the blocks that a delta looks up in the reference; an operation costs as much.
BLOCK = 16


@dataclass(frozen=True)
class Scoring:
    """Scores of letters and gaps. Without ``table``, equal letters score ``match`` and others ``mismatch``; with it, rows and
    columns are ``letters``, and any letter that they lack scores ``mismatch``. Case makes no difference."""

    match: int = MATCH
    mismatch: int = MISMATCH
    gap_open: int = GAP_OPEN
    gap_extend: int = GAP_EXTEND
    letters: str = ""
    table: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def triangle(cls, letters: str, text: str, other: int = -1, gap_open: int = GAP_OPEN, gap_extend: int = GAP_EXTEND) -> Scoring:
        """From lines of a symmetric table, each with the scores of a letter and those before it."""
        rows = [list(map(int, line.split())) for line in text.split("\n") if line.strip()]
        full = tuple(tuple((*rows[max(i, j)],)[min(i, j)] for j in range(len(rows))) for i in range(len(rows)))
        return cls(0, other, gap_open, gap_extend, letters, full)

    def codes(self, text: str) -> np.ndarray:
        """Upper-case letters as numbers: of the table, one past it for others, or code points."""
        points = np.frombuffer("".join(c if len(c.upper()) > 1 else c.upper() for c in text).encode("utf-32-le"), "<u4").astype(np.int64)
        if not self.table:
            return points
        place = np.full(128, len(self.letters))
        place[[ord(c) for c in self.letters]] = range(len(self.letters))
        return np.where(points < 128, place[np.minimum(points, 127)], len(self.letters))

    def against(self, code: int, others: np.ndarray) -> np.ndarray:
        if not self.table:
            return np.where(others == code, self.match, self.mismatch)
        if code == len(self.letters):
            return np.full(len(others), self.mismatch)
        return np.array([*self.table[code], self.mismatch])[others]


NUCLEOTIDE = Scoring()
PROTEIN = Scoring.triangle(AMINO_ACIDS, BLOSUM62)


def scoring_for(text: str) -> Scoring:
    """Proteins are told by a letter that nucleotides lack."""
    return PROTEIN if set(text.upper()) & set(PROTEIN_ONLY) else NUCLEOTIDE


#: What is under any score, by the bytes of a number; the smaller numbers are for tables of up to BATCH_CELLS.
LOWEST = {4: -(1 << 29), 8: -(1 << 40)}
#: Cells of the tables that are worked out at once for many pairs; a pair with more goes by itself.
BATCH_CELLS = 1 << 21
#: The steps of a path: a letter of both, of the first alone, of the second alone.
BOTH, FIRST, SECOND, NO_STEP = 0, 1, 2, 3


@dataclass(frozen=True)
class Path:
    """An alignment: its score, and its steps from the start."""

    score: int
    steps: bytes


def _row(h: np.ndarray, e: np.ndarray, gained: np.ndarray, ramp: np.ndarray, scoring: Scoring) -> tuple[np.ndarray, ...]:
    """One row of the tables: best scores, those that end in a gap of the second text, the moves, and whether each
    of the two gaps goes on. Gaps along the row are a running maximum; ties take the diagonal, then the first text's letter.
    Arrays have places in the second text as their last axis, and may have one for pairs before it."""
    lowest = LOWEST[h.dtype.itemsize]
    opened, longer = h + scoring.gap_open, e + scoring.gap_extend
    up_on = longer > opened
    e = np.maximum(opened, longer)
    diagonal = np.full(h.shape, lowest, h.dtype)
    diagonal[..., 1:] = h[..., :-1] + gained
    base = np.maximum(diagonal, e)
    base[..., 0] = e[..., 0]
    along = np.maximum.accumulate(base - ramp + (scoring.gap_open - scoring.gap_extend), axis=-1)
    f = np.full(h.shape, lowest, h.dtype)
    f[..., 1:] = along[..., :-1] + ramp[1:]
    left_on = np.zeros(h.shape, bool)
    left_on[..., 1:] = f[..., :-1] + scoring.gap_extend > base[..., :-1] + scoring.gap_open
    h = np.maximum(base, f)
    return h, e, np.where(diagonal == h, BOTH, np.where(e == h, FIRST, SECOND)).astype(np.int8), up_on, left_on


def best_path(a: str, b: str, scoring: Scoring | None = None, free_end: bool = False) -> Path:
    """The best alignment with affine gaps, of any length: only every so many rows are kept, and the rows
    between two of them are worked out again when the path comes there, so memory grows with the length times its square root.

    With ``free_end`` it ends at the best cell of the last row or column, and what is left of one text is
    added without a cost.
    """
    scoring = scoring or scoring_for(a)
    x, y = scoring.codes(a), scoring.codes(b)
    n, m = len(x), len(y)
    ramp = scoring.gap_extend * np.arange(m + 1)
    h = np.concatenate([[0], scoring.gap_open + ramp[:m]])
    e = np.full(m + 1, np.int64(-(1 << 40)))
    every = max(16, 3 * math.isqrt(n))
    kept, edge = {0: (h, e)}, [int(h[m])]
    for i in range(1, n + 1):
        h, e, *_ = _row(h, e, scoring.against(x[i - 1], y), ramp, scoring)
        edge.append(int(h[m]))
        if i % every == 0:
            kept[i] = h, e
    i, j, score = n, m, int(h[m])
    if free_end:
        if (k := int(np.argmax(h))) != m and h[k] > score:
            j, score = k, int(h[k])
        if (k := int(np.argmax(edge))) != n and edge[k] > score:
            i, j, score = k, m, edge[k]
    steps = bytearray([SECOND] * (m - j) + [FIRST] * (n - i))
    going_up = False
    while i:
        low = (i - 1) // every * every
        rows, (h, e) = [], kept[low]
        for k in range(low + 1, i + 1):
            h, e, *found = _row(h, e, scoring.against(x[k - 1], y), ramp, scoring)
            rows.append(found)
        while i > low:
            moves, up_on, left_on = rows[i - low - 1]
            step = FIRST if going_up or not j else moves[j]
            if step == BOTH:
                steps.append(BOTH)
                i, j = i - 1, j - 1
            elif step == FIRST:
                going_up = bool(up_on[j]) and i > 1
                steps.append(FIRST)
                i -= 1
            else:
                while left_on[j] and j > 1:
                    steps.append(SECOND)
                    j -= 1
                steps.append(SECOND)
                j -= 1
    steps += bytes([SECOND] * j)
    return Path(score, bytes(reversed(steps)))


def best_paths(pairs: list[tuple[str, str]], scoring: Scoring | None = None, free_end: bool = False) -> list[Path]:
    """best_path of each pair. Pairs of about the same lengths are worked out at once, one row of all their tables after
    another, and so are the steps back; pairs that are too long for that go one by one."""
    out: list[Path | None] = [None] * len(pairs)
    waiting: dict[int, tuple[Scoring, int, list[int]]] = {}
    for k, (a, b) in enumerate(pairs):
        rules = scoring or scoring_for(a)
        if id(rules) not in waiting:
            waiting[id(rules)] = rules, max(abs(x) for x in (rules.match, rules.mismatch, rules.gap_open, rules.gap_extend, *(y for row in rules.table for y in row))), []
        _, most, ks = waiting[id(rules)]
        if a and b and (len(a) + 1) * (len(b) + 1) <= BATCH_CELLS and most * (len(a) + len(b) + 2) < 1 << 28:
            ks.append(k)
        else:
            out[k] = best_path(a, b, rules, free_end)
    for rules, _, ks in waiting.values():
        if not ks:
            continue
        ks.sort(key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
        start, n, m = 0, 0, 0
        for at, k in enumerate([*ks, None]):
            a, b = pairs[k] if k is not None else ("", "")
            n2, m2 = max(n, len(a)), max(m, len(b))
            if k is None or (at - start + 1) * (n2 + 1) * (m2 + 1) > BATCH_CELLS:
                for j, path in zip(ks[start:at], _paths([pairs[j] for j in ks[start:at]], rules, free_end)):
                    out[j] = path
                start, n2, m2 = at, len(a), len(b)
            n, m = n2, m2
    return out


def _paths(pairs: list[tuple[str, str]], scoring: Scoring, free_end: bool) -> list[Path]:
    """best_path of pairs of texts that are not empty, in tables of the longest of them."""
    size, every = len(pairs), np.arange(len(pairs))
    xs, ys = [scoring.codes(a) for a, _ in pairs], [scoring.codes(b) for _, b in pairs]
    ns, ms = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    n, m = int(ns.max()), int(ms.max())
    x, y = np.zeros((size, n), np.int64), np.zeros((size, m), np.int64)
    for k in range(size):
        x[k, : ns[k]], y[k, : ms[k]] = xs[k], ys[k]
    if scoring.table:
        scores = np.full((len(scoring.letters) + 1,) * 2, scoring.mismatch, np.int32)
        scores[:-1, :-1] = scoring.table
    ramp = (scoring.gap_extend * np.arange(m + 1)).astype(np.int32)
    h = np.tile(np.concatenate([[0], scoring.gap_open + ramp[:m]]).astype(np.int32), (size, 1))
    e = np.full((size, m + 1), LOWEST[4], np.int32)
    cells = np.empty((n, size, m + 1), np.uint8)
    bottom, edge = np.full((size, m + 1), LOWEST[4], np.int32), np.full((n + 1, size), LOWEST[4], np.int32)
    edge[0] = h[every, ms]
    inside = np.arange(m + 1) <= ms[:, None]
    for i in range(1, n + 1):
        code = x[:, i - 1, None]
        gained = scores[code, y] if scoring.table else np.where(code == y, scoring.match, scoring.mismatch).astype(np.int32)
        h, e, moves, up_on, left_on = _row(h, e, gained, ramp, scoring)
        cells[i - 1] = moves | (up_on << 2) | (left_on << 3)
        edge[i] = np.where(i <= ns, h[every, ms], LOWEST[4])
        bottom[ns == i] = h[ns == i]
    bottom[~inside] = LOWEST[4]
    i, j, score = ns.copy(), ms.copy(), bottom[every, ms]
    if free_end:
        best = bottom.argmax(1)
        better = (best != ms) & (bottom[every, best] > score)
        j, score = np.where(better, best, j), np.where(better, bottom[every, best], score)
        best = edge.argmax(0)
        better = (best != ns) & (edge[best, every] > score)
        i, j, score = np.where(better, best, i), np.where(better, ms, j), np.where(better, edge[best, every], score)
    rest = zip(ns - i, ms - j)
    up, left, back = np.zeros(size, bool), np.zeros(size, bool), []
    while (going := (i > 0) | (j > 0)).any():
        cell = cells[np.maximum(i - 1, 0), every, j]
        step = np.where((i == 0) | left, SECOND, np.where(up | (j == 0), FIRST, cell & 3))
        first, second = going & (step == FIRST), going & (step == SECOND)
        up = first & (cell & 4 > 0) & (i > 1)
        left = second & (cell & 8 > 0) & (j > 1) & (i > 0)
        back.append(np.where(going, step, NO_STEP).astype(np.uint8))
        i, j = i - (going & (step != SECOND)), j - (going & (step != FIRST))
    steps = np.stack(back, 1)[:, ::-1] if back else np.empty((size, 0), np.uint8)
    return [Path(int(s), row[row != NO_STEP].tobytes() + bytes([FIRST] * over + [SECOND] * under)) for s, row, (over, under) in zip(score, steps, rest)]


def align(a: str, b: str, scoring: Scoring | None = None, free_end: bool = False) -> tuple[int, int, int]:
    """(matches, columns, score) of the best alignment; letters match in either case."""
    path = best_path(a, b, scoring, free_end)
    return len(path.steps) - len(differences(a, b, path)), len(path.steps), path.score


def differences(a: str, b: str, path: Path) -> list[tuple[int, str, str]]:
    """(place in the first text, its letter or -, the second's letter or -) where an alignment's two rows differ."""
    out, i, j = [], 0, 0
    for step in path.steps:
        if step == BOTH:
            if a[i].upper() != b[j].upper():
                out.append((i, a[i], b[j]))
            i, j = i + 1, j + 1
        elif step == FIRST:
            out.append((i, a[i], "-"))
            i += 1
        else:
            out.append((i, "-", b[j]))
            j += 1
    return out


def alignment_identity(a: Column, b: Column) -> Column:
    """Matches over alignment columns, with a free end and scores by the kind of the first text; null for a null text, 1
    for two empty ones."""
    return F.pandas_udf(_identities, "double")(a, b)


def _once(a: pd.Series, b: pd.Series, work: Callable[[list[tuple[str, str]]], list]) -> list:
    """What ``work`` makes of each pair of texts, worked out once for equal pairs; None for a null text."""
    pairs = list(dict.fromkeys((x, y) for x, y in zip(a, b) if x is not None and y is not None))
    done = dict(zip(pairs, work(pairs)))
    return [done.get(pair) for pair in zip(a, b)]


def _identities(a: pd.Series, b: pd.Series) -> pd.Series:
    def work(pairs: list[tuple[str, str]]) -> list[float]:
        found = ((len(path.steps), len(differences(x, y, path))) for (x, y), path in zip(pairs, best_paths(pairs, free_end=True)))
        return [(columns - others) / columns if columns else 1.0 for columns, others in found]

    return pd.Series(_once(a, b, work), dtype="float64")


EDITS = "array<struct<place:bigint,old:string,new:string>>"


def edits(a: Column, b: Column) -> Column:
    """differences of the best global alignment of each row; null for a null text."""
    return F.pandas_udf(_edits, EDITS)(a, b)


def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    row = lambda e: dict(zip(("place", "old", "new"), e))
    return pd.Series(_once(a, b, lambda pairs: [[row(e) for e in differences(x, y, path)] for (x, y), path in zip(pairs, best_paths(pairs))]), dtype=object)


def apply_edits(reference: Column, changes: Column) -> Column:
    """``reference`` after edits in order: each comes after what stands between it and the one before. SQL functions
    only."""
    after = lambda e: e["place"] + (e["old"] != "-").cast("int")
    between = lambda start, stop: F.substring(reference, (start + 1).cast("int"), (stop - start).cast("int"))
    done = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(after(F.get(changes, i - 1)))
    pieces = F.transform(changes, lambda e, i: F.concat(between(done(i), e["place"]), F.when(e["new"] == "-", "").otherwise(e["new"])))
    last = F.when(F.size(changes) > 0, after(F.element_at(changes, -1))).otherwise(F.lit(0).cast("long"))
    return F.concat(F.array_join(pieces, ""), between(last, F.length(reference)))


def decode_operation(kind: Column, reference: Column, start: Column, length: Column, text: Column, changes: Column) -> Column:
    """A stored operation's sequence: 'use' a part of the reference, 'insert' a text, 'modify' the reference by edits; null for
    'delete', a sequence that is gone."""
    part = F.substring(reference, (start + 1).cast("int"), length.cast("int"))
    return F.when(kind == "use", part).when(kind == "insert", text).when(kind == "modify", apply_edits(reference, changes))


# ---- deltas --------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _blocks(reference: str) -> dict[str, int]:
    """The first place of each block of ``BLOCK`` characters."""
    return {reference[i : i + BLOCK]: i for i in range(len(reference) - BLOCK, -1, -1)}


def _shared(a: str, i: int, b: str, j: int) -> int:
    """How many characters are equal from a[i] and b[j] on: by doubled steps, then halved ones."""
    n, most, step = 0, min(len(a) - i, len(b) - j), BLOCK
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    while step and n < most:
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        step //= 2
    return min(n, most)


def encode_delta(reference: str, child: str) -> list[tuple[str, int, int, str]]:
    """Operations (kind, start, end, text) that make ``child`` of ``reference``: copy start..end, or insert.

    The equal start is a copy; after it each block of ``BLOCK`` characters that the reference has is, as far as the
    texts agree on both sides. One pass, so any length will do; copies may go back in the reference.
    """
    ops: list[tuple[str, int, int, str]] = []
    at = done = _shared(reference, 0, child, 0)
    if done:
        ops.append(("copy", 0, done, ""))
    blocks = _blocks(reference) if len(child) - done >= BLOCK else {}
    while at <= len(child) - BLOCK:
        start = blocks.get(child[at : at + BLOCK])
        if start is None:
            at += 1
            continue
        end = at + _shared(reference, start, child, at)
        stop = start + end - at
        while at > done and start and reference[start - 1] == child[at - 1]:
            at, start = at - 1, start - 1
        if at > done:
            ops.append(("insert", start, start, child[done:at]))
        ops.append(("copy", start, stop, ""))
        at = done = end
    if done < len(child):
        ops.append(("insert", len(reference), len(reference), child[done:]))
    return ops


def decode_delta(reference: str, ops: list[tuple[str, int, int, str]]) -> str:
    return "".join(reference[start:end] if kind == "copy" else text for kind, start, end, text in ops)


DELTA = "array<struct<kind:string,start:bigint,end:bigint,text:string>>"


def delta(reference: Column, child: Column) -> Column:
    """encode_delta of each row; null for a null text."""
    return F.pandas_udf(_deltas, DELTA)(reference, child)


def _deltas(reference: pd.Series, child: pd.Series) -> pd.Series:
    row = lambda op: dict(zip(("kind", "start", "end", "text"), op))
    return pd.Series([None if r is None or c is None else [row(op) for op in encode_delta(r, c)] for r, c in zip(reference, child)])


def apply_delta(reference: Column, ops: Column) -> Column:
    """The child of a reference and its operations, by SQL functions alone."""
    part = lambda o: F.when(o["kind"] == "copy", F.substring(reference, (o["start"] + 1).cast("int"), (o["end"] - o["start"]).cast("int"))).otherwise(o["text"])
    return F.array_join(F.transform(ops, part), "")


def delta_cost(ops: Column) -> Column:
    """Bytes that a delta takes: 16 for an operation and its text."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, o: acc + 16 + F.octet_length(o["text"]))


# ---- deltas within a distance --------------------------------------------------------------------------


def common_blocks(a: str, b: str, most: int) -> list[tuple[int, int, int]] | None:
    """(place in a, place in b, length) of the blocks of a longest common subsequence, if ``most`` insertions and deletions
    make ``b`` of ``a``; else None. The farthest place on each diagonal is followed for each number of edits."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    far, trace = {1: 0}, []
    for d in range(most + 1):
        trace.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            if x <= n and x - k <= m:
                x += _shared(a, x, b, x - k)
            far[k] = x
            if x >= n and x - k >= m:
                return _walk_back(trace, n, m)
    return None


def _walk_back(trace: list[dict[int, int]], x: int, y: int) -> list[tuple[int, int, int]]:
    blocks = []
    for d in range(len(trace) - 1, -1, -1):
        far, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and far[k - 1] < far[k + 1]) else k - 1
        px = far[before] if d else 0
        sx = (px if before == k + 1 else px + 1) if d else 0
        if x > sx:
            blocks.append((sx, sx - k, x - sx))
        x, y = px, px - before
    return blocks[::-1]


def banded_delta(reference: str, target: str, most: int = 1000) -> tuple[list[tuple[str, int, int, str]], int]:
    """Operations copy (start, end), insert (text) and skip (start, end), and their bytes: 16, 8 and the text's, 8.

    A target further than ``most`` edits from the reference is one insert.
    """
    ops, at, done, cost = [], 0, 0, 0
    for start, place, size in common_blocks(reference, target, most) or []:
        if place > done:
            ops.append(("insert", start, start, target[done:place]))
            cost += 8 + len(target[done:place].encode())
        if start > at:
            ops.append(("skip", at, start, ""))
            cost += 8
        ops.append(("copy", start, start + size, ""))
        at, done, cost = start + size, place + size, cost + 16
    if done < len(target):
        ops.append(("insert", at, at, target[done:]))
        cost += 8 + len(target[done:].encode())
    return ops, cost


BANDED = "struct<ops:" + DELTA + ",cost:bigint>"


def banded(reference: Column, target: Column) -> Column:
    """banded_delta of each row as (ops, cost); null for a null text. A delta is worth storing under 0.8 of its target."""
    return F.pandas_udf(_banded, BANDED)(reference, target)


def _banded(reference: pd.Series, target: pd.Series) -> pd.DataFrame:
    row = lambda op: dict(zip(("kind", "start", "end", "text"), op))
    found = [(None, None) if r is None or t is None else banded_delta(r, t) for r, t in zip(reference, target)]
    return pd.DataFrame({"ops": [None if ops is None else [row(o) for o in ops] for ops, _ in found], "cost": pd.array([c for _, c in found], "Int64")})


def apply_banded(reference: Column, ops: Column) -> Column:
    return apply_delta(reference, F.filter(ops, lambda o: o["kind"] != "skip"))


def worth_storing(cost: Column, target: Column) -> Column:
    return cost < 0.8 * F.octet_length(target)


#: Ways to align two columns, by name; add your own.
ALIGNERS = {"best": edits, "banded": banded, "blocks": delta}
