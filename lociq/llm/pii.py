"""Personal data: fixed patterns, and a semi-Markov conditional random field for other spellings.

The field scores whole candidate segments: how many digits, in which groups, with which separators,
whether check digits hold, what stands before. Dynamic programming over segments of bounded length
chooses boundaries and types together, over the whole text: where no segment can stand, every token is
outside and nothing is left to choose, so such stretches are passed over.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from lociq.llm.common import each, long_fields, map_texts, string_fields

KINDS = ("email", "ip", "card", "phone")
#: The labels of segments; O is everything else and always one token.
LABELS = ("O", *KINDS)
#: Tokens in an entity at most.
LONGEST = 17

# ---- the base patterns -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]").search


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    return len(short := part.lstrip("0")) <= 3 and int(short or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at-sign back over the local part's characters, so that a long run is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at)):
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, four at a time."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if 14 <= len(digits := _digits(match.group())) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(match.group())) <= 15:
            yield match.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, in order."""
    if not _TRIGGER(text):
        return []
    found = [(s, k, e) for k, find in enumerate((emails, ips, cards, phones)) for s, e in find(text)]
    return sorted(found)


# ---- the field ---------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
#: What a candidate has at least one of: a digit, an at-sign, or the word in brackets.
_MARK = re.compile(r"[0-9@]|[(\[]\s?at(?![^\W\d_])", re.IGNORECASE)
_CUES = {
    "email": {"email", "mail", "contact", "mailto"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit"},
    "ip": {"ip", "host", "address", "server"},
}
_CUE = {word: kind for kind, words in _CUES.items() for word in words}
#: Tokens before a segment in which a cue counts.
CUE_TOKENS = 4
#: Digits in an entity at most.
MOST_DIGITS = 19
_ZEROS = str.maketrans("123456789", "000000000")
_NO_DIGITS = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)


class Shape(NamedTuple):
    """What the features of a segment depend on; its digits are all 0."""

    text: str
    held: int
    cue: str
    before: tuple[bool, bool]
    after: tuple[bool, bool]
    luhn: bool
    octets: bool


class _Token(NamedTuple):
    """A token's place, whether a segment can begin with it, what stands before it in the line, and its cue."""

    start: int
    opens: bool
    digits: int
    groups: int
    ats: int
    dots: int
    cue: str | None


def candidates(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, list[tuple[int, Shape]], bool]]:
    """For each token of text[lo:hi] its start and end, the segments that end with it, as numbers of tokens and
    shapes, the longest first, and whether it can make a segment (a digit or at-sign).

    A segment has 2 to LONGEST tokens of one line and at most MOST_DIGITS digits; it begins with a number, a word, + or (
    and ends with a number or a word; and it has seven digits, or one at-sign, or four numbers with three dots.
    Only the last LONGEST + CUE_TOKENS tokens are held.
    """
    last: deque[_Token] = deque(maxlen=LONGEST + CUE_TOKENS)
    digits = groups = ats = dots = 0
    since = LONGEST
    one = two = ""
    for match in _TOKEN.finditer(text, lo, hi):
        token, start, end = match.group(), match.start(), match.end()
        first = token[0]
        number = "0" <= first <= "9"
        at = first == "@" or (len(token) == 2 and token.lower() == "at" and (one in ("(", "[") or (two in ("(", "[") and one.isspace())))
        last.append(_Token(start, first.isalnum() or first in "+(", digits, groups, ats, dots, _CUE.get(token.lower())))
        one, two = token, one
        if number:
            digits, groups = digits + len(token), groups + 1
        ats += at
        dots += first == "."
        since = 0 if number or at else since + 1
        found: list[tuple[int, Shape]] = []
        if since < LONGEST - 1 and first.isalnum():
            for size in range(2, min(LONGEST, len(last)) + 1):
                a = last[-size]
                held = digits - a.digits
                if held > MOST_DIGITS:
                    break
                if not a.opens:
                    continue
                signs, numbers = ats - a.ats, groups - a.groups
                if held >= 7 or signs == 1 or (numbers == 4 and dots - a.dots >= 3):
                    found.append((size, _shape(text, a.start, end, held, numbers, _cue(last, size))))
            found.reverse()
        elif first == "\n":
            last.clear()
        yield start, end, found, number or at


def _cue(last: deque[_Token], size: int) -> str:
    for k in range(size + 1, min(size + CUE_TOKENS, len(last)) + 1):
        if last[-k].cue:
            return last[-k].cue
    return "none"


def _shape(text: str, start: int, end: int, held: int, numbers: int, cue: str) -> Shape:
    segment, before, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    return Shape(
        segment.translate(_ZEROS),
        held,
        cue,
        (before.isalnum(), bool(before) and before in ".+-@/"),
        (after.isalnum(), bool(after) and after in "@/-"),
        14 <= held <= MOST_DIGITS and luhn(segment.encode().translate(None, _NO_DIGITS).decode()),
        numbers == 4 and all(map(_octet, re.findall("[0-9]+", segment))),
    )


@lru_cache(50_000)
def features(shape: Shape) -> tuple[str, ...]:
    text, held = shape.text, shape.held
    groups = [len(g) for g in re.findall("[0-9]+", text)]
    letters = bool(re.search(r"[^\W\d_]", text))
    ats = text.count("@") + len(re.findall(r"[(\[]\s?at(?![^\W\d_])", text, re.I))
    found = [
        "bias",
        f"digits={held}",
        f"groups={'-'.join(map(str, groups))}" if len(groups) < 7 else "groups=many",
        f"seps={''.join(sorted(set(re.sub(r'[^\W_]', '', text))))}",
        f"first={'a' if text[0].isalpha() else '0' if text[0].isdigit() else text[0]}",
        f"letters={letters}",
        f"at={ats}:{bool(re.search(r'(?:[.]|[ (\[]dot[ )\]])\s?[a-z]{2,6}$', text, re.I))}",
        f"marked={bool(re.search(r'@|[(\[ ]at[)\] ]', text, re.I))}:{letters and held < 7}",
        f"cue={shape.cue}",
        f"outside={shape.before[0]}{shape.before[1]}{shape.after[0]}{shape.after[1]}",
    ]
    if not letters and 14 <= held <= MOST_DIGITS:
        found.append(f"luhn={shape.luhn}")
    if len(groups) == 4:
        found.append(f"octets={shape.octets}:{max(groups) <= 3}")
    return tuple(found)


class Sentence:
    """A short text's tokens and, by the token after their last, its segments: (first token, features)."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[int, int]] = []
        self.segments: list[list[tuple[int, tuple[str, ...]]]] = [[]]
        for start, end, found, _ in candidates(text, 0, len(text)):
            self.tokens.append((start, end))
            self.segments.append([(len(self.tokens) - size, features(shape)) for size, shape in found])


#: Shapes whose scores are held at once.
KNOWN_SHAPES = 50_000


def _worth(text: str, start: int, end: int) -> bool:
    """Whether a line can hold a segment: it has four digits or an at-sign."""
    line = text[start:end]
    return len(line.encode().translate(None, _NO_DIGITS)) >= 4 or any(m.group()[0] not in "0123456789" for m in _MARK.finditer(line))


def _tokens_before(text: str, at: int, floor: int, count: int) -> int:
    """Where the ``count``th token before ``at`` begins, or ``floor``."""
    while count and at > floor:
        at, count = at - 1, count - 1
        c = text[at]
        if "0" <= c <= "9":
            while at > floor and "0" <= text[at - 1] <= "9":
                at -= 1
        elif c.isalnum() and not c.isdecimal():
            while at > floor and (c := text[at - 1]).isalnum() and not c.isdecimal():
                at -= 1
    return at


class Field:
    """Weights by (label, feature) and by (label, label) of neighbouring segments."""

    def __init__(self, weights: dict | None = None) -> None:
        self.weights: dict = dict(weights or {})
        self._known: dict[Shape, tuple[float, ...]] = {}

    def _arcs(self, sentence: Sentence) -> list[list[tuple[int, int, float, tuple[str, ...]]]]:
        """For each end: (start, label, score, features) of the segments that end there."""
        get, n = self.weights.get, len(sentence.tokens)
        arcs: list = [[] for _ in range(n + 1)]
        for end in range(1, n + 1):
            arcs[end].append((end - 1, 0, 0.0, ()))
            for start, features in sentence.segments[end]:
                for label in range(1, len(LABELS)):
                    arcs[end].append((start, label, sum(get((label, f), 0.0) for f in features), features))
        return arcs

    def _next(self, before: int, label: int) -> float:
        return self.weights.get((before, label), 0.0)

    def scores(self, shape: Shape) -> tuple[float, ...]:
        """The score of a segment under each label after O."""
        found = self._known.get(shape)
        if found is None:
            if len(self._known) >= KNOWN_SHAPES:
                self._known.clear()
            get, own = self.weights.get, features(shape)
            found = self._known[shape] = tuple(sum(get((label, f), 0.0) for f in own) for label in range(1, len(LABELS)))
        return found

    def entities(self, text: str) -> list[tuple[int, int, int]]:
        """(start, label, end) of the entities of the best segmentation of the whole text, in order."""
        found: list[tuple[int, int, int]] = []
        at = line_end = 0
        while mark := _MARK.search(text, at):
            if mark.start() >= line_end:
                line_start = text.rfind("\n", line_end, mark.start()) + 1 or line_end
                line_end = text.find("\n", mark.start()) + 1 or len(text)
                at = line_start
                if not _worth(text, line_start, line_end):
                    at = line_end
                    continue
            lo = _tokens_before(text, mark.start(), at, LONGEST + CUE_TOKENS)
            at = self._decode(text, lo, line_end, found)
        return found

    def _decode(self, text: str, lo: int, hi: int, found: list[tuple[int, int, int]]) -> int:
        """Add the entities from ``lo`` on to ``found``; returns where it ended, at ``hi`` or where no segment can reach.

        States of the last LONGEST places are held, and for the whole stretch a byte for each label and token
        with the way back, and the tokens' places.
        """
        many = len(LABELS)
        starts, stops, back = array("q"), array("q"), bytearray()
        step = [[self._next(b, label) for label in range(many)] for b in range(many)]
        states: deque = deque([([0.0] + [-math.inf] * (many - 1), None)], maxlen=LONGEST)
        since = 0
        for start, end, segments, marks in candidates(text, lo, hi):
            since = 0 if marks else since + 1
            value, ways = [-math.inf] * many, [0] * many
            row = states[-1][0]
            for b in range(many):
                if row[b] + step[b][0] > value[0]:
                    value[0], ways[0] = row[b] + step[b][0], many + b
            for size, shape in segments:
                row, into = states[-size]
                if into is None:
                    into = [max((row[b] + step[b][label], -b) for b in range(many)) for label in range(many)]
                    states[-size] = row, into
                for label, score in enumerate(self.scores(shape), 1):
                    if into[label][0] + score > value[label]:
                        value[label], ways[label] = into[label][0] + score, many * size - into[label][1]
            states.append((value, None))
            starts.append(start)
            stops.append(end)
            back.extend(ways)
            if since > 2 * LONGEST + CUE_TOKENS:
                break
        value, place, entities = states[-1][0], len(starts), []
        label = value.index(max(value))
        while place:
            size, before = divmod(back[(place - 1) * many + label], many)
            if label:
                entities.append((starts[place - size], label, stops[place - 1]))
            place, label = place - size, before
        found += entities[::-1]
        return stops[-1] if stops else hi

    def fit(self, examples: list[tuple[Sentence, list[tuple[int, int, int]]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Stochastic gradient of the log-likelihood, with a step of its own for each weight."""
        squares: dict = defaultdict(lambda: 1e-3)
        for _ in range(rounds):
            for sentence, truth in examples:
                slope = self._slope(sentence, truth)
                for key, value in slope.items():
                    value -= decay * self.weights.get(key, 0.0)
                    squares[key] += value * value
                    self.weights[key] = self.weights.get(key, 0.0) + rate * value / math.sqrt(squares[key])
        self._known.clear()
        return self

    def _slope(self, sentence: Sentence, truth: list[tuple[int, int, int]]) -> dict:
        n, many = len(sentence.tokens), len(LABELS)
        arcs = self._arcs(sentence)
        ahead = [[-math.inf] * many for _ in range(n + 1)]
        behind = [[-math.inf] * many for _ in range(n + 1)]
        ahead[0][0] = 0.0
        behind[n] = [0.0] * many
        for end in range(1, n + 1):
            for start, label, score, _ in arcs[end]:
                ahead[end][label] = _plus(ahead[end][label], score + _all(ahead[start][b] + self._next(b, label) for b in range(many)))
        for end in range(n, 0, -1):
            for start, label, score, _ in arcs[end]:
                if (tail := behind[end][label]) > -math.inf:
                    for b in range(many):
                        behind[start][b] = _plus(behind[start][b], self._next(b, label) + score + tail)
        total, slope = _all(ahead[n]), defaultdict(float)
        for end in range(1, n + 1):
            for start, label, score, features in arcs[end]:
                for b in range(many):
                    p = math.exp(min(0.0, ahead[start][b] + self._next(b, label) + score + behind[end][label] - total))
                    if p > 1e-9:
                        slope[b, label] -= p
                        for f in features:
                            slope[label, f] -= p
        spans = {a: (label, b) for a, label, b in truth}
        at = before = 0
        while at < n:
            label, end = spans.get(at, (0, at + 1))
            slope[before, label] += 1
            for start, features in sentence.segments[end]:
                if label and start == at:
                    for f in features:
                        slope[label, f] += 1
            at, before = end, label
        return slope


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _all(values) -> float:  # noqa: ANN001
    values = list(values)
    top = max(values)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


# ---- labelled examples -------------------------------------------------------------------------------

_FILLER = "the and of to was reply about order number on from item total page version dated room chapter figure see please send we is der die und le la de con para".split()


def examples(n: int = 260, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with (start, label, end) of their entities; half have numbers that are none."""
    rng = random.Random(seed)
    digit = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: rng.choice(_FILLER)
    name = lambda: "".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(3, 7)))

    def card() -> str:
        body = digit(15)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice((".", "/", " - ", "_")).join(number[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        at, dot = rng.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" @ ", ".")))
        return f"{name()}{at}{name()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr'))}"

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}"))

    def ip() -> str:
        return rng.choice((" . ", "[.]")).join(str(rng.randint(1, 254)) for _ in range(4))

    make = {"card": card, "email": email, "phone": phone, "ip": ip}
    noise = (
        lambda: digit(rng.randint(1, 4)), lambda: digit(rng.randint(7, 13)), lambda: digit(16), lambda: f"{digit(2)}.{digit(2)}.20{digit(2)}", lambda: f"20{digit(2)}-{digit(2)}-{digit(2)}",
        lambda: f"{digit(1)}.{digit(1)}.{digit(2)}", lambda: f"{digit(3)} {digit(3)} {digit(4)}", lambda: f"{digit(4)} {digit(4)} {digit(4)} {digit(4)}", lambda: f"{digit(3)},{digit(3)},{digit(3)}", lambda: f"meet at {name()}.", lambda: f"{digit(4)}-{digit(4)}",
        lambda: f"at {name()}.{name()}", lambda: f"20{digit(2)}-20{digit(2)}", lambda: f"{digit(4)} {digit(4)}", lambda: f"at {digit(2)} {word()} {digit(6)}", lambda: f"{digit(3)}.{digit(3)}.{digit(3)}.{digit(3)}.{digit(3)}", lambda: f"{name()} at {name()} {rng.choice(('com', 'de', 'net'))}",
    )
    out = []
    for _ in range(n):
        parts, spans = [word() for _ in range(rng.randint(1, 3))], []
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.5:
                kind = rng.choice(list(make))
                if rng.random() < 0.4:
                    parts.append(rng.choice(sorted(_CUES[kind])) + rng.choice(("", ":")))
                start = len(" ".join(parts)) + 1
                parts.append(make[kind]())
                spans.append((start, LABELS.index(kind), start + len(parts[-1])))
            else:
                parts.append(rng.choice(noise)())
            parts += [word() for _ in range(rng.randint(1, 3))]
        out.append((" ".join(parts), spans))
    return out


def aligned(text: str, spans: list[tuple[int, int, int]]) -> tuple[Sentence, list[tuple[int, int, int]]]:
    sentence = Sentence(text)
    first = {s: k for k, (s, _) in enumerate(sentence.tokens)}
    last = {e: k + 1 for k, (_, e) in enumerate(sentence.tokens)}
    return sentence, [(first[s], label, last[e]) for s, label, e in spans]


def train(n: int = 260, seed: int = 3) -> Field:
    """A field fitted on ``n`` generated sentences."""
    return Field().fit([aligned(*example) for example in examples(n, seed)])


# ---- texts -------------------------------------------------------------------------------------------

def more_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Entities of the field, as (start, kind's number, end), that overlap no base span."""
    starts = [start for start, _, _ in base]
    ends = [0, *accumulate((end for _, _, end in base), max)]
    return [(s, label - 1, e) for s, label, e in field.entities(text) if ends[bisect_left(starts, e)] <= s]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one per row.

    The counts and the hash are of the base patterns; ``spans`` has these and the field's, as
    kind:start:end by start and kind, in code points, end exclusive. A null or empty text has none.
    Repeated rows and null ids stay; other columns are not read. The field is trained on a fixed number
    of generated sentences and broadcast. One pass, no shuffle. A text has to fit a Python worker; a line of numbers only
    takes some 20 bytes for each of its tokens besides, any other text less, and time in proportion.
    """
    shared = df.sparkSession.sparkContext.broadcast((field or train()).weights)

    def make() -> Callable[[list[str]], list[tuple]]:
        trained = Field(shared.value)

        def one(text: str) -> tuple:
            base = base_spans(text)
            added = more_spans(text, base, trained)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)

        return each(one)

    return map_texts(df, id_col, text_col, make, [*long_fields("n_email", "n_ip", "n_card", "n_phone"), *string_fields("base_sha256", "spans"), *long_fields("n_added")])
