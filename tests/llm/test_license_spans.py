"""Every licence notice within its edits is reported, or overlaps a better one."""

import random

from lociq.llm import licenses

NOTICES = [licenses.Notice.of(text, label) for text, label in licenses.NOTICES.items()]


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(line: bytes, notice: licenses.Notice) -> list[tuple[int, int, int]]:
    size, slack = len(notice.text), notice.edits
    starts = [k for k in range(len(line)) if k == 0 or line[k - 1] == 32]
    stops = [k for k in range(1, len(line) + 1) if k == len(line) or line[k] == 32]
    spans = [(distance(notice.text.encode(), line[a:b]), a, b) for a in starts for b in stops if size - slack <= b - a <= size + slack]
    kept: list[tuple[int, int, int]] = []
    for edits, a, b in sorted(s for s in spans if s[0] <= slack):
        if all(b <= lo or hi <= a for lo, hi, _ in kept):
            kept.append((a, b, edits))
    return sorted(kept)


def spans(text: str) -> list[str]:
    return licenses.scan(text, licenses.BASE, NOTICES)[7].split(",")


def test_inexact_notice_before_an_exact_one():
    assert spans("under the mit licence or under the mit license") == ["mit:0:4:1", "mit:5:9:0"]


def test_valid_notice_beside_a_cut_one():
    assert spans("under the mit lisence sublicenseunder the mit licenses") == ["mit:0:4:2"]


def test_spans_against_brute_force():
    rng = random.Random(12)
    short = sorted(licenses.NOTICES, key=len)[:6]
    found = 0
    for _ in range(150):
        text = " ".join(rng.choice([*short, "license", "under", "the license", "or sub"]) for _ in range(rng.randrange(1, 6)))
        letters = list(text)
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(letters))
            letters[k] = rng.choice(["", "x", " ", letters[k] * 2, "é"])
        line, _ = licenses.normalise("".join(letters))
        for notice in NOTICES:
            want = brute(line, notice)
            assert [(h.start, h.stop, h.edits) for h in licenses.find(line, [notice])] == want
            found += len(want)
    assert found > 100
