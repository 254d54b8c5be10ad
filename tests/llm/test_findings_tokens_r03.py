"""Tests of what the second round's findings on the token operators changed."""

from __future__ import annotations

import json
import random
from pathlib import Path

import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from lociq.llm import bpe, pretoken, token_count

ALPHABET = "ab'st 1é\xa0\x85\x1c\n\t  ñ²—你ж\U0001f600.#  re "


def texts(n: int, words: int) -> list[str]:
    """Texts of words that hardly any other has."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefgéñ你") if rng.random() < 0.02 else rng.choice("abcdefgéñ") for _ in range(9))
    return [" ".join(word() for _ in range(words)) for _ in range(n)]


def ranks() -> dict[bytes, int]:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe.read_ranks(lines)


def test_split_is_the_pattern():
    plain, split = regex.compile(pretoken.BYTE_LEVEL_PATTERN).findall, pretoken.splitter(pretoken.BYTE_LEVEL_PATTERN)
    rng = random.Random(2)
    for size in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(size % 60))
        assert split(text) == plain(text)
    for text in texts(20, 300):
        assert split(text) == plain(text)


@pytest.mark.parametrize("bits", [2, 20])
def test_a_text_is_split_once(monkeypatch, bits):
    """op8_byte_bpe: each new word was split, looked up and put together by itself; and pairs that share a place don't mix."""
    monkeypatch.setattr(bpe, "PAIR_BITS", bits)
    found = ranks()
    codec, calls = bpe.Codec(bpe.Vocabulary(found), public_tokenizers.PATTERN), []
    split = codec.split
    codec.split = lambda text: calls.append(1) or split(text)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
    some = texts(8, 100)
    packed = codec.pack_all(some)
    assert [list(memoryview(x).cast("I")) for x in packed] == [library.encode_ordinary(text) for text in some]
    assert len(calls) == len(some)


def test_a_text_is_counted_in_one_split():
    """op9_token_counts: as for the codec."""
    model = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    merges, vocabulary, special = token_count.read_model(json.loads(model))
    counter, calls = token_count.Counter(merges, token_count.prove_whole(merges, vocabulary), special), []
    split = counter.split
    counter.split = lambda text: calls.append(1) or split(text)
    some = texts(8, 100)
    library = Tokenizer.from_str(model)
    assert counter.counts(some) == [len(library.encode(text, add_special_tokens=False).ids) for text in some]
    assert len(calls) == len(some)
