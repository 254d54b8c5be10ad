import hashlib
import json
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lociq.llm import bpe, pretoken, token_count  # noqa: E402


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe.read_ranks(lines)


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def model_json():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


TEXTS = ["", " ", "a", "Hello  world's 123", "ab" * 900, "é́\U0001f600  \n\n x", "x" * 3000, "\x1c\x1d a\x85b", "'re 'REll", "<|endoftext|>a<|endoftext|>", " lead", "trail ", "tab\t x", "1" * 200]


def test_pattern_is_the_public_one():
    assert public_tokenizers.PATTERN == pretoken.BYTE_LEVEL_PATTERN


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_and_decoding(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)
    assert codec.decode(codec.pack_all([text])[0]).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_of_any_text(codec, library, text):
    assert codec.encode(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'rels \n\té1!", max_size=20), st.text(alphabet="ab'rels \n\té1!", max_size=20))
def test_appends_are_exact(codec, library, first, second):
    text = bpe.EncodedText(codec, first)
    text.append(second)
    assert text.ids() == library.encode_ordinary(first + second)


def test_edits_are_exact_and_local(codec):
    rng = random.Random(3)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdethinor ") for _ in range(rng.randrange(1, 2000)))
        states = bpe.PrefixTable(codec.pairs, data)
        start = rng.randrange(len(data))
        stop = min(len(data), start + rng.randrange(4))
        done = states.replace(start, stop, b"xyz")
        whole = bpe.PrefixTable(codec.pairs, data[:start] + b"xyz" + data[stop:])
        assert states.data == whole.data and states.last == whole.last
        if len(data) - stop > 5 * codec.vocabulary.longest:
            assert done < len(whole.data) - start


def test_vocabulary_must_have_all_bytes():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_unordered_merges():
    """A vocabulary whose longer token has the lower rank still gives what merging gives."""
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"ab": 500, b"abc": 400, b"bc": 600}
    codec = bpe.Codec(bpe.Vocabulary(ranks), "(?s).+")
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        assert codec.encode(text) == [ranks[p] for p in bpe.merge(text.encode(), ranks)[0]]


def frame(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (77, None), (0, "")]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")


def test_digests_query(spark, ranks, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(frame(spark), ranks).collect())
    want = []
    for r in frame(spark).collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.token_digests(frame(spark).limit(0), ranks).count() == 0


def test_encode_then_decode(spark, ranks):
    coded = bpe.encode_texts(frame(spark), ranks)
    back = {(r.doc_id, r.text) for r in bpe.decode_ids(coded, ranks).collect()}
    assert back == {(r.doc_id, r.text or "") for r in frame(spark).collect()}


@pytest.fixture(scope="module")
def counter(model_json):
    merges, vocabulary, special = token_count.read_model(json.loads(model_json))
    return token_count.Counter(merges, token_count.prove_whole(merges, vocabulary), special)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " a", "b c", "\n"]), max_size=8).map("".join))
def test_counts_of_any_text(counter, model_json, text):
    tokenizer = _tokenizer(model_json)
    assert counter.counts([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)]


_known = {}


def _tokenizer(model_json):
    return _known.setdefault(len(model_json), Tokenizer.from_str(model_json))


def test_counts_query(spark, model_json):
    tokenizer = _tokenizer(model_json)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(frame(spark), model_json, limit=20).collect())
    want = []
    for r in frame(spark).collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 20))
    assert got == sorted(want)


def test_whole_tokens_are_proved(counter, model_json):
    tokenizer = _tokenizer(model_json)
    for token in random.Random(5).sample(sorted(counter.whole), 300):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert len(tokenizer.model.tokenize(tokenizer.pre_tokenizer.pre_tokenize_str(text)[0][0])) == 1 or len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) > 1


def test_tokens_that_no_merges_reach():
    """The library takes a piece that is a token whole; inside other pieces only merges count."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 257, b" abc": 258}
    library = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    for text in ("abc", "abc abc", "xabc", "abcabc", "bc abc abcx", "", "a bc"):
        assert codec.encode(text) == library.encode_ordinary(text), text
        grown = bpe.EncodedText(codec)
        for c in text:
            grown.append(c)
        assert grown.ids() == library.encode_ordinary(text), text
