import base64
import random

import public_tokenizers
import pytest
import tiktoken

from leaselake.llm import bpe

from .conftest import lines

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(packed):
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.whole.slots) == list(range(len(codec.tokens)))
    assert all(codec.whole.place(t) == i for i, t in enumerate(codec.tokens))
    for keys in ([], [b""], [b"a", b"b"]):
        assert [bpe.PerfectHash(keys).place(k) for k in keys] == list(range(len(keys)))


def test_same_ids_as_another_encoder(codec, other):
    rng = random.Random(2)
    samples = ["", " ", "\n\n  x", "don't I'LL 's", "ñandú über 12345 ½ 日本語 🙂🙂", "a" * 3000, "=" * 500, lines(1, 20, "fr"), "<|endoftext|>"]
    samples += ["".join(rng.choices("abcdeéß 1 .\n日🙂", k=rng.randint(1, 60))) for _ in range(300)]
    for text in samples:
        packed = codec.encode(text)
        assert ids_of(packed) == other.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_memo_is_bounded(codec, monkeypatch, other):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 5)
    text = lines(9, 5)
    codec.clear()
    assert ids_of(codec.encode(text)) == other.encode_ordinary(text) and len(codec) <= 5


def test_ranks_must_be_complete(tmp_path):
    bad = tmp_path / "ranks"
    bad.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(bad))


def test_awkward_rows(awkward, empty, other):
    args = (PATH, public_tokenizers.PATTERN)
    encoded = bpe.encode(awkward, *args)
    assert set(encoded.columns) == set(awkward.columns) and encoded.count() == awkward.count()
    for r in bpe.decode(encoded, *args).collect():
        assert ids_of(r.ids) == other.encode_ordinary(r.text or "") and r.decoded == (r.text or "").encode()
    both = bpe.encode_and_decode(awkward, *args)
    assert both.columns == ["doc_id", "ids", "decoded"] and both.count() == awkward.count()
    assert bpe.encode_and_decode(empty, *args).count() == 0
