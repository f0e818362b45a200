"""Words without a break, as in scripts without spaces, hashes and junk: equal to the libraries, and in time."""

import random
import time

import numpy as np
import pytest
from litsieve.llm import bpe, byte_bpe, packing


def long_words():
    r = random.Random(8)
    out = ["".join(r.choice("etaoinshrdlu") for _ in range(n)) for n in (127, 128, 129, 130, 500, 3000)]
    out += ["a" * 4001, "ab" * 1500, "the" * 700, "漢字仮名" * 300, "".join(r.choice("ßäöüéñ😀x") for _ in range(900)), "x" * 200 + "y" + "x" * 200, "".join(chr(r.randrange(0xAC00, 0xD7A3)) for _ in range(400))]
    return out


def test_merging_by_heap_equals_merging_by_rounds(monkeypatch):
    r = np.random.default_rng(3)
    left, right = np.divmod(r.choice(36, 20, replace=False), 6)
    rank = r.permutation(20) // 2  # some pairs share a rank
    merger = bpe.PairMerger(left, right, rank, 6 + np.arange(20, dtype=np.int32))
    words = [r.integers(0, 6, n) for n in r.integers(1, 90, 200)]
    symbols, lengths = np.concatenate(words), np.array([len(w) for w in words])
    by_rounds = merger.merge(symbols, lengths)
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    by_heap = merger.merge(symbols, lengths)
    monkeypatch.setattr(bpe, "LONG_WORD", 40)
    mixed = merger.merge(symbols, lengths)
    for a, b in zip(by_rounds, by_heap, strict=True):
        assert a.tolist() == b.tolist()
    assert by_rounds[0].tolist() == mixed[0].tolist()


def test_byte_bpe_equals_the_library():
    import public_tokenizers
    import tiktoken

    path = byte_bpe.multilingual_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = [w for w in long_words()] + [f"so {w} it is" for w in long_words()]
    got = [np.frombuffer(c, "<u4").tolist() for c in byte_bpe.RankEncoder.of(path).encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = packing.word_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [w for w in long_words()] + [f"So {w} it {w.upper()} is." for w in long_words()]
    got = [np.frombuffer(c, "<u4").tolist() for c in packing.WordEncoder.of(path).encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("letters", ["etaoinshrdlu", "a", "acgt"])
def test_a_million_letters_take_seconds(letters):
    r = random.Random(2)
    word = "".join(r.choices(letters, k=1_000_000))
    coder = byte_bpe.RankEncoder.of(byte_bpe.multilingual_ranks())
    words = packing.WordEncoder.of(packing.word_vocabulary())
    coder.encode(["warm " + "up" * 200]), words.encode([b"warm " + b"up" * 200])
    began = time.process_time()
    (code,) = coder.encode([word])
    assert time.process_time() - began < 40
    assert coder.decode(code) == word.encode()
    began = time.process_time()
    (code,) = words.encode([word.encode()])
    assert time.process_time() - began < 40 and len(code) > 4 * 50_000
    assert not any(len(w) > 10_000 for w in [*coder.words, *words.words])
