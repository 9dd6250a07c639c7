"""Huge texts without spaces are spliced like any other."""

import random

import pytest

from panelworks.llm import tokencount

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_chunks_stay_short():
    r = random.Random(5)
    cjk = "".join(chr(r.choice([r.randrange(0x4E00, 0x9FFF), r.randrange(0x3041, 0x3097)])) for _ in range(400_000))
    counter = tokencount.Counter(MODEL)
    assert counter.count(cjk) == len(counter.sp.encode(cjk))
    assert 0 < counter.longest <= counter.chunk + counter.overlap


@pytest.mark.parametrize("chunk, overlap", [(64, 4), (200, 8), (1000, 64)])
def test_any_alphabet_without_spaces(chunk, overlap):
    r = random.Random(chunk)
    alphabets = ["abcdefghij", "日本語東京都市山川", "éàüñß", "😀🫠𠀀x", "xyz日é😀\n\t\x00", "the ing of to ", "▁ a", "아버지가방", " \n"]
    counter = tokencount.Counter(MODEL, chunk=chunk, overlap=overlap)
    for a in alphabets:
        for n in (chunk, 3 * chunk + 1, 10 * chunk):
            t = "".join(r.choice(a) for _ in range(n))
            assert counter.count(t) == len(counter.sp.encode(t)), (a, n)


def test_one_piece_repeated_widens():
    counter = tokencount.Counter(MODEL, chunk=64, overlap=4)
    for t in ("a" * 3000, "=" * 5000, " " * 3000, "ab" * 2000):
        assert counter.count(t) == len(counter.sp.encode(t))
