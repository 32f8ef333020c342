import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seatward.llm import range_coder
from seatward.llm.bpe import vocabulary
from seatward.llm.range_coder import decode, encode
from seatward.llm.token_files import LibraryIds, read_tokens, token_digests, write_tokens


def blocks():
    rng = np.random.default_rng(2)
    skewed = np.minimum(rng.zipf(1.3, 3000), 49_407)
    return [
        np.array([], np.int32), np.array([5]), np.array([0]), np.array([65_535, 0, 65_535]), np.zeros(9000, int), np.arange(2000) % 7,
        rng.integers(0, 65_536, 2500), skewed, np.concatenate([skewed[:500]] * 4), rng.integers(0, 3, 4000), np.repeat([0, 9, 0, 511, 512, 4095, 4096], 40),
    ]


def test_round_trip_of_blocks_side_by_side():
    want = blocks()
    coded = encode(want)
    assert all(np.array_equal(a, b) for a, b in zip(decode(coded), want, strict=True))
    # A block does not depend on its neighbours.
    assert [encode([b])[0] for b in want] == coded
    assert all(np.array_equal(decode([c])[0], b) for c, b in zip(coded, want, strict=True))
    assert encode([]) == [] and decode([]) == []
    assert len(coded[4]) < 100 and len(coded[8]) < 0.6 * len(coded[7]) * 4


def test_more_blocks_than_lanes(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 3)
    want = blocks()
    assert all(np.array_equal(a, b) for a, b in zip(decode(encode(want)), want, strict=True))


def test_damage_is_found():
    code = encode([np.arange(500) % 91])[0]
    for at in (0, 9, 20, len(code) - 9):
        spoilt = bytes(b ^ (255 if i == at else 0) for i, b in enumerate(code))
        with pytest.raises(ValueError):
            decode([spoilt])
    with pytest.raises(ValueError):
        decode([code[:-30]])
    with pytest.raises(ValueError):
        encode([np.array([70_000])])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


TEXTS = [None, "", "  ", "Plain words, plain words", "a<|endoftext|>b", "<|ENDOFTEXT|> é É ΑΣ İx", "K ﬁ Å é Ᲊ", "word " * 3000, "x" * 300, '"quoted"']


def test_ids_are_the_librarys(library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcÉé Σςİ'.!1²́\n<|>") for _ in range(80)) for _ in range(300)]
    own = LibraryIds(vocabulary())
    for _ in range(2):
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_files(docs_df, library):
    rows = [(i * 37 % 101, t) for i, t in enumerate(TEXTS * 3)] + [(None, "null key"), (None, None), (500, "tie"), (500, "tie"), (-4, "first but one")]
    files = write_tokens(docs_df(rows).repartition(5), vocabulary())
    want = {}
    for key, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(token_digests(files).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(want.values())
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    read = {(r["doc_id"], len(r["ids"])) for r in read_tokens(files).collect()}
    assert read == {(r["doc_id"], r["n_tokens"]) for r in got}
    assert token_digests(write_tokens(docs_df([]), vocabulary())).count() == 0


def test_many_segments(docs_df, monkeypatch, library):
    import seatward.llm.token_files as module

    monkeypatch.setattr(module, "SEGMENT", 50)
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "LANES", 4)
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(200)]
    got = sorted(token_digests(write_tokens(docs_df(rows), vocabulary())).collect(), key=lambda r: r["doc_id"])
    lengths = [len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows]
    assert [r["n_tokens"] for r in got] == lengths
    assert [r["start"] for r in got] == [sum(lengths[:i]) for i in range(200)]
