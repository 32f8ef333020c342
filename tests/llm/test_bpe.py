import hashlib
import random

import pytest
from tokenizers import Tokenizer

from seatward.llm.bpe import Bpe, encode_decode, encoding_digests, vocabulary

RNG = random.Random(5)
ALPHABET = "abcdehilmnorstuABSTÉéèßñçŒœİΣσςſK'’.,!?0123456789²½٣  \t\n\x0b\x0c\r\x1c\x1f\x85   ​́é中文字한글🙂👩‍👩‍👧<|>_#$"
TEXTS = [
    None, "", " \n ", "The quick brown fox didn't jump; it's we'll I'M you'RE", "ÀÉÎ é ﬁ ΑΣ ΣΑΣ İstanbul", "\x1c\x1d a\x1eb\x1fc",
    "a<|endoftext|>b <|startoftext|><|endoftext|> <|ENDOFTEXT|> <|endoftext", "x" * 5000, "ab" * 3000, "é" * 2000, "\u0000\u0001�",
    *("".join(RNG.choice(ALPHABET) for _ in range(RNG.randrange(1, 200))) for _ in range(300)),
    *("".join(chr(RNG.choice([RNG.randrange(32, 0x3000), RNG.randrange(0xE000, 0x20000)])) for _ in range(60)) for _ in range(100)),
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_same_ids_and_text_as_the_library(library):
    bpe = Bpe(vocabulary())
    for text in TEXTS:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert bpe.encode(text or "") == want, repr(text)
        assert bpe.decode(want) == library.decode(want, skip_special_tokens=False)
        n, ids, decoded = bpe.digests(text)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (n, ids, decoded) == (len(want), sha(" ".join(map(str, want))), sha(bpe.decode(want)))


def test_blanks_are_those_of_the_library(library):
    bpe = Bpe(vocabulary())
    for code in [*range(0x300), *range(0x1680, 0x1681), *range(0x180E, 0x180F), *range(0x2000, 0x2070), 0x3000, 0xFEFF]:
        text = f"a{chr(code)}b"
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(code)


def test_forgetting_words_changes_nothing(monkeypatch):
    import seatward.llm.bpe as module

    bpe, small = Bpe(vocabulary()), Bpe(vocabulary())
    want = [bpe.digests(t) for t in TEXTS]
    monkeypatch.setattr(module, "CACHE_WORDS", 3)
    assert [small.digests(t) for t in TEXTS] == want and len(small.young) <= 3


def test_on_tables(docs_df, library):
    df = docs_df([(i, t) for i, t in enumerate(TEXTS[:12])] + [(None, "twin"), (None, "twin")])
    got = {r["doc_id"]: r for r in encoding_digests(df.withColumnRenamed("n_chars", "n_tokens"), vocabulary()).collect()}
    assert all(got[i]["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS[:12]))
    both = encode_decode(df, vocabulary(), carry=["doc_id"]).where("doc_id IS NULL").collect()
    assert len(both) == 2 and both[0] == both[1] and both[0]["ids"] == library.encode("twin", add_special_tokens=False).ids
    assert encoding_digests(docs_df([]), vocabulary()).count() == 0
