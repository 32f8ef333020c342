"""Byte-pair encoding and decoding from a published vocabulary file.

A piece is a doubly linked list of symbols. A priority queue holds the mergeable neighbours by rank, then place; an entry whose
symbols have changed since is skipped when it comes up. Decoding joins the vocabulary strings. Merges never cross blanks, so encoded
words are remembered per Python worker, in two generations of bounded size, and most words cost one lookup.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, unpacked, worker_cache
from seatward.llm.texts import map_texts

# Words remembered in one generation.
CACHE_WORDS = 400_000


# Letters and numbers of Unicode 17, which the ``regex`` module knows and the tokenizers library does not.
LATE = (
    r"\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1"
    r"\uAB6C-\uAB6D\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A"
    r"\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686"
    r"\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA"
    r"\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128"
    r"\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4"
    r"\U0001E6FE-\U0001E6FF\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479"
    r"\U0003D000-\U0003FC3F"
)
# Lower case of letters later than the standard library's Unicode 15.1.
LATE_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATE = regex.compile(f"[{LATE}]")
_PIECE_LATE = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{LATE}]]+|[\p{{N}}--[{LATE}]]|[^\s[\p{{L}}\p{{N}}--[{LATE}]]]+"
)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one ``tokenizers`` file: BPE with word ends, byte-level symbols, lower case, blanks dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]):
            self.ranks[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.end] for s in symbols]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: the lowest rank first, of equal ranks the leftmost."""
        n = len(raw)
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if n == 1:
            return ids
        ranks = self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has been merged away since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], new, ids[k]))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], new))
        return [i for i in ids if i >= 0]

    def pieces(self, word: str) -> list[str]:
        """A run without blanks, in lower case, cut into what is merged by itself."""
        if word.isascii():
            return _PIECE.findall(word)
        word = word.translate(LATE_LOWER)
        return (_PIECE_LATE if _LATE.search(word) else _PIECE).findall(word)

    def word_ids(self, word: str) -> list[int]:
        return [i for piece in self.pieces(word) for i in self.merge(piece.encode("utf-8", "surrogatepass"))]

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids and strings as the joined texts; from memory where it is there."""
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                pieces = self.pieces(word)
                if len(pieces) > 1:
                    # A piece is a word of its own: cut again, it stays whole.
                    parts = [*map(self.word, pieces)]
                    found = (sum(f[0] for f in parts), " ".join([f[1] for f in parts]), " ".join([f[2] for f in parts]))
                else:
                    ids = self.merge(pieces[0].encode("utf-8", "surrogatepass")) if pieces else []
                    found = (len(ids), " ".join(map(str, ids)), " ".join(map(self.strings.__getitem__, ids)))
            if len(word) <= 64:
                if len(self.young) >= CACHE_WORDS:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return found

    @staticmethod
    def words(text: str) -> list[str]:
        """Normalised text cut at blanks: composed form, lower case character by character."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        else:
            low = text.lower()
        # str.split also cuts at four controls that are no blanks here.
        if any(c in low for c in "\x1c\x1d\x1e\x1f"):
            return regex.findall(r"[^\s]+", low)
        return low.split()

    def segments(self, text: str):
        """Texts between special tokens, and the special tokens as ids, in order."""
        at = 0
        if self.special and any(s in text for s in self.special):
            for m in self.split_special.finditer(text):
                yield text[at : m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.segments(text):
            for w in self.words(part):
                out += self.word_ids(w)
            if special is not None:
                out.append(special)
        return out

    def decode(self, ids) -> str:
        """Vocabulary strings with a blank between, as a tokenizer without a decoder joins them."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids' decimals joined by blanks, SHA-256 of the decoded text."""
        n, ids, strings = 0, [], []
        for part, special in self.segments(text or ""):
            found = [*map(self.word, self.words(part))]
            if special is not None:
                found.append((1, str(special), self.strings[special]))
            n += sum(f[0] for f in found)
            ids += [f[1] for f in found if f[0]]
            strings += [f[2] for f in found if f[0]]
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
        return n, sha(ids), sha(strings)

    def ids_and_text(self, text: str | None) -> tuple[list[int], str]:
        ids = self.encode(text or "")
        return ids, self.decode(ids)


def loaded(path: str) -> Bpe:
    """The vocabulary once per worker, with the words it remembers."""
    cache = worker_cache("bpe")
    if path not in cache:
        cache[path] = Bpe(path)
    return cache[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``ids`` and ``decoded``. A null or empty text has no ids. Rows are independent: no shuffle."""
    rows = docs.select(packed(docs, carry), F.col(text).alias("text"))

    def make():
        bpe = loaded(path)
        return lambda texts: [bpe.ids_and_text(t) for t in texts]

    return unpacked(map_texts(rows, F.col("text"), make, "ids array<int>, decoded string"), "ids", "decoded")


def encoding_digests(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    A null text counts as empty: no ids, and the digests of the empty string. Texts are encoded whole, of any length. Repeated rows get
    equal results; an empty table gives no rows. Input columns named like a result column give way to it.
    """
    rows = docs.select(packed(docs, carry), F.col(text).alias("text"))

    def make():
        bpe = loaded(path)
        return lambda texts: [bpe.digests(t) for t in texts]

    found = map_texts(rows, F.col("text"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return unpacked(found, "n_tokens", "ids_sha256", "decoded_sha256")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary of the installed collection; any other path will do as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_bpe")
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_digests(documents(spark, folder), vocabulary(), carry=["doc_id"])
