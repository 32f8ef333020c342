"""Scoring texts with a probabilistic suffix tree over words.

A state of the tree is a context of up to ``DEPTH`` words (the start of a text counts as the end token before it) that was seen twice or more. A state
gives a next word that it has seen n times out of N the share (n - 1) / N, and hands what is left to the state one word shorter, down to
the single words; so a word seen once is evidence of novelty only, and every state is a proper distribution. A state is
retained where the counts diverge from its parent's prediction by enough per word (in nats, after smoothing, so that chance
does not pass); its suffixes are retained with it. A word is scored in the longest retained suffix of what stands before it.

All contexts that end in the same word meet in one task, with every token after them: their counts, shares and divergences follow there, for rare and frequent ones alike,
and the tokens get their parts of the score. Contexts of ``HEAVY`` tokens and more would be too many for one task: their tokens are dealt by the shortest context that is
lighter, and what follows a heavy context is counted by a table (``facts``) from which each task gets the rows that it needs. Only heavy contexts, at most one in ``HEAVY`` tokens
a level, and the ``FREQUENT`` most frequent words are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seatward.llm.common import documents, packed, query, stored, unpacked
from seatward.llm.texts import PIECE

DEPTH = 2
# Words with a short code, which are broadcast.
FREQUENT = 1 << 20
# Tokens that meet in one task, about, and those of a context that is dealt out to several.
BUCKET = 3 << 18
HEAVY = BUCKET
# Tokens that a task works on at once, about; a light context is not cut.
GROUP = 1 << 17
# Nats a word by which a state must diverge from its parent.
MIN_DIVERGENCE = 0.02
FOLDS, HELD = 7, 2
# Distinct words at which a chunk of texts ends; tokens at which it ends, and numbers a task gathers before it counts them.
MEMORY = 200_000
GATHER = 1 << 20
# The end token; no word has a blank.
END = b" "
# What stands before the start of a text; the number of the context without words.
NONE, ROOT = -(1 << 63), 0
# Logarithms are added up as multiples of 2^-40, so that no order of addition shows.
UNIT = float(1 << 40)
# The document of what is told of contexts, and to how many groups that goes.
NOBODY, SHARES = -1, 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case, and the end token. Bytes split at exactly the six ASCII blanks."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    words.append(END)
    return words


def word_hash(word: bytes) -> int:
    """64 signed bits; a word stands for itself below, up to collisions (one chance in 2^64 for two words)."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in the sorted ``table``, -1 for what it lacks."""
    if not len(table):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, at, -1)


class Words:
    """Numbers for the words of a task, with their hashes and their positions in a sorted table of hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes = np.empty(0, np.int64)
        self.places = np.empty(0, np.int64)

    def full(self) -> bool:
        return len(self.number) > MEMORY

    def ids(self, words: list[bytes]) -> np.ndarray:
        number, before = self.number, len(self.number)
        out = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        new = np.fromiter(map(word_hash, islice(number, before, None)), np.int64, len(number) - before)
        self.hashes = np.concatenate([self.hashes, new])
        self.places = np.concatenate([self.places, find(self.table, new)])
        return out


def chunked_texts(df: DataFrame) -> DataFrame:
    """Texts as numbers, many documents a row, so that later passes need not split them again: ``df`` has the columns row (any struct), held_out and text.

    A chunk has its documents' rows, held_out and sizes in tokens, the tokens as numbers (packed) of its distinct words, whose hashes follow, and the number ``pos`` of
    its first document; the others follow in order. A chunk ends at ``GATHER`` tokens or ``MEMORY`` words.
    """
    schema = T.StructType.fromDDL("held_out array<boolean>, sizes array<int>, ids binary, hashes binary, pos long")
    schema = T.StructType([T.StructField("rows", T.ArrayType(df.schema["row"].dataType)), *schema.fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = TaskContext.get().partitionId() << 40
        words = Words(np.empty(0, np.int64))
        rows, held, sizes, ids, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in map(pa.concat_arrays, (rows, held))]
            numbers = _pack(np.concatenate(ids).astype(np.int32))
            columns = [*lists, pa.array([sizes], pa.list_(pa.int32())), pa.array([numbers]), pa.array([words.hashes.tobytes()]), pa.array([pos])]
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types.types, strict=True)], types.names)

        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                row, held_out, text = batch.slice(at, PIECE).columns
                lists = list(map(tokens, text.to_pylist()))
                ids.append(words.ids(list(chain.from_iterable(lists))))
                rows.append(row)
                held.append(held_out)
                sizes += map(len, lists)
                size += len(ids[-1])
                if size >= GATHER or words.full():
                    yield out()
                    pos += len(sizes)
                    words.clear()
                    rows, held, sizes, ids, size = [], [], [], [], 0
        if rows:
            yield out()

    return df.select("row", "held_out", "text").mapInArrow(run, schema)


class Chunk:
    """One row of ``chunked_texts``, without its documents' rows: hashes of its words, their numbers by token, sizes and first tokens of documents, which are learned from, and ``pos``."""

    def __init__(self, held_out: pa.Scalar, sizes: pa.Scalar, ids: pa.Scalar, hashes: pa.Scalar, pos: pa.Scalar):
        self.sizes = sizes.values.to_numpy()
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.train = ~held_out.values.to_numpy(zero_copy_only=False)
        self.hashes = np.frombuffer(hashes.as_py(), np.int64)
        self.ids = _unpack(ids.as_py(), int(self.sizes.sum()), np.int32)
        self.pos = pos.as_py()

    def learned(self) -> np.ndarray:
        """Whether each token is learned from."""
        return np.repeat(self.train, self.sizes)


CHUNK = ("held_out", "sizes", "ids", "hashes", "pos")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk(*(batch.column(name)[i] for name in CHUNK))


def word_counts(chunks: DataFrame) -> DataFrame:
    """(h, n, seen): how often each token is in the texts learned from, and in all. Tasks count first; their sums shuffle packed, by the first bits of the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, *sums = _counted(*map(np.concatenate, zip(*held, strict=True)))
            edges = np.searchsorted(h >> 54, np.arange(-512, 513))
            cuts = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]
            return _packed_rows([(c, [np.diff(h[at], prepend=0), *(x[at] for x in sums)]) for c, at in cuts], "share").to_batches()[0]

        for chunk in _chunks(batches):
            seen = np.bincount(chunk.ids, minlength=len(chunk.hashes))
            held.append((chunk.hashes, np.bincount(chunk.ids[chunk.learned()], minlength=len(chunk.hashes)), seen))
            size += len(chunk.hashes)
            if size > GATHER:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        h, n, seen = _unpacked_rows(table, differences=0)
        return pa.Table.from_arrays([pa.array(x) for x in _counted(h, n, seen)], ["h", "n", "seen"])

    return chunks.select(*CHUNK).mapInArrow(count, PACKED.format("share")).groupBy("share").applyInArrow(add, "h long, n long, seen long")


def _counted(h: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes in order, with the sums of their counts."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
    return [h[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in counts)]


def walk(levels: list[np.ndarray], words: np.ndarray, starts: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level (its sorted keys) and one level beyond: (state before each token, place of the token's key in the level), -1 for none.

    ``words`` are places of tokens among the frequent ones, texts one after the other; ``starts`` marks the first token of each text, ``first`` is the place of the
    end token. Beyond the last level only states are found; the places are then those of the level before.
    """
    state = np.empty_like(words)
    state[1:] = words[:-1]
    state[starts] = first
    found = words
    for depth in range(len(levels) + 1):
        if depth == len(levels):
            yield state, found
            return
        known = np.flatnonzero((state >= 0) & (found >= 0))
        place = np.full(len(words), -1, np.int64)
        place[known] = find(levels[depth], (state[known] << 32) | words[known])
        yield state, place
        found = place
        state = np.empty_like(place)
        state[1:] = place[:-1]
        # Nothing longer than the start itself stands before the first token.
        state[starts] = -1


def next_word_counts(chunks: DataFrame, hashes: np.ndarray, levels: list[np.ndarray]) -> DataFrame:
    """(key, n) at the level after ``levels``: frequent states with the frequent words after them. A key can only be frequent where its suffix is."""
    share = chunks.sparkSession.sparkContext.broadcast((hashes, levels))  # frequent ones only

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = share.value
        first = find(table, np.array([word_hash(END)]))[0]
        held, size = [], 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

        for chunk in _chunks(batches):
            places = find(table, chunk.hashes)[chunk.ids]
            for state, found in walk(known, places, chunk.starts, first):
                pass
            here = (state >= 0) & (found >= 0) & chunk.learned()
            held.append((state[here] << 32) | places[here])
            size += len(held[-1])
            if size > GATHER:
                yield out()
                held, size = [], 0
        yield out()

    return chunks.select(*CHUNK).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, column: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values of ``column`` with a count of ``least`` or more; as the counts sum to the tokens at most, there are at most one in ``least`` tokens."""
    rows = counts.where(F.col("n") >= least).select(column, "n").toArrow()
    values, n = rows[column].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def divergence(keys: np.ndarray, n: np.ndarray, state_counts: np.ndarray, shares: np.ndarray, rest: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Per state the mean log ratio of its smoothed prediction to its parent's over the words counted after it, in nats.

    ``parent`` has the parent's probability of each key's word. Words outside the keys get the parent's probability times ``rest``.
    """
    state = keys >> 32
    p = shares + rest[state] * parent
    inside = np.bincount(state, weights=n * np.log(p / parent), minlength=len(state_counts))
    others = state_counts - np.bincount(state, weights=n, minlength=len(state_counts))
    return (inside + others * np.log(rest)) / state_counts


class Level:
    """Frequent contexts one word longer than those of the level before: sorted ``keys`` (context << 32 | word) and how often each was seen.

    A context of one word is the place of the word among the frequent ones; a longer one is the place of its last word's key.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts


class SuffixTree:
    """The frequent part of the tree: single words (sorted hashes with counts) and levels of longer contexts; with the counts of all training tokens and distinct words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, levels: list[Level], total: int, distinct: int):
        self.hashes, self.counts, self.levels = hashes, counts, levels
        self.total, self.distinct = total, distinct


def fit_tree(texts: DataFrame, depth: int = DEPTH, max_states: int | None = None) -> tuple[SuffixTree, DataFrame]:
    """The contexts of up to ``depth`` words with ``HEAVY`` tokens or more (or a share of ``1 / max_states`` of all), and the stored counts (h, n, seen) of all words.

    ``texts`` has the one text column.
    """
    rows = texts.select(F.struct(F.lit(True).alias("one")).alias("row"), F.lit(False).alias("held_out"), F.col(texts.columns[0]).alias("text"))
    return fit_chunks(stored(chunked_texts(rows), "tree-codes"), depth, max_states)


def fit_chunks(chunks: DataFrame, depth: int = DEPTH, max_states: int | None = None) -> tuple[SuffixTree, DataFrame]:
    """``fit_tree`` of the documents in the chunks that are not held out."""
    words = stored(word_counts(chunks), "tree-words")
    counts = words.where(F.col("n") > 0)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = HEAVY if max_states is None else max(2, -(-total // max_states))
    hashes, n_words = _frequent(counts, "h", least)
    levels: list[Level] = []
    while len(levels) < depth - 1 and len(levels[-1].keys if levels else hashes):
        levels.append(Level(*_frequent(next_word_counts(chunks, hashes, [x.keys for x in levels]), "key", least)))
    return SuffixTree(hashes, n_words, levels, total, distinct), words


def _place(words: list[np.ndarray], levels: list[np.ndarray]) -> np.ndarray:
    """The context that ``words`` in a row are: the place of a word, or of their key; -1 for none."""
    state = words[0]
    for level, word in zip(levels, words[1:], strict=False):
        known = np.flatnonzero((state >= 0) & (word >= 0))
        found = np.full(len(state), -1, state.dtype)
        found[known] = find(level, state[known].astype(np.int64) << 32 | word[known])
        state = found
    return state


class Codes:
    """Words as numbers: the rank of a frequent one, the hash of any other."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        """``hashes`` and ``counts`` of the frequent words, the most frequent first."""
        self.hashes, self.counts = hashes, counts
        self.rank = np.argsort(hashes).astype(np.int32)
        self.table = hashes[self.rank]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        place = find(self.table, hashes)
        return np.where(place >= 0, self._at(self.rank, place), hashes)

    def _at(self, values: np.ndarray, place: np.ndarray) -> np.ndarray:
        return values[np.maximum(place, 0)] if len(values) else np.zeros(len(place), np.int64)

    def frequent(self, codes: np.ndarray) -> np.ndarray:
        return (codes >= 0) & (codes < len(self.hashes))

    def hash(self, codes: np.ndarray) -> np.ndarray:
        known = self.frequent(codes)
        return np.where(known, self._at(self.hashes, np.where(known, codes, 0)), codes)

    def count(self, codes: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        known = self.frequent(codes)
        return np.where(known, self._at(self.counts, np.where(known, codes, 0)), 0)


def frequent_words(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words seen ``least`` times, and of as many more as come to ``FREQUENT``, the most frequent first.

    There are fewer different counts than twice the square root of the number of tokens; they come to the driver.
    """
    sizes = counts.groupBy("n").count().toPandas().sort_values("n", ascending=False)
    fit = sizes["n"].to_numpy()[np.cumsum(sizes["count"].to_numpy()) <= FREQUENT]
    hashes, n = _frequent(counts, "h", min(least, int(fit[-1]) if len(fit) else least))
    order = np.argsort(-n, kind="stable")
    return hashes[order], n[order]


def documents_of(chunks: DataFrame, frequent: tuple, total: int, distinct: int) -> DataFrame:
    """The documents of the chunks: row, held_out, pos, n_tokens, and ``known`` and ``base`` over the frequent tokens."""
    share = chunks.sparkSession.sparkContext.broadcast(frequent)
    schema = T.StructType.fromDDL("held_out boolean, pos long, n_tokens long, known long, base double")
    schema = T.StructType([T.StructField("row", chunks.schema["rows"].dataType.elementType), *schema.fields])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(*share.value)
        for batch in batches:
            for i, chunk in enumerate(_chunks([batch])):
                code = codes.of(chunk.hashes)
                known = codes.frequent(code)
                logs = np.where(known, np.log10((codes.count(code) + 1) / (total + distinct + 1)), 0.0)
                sums = [np.add.reduceat(x[chunk.ids], chunk.starts) for x in (known.astype(np.int64), logs)]
                numbers = [chunk.pos + np.arange(len(chunk.sizes)), chunk.sizes.astype(np.int64), *sums]
                columns = [batch.column("rows")[i].values, batch.column("held_out")[i].values, *map(pa.array, numbers)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types.types, strict=True)], types.names)

    return chunks.mapInArrow(run, schema)


class Deal:
    """How tokens go to tasks: codes of words, the heavy contexts (words by rank, then levels of keys), and the number of tasks' shares (buckets)."""

    def __init__(self, frequent: tuple, heavy: tuple, depth: int, buckets: int):
        self.codes = Codes(*frequent)
        hashes, self.levels = heavy
        # Heavy words are the first by rank.
        self.heavy = find(hashes, self.codes.hashes[: len(hashes)])
        self.offsets = np.cumsum([ROOT + 1, len(hashes), *(len(x) for x in self.levels)])
        self.depth, self.buckets, self.shares = depth, buckets, -(-buckets // 4)

    def heavy_contexts(self, places: list[np.ndarray]) -> list[np.ndarray]:
        """For each length the number of the heavy context before a token, -1 where it is not heavy; ``places`` are those of the words one, two, ... before."""
        out = []
        for d in range(self.depth):
            state = _place(places[d::-1], self.levels[:d]) if d <= len(self.levels) else np.full(len(places[0]), -1, np.int32)
            out.append(np.where(state >= 0, state + np.int32(self.offsets[min(d, len(self.levels))]), np.int32(-1)))
        return out

    def places(self, words: np.ndarray) -> np.ndarray:
        """Of words, given by code, among the heavy ones; -1 for others."""
        out = np.full(len(words), -1, np.int32)
        known = np.flatnonzero((words >= 0) & (words < len(self.heavy)))
        out[known] = self.heavy[words[known]]
        return out

    def keys(self, words: np.ndarray, context: list[np.ndarray], heavy: list[np.ndarray]) -> np.ndarray:
        """Hashes of the shortest context that is not heavy; where all are, of the longest and the word. The upper halves tell the bucket, the lower ones the group in it."""
        key = _mix(np.zeros(len(words), np.uint64), context[0])
        for d in range(self.depth):
            longer = context[d + 1] if d + 1 < self.depth else words
            key = np.where(heavy[d] >= 0, _mix(key, np.where(longer == NONE, words, longer)), key)
        return key

    def tokens(self, chunk: Chunk) -> tuple:
        """(codes, words, contexts, heavy contexts, buckets) of a chunk's tokens. Words are numbers in the chunk, by which ``codes`` has their codes; -1, the last, is none."""
        codes, words = np.append(self.codes.of(chunk.hashes), NONE), chunk.ids
        context, last = [], words
        for d in range(self.depth):
            here = np.empty_like(words)
            here[1:] = last[:-1]
            # Documents end with the end token.
            here[chunk.starts] = -1 if d else words[chunk.sizes[0] - 1]
            context.append(here)
            last = here
        place = self.places(codes)
        heavy = self.heavy_contexts([place[c] for c in context])
        bucket = np.empty(len(words), np.uint16 if self.buckets <= 1 << 16 else np.int64)
        for at in _slices(len(words)):
            key = self.keys(codes[words[at]], [codes[c[at]] for c in context], [h[at] for h in heavy])
            bucket[at] = (key >> np.uint64(32)) % np.uint64(self.buckets)
        return codes, words, context, heavy, bucket


def _taken(items: list) -> Iterator:
    """The items, each out of the list, so that it can go when it is done with."""
    while items:
        yield items.pop(0)


def _slices(size: int) -> Iterator[slice]:
    """``GROUP`` rows each."""
    return (slice(at, at + GROUP) for at in range(0, size, GROUP))


def _runs(numbers: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their ``numbers``, and where each number below ``most`` begins, with the end."""
    order = np.argsort(numbers, kind="stable")
    return order, np.append(np.searchsorted(numbers[order], np.arange(most, dtype=numbers.dtype)), len(order))


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = (key ^ word.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(29))


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers, their first bytes together, then their second bytes and so on, compressed."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T), asbytes=True)


def _unpack(packed: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.Codec("zstd").decompress(packed, size * width), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).reshape(-1)


PACKED = "{} long, size long, packed array<binary>"


def _packed_rows(rows: list[tuple], name: str) -> pa.Table:
    """(``name``, size, packed) of (number, columns of 64-bit numbers)."""
    columns = [[c for c, _ in rows], [len(x[0]) for _, x in rows], [[_pack(np.ascontiguousarray(c, np.int64)) for c in x] for _, x in rows]]
    types = [pa.int64(), pa.int64(), pa.list_(pa.binary())]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [name, "size", "packed"])


def _unpacked_rows(table: pa.Table, differences: int, width: int = 0) -> list[np.ndarray]:
    """The columns (``width`` where there may be no rows) of packed rows one after the other; that numbered ``differences`` is packed as such."""
    size, rows = table["size"].to_pylist(), table["packed"].to_pylist()
    columns = [[_unpack(x, n) for x, n in zip(c, size, strict=True)] for c in zip(*rows, strict=True)] or [[np.empty(0, np.int64)] for _ in range(width)]
    columns[differences] = [np.cumsum(x) for x in columns[differences]]
    return [np.concatenate(c) for c in columns]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them; faster than sorting where there are few."""
    codes, distinct = pd.factorize(values)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[codes]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    return np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]])


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct key, in the order of the keys, and the place of each row's key among them."""
    order = np.argsort(keys)
    first = _firsts(keys[order])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    return order[first], place


def dealt_tokens(chunks: DataFrame, given: tuple) -> DataFrame:
    """(bucket, chunk, size, doc, words, n_last, last): the tokens of a chunk and bucket with the words before them, packed."""
    share = chunks.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Deal(*share.value)

        def dealt(chunk: Chunk) -> pa.RecordBatch:
            codes, words, context, _, bucket = deal.tokens(chunk)
            docs = chunk.pos + np.arange(len(chunk.sizes)) << 1 | chunk.train
            doc = np.repeat(np.arange(len(docs), dtype=np.int32), chunk.sizes)
            order, edges = _runs(bucket, deal.buckets)
            out = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                here = order[edges[b] : edges[b + 1]]
                # Few words stand last before the tokens of a bucket: those, and which of them.
                last, which = _numbered(codes[context[0][here]])
                others = [_pack(codes[x[here]]) for x in (words, *context[1:])]
                lasts = [_pack(np.diff(last, prepend=0)), _pack(which.astype(np.int32))]
                out.append((b, chunk.pos, len(here), _pack(np.diff(docs[doc[here]], prepend=0)), others, len(last), lasts))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "chunk", "size", "doc", "words", "n_last", "last"]
            )

        # What was made of a chunk is gone before the next one.
        yield from map(dealt, _chunks(batches))

    return chunks.select(*CHUNK).mapInArrow(run, "bucket long, chunk long, size long, doc binary, words array<binary>, n_last long, last array<binary>")


def wanted_facts(chunks: DataFrame, given: tuple) -> DataFrame:
    """(share, size, packed): code, context and bucket of the rare words of a bucket (context ROOT) and of words after a heavy context, distinct per chunk."""
    share = chunks.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Deal(*share.value)

        def asked(chunk: Chunk) -> list[pa.RecordBatch]:
            codes, words, _, heavy, bucket = deal.tokens(chunk)
            rare, out = ~deal.codes.frequent(codes), []
            order, edges = _runs(bucket, deal.buckets)
            # Whole buckets, so that what is distinct in a slice is so in the chunk.
            cuts = np.unique(np.append(edges[np.searchsorted(edges, np.arange(0, len(order), GROUP))], len(order)))
            for cut in map(slice, cuts[:-1].tolist(), cuts[1:].tolist()):
                for state in (None, *heavy):
                    here = order[cut]
                    here = here[rare[words[here]] if state is None else state[here] >= 0]
                    target = bucket[here].astype(np.int64) << 32 | (ROOT if state is None else state[here])
                    target, which = _numbered(target)
                    pairs = np.sort(which << 32 | words[here])
                    pairs = pairs[_firsts(pairs)]
                    target = target[pairs >> 32]
                    out.append((codes[pairs & 0xFFFFFFFF], (target & 0xFFFFFFFF).astype(np.int32), (target >> 32).astype(np.int32)))
            del heavy, bucket, order
            word, context, bucket = map(np.concatenate, zip(*out, strict=True))
            del out
            part = _share(context, deal.codes.hash(word), deal.shares)
            order = np.lexsort((bucket, word, context, part))
            edges = np.searchsorted(part[order], np.arange(deal.shares + 1))
            cuts = [(c, order[edges[c] : edges[c + 1]]) for c in np.flatnonzero(np.diff(edges)).tolist()]
            return _packed_rows([(c, [np.diff(word[at], prepend=0), context[at], bucket[at]]) for c, at in cuts], "share").to_batches() if cuts else []

        yield from chain.from_iterable(map(asked, _chunks(batches)))

    return chunks.select(*CHUNK).mapInArrow(run, PACKED.format("share"))


def _share(context, h, shares: int):
    """The task in which a word after a context is looked up; of arrays or of columns."""
    if isinstance(h, np.ndarray):
        return ((h >> 20) + context) % shares
    return F.pmod(F.shiftright(h, 20) + context, F.lit(shares)).cast("long")


def told_facts(wanted: DataFrame, facts: DataFrame, given: tuple) -> DataFrame:
    """(bucket, size, packed): code, context and n of the ``facts`` (context, h, n) that each bucket wants."""
    share = wanted.sparkSession.sparkContext.broadcast(given)

    def run(asked: pa.Table, facts: pa.Table) -> pa.Table:
        codes = Codes(*share.value[0])
        word, context, bucket = _unpacked_rows(asked, differences=0, width=3)
        distinct, word_no = _numbered(word)
        place = find(distinct, codes.of(facts["h"].to_numpy()))
        known = np.flatnonzero(place >= 0)
        keys, n = facts["context"].to_numpy()[known].astype(np.int64) << 32 | place[known], facts["n"].to_numpy()[known]
        order = np.argsort(keys)
        at = find(keys[order], context << 32 | word_no)
        found = np.flatnonzero(at >= 0)
        # Once for each bucket.
        bucket, at = bucket[found], at[found]
        pairs = np.unique(bucket << 32 | at)
        bucket, at = pairs >> 32, order[pairs & 0xFFFFFFFF]
        columns = [distinct[keys[at] & 0xFFFFFFFF], keys[at] >> 32, n[at]]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(bucket), 1), bool), bucket[1:] != bucket[:-1]]))
        cuts = [(int(bucket[i]), slice(i, j)) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=len(first) > 0)]
        return _packed_rows([(b, [np.diff(columns[0][cut], prepend=0), *(x[cut] for x in columns[1:])]) for b, cut in cuts], "bucket")

    shares = Deal(*given).shares
    facts = facts.withColumn("share", _share(F.col("context"), F.col("h"), shares))
    return wanted.groupBy("share").cogroup(facts.groupBy("share")).applyInArrow(run, PACKED.format("bucket"))


def words_after_heavy(chunks: DataFrame, given: tuple) -> DataFrame:
    """(context, h, n): how often a word follows a heavy context in the training texts. Chunks count first; their sums shuffle packed."""
    share = chunks.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Deal(*share.value)

        def counted(chunk: Chunk) -> list[pa.RecordBatch]:
            codes, words, _, heavy, _ = deal.tokens(chunk)
            learned, found = chunk.learned(), []
            for state in heavy:
                here = np.flatnonzero((state >= 0) & learned)
                pairs, n = np.unique(state[here].astype(np.int64) << 32 | words[here], return_counts=True)
                found.append((pairs >> 32, codes[pairs & 0xFFFFFFFF], n))
            context, word, n = map(np.concatenate, zip(*found, strict=True))
            part = _share(context, deal.codes.hash(word), deal.shares)
            order = np.lexsort((word, context, part))
            edges = np.searchsorted(part[order], np.arange(deal.shares + 1))
            cuts = [(c, order[edges[c] : edges[c + 1]]) for c in np.flatnonzero(np.diff(edges)).tolist()]
            return _packed_rows([(c, [np.diff(word[at], prepend=0), context[at], n[at]]) for c, at in cuts], "share").to_batches() if cuts else []

        yield from chain.from_iterable(map(counted, _chunks(batches)))

    def add(table: pa.Table) -> pa.Table:
        codes = Codes(*share.value[0])
        word, context, n = _sums(*_unpacked_rows(table, differences=0))
        return pa.Table.from_arrays([pa.array(context, pa.int32()), pa.array(codes.hash(word)), pa.array(n)], ["context", "h", "n"])

    packed_ = chunks.select(*CHUNK).mapInArrow(run, PACKED.format("share"))
    return packed_.groupBy("share").applyInArrow(add, "context int, h long, n long")


def heavy_states(facts: DataFrame, counts: DataFrame, tree: SuffixTree, least: int, min_divergence: float) -> tuple[np.ndarray, ...]:
    """By the number of a heavy context (ROOT first): its size, what it leaves to its parent, the parent's number, and whether it diverges enough.

    ``facts`` are (context, h, n) of the contexts but ROOT, words seen ``least`` times; ``counts`` (h, n) has the words seen as often.
    """
    spark, keys = facts.sparkSession, [x.keys for x in tree.levels]
    sizes = np.concatenate([[0], tree.counts, *(x.counts for x in tree.levels)])
    first = np.cumsum([ROOT + 1, len(tree.hashes), *map(len, keys)])
    parents = np.zeros(len(sizes), np.int64)
    for d, level in enumerate(keys):
        # A context's parent drops its first word.
        parents[first[d + 1] : first[d + 2]] = first[d] + _place(_symbols(level, keys[:d])[1:], keys[:d])
    given = np.zeros(len(sizes))
    for r in facts.groupBy("context").agg(F.sum(F.col("n") - 1).alias("n")).toPandas().itertuples():
        given[r.context] = r.n
    rest = 1 - given / np.maximum(sizes, 1)
    known = spark.createDataFrame(
        list(zip(range(len(sizes)), parents.tolist(), sizes.tolist(), rest.tolist(), strict=True)), "context int, parent int, size long, rest double"
    )
    facts = facts.join(F.broadcast(known), "context")
    before = counts.select(F.lit(ROOT).alias("parent"), "h", ((F.col("n") + 1) / (tree.total + tree.distinct + 1)).alias("q"))
    diverges = np.zeros(len(sizes), bool)
    for d in range(len(first) - 1):
        here = facts.where(F.col("context").between(int(first[d]), int(first[d + 1]) - 1)).join(before, ["parent", "h"])
        here = here.withColumn("p", (F.col("n") - 1) / F.col("size") + F.col("rest") * F.col("q"))
        here = stored(here.select("context", "h", "n", "p", "q"), "tree-heavy")
        sums = here.groupBy("context").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("q"))).alias("inside"), F.sum("n").alias("n"))
        inside, seen = np.zeros(len(sizes)), np.zeros(len(sizes))
        for r in sums.toPandas().itertuples():
            inside[r.context], seen[r.context] = r.inside, r.n
        at = slice(first[d], first[d + 1])
        diverges[at] = (inside[at] + (sizes[at] - seen[at]) * np.log(rest[at])) / sizes[at] >= min_divergence
        before = here.select(F.col("context").alias("parent"), "h", F.col("p").alias("q"))
    return sizes, rest, parents, diverges


def _symbols(keys: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
    """The words of keys of the level after ``levels``, first to last: a context is a place in the level before, at depth one a word."""
    out = [keys & 0xFFFFFFFF]
    state = keys >> 32
    for level in reversed(levels):
        here = level[state]
        out.insert(0, here & 0xFFFFFFFF)
        state = here >> 32
    out.insert(0, state)
    return out


def context_scores(tokens_: DataFrame, facts: DataFrame, given: tuple, model: tuple) -> DataFrame:
    """(chunk, size, packed): columns pos, needs, part, logs, seen of what contexts add to the scores of a chunk's documents, and the logarithms of one more than the
    counts of their rare words (``seen`` words with any), in multiples of 2^-40.

    A part that holds only if a heavy context is retained ``needs`` it (else ROOT). Rows of ``NOBODY`` name heavy contexts that longer ones retain; their chunks are negative.
    """
    share = tokens_.sparkSession.sparkContext.broadcast((given, model))

    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        given, (sizes, rest_of, diverges, total, distinct, least, min_divergence) = share.value
        deal = Deal(*given)
        size, packed = dealt["size"].to_pylist(), dealt["words"].to_pylist()
        chunks = np.unique(np.append(dealt["chunk"].to_numpy(), -1 - dealt["bucket"][0].as_py() % SHARES))
        docs = np.concatenate([np.empty(0, np.int64), *(np.cumsum(_unpack(x, n)) for x, n in zip(dealt["doc"].to_pylist(), size, strict=True))])
        words, *context = (
            np.concatenate([np.empty(0, np.int64), *(_unpack(x[i], n) for x, n in zip(packed, size, strict=True))]) for i in range(deal.depth)
        )
        last = zip(dealt["last"].to_pylist(), dealt["n_last"].to_pylist(), size, strict=True)
        context.insert(0, np.concatenate([np.empty(0, np.int64), *(np.cumsum(_unpack(x[0], n))[_unpack(x[1], m, np.int32)] for x, n, m in last)]))
        del packed, last
        codes, context = map(list, zip(*((codes, x.astype(np.int32)) for codes, x in map(_numbered, _taken(context))), strict=True))
        distinct_words, word = _numbered(words)
        word = word.astype(np.int32)
        del words
        places = [deal.places(c) for c in codes]

        # Facts by context and word.
        code, fact, fact_n = _unpacked_rows(answers, differences=0, width=3)
        fact = fact << 32 | find(distinct_words, code)
        order = np.argsort(fact)
        fact, fact_n = fact[order], fact_n[order]

        def told(contexts: np.ndarray, word: np.ndarray, missing: np.ndarray | int = 0) -> np.ndarray:
            at = find(fact, contexts.astype(np.int64) << 32 | word)
            return np.where(at >= 0, fact_n[at], missing) if len(fact_n) else np.zeros(len(word), np.int64) + missing

        rare = ~deal.codes.frequent(distinct_words)
        # A rare word without a fact has no other token than this one.
        alone = np.zeros(len(distinct_words), np.int64)
        alone[word] = docs & 1
        count = np.where(rare, told(np.full(len(distinct_words), ROOT), np.arange(len(distinct_words)), alone), deal.codes.count(distinct_words))
        logs = np.where(rare, np.rint(np.log10(count + 1) * UNIT).astype(np.int64), 0)
        del code, alone, rare

        def scored(docs: np.ndarray, word: np.ndarray, context: list[np.ndarray]) -> list[np.ndarray]:
            """Columns pos, needs, part, logs of some tokens, all of each light context among them. Contexts are numbers of words, as ``codes`` has them."""
            heavy = deal.heavy_contexts([p[c] for p, c in zip(places, context, strict=True)])
            train, state, levels = docs & 1 == 1, np.zeros(len(word), np.int32), []
            before, live = ((count + 1) / (total + distinct + 1))[word], (count >= least)[word]
            for d in range(deal.depth):
                one, state = _classes(state.astype(np.int64) << 32 | context[d])
                seen_before = np.bincount(state[train], minlength=len(one))
                number = heavy[d][one]
                light = (number < 0) & (codes[d][context[d][one]] != NONE) & (seen_before >= least)
                context[d] = heavy[d] = None
                # A word that is rare after the shorter context is rare here.
                live = np.flatnonzero(live & (light | (number >= 0))[state])
                keys = state[live].astype(np.int64) << 32 | word[live]
                first, key = _classes(keys)
                keys, first, seen_before = keys[first], live[first], np.maximum(seen_before, 1)
                states, n = keys >> 32, np.bincount(key[train[live]], minlength=len(keys))
                far = np.flatnonzero(number[states] >= 0)
                n[far] = 0
                counted = n >= least
                shares = np.where(counted, (n - 1) / seen_before[states], 0.0)
                rest = 1 - np.bincount(states, weights=shares, minlength=len(one))
                gain = divergence(keys[counted], n[counted], seen_before, shares[counted], rest, before[first][counted])
                # Of a heavy context only some tokens are here; the facts have them all.
                n[far] = told(number[states[far]], word[first[far]])
                shares[far] = np.where(n[far] >= least, (n[far] - 1) / sizes[number[states[far]]], 0.0)
                rest = np.where(number >= 0, rest_of[np.maximum(number, 0)], rest)
                after = np.where((light | (number >= 0))[state], rest[state] * before, before)
                after[live] += shares[key]
                known, live = live, np.zeros(len(word), bool)
                live[known] = (n >= least)[key]
                levels.append((state, number, light & (gain >= min_divergence), np.rint(np.log10(after / before) * UNIT).astype(np.int64)))
                before = after
            del before, after, keys, key, first, states, n, shares, known, live, train
            out = []
            sure, longer = np.zeros(len(word), np.int64), np.zeros(len(word), bool)
            while levels:
                state, number, kept, part = levels.pop()
                kept[state[longer]] = True
                told_by = np.unique(number[state[longer]])
                told_by = told_by[told_by >= 0]
                nothing = np.zeros(len(told_by), np.int64)
                out.append((nothing + NOBODY, told_by, nothing, nothing))
                far = number[state]
                known = kept[state] & (far < 0) | (far >= 0) & diverges[np.maximum(far, 0)]
                sure += np.where(known, part, 0)
                open_ = np.flatnonzero((far >= 0) & ~known & (part != 0))
                out.append((docs[open_] >> 1, far[open_], part[open_], np.zeros(len(open_), np.int64)))
                longer = kept[state] & (far < 0)
            own = logs[word]
            some = np.flatnonzero((sure != 0) | (own != 0))
            out.append((docs[some] >> 1, np.full(len(some), ROOT), sure[some], own[some]))
            return [np.concatenate(x) for x in _taken(list(zip(*out, strict=True)))]

        def seen(pos: np.ndarray, needs: np.ndarray, part: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
            return _sums(pos, needs.astype(np.int32), part, own, (own != 0).astype(np.int32))

        groups = max(1, -(-len(word) // GROUP))
        group = np.empty(len(word), np.uint16 if groups <= 1 << 16 else np.int64)
        for at in _slices(len(word)):
            near = [c[at] for c in context]
            heavy = deal.heavy_contexts([p[c] for p, c in zip(places, near, strict=True)])
            key = deal.keys(distinct_words[word[at]], [c[x] for c, x in zip(codes, near, strict=True)], heavy)
            group[at] = (key & np.uint64(0xFFFFFFFF)) % np.uint64(groups)
        del near, heavy, key
        order, edges = _runs(group, groups)
        del group
        out = [[np.empty(0, np.int64) for _ in range(5)]]
        for at in (order[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            out.append(seen(*scored(docs[at], word[at], [c[at] for c in context])))
        del docs, word, context, order, at
        columns = list(zip(*out, strict=True))
        del out
        sums = _sums(*[np.concatenate(x) for x in _taken(columns)])
        # Documents are numbered on from their chunk's number.
        edges = np.append(np.searchsorted(sums[0], chunks), len(sums[0]))
        cuts = [(c, slice(edges[i], edges[i + 1])) for i, c in enumerate(chunks.tolist()) if edges[i + 1] > edges[i]]
        return _packed_rows([(c, [np.diff(sums[0][at], prepend=0), *(x[at] for x in sums[1:])]) for c, at in cuts], "chunk")

    return tokens_.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(run, PACKED.format("chunk"))


def sums_by_document(packed_: DataFrame) -> DataFrame:
    """(pos, needs, part, logs, seen): the packed sums of all tasks added up."""

    def add(table: pa.Table) -> pa.Table:
        out = _sums(*_unpacked_rows(table, differences=0))
        return pa.Table.from_arrays([pa.array(x).cast(t) for x, t in zip(out, types.types, strict=True)], types.names)

    schema = T.StructType.fromDDL("pos long, needs int, part long, logs long, seen long")
    types = to_arrow_schema(schema)
    return packed_.groupBy("chunk").applyInArrow(add, schema)


def _sums(pos: np.ndarray, needs: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs of the first two columns (documents and needed contexts), in order, with the sums of the others."""
    order = np.lexsort((needs, pos))
    pos, needs = pos[order], needs[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(pos), 1), bool), (pos[1:] != pos[:-1]) | (needs[1:] != needs[:-1])]))
    return [pos[first], needs[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in values)]


def context_parts(
    chunks: DataFrame, n_tokens: int, counts: DataFrame, frequent: tuple, tree: SuffixTree, depth: int, least: int, min_divergence: float
) -> DataFrame:
    """(pos, part, logs, seen): what the retained contexts and the counts of rare words add to the scores of the documents in the chunks, as ``context_scores`` has it."""
    given = (frequent, (tree.hashes, [x.keys for x in tree.levels]), depth, max(1, -(-n_tokens // BUCKET)))
    # A rare word that was seen once in all tells its count itself.
    facts = counts.where(F.col("seen") > 1).select(F.lit(ROOT).alias("context"), "h", "n")
    if len(tree.hashes):
        after = stored(words_after_heavy(chunks, given).where(F.col("n") >= least), "tree-facts")
        sizes, rest, parents, diverges = heavy_states(after, counts.where(F.col("n") >= least), tree, least, min_divergence)
        facts = facts.union(after)
    else:
        sizes, rest, parents, diverges = np.zeros(1, np.int64), np.ones(1), np.zeros(1, np.int64), np.zeros(1, bool)

    def with_parents(numbers) -> set[int]:
        kept = set()
        for c in numbers:
            while c != ROOT and c not in kept:
                kept.add(c)
                c = int(parents[c])
        return kept

    for c in with_parents(np.flatnonzero(diverges).tolist()):
        diverges[c] = True
    wanted = told_facts(wanted_facts(chunks, given), facts, given)
    model = (sizes, rest, diverges, tree.total, tree.distinct, least, min_divergence)
    parts = stored(sums_by_document(context_scores(dealt_tokens(chunks, given), wanted, given, model)), "tree-parts")
    told = [r["needs"] for r in parts.where(F.col("pos") == NOBODY).select("needs").distinct().collect()]
    kept = chunks.sparkSession.createDataFrame([(c,) for c in sorted({ROOT, *with_parents(told)})], "needs int")
    return parts.where(F.col("pos") != NOBODY).join(F.broadcast(kept), "needs").groupBy("pos").agg(*(F.sum(c).alias(c) for c in ("part", "logs", "seen")))


def lm_scores(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    carry: list[str] | None = None,
    depth: int = DEPTH,
    max_states: int | None = None,
    min_divergence: float = MIN_DIVERGENCE,
    folds: int = FOLDS,
    held: int = HELD,
) -> DataFrame:
    """Every row with held_out, n_tokens, n_known, train_tokens, base_score (single words, one added to each count) and score (the tree's), both log10.

    Rows whose key's CRC-32 (null: of the empty text) modulo ``folds`` is ``held`` are scored but not learned from. A null or empty text is the end token alone.
    Repeated rows are learned from and scored each. With nothing to learn from every probability is that of an unseen word. An empty table gives
    no rows. Texts are read whole, of any length. Input columns named like a result column give way to it.

    With ``max_states`` a context, and a word after it, counts only with a share of ``1 / max_states`` of the training tokens; without, whenever it was seen twice.
    """
    held_out = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(packed(docs, carry), held_out.alias("held_out"), F.col(text).alias("text"))
    chunks = stored(chunked_texts(rows), "tree-codes")
    tree, words = fit_chunks(chunks, depth)
    least = 2 if max_states is None else max(2, -(-tree.total // max_states))
    frequent = frequent_words(words.where(F.col("n") > 0), HEAVY)
    n_tokens = chunks.select(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()[0]
    parts = context_parts(chunks, n_tokens, words, frequent, tree, depth, least, min_divergence)
    rows = documents_of(chunks, frequent, tree.total, tree.distinct)
    zero = F.lit(0).cast("long")
    base = F.col("base") + F.coalesce("logs", zero) / UNIT - (F.col("n_tokens") - F.col("known")) * float(np.log10(tree.total + tree.distinct + 1))
    scored = rows.select("row", "held_out", "n_tokens", "known", "base", "pos").join(parts, "pos", "left")
    out = scored.select(
        "row", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", zero)).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.coalesce("part", zero) / UNIT).alias("score"),
    )
    return unpacked(out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_suffix_tree")
def op11_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(documents(spark, folder), carry=["doc_id"])
