"""Token files: every text as ids, in the order of the keys, compressed in blocks that can be read each for itself.

A file is what one task of the sorted table wrote. Its rows are segments of whole documents: their keys and lengths, and the segment's ids
in blocks of a fixed number, coded by ``range_coder``. The rows are kept as Parquet, so that the writer's commit protocol holds when an executor is lost.
Where a document starts in the stream follows from the lengths alone.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seatward.llm.bpe import Bpe, vocabulary
from seatward.llm.common import documents, query, stored, worker_cache
from seatward.llm.range_coder import BLOCK, LANES, decode, encode
from seatward.llm.texts import PIECE

END = 1
# Ids of a segment, at least, if there are so many; words remembered per worker in one generation.
SEGMENT = 64 * BLOCK
CACHE_WORDS = 500_000


class LibraryIds:
    """Ids as the ``tokenizers`` library gives them, without special tokens added.

    The library splits at blanks before it merges, so words are encoded once and remembered. A word that would be normalised twice, or
    could be taken for a special token, sends its whole text through the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, word: str) -> bool:
        fixed = word.isascii() or (word == word.lower() and unicodedata.is_normalized("NFC", word))
        return fixed and not any(s in word for s in self.special)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [None if t and any(s in t for s in self.special) else Bpe.words(t or "") for t in texts]
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        words: set[str] = set().union(*(part for part in split if part is not None))
        words.difference_update(self.young.keys())
        self.young.update((w, self.old[w]) for w in words if w in self.old)
        new = [w for w in words if w not in self.old]
        odd = {w for w in new if not self._plain(w)}
        new = [w for w in new if w not in odd]
        found = {w: _bytes(e.ids) for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        long = {w: ids for w, ids in found.items() if len(w) > 64}
        self.young.update(found)
        out = []
        for text, part in zip(texts, split, strict=True):
            if part is None or (odd and not odd.isdisjoint(part)):
                ids = _bytes(self.library.encode(text, add_special_tokens=False).ids)
            else:
                ids = b"".join(map(self.young.__getitem__, part))
            out.append(np.frombuffer(ids, "<u2"))
        # Only ordinary words are worth remembering.
        for w in long:
            del self.young[w]
        return out


def _bytes(ids: list[int]) -> bytes:
    """Ids as 16-bit numbers; larger ones raise ``OverflowError``."""
    return array("H", ids).tobytes()


def _loaded(path: str) -> LibraryIds:
    cache = worker_cache("library_ids")
    if path not in cache:
        cache[path] = LibraryIds(path)
    return cache[path]


FILE_SCHEMA = "part int, seq int, keys array<bigint>, lengths array<bigint>, n_tokens bigint, blocks array<binary>"


def write_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored token files of ``docs``, whose keys are whole numbers.

    Every document ends with id 1; null and empty texts have only that. Null keys come first; rows that tie on the key are ordered by a hash of
    their text. Many rows of one key are spread over tasks by that hash.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("h")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        library, keys, parts, size = _loaded(path), [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                encoded = library.encode(piece.column(1).to_pylist())
                for k, ids in zip(piece.column(0).to_pylist(), encoded, strict=True):
                    keys.append(k)
                    parts.append(np.append(ids, np.uint16(END)))
                    size += len(ids) + 1
                    if size >= SEGMENT:
                        yield keys, parts
                        keys, parts, size = [], [], 0
        if keys:
            yield keys, parts

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held, cut, lanes = [], [], 0

        def flush():
            nonlocal seq
            coded = iter(encode([b for blocks in cut for b in blocks]))
            rows = []
            for (keys, lengths), blocks in zip(held, cut, strict=True):
                rows.append((part, seq, keys, lengths, sum(lengths), [next(coded) for _ in blocks]))
                seq += 1
            columns = zip(*rows, strict=True)
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["part", "seq", "keys", "lengths", "n_tokens", "blocks"]
            )

        for keys, parts in segments(batches):
            ids = np.concatenate(parts)
            held.append((keys, [len(p) for p in parts]))
            cut.append([ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)])
            lanes += len(cut[-1])
            if lanes >= LANES:
                yield flush()
                held, cut, lanes = [], [], 0
        if held:
            yield flush()

    return stored(ordered.mapInArrow(write, FILE_SCHEMA), "tokens")


def _documents(batches) -> Iterator[tuple[int, int, int, int | None, np.ndarray]]:
    """(part, seq, place in the segment, key, ids) of every document, many blocks decoded together."""

    def flush(rows):
        decoded = iter(decode([b for r in rows for b in r["blocks"]]))
        for r in rows:
            ids = np.concatenate([next(decoded) for _ in r["blocks"]])
            at = 0
            for key, length in zip(r["keys"], r["lengths"], strict=True):
                yield r["part"], r["seq"], at, key, ids[at : at + length]
                at += length

    held, lanes = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            held.append(row)
            lanes += len(row["blocks"])
            if lanes >= LANES:
                yield from flush(held)
                held, lanes = [], 0
    if held:
        yield from flush(held)


def _in_pieces(rows, names: list[str], types: list[pa.DataType], most: int):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document in the files, the end id included. A block that does not fit its checksum fails the read."""

    def read(batches):
        found = ((key, ids) for _, _, _, key, ids in _documents(batches))
        yield from _in_pieces(found, ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())], PIECE)

    return files.mapInArrow(read, "doc_id bigint, ids array<int>")


def token_digests(files: DataFrame) -> DataFrame:
    """Per document, from the decoded files: doc_id, ``start`` in the whole stream, ``n_tokens`` and ``ids_crc32``.

    Starts are the sums of files before, of segments before in the file, and the place in the segment; no window holds more than the
    segments of one file, or the list of files.
    """

    def read(batches):
        found = ((p, s, at, key, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for p, s, at, key, ids in _documents(batches))
        names = ["part", "seq", "place", "doc_id", "n_tokens", "ids_crc32"]
        yield from _in_pieces(found, names, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], 1 << 14)

    segments = files.select("part", "seq", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("ahead", before(Window.orderBy("part"))).drop("n_tokens")
    bases = (
        segments.withColumn("inside", before(Window.partitionBy("part").orderBy("seq")))
        .join(parts, "part")
        .select("part", "seq", (F.col("ahead") + F.col("inside")).alias("base"))
    )
    docs = files.mapInArrow(read, "part int, seq int, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(write_tokens(documents(spark, folder), vocabulary()))
