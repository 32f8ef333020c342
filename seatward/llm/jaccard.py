"""Near duplicates by Jaccard similarity of word shingles: a size-aware join, exact, and the components of its links.

Equal sets are one vertex. Small sets are joined by enumeration: both sides of a link with sizes n and m share a subset of
exactly the overlap they need, so all subsets of that fixed size are keys, and sharing a key is the proof. Large sets scan inverted
lists: tokens are ordered rare first by counters over the whole table, and of a set only the leading tokens are listed that a
link's first common token can be (with the largest partner each still allows). The size up to which sets are enumerated is the one
with the lowest estimated number of rows.

Lists may be long where many documents are near copies, so pairs are not enumerated within them. First every set of a list is compared with the
list's most common set; then only sets that are still in different components are paired. Before sets are compared, parity bitmaps (a
lower bound of the difference) sort out pairs that cannot link. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, stored, unpacked
from seatward.llm.components import components
from seatward.llm.texts import PIECE

WORDS = 5
# Counters that order the tokens: about 64 a row, 2^26 bytes at most whatever the input. Coarser counters lengthen lists only.
COUNTERS_A_ROW, MAX_COUNTER_BITS = 64, 26
CHUNK = 1 << 16
# Largest set size that may be enumerated; rows that a listed token is worth, with its share of comparisons.
MAX_SMALL, LIST_COST = 10, 4.0
# Bits of the filter for sets that have to be compared: 2 MB whatever the input.
NEEDED_BITS = 24
# Sets of one component that are compared with as many others at once, and their tokens; tokens looked at together. Base of the size classes: above 4/3,
# so that sets that link are in the same class or in neighbouring ones.
BLOCK_SETS, BLOCK_TOKENS, COLUMNS, CLASS_BASE = 128, 1 << 20, 4096, 1.34

# Positions of 8 bytes up to which a list of rows is broadcast.
MAX_BROADCAST_ROWS = 2_000_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def needed(n: int, m: int) -> int:
    """Least overlap at which sets of these sizes have a similarity of 0.75."""
    return -(-3 * (n + m) // 7)


def partners(n: int) -> range:
    """Sizes a set of size n can link with."""
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles, A-Z in lower case; a shorter text is one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - WORDS + 1
    h = w[:last].copy()
    for j in range(1, WORDS):
        h = (h ^ (h >> np.uint64(31))) * _M1 + w[j : last + j]
    h = (h ^ (h >> np.uint64(33))) * _M2
    return np.unique(h ^ (h >> np.uint64(29)))


def vertex(tokens: np.ndarray) -> int:
    """64 bits of a digest of the whole set, as a signed number."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(tokens: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens has i as the low bits of its hash. Two bitmaps differ in at most as many bits as their sets in tokens."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    at = ((tokens >> np.uint64(16)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def can_link(n: int, bits_n: bytes, m: int, bits_m: bytes) -> bool:
    a, b = sorted((bits_n, bits_m), key=len)
    small, large, width = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
    while width > len(a) * 8:
        width //= 2
        large = (large >> width) ^ (large & ((1 << width) - 1))
    return (small ^ large).bit_count() <= n + m - 2 * needed(n, m)


def subset_keys(tokens: np.ndarray, most: int) -> list[int]:
    """Keys of a small set: for each partner size up to ``most``, all its subsets of the overlap needed; even where the set is the smaller."""
    n, out = len(tokens), []
    own = tokens.tolist()
    for m in partners(n):
        if m > most:
            continue
        low, high = min(n, m), max(n, m)
        head = bytes((low, high))
        for part in combinations(own, needed(low, high)):
            digest = xxhash.xxh3_64_intdigest(head + np.array(part, np.uint64).tobytes())
            out.append(((digest >> 1) << 1 | (n != low)) - (1 << 63))
    return out


def listed(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of a set that go to the lists, the largest partner each allows, and how rare the set's tokens are."""
    n = len(tokens)
    bucket = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)]
    length = n - -(-3 * n // 4) + 1
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8)), kind="stable")[:length]
    tops = 7 * (n - np.arange(length)) // 3 - n
    return tokens[order].view(np.int64), tops, int(100 * (64 - bucket.mean()))


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def count_tokens(texts: DataFrame, bits: int) -> tuple[np.ndarray, dict[int, int]]:
    """Logarithms of the tokens' counters over all texts, and how many sets have each small size.

    Each task sums its own counters and hands on compressed chunks; they are added in two steps, so no task gets the chunks of all tasks.
    The driver gets 2^bits bytes.
    """
    size = 1 << bits
    chunk = min(CHUNK, size)

    def local(batches):
        counts, sizes = np.zeros(size, np.int64), np.zeros(MAX_SMALL * 2, np.int64)
        for piece in _pieces(batches):
            for text in piece.column(0).to_pylist():
                tokens = shingles(text)
                np.add.at(counts, (tokens & np.uint64(size - 1)).astype(np.int64), 1)
                if 0 < len(tokens) < len(sizes):
                    sizes[len(tokens)] += 1
        parts = [(-1, sizes)] + [(i, counts[i * chunk : (i + 1) * chunk]) for i in range(size // chunk)]
        parts = [(i, zlib.compress(c.tobytes(), 1)) for i, c in parts if c.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["chunk", "counts"])

    def add(keys, group):
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["counts"])
        return pd.DataFrame({"chunk": [keys[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "chunk int, counts binary"
    parts = stored(texts.mapInArrow(local, schema).withColumn("part", F.spark_partition_id()), "shingle-counts")
    width = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    once = parts.withColumn("salt", F.pmod("part", F.lit(width))).groupBy("chunk", "salt").applyInPandas(add, schema)
    twice = once.groupBy("chunk").applyInPandas(add, schema)
    logs, sizes = np.zeros(size, np.uint8), {}
    # At most 2^bits counters in chunks, compressed.
    for row in twice.toLocalIterator():
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.int64)
        if row["chunk"] < 0:
            sizes = {n: int(c) for n, c in enumerate(counts) if c}
        else:
            logs[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.ceil(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return logs, sizes


def boundary(sizes: dict[int, int]) -> int:
    """The largest size to enumerate: where the estimated rows of both sides are fewest."""

    def rows(most: int) -> float:
        keys = sum(c * sum(comb(n, needed(min(n, m), max(n, m))) for m in partners(n) if m <= most) for n, c in sizes.items() if n <= most)
        lists = sum(c * (n - -(-3 * n // 4) + 1) for n, c in sizes.items() if 4 * n >= 3 * (most + 1))
        return keys + LIST_COST * lists

    return min(range(MAX_SMALL + 1), key=lambda most: (rows(most), -most))


SET_SCHEMA = "vertex long, n long, rare int, bits binary, tokens array<long>, tops array<int>, keys array<long>"


def describe(rows: DataFrame, counts, small: int) -> DataFrame:
    """``rows`` (last column ``text``) with the columns of ``SET_SCHEMA`` for it. Of equal sets in a task only the first has lists and keys."""
    kept = rows.columns[:-1]
    names = [*kept, *(f.split()[0] for f in SET_SCHEMA.split(", "))]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        seen: set[int] = set()
        logs = counts.value
        for piece in _pieces(batches):
            out = []
            for text in piece.column(piece.num_columns - 1).to_pylist():
                tokens = shingles(text)
                n = len(tokens)
                if n == 0:
                    out.append((None, 0, None, None, None, None, None))
                    continue
                v = vertex(tokens)
                if v in seen:
                    out.append((v, n, None, None, None, None, None))
                    continue
                seen.add(v)
                first, tops, rare = listed(tokens, logs) if 4 * n >= 3 * (small + 1) else (None, None, 0)
                keys = subset_keys(tokens, small) if n <= small else None
                out.append((v, n, rare, parity(tokens), first, tops, keys))
            columns = list(zip(*out, strict=True)) if out else [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(i) for i in range(len(kept))] + arrays, names)

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, ", ".join(x for x in (plain, SET_SCHEMA) if x))


LIST_SCHEMA = "token long, vertex long, n long, top int, hub long, hub_n long, hub_top int"


def shared_lists(postings: DataFrame) -> DataFrame:
    """Lists with two vertices or more; each row with the list's hub, its first row. Reads sorted rows once and keeps one of them."""

    def run(batches):
        held = None  # token, vertex, n, top of the open list's hub, whether it is out, last vertex
        for batch in batches:
            if not batch.num_rows:
                continue
            token, v, n, top = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.empty(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = held is None or held[0] != token[0]
            fresh = np.ones(len(token), bool)
            fresh[1:] = new[1:] | (v[1:] != v[:-1])
            if not new[0]:
                fresh[0] = v[0] != held[5]
            first = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1 + (0 if new[0] else 1)
            # The open list's hub goes before the hubs of the lists that start here; typed, as an empty list would make floats.
            hubs = [held[:4]] if not new[0] else []
            hub_token, hub_v, hub_n, hub_top = (
                np.concatenate([np.array([h[k] for h in hubs], c.dtype), c[first]]) for k, c in enumerate((token, v, n, top))
            )
            other = fresh & (v != hub_v[run_of])
            joined = np.zeros(len(hub_v), bool)
            joined[run_of[other]] = True
            out_now = joined.copy()
            if hubs and held[4]:
                out_now[0] = False
            r = run_of[other]
            parts = [
                np.concatenate([hub_token[out_now], token[other]]), np.concatenate([hub_v[out_now], v[other]]),
                np.concatenate([hub_n[out_now], n[other]]), np.concatenate([hub_top[out_now], top[other]]),
                np.concatenate([hub_v[out_now], hub_v[r]]), np.concatenate([hub_n[out_now], hub_n[r]]), np.concatenate([hub_top[out_now], hub_top[r]]),
            ]
            is_out = bool(joined[-1]) or bool(hubs and len(hub_v) == 1 and held[4])
            held = (token[-1], hub_v[-1], hub_n[-1], hub_top[-1], is_out, v[-1])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types, strict=True)], [f.split()[0] for f in LIST_SCHEMA.split(", ")])

    ordered = postings.repartition("token").sortWithinPartitions("token", "rare", "vertex")
    return ordered.select("token", "vertex", "n", "top").mapInArrow(run, LIST_SCHEMA)


_FITS = "{a}_top >= {b}_n AND {b}_top >= {a}_n AND 4 * {a}_n >= 3 * {b}_n AND 4 * {b}_n >= 3 * {a}_n"


def token_sets(texts: DataFrame, wanted_vertices: DataFrame) -> DataFrame:
    """(v, tokens) of the vertices in ``wanted_vertices`` (v), and of a few more that share a bit with one."""
    # At most 2^NEEDED_BITS bits come to the driver and go to the tasks.
    size = 1 << NEEDED_BITS
    spots = wanted_vertices.select(F.pmod("v", F.lit(size)).alias("spot"))
    marks = spots.groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("marks"))
    wanted = np.zeros(size // 8 + 4096, np.uint8)
    for row in marks.toLocalIterator():
        # Bucket k holds the numbers from (k - 1) * 32768 + 1 on; bit 0 of a bitmap is its first number.
        piece = np.frombuffer(bytes(row["marks"]), np.uint8)
        start = (row["bucket"] - 1) * 4096 if row["bucket"] > 0 else None
        if start is None:
            start = size // 8
        wanted[start : start + 4096] |= piece
    share = texts.sparkSession.sparkContext.broadcast(wanted)

    def marked(v: int) -> bool:
        spot = v % size
        at = spot - 1 if spot > 0 else size
        return bool(share.value[at >> 3] >> (at & 7) & 1)

    def sets(batches):
        seen: set[int] = set()
        for piece in _pieces(batches):
            vs, out = [], []
            for text in piece.column(0).to_pylist():
                tokens = shingles(text)
                if len(tokens) and (v := vertex(tokens)) not in seen and marked(v):
                    seen.add(v)
                    vs.append(v)
                    out.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["v", "tokens"])

    return texts.mapInArrow(sets, "v long, tokens array<long>").dropDuplicates(["v"])


def verified(pairs: DataFrame, bitmaps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link. ``bitmaps`` has vertex, n, bits; ``texts`` the texts, for the sets of what the bitmaps let through."""
    left = bitmaps.select(F.col("vertex").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = bitmaps.select(F.col("vertex").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")

    def sift(batches):
        for batch in batches:
            keep = [can_link(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))

    open_pairs = stored(wide.mapInArrow(sift, "a long, b long, n_a long, n_b long"), "jaccard-pairs")
    full = token_sets(texts, open_pairs.select(F.explode(F.array("a", "b")).alias("v")))
    both = (
        open_pairs.join(full.select(F.col("v").alias("a"), F.col("tokens").alias("of_a")), "a")
        .join(full.select(F.col("v").alias("b"), F.col("tokens").alias("of_b")), "b")
        .withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    )
    return stored(both.where("7 * shared >= 3 * (n_a + n_b)").select("a", "b"), "jaccard-links")


def subset_links(sets: DataFrame) -> DataFrame:
    """Links of enumerated sets: who shares a key with a set of the smaller size links with it."""
    keys = sets.where("keys IS NOT NULL").select("vertex", F.explode("keys").alias("key"))
    keys = keys.select("vertex", F.shiftright("key", 1).alias("key"), (F.col("key").bitwiseAND(1) == 0).alias("smaller"))
    hubs = keys.groupBy("key").agg(F.min(F.when(F.col("smaller"), F.col("vertex"))).alias("hub"), F.min("vertex").alias("low"), F.max("vertex").alias("high"))
    return keys.join(hubs.where("hub IS NOT NULL AND low <> high"), "key").where("vertex <> hub").select(F.col("hub").alias("a"), F.col("vertex").alias("b")).distinct()


def jaccard_links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label): the components of all vertices that have a link. ``sets`` is the stored result of ``describe``."""
    postings = sets.where("tokens IS NOT NULL").select(
        F.explode(F.arrays_zip("tokens", "tops")).alias("x"), "vertex", "n", "rare"
    ).select(F.col("x.tokens").alias("token"), "vertex", "n", F.col("x.tops").alias("top"), "rare")
    lists = stored(shared_lists(postings), "jaccard-lists")
    bitmaps = sets.where("bits IS NOT NULL").groupBy("vertex").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))

    star = lists.where("vertex <> hub").withColumnsRenamed({"n": "b_n", "top": "b_top", "hub_n": "a_n", "hub_top": "a_top"})
    tried = stored(
        star.where(_FITS.format(a="a", b="b")).select(F.least("hub", "vertex").alias("a"), F.greatest("hub", "vertex").alias("b")).distinct(), "jaccard-star"
    )
    links = verified(tried, bitmaps, texts).unionByName(subset_links(sets))
    links = stored(links, "jaccard-links")
    found = components(links)

    # What is left: lists that still hold several components.
    named = lists.join(found, lists["vertex"] == found["node"], "left").select(
        "token", "vertex", "n", "top", F.coalesce("label", "vertex").alias("label")
    )
    named = stored(named, "jaccard-named")
    open_lists = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rows = named.join(open_lists, "token")
    side = lambda s: rows.select("token", *(F.col(c).alias(f"{s}_{c}") for c in ("vertex", "n", "top", "label")))
    cross = side("a").join(side("b"), "token").where("a_vertex < b_vertex AND a_label <> b_label").where(_FITS.format(a="a", b="b"))
    pairs = cross.select(F.col("a_vertex").alias("a"), F.col("b_vertex").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(stored(pairs, "jaccard-cross"), bitmaps, texts)
    if more.isEmpty():
        return found
    return components(links.unionByName(more))


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (left, right))
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    at_a, at_b = (np.minimum(np.searchsorted(common, x), len(common) - 1) for x in (a, b))
    in_a, in_b = common[at_a] == a, common[at_b] == b
    at_a, of_a, at_b, of_b = at_a[in_a], of_a[in_a], at_b[in_b], of_b[in_b]
    for low in range(0, len(common), COLUMNS):
        sides = []
        for at, of, n in ((at_a, of_a, len(left)), (at_b, of_b, len(right))):
            here = (at >= low) & (at < low + COLUMNS)
            side = np.zeros((n, COLUMNS), np.float32)
            side[of[here], at[here] - low] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def set_links(vertices: DataFrame, found: DataFrame, texts: DataFrame, pairs: bool = False) -> DataFrame:
    """(vertex, linked): the rows whose other sets link with the vertex's; or with ``pairs`` the links (a, b) themselves.

    ``vertices`` has vertex, n, copies; ``found`` the components, within which all links are. Two sets alone in a component link. Larger components are cut by
    class of size into salted blocks; each two blocks whose classes are the same or neighbours meet in one group, so each pair of sets
    is compared once, and no rows are made for pairs unless they are asked for.
    """
    members = stored(found.join(vertices, found["node"] == vertices["vertex"]).select("label", "vertex", "n", "copies"), "jaccard-members")
    sizes = members.groupBy("label").agg(
        F.count(F.lit(1)).alias("k"), F.sum("copies").alias("all_copies"), F.min("vertex").alias("a"), F.max("vertex").alias("b")
    )
    sizes = stored(sizes, "jaccard-sizes")
    if pairs:
        two = sizes.where("k = 2").select("a", "b")
    else:
        two = members.join(sizes.where("k = 2"), "label").select("vertex", (F.col("all_copies") - F.col("copies")).alias("linked"))
    many = members.join(sizes.where("k > 2").select("label"), "label")
    many = stored(many.withColumn("class", F.floor(F.log(CLASS_BASE, "n"))), "jaccard-many")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / F.pow(F.lit(CLASS_BASE), F.col("class") + 1))))
    blocks = stored(many.groupBy("label", "class").agg(F.ceil(F.count(F.lit(1)) / F.first(room)).alias("nb")), "jaccard-blocks")
    near = blocks.select(
        "label", F.explode(F.expr("array(struct(class, nb AS own, 0L AS above, 0L AS below), struct(class - 1 AS class, 0L AS own, nb AS above, 0L AS below),"
                                  " struct(class + 1 AS class, 0L AS own, 0L AS above, nb AS below))")).alias("x"),
    ).groupBy("label", "x.class").agg(*(F.max(f"x.{c}").alias(c) for c in ("own", "above", "below"))).where("own > 0")
    near = stored(near, "jaccard-near")
    small = near.count() <= MAX_BROADCAST_ROWS // 10
    span = lambda n, to: f"IF({n} > 0, transform(sequence(0L, greatest({n}, 1L) - 1L), t -> {to}), array())"
    to = lambda low, i, high, j, first: f"struct({low} AS low, {i} AS i, {high} AS high, {j} AS j, {first} AS first)"
    placed = (
        many.join(F.broadcast(near) if small else near, ["label", "class"])
        .withColumn("salt", F.pmod(F.xxhash64("vertex"), "own"))
        .select(
            "label", "vertex", "copies",
            F.explode(F.expr(
                f"concat({span('own', to('class', 'least(salt, t)', 'class', 'greatest(salt, t)', 'salt <= t'))},"
                f" {span('above', to('class', 'salt', 'class + 1', 't', 'true'))}, {span('below', to('class - 1', 't', 'class', 'salt', 'false'))})"
            )).alias("x"),
        ).select("label", "x.*", "vertex", "copies")
    )

    def meet(group: pa.Table) -> pa.Table:
        first = np.array(group.column("first").to_pylist(), bool)
        same = group.column("low")[0] == group.column("high")[0] and group.column("i")[0] == group.column("j")[0]
        v, copies = (group.column(c).to_numpy() for c in ("vertex", "copies"))
        tokens = [np.asarray(t.values.to_numpy(zero_copy_only=False)) for t in group.column("tokens")]
        n = np.array([len(t) for t in tokens], np.int64)
        l, r = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
        if not len(l) or not len(r):
            links = np.zeros((len(l), len(r)), bool)
        else:
            links = 7 * shared_tokens([tokens[i] for i in l], [tokens[i] for i in r]) >= 3 * (n[l][:, None] + n[r][None, :])
        if same:
            np.fill_diagonal(links, False)
        if pairs:
            x, y = np.nonzero(np.triu(links) if same else links)
            a, b = v[l[x]], v[r[y]]
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
        counts = np.zeros(len(v), np.int64)
        counts[l] = links @ copies[r]
        if not same:
            counts[r] = links.T @ copies[l]
        return pa.table({"vertex": v, "linked": counts})

    full = token_sets(texts, many.select(F.col("vertex").alias("v")))
    groups = placed.join(full, placed["vertex"] == full["v"]).drop("v").groupBy("label", "low", "i", "high", "j")
    if pairs:
        return two.unionByName(groups.applyInArrow(meet, "a long, b long"))
    met = groups.applyInArrow(meet, "vertex long, linked long")
    return two.unionByName(met.groupBy("vertex").agg(F.sum("linked").alias("linked")))


def linked_sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(members, links): the vertex of every row with words (key, vertex), and all links (a, b) between distinct sets, a < b."""
    sets, _, found = _described(docs, text, key, [key])
    links = set_links(_vertices(sets), found, docs.select(F.col(text).alias("text")), pairs=True)
    return sets.where("n > 0").select("key", "vertex"), links


def _vertices(sets: DataFrame) -> DataFrame:
    return stored(sets.where("n > 0").groupBy("vertex").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "jaccard-vertices")


def _described(docs: DataFrame, text: str, key: str, carry: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored sets with row and key, (vertex, top) with the smallest key of each vertex's component, components of linked vertices)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    rows = docs.count()
    bits = min(MAX_COUNTER_BITS, max(12, (COUNTERS_A_ROW * max(rows, 1)).bit_length()))
    logs, sizes = count_tokens(texts, bits)
    counts = spark.sparkContext.broadcast(logs)
    # The key is evaluated here alone, and stored.
    keyed = docs.select(packed(docs, carry), F.col(key).alias("key"), F.col(text).alias("text"))
    sets = stored(describe(keyed, counts, boundary(sizes)), "jaccard-sets")

    linked = jaccard_links(sets, texts)
    least = sets.where("n > 0").groupBy("vertex").agg(F.min("key").alias("least"))
    labelled = least.join(linked, least["vertex"] == linked["node"], "left").select("vertex", "least", F.coalesce("label", "vertex").alias("label"))
    labelled = stored(labelled, "jaccard-labels")
    top = labelled.groupBy("label").agg(F.min("least").alias("top"))
    return sets, labelled.join(top, "label").select("vertex", "top"), linked


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``n_shingles``, ``component_id``, the smallest key that links reach from it, its own included, and ``n_links``, the other rows it links with.

    Two rows link when their sets of five-word shingles have a Jaccard similarity of 0.75 or more. A text with fewer words is one shingle; a null
    text or one without words has none and links with nothing. Null keys count as larger than any; a component of null keys only has a null id.
    Repeated rows have equal sets, so they share a component. An empty table gives no rows. Input columns named like a result column give way to it.
    """
    sets, ids, found = _described(docs, text, key, carry)
    vertices = _vertices(sets)
    linked = set_links(vertices, found, docs.select(F.col(text).alias("text")))
    counted = vertices.join(linked, "vertex", "left").select("vertex", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("count"))
    out = sets.select("row", "key", F.col("n").alias("n_shingles"), "vertex").join(ids.join(counted, "vertex"), "vertex", "left")
    out = out.withColumn("n_links", F.coalesce("count", F.lit(0)).cast("long"))
    out = out.withColumn("component_id", F.when(F.col("vertex").isNull(), F.col("key")).otherwise(F.col("top")))
    return unpacked(out, "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of every component, with the input's columns: the smallest key, of equal keys any one; null keys come last.

    Rows without words are in no component and all stay. Only positions of the rows that go are joined with the texts; they are
    broadcast up to ``MAX_BROADCAST_ROWS``, and shuffled beyond.
    """
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("pos"))
    wrapped = docs.select(packed(docs), F.col(text).alias("text"), order.alias("rank"))
    sets, ids, _ = _described(wrapped, "text", "rank", ["row"])
    gone = sets.select("key", "vertex").join(ids, "vertex").where("key <> top").select(F.col("key.pos").alias("gone"))
    gone = stored(gone, "jaccard-gone")
    small = gone.count() <= MAX_BROADCAST_ROWS
    kept = sets.join(F.broadcast(gone) if small else gone, F.col("key.pos") == F.col("gone"), "left_anti")
    return kept.select("row.row.*")


CHECK = r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
    tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, coalesce(c.n_links, 0) AS n_links
    FROM sets s JOIN reach r ON r.a = s.doc_id LEFT JOIN counted c ON c.a = s.doc_id GROUP BY ALL"""


@query("op6_jaccard_components", CHECK)
def op6_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder), carry=["doc_id"])
