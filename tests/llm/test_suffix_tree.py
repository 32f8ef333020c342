import gc
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from seatward.llm import suffix_tree
from seatward.llm.suffix_tree import (
    END, chunked_texts, context_scores, dealt_tokens, fit_chunks, fit_tree, frequent_words, lm_scores, tokens, wanted_facts, word_hash,
)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " "]


class Brute:
    """The same tree from dictionaries: contexts are tuples of words."""

    def __init__(self, texts, depth, max_states, min_divergence):
        self.depth, self.single, self.next = depth, Counter(), defaultdict(Counter)
        for text in texts:
            line = words(text)
            self.single.update(line)
            for i, w in enumerate(line):
                for d in range(1, depth + 1):
                    if i - d >= -1:
                        self.next[tuple(([" "] + line)[i + 1 - d : i + 1])][w] += 1
        self.total, self.distinct = sum(self.single.values()), len(self.single)
        self.least = max(2, -(-self.total // max_states))
        self.kept = {()}
        for context in self.next:
            if self.frequent(context) and self.gain(context) >= min_divergence:
                self.kept |= {context[i:] for i in range(len(context))}

    def size(self, context):
        if len(context) == 1:
            return self.single[context[0]]
        return self.next[context[:-1]][context[-1]]

    def frequent(self, context):
        return all(self.size(context[:i]) >= self.least for i in range(1, len(context) + 1)) and self.size(context) >= self.least

    def seen(self, context):
        """Next words that count: frequent after the context, and after each of its suffixes."""
        return {w: n for w, n in self.next[context].items() if n >= self.least}

    def rest(self, context):
        return 1 - sum((n - 1) / self.size(context) for n in self.seen(context).values())

    def p(self, context, word):
        if not context:
            return (self.single[word] + 1) / (self.total + self.distinct + 1)
        n = self.seen(context).get(word, 1)
        return (n - 1) / self.size(context) + self.rest(context) * self.p(context[1:], word)

    def gain(self, context):
        seen, size = self.seen(context), self.size(context)
        inside = sum(n * math.log(self.p(context, w) / self.p(context[1:], w)) for w, n in seen.items())
        return (inside + (size - sum(seen.values())) * math.log(self.rest(context))) / size

    def score(self, text):
        line, out = words(text), 0.0
        for i, w in enumerate(line):
            context = tuple(([" "] + line)[max(0, i + 1 - self.depth) : i + 1])
            while context not in self.kept:
                context = context[1:]
            out += math.log10(self.p(context, w))
        return out


def corpus(seed, n=140):
    """Words follow each other by a random rule now and then; some texts are repeated, some words are rare."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "É x", "UPPER"]
    after = {w: rng.choice(vocabulary) for w in vocabulary}
    rows = []
    for i in range(n):
        line = [rng.choice(vocabulary)]
        for _ in range(rng.randrange(0, 40)):
            line.append(after[line[-1]] if line[-1] in after and rng.random() < 0.6 else rng.choice(vocabulary) if rng.random() < 0.9 else f"rare{rng.randrange(200)}")
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(line)))
    return rows + [(n + i, rows[3][1]) for i in range(20)]


EDGES = [(5000, None), (5001, ""), (5002, " \n"), (None, "w1 w2 w3"), (5003, "w1 " * 3000), (5004, "never seen words"), (5005, "rare1 w2")]


@pytest.mark.parametrize(("depth", "max_states", "gain"), [(2, 1 << 20, 0.02), (3, 300, 0.0), (1, 50, 0.3), (3, 1 << 20, -9.0)])
def test_against_brute_force(docs_df, depth, max_states, gain):
    rows = corpus(depth) + EDGES
    held = lambda key: zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2
    model = Brute([t for k, t in rows if not held(k)], depth, max_states, gain)
    out = lm_scores(docs_df(rows).repartition(3), depth=depth, max_states=max_states, min_divergence=gain)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        r, line = got[key], words(text)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(key), len(line), model.total)
        assert r["n_known"] == sum(model.single[w] > 0 for w in line)
        assert r["base_score"] == pytest.approx(sum(math.log10(model.p((), w)) for w in line), abs=1e-6)
        assert r["score"] == pytest.approx(model.score(text), abs=1e-6)


def test_states_are_distributions(docs_df):
    model = Brute([t for _, t in corpus(5)], 2, 1 << 20, 0.02)
    symbols = [*model.single, "unseen"]
    assert len(model.kept) > 20
    for context in model.kept:
        assert sum(model.p(context, w) for w in symbols) == pytest.approx(1)


def test_more_context_predicts_held_out_texts_better(docs_df):
    out = lm_scores(docs_df(corpus(6, 600))).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert out[1] > 0.8 * out[0]


def test_memory_is_bounded(docs_df, rows_of, monkeypatch):
    """Forgetting words and counting pairs early changes nothing."""
    df = docs_df(corpus(7))
    want = rows_of(lm_scores(df), "doc_id", "score", "n_known")
    monkeypatch.setattr(suffix_tree, "MEMORY", 3)
    monkeypatch.setattr(suffix_tree, "GATHER", 5)
    monkeypatch.setattr(suffix_tree, "PIECE", 4)
    assert rows_of(lm_scores(df), "doc_id", "score", "n_known") == want


def test_bound_on_states(docs_df):
    tree, _ = fit_tree(docs_df(corpus(8)).select("text"), max_states=40)
    assert 0 < len(tree.hashes) <= 40 and all(len(x.keys) <= 40 for x in tree.levels)


def test_empty_nothing_to_learn_and_clashing_names(docs_df, rows_of):
    assert lm_scores(docs_df([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = docs_df([(held, "a b"), (held, "a b")]).withColumns({"score": F.lit("mine"), "row": F.lit(1), "pos": F.lit(2), "rare": F.lit(3)})
    out = lm_scores(df)
    assert rows_of(out, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "pos") == [(held, 3, 0, 0, 0.0, 0.0, 2)] * 2


def test_tokens():
    assert tokens("A É b\x85\x1cC\x0bd") == [b"a", "É b\x85\x1cc".encode(), b"d", END]
    assert tokens(None) == tokens("") == [END]
    assert -(1 << 63) <= word_hash(b"a") < 1 << 63


def scores_as_brute(model, rows, out, leave=()):
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        if key not in leave:
            line = words(text)
            assert got[key]["n_known"] == sum(model.single[w] > 0 for w in line)
            assert got[key]["base_score"] == pytest.approx(sum(math.log10(model.p((), w)) for w in line), abs=1e-6)
            assert got[key]["score"] == pytest.approx(model.score(text), abs=1e-6)


def test_contexts_rarer_than_a_share_of_the_tokens_count(docs_df):
    """Of 2.3 million tokens a context that was seen twice still predicts."""
    filler = range(9000, 37_000)
    rows = corpus(9) + [(i, "filler " * 99) for i in filler]
    held = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    model = Brute([t for k, t in rows if not held(k)], 2, 1 << 40, 0.02)
    assert model.least == 2 and model.total > 2 << 20
    assert sum(n == 2 for c in model.kept for n in model.next[c].values()) > 10
    scores_as_brute(model, rows, lm_scores(docs_df(rows)), leave=filler)


@pytest.mark.parametrize(("depth", "gain"), [(1, 0.02), (2, 0.02), (2, 0.9), (3, 0.4), (3, -9.0)])
def test_contexts_too_heavy_for_one_task(docs_df, monkeypatch, depth, gain):
    """Dealt out, with what follows them from a table, they score the same; words without a short code, too."""
    for name, value in (("HEAVY", 25), ("BUCKET", 150), ("FREQUENT", 9), ("GATHER", 700)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = corpus(10 + depth) + [(6000 + i, "w1 w2 w3 w4 " * 9) for i in range(12)] + EDGES
    held = lambda key: zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2
    model = Brute([t for k, t in rows if not held(k)], depth, 1 << 40, gain)
    tree, _ = fit_tree(docs_df([(k, t) for k, t in rows if not held(k)]).select("text"), depth)
    assert len(tree.hashes) > 9 and len(tree.levels) == depth - 1 and all(len(x.keys) for x in tree.levels)
    scores_as_brute(model, rows, lm_scores(docs_df(rows).repartition(3), depth=depth, min_divergence=gain))


def test_what_tasks_ask_for_travels_packed(docs_df, monkeypatch):
    """One row for each chunk of texts and each task that answers, not one for each word after a heavy context."""
    for name, value in (("HEAVY", 25), ("FREQUENT", 9), ("GATHER", 700)):
        monkeypatch.setattr(suffix_tree, name, value)
    rows = docs_df(corpus(14)).select(F.struct("doc_id").alias("row"), F.lit(False).alias("held_out"), "text")
    chunks = chunked_texts(rows.coalesce(2)).cache()
    tree, words = fit_chunks(chunks)
    given = (frequent_words(words, 25), (tree.hashes, [x.keys for x in tree.levels]), 2, 12)
    asked, n_chunks = wanted_facts(chunks, given).agg(F.count("*").alias("rows"), F.sum("size").alias("asks")).first(), chunks.count()
    assert 1 < n_chunks and 0 < asked["rows"] <= 3 * n_chunks and asked["asks"] > 10 * asked["rows"]
    dealt = dealt_tokens(chunks, given).agg(F.count("*").alias("rows"), F.sum("size").alias("tokens")).first()
    assert dealt["rows"] <= 12 * n_chunks and dealt["tokens"] == tree.total


class Here:
    """Stands for a table: hands back the function given to Spark, to run it here."""

    def __init__(self, *columns):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *columns):
        return self

    groupBy = cogroup = select

    def mapInArrow(self, run, schema):  # noqa: N802
        return run

    applyInArrow = mapInArrow  # noqa: N815


def test_memory_of_a_task(spark, docs_df, monkeypatch):
    """What a task holds at once, in bytes a token: one chunk's tokens while they are dealt, a bucket's while they are scored."""
    for name, value in (("HEAVY", 30_000), ("GATHER", 1 << 17), ("GROUP", 1 << 13), ("PIECE", 64)):
        monkeypatch.setattr(suffix_tree, name, value)
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 4000)}" for _ in range(500))) for i in range(800)]
    rows = docs_df(texts).select(F.struct("doc_id").alias("row"), F.lit(False).alias("held_out"), "text")
    chunks = chunked_texts(rows.coalesce(1)).cache()
    tree, counted = fit_chunks(chunks)
    given = (frequent_words(counted, 30_000), (tree.hashes, [x.keys for x in tree.levels]), 2, 2)
    batches = [chunks.toArrow().combine_chunks().to_batches()[0]]
    size = max(map(sum, batches[0]["sizes"].to_pylist()))
    assert len(tree.hashes) == 3 and batches[0].num_rows > 2

    def peak(work):
        gc.collect()
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(lambda: deque(dealt_tokens(Here(), given)(iter(batches)), 0)) < 85 * size
    assert peak(lambda: deque(wanted_facts(Here(), given)(iter(batches)), 0)) < 75 * size
    wanted = pa.Table.from_batches(wanted_facts(Here(), given)(iter(batches)))
    assert wanted.num_rows
    dealt = pa.Table.from_batches(dealt_tokens(Here(), given)(iter(batches)))
    bucket = dealt.filter(pc.equal(dealt["bucket"], 0))
    nothing = suffix_tree._packed_rows([], "bucket")
    n = 1 + sum(map(len, [tree.hashes, *(x.keys for x in tree.levels)]))
    model = (np.full(n, 30_000), np.full(n, 0.5), np.ones(n, bool), tree.total, tree.distinct, 2, 0.02)
    tokens_ = pc.sum(bucket["size"]).as_py()
    assert tokens_ > 1 << 17
    assert peak(lambda: context_scores(Here(), Here(), given, model)(bucket, nothing)) < 105 * tokens_
