import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as brute_components
from test_mixing import brute_targets, words
from test_quality import corpus as quality_corpus
from tokenizers import Tokenizer

import corpus_pipeline
from seatward.llm.bpe import vocabulary
from seatward.llm.quality import features


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    clean, junk = quality_corpus()
    texts = [t for _, t in clean]
    near = [" ".join(w if rng.random() > 0.01 else "changed" for w in t.split()) for t in texts[:60]]
    every = texts + near + texts[:40] + texts[:10] + [t for _, t in junk] + ["", "too short"]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(t)) for i, t in enumerate(every)]
    rows += [(9000, None, None, "a", None), (9001, texts[100], "en", "b", 1), (9001, texts[100], "en", "b", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs.collect(), docs.columns
    stages = iter(corpus_pipeline.STAGES)

    def after():
        nonlocal docs
        name, stage = next(stages)
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        return docs.collect()

    good = after()
    clean = {t for _, t in quality_corpus()[0]}
    assert clean <= {r["text"] for r in good} and docs.columns == columns
    assert all(features(r["text"])[0] >= 20 for r in good)
    junk = {t for _, t in quality_corpus()[1]}
    assert not junk & {r["text"] for r in good} and len(good) < len(before)

    single = after()
    top = {}
    for r in good:
        top[r["text"]] = max(top.get(r["text"], -1), r["doc_id"])
    assert sorted((r["doc_id"], r["text"]) for r in single) == sorted((i, t) for t, i in top.items()) and docs.columns == columns

    apart = after()
    groups = brute_components([(r["doc_id"], r["text"]) for r in single])
    assert sorted(r["doc_id"] for r in apart) == sorted({g[2] for g in groups}) and docs.columns == columns

    mixed = after()
    sizes = Counter()
    for r in apart:
        sizes[r["source"]] += words(r["text"])
    want, taken, drawn = brute_targets(sizes), Counter(), Counter(r["doc_id"] for r in mixed)
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 30 for s in want) and max(drawn.values()) <= 3
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in apart} and docs.columns == columns

    last = after()
    library = Tokenizer.from_file(vocabulary())
    text = {r["doc_id"]: r["text"] for r in mixed}
    assert Counter(r["doc_id"] for r in last) == drawn
    for r in last:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding",
    ]
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert out.where(F.col("n_tokens") < 20).count() == 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
