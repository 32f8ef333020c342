import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from seatward.llm.language import SLICE, LanguageModel, bucket_counts, learn, predict, subwords, train

SYLLABLES = {"aa": "ka mo tu ri sel", "bb": "ng pfe ö sch tz", "cc": "eau ille qué ont ç", "dd": "привет мир да нет"}


def prose(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(seed, n=400):
    rng = random.Random(seed)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [(i, prose(rng, lang, rng.randrange(8, 60)), lang, "s", 0) for i, lang in enumerate(langs)]


def plain_subwords(raw: bytes):
    low = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
    out = []
    for n, mix in ((3, 2654435761), (4, 2246822519)):
        for i in range(len(low) - n + 1):
            if 32 not in low[i + 1 : i + n - 1]:
                out.append((i, (int.from_bytes(low[i : i + n], "little") * mix % 2**32) >> 16))
    return sorted(out)


def test_subwords_against_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice(b"abZ .1\xc3\xa9") for _ in range(rng.randrange(40)))
        at, found = subwords(np.frombuffer(raw, np.uint8))
        assert sorted(zip(at.tolist(), found.tolist(), strict=True)) == plain_subwords(raw)


def test_held_out_accuracy_and_determinism(docs_df):
    rows = corpus(1)
    odd = [(1000, None, "aa", "s", 0), (1001, "", "bb", "s", 0), (1002, "123 %% 4", "cc", "s", 0), (1003, "x", None, "s", 0), (None, rows[0][1], "aa", "s", 0)]
    df = docs_df(rows + odd)
    model = learn(df.where("doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2"))
    got = {r["doc_id"]: r for r in predict(df, model, carry=["doc_id"]).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.98 * len(held) and len(held) > 50
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False) for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] in SYLLABLES and got[None]["lang_pred"] == rows[0][2]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = learn(df.where("doc_id IS NOT NULL AND crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2").repartition(3))
    assert np.array_equal(again.embeddings, model.embeddings) and again.threshold == model.threshold


def test_whole_texts_in_slices(monkeypatch):
    import seatward.llm.language as module

    rng = random.Random(3)
    samples = [(lang, *(a.astype(np.int64) if i == 0 else a for i, a in enumerate(bucket_counts(prose(rng, lang, 30))))) for lang in list(SYLLABLES) * 30]
    model = train(samples)
    texts = [prose(rng, lang, n) for lang in SYLLABLES for n in (1, 2, 50, 400)] + [None, "a", "é", "7"]
    want = [model.predict([t])[0] for t in texts]
    assert [p[0] for p in model.predict(texts)] == [p[0] for p in want]
    counts = [bucket_counts(t or "") for t in texts]
    monkeypatch.setattr(module, "SLICE", 37)
    for a, b in zip(model.predict(texts), want, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6
    for t, (b, s) in zip(texts, counts, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(bucket_counts(t or ""), (b, s), strict=True))
    assert SLICE == 1 << 20


def test_nothing_to_learn(docs_df):
    df = docs_df([(1, "some words", None, "s", 0), (2, None, "en", "s", 0)]).withColumn("score", F.lit("x"))
    got = predict(df, learn(df)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert isinstance(learn(docs_df([])), LanguageModel) and predict(docs_df([]), learn(docs_df([]))).count() == 0
    one = docs_df([(1, "only one language", "en", "s", 0)])
    assert predict(one, learn(one)).first()["lang_pred"] == "en"


def test_many_languages_are_all_learned(docs_df):
    """Twelve hundred languages, the rare ones with two rows: each is learned, and more than the bound is an error, not a loss."""
    import seatward.llm.language as module

    rng = random.Random(12)
    rows = []
    for n in range(1200):
        stem = "".join(rng.choice("bcdfghklmnpqrstvwz") + rng.choice("aeiou") for _ in range(3))
        rows += [(10 * n + i, f"{stem} {stem}{rng.choice('xyz')} {stem}", f"l{n}", "s", 0) for i in range(2 if n % 3 else 6)]
    df = docs_df(rows)
    model = learn(df)
    assert len(model.labels) == 1200
    most = module.MAX_LANGUAGES
    try:
        module.MAX_LANGUAGES = 1199
        learn(df)
        raise AssertionError("no error")
    except ValueError as e:
        assert "languages" in str(e)
    finally:
        module.MAX_LANGUAGES = most


def test_gradient_step_against_the_plain_formula():
    """One sample, one step at a time: embeddings, softmax weights and bias move down the gradient of the log loss."""
    import seatward.llm.language as module

    samples = [("aa", np.array([5, 9]), np.array([0.25, 0.75], np.float32)), ("bb", np.array([9, 11]), np.array([0.5, 0.5], np.float32))]
    epochs = module.EPOCHS
    try:
        module.EPOCHS = 1
        model = train(samples)
    finally:
        module.EPOCHS = epochs
    rng = np.random.default_rng(module.SEED)
    e = rng.normal(0, 0.1, (module.BUCKETS, module.WIDTH)).astype(np.float32).astype(np.float64)
    w, b = np.zeros((module.WIDTH, 2)), np.zeros(2)
    order = rng.permutation(2)
    for step, i in enumerate(rng.permutation(order)):
        label, buckets, shares = samples[i]
        rate = module.RATE * (1 - step / 2)
        mean = sum(s * e[k] for k, s in zip(buckets, shares, strict=True))
        p = np.exp(mean @ w + b) / np.exp(mean @ w + b).sum()
        slope = p - np.array([label == "aa", label == "bb"], float)
        back = w @ slope
        w, b = w - rate * np.outer(mean, slope), b - 0.1 * rate * slope
        for k, s in zip(buckets, shares, strict=True):
            e[k] = e[k] - rate * s * back
    assert np.allclose(model.weights, w, atol=1e-5) and np.allclose(model.bias, b, atol=1e-5) and np.allclose(model.embeddings, e, atol=1e-5)
