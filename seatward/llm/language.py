"""Language identification: the mean of hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are the three- and four-byte pieces of lower-case words, with the blanks around a word. Each hashes to one of 2^16 buckets
with an embedding; a text is the mean of its embeddings. Embeddings and softmax are trained together by stochastic gradient descent
in numpy on a bounded sample; a part of it is set aside to fit the temperature that makes scores probabilities, and the score below which a prediction counts as
rejected. Prediction reads every whole text, in slices of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, unpacked
from seatward.llm.texts import map_texts

BUCKETS, WIDTH = 1 << 16, 16
# Rows of the sample the model is fitted on (about; at least one of each language).
SAMPLE_ROWS = 3000
# Languages a model can have: its weights are a column each. More raise an error.
MAX_LANGUAGES = 20_000
EPOCHS, RATE, SEED = 8, 2.0, 11
# Share of accepted predictions that should be right, on the part set aside.
PRECISION = 0.99
# Bytes looked at together.
SLICE = 1 << 20

_CLASS = np.full(256, 32, np.uint8)
_CLASS[65:91], _CLASS[97:123] = np.arange(97, 123), np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def subwords(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, buckets) of the subwords in bytes; a subword has blanks at its ends only."""
    b = _CLASS[raw].astype(np.uint32)
    blank = b == 32
    at, found = [], []
    for n, mix in ((3, 2654435761), (4, 2246822519)):
        if len(b) < n:
            continue
        last = len(b) - n + 1
        value = b[:last].copy()
        ok = ~blank[1 : last + 1]
        for j in range(1, n):
            value |= b[j : last + j] << np.uint32(8 * j)
            if 1 < j < n - 1:
                ok &= ~blank[j : last + j]
        where = np.flatnonzero(ok)
        at.append(where)
        found.append((value[where] * np.uint32(mix)) >> np.uint32(16))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(at), np.concatenate(found)


def _raw(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass") + b" "


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of its subwords in each."""
    raw = np.frombuffer(_raw(text), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), SLICE):
        # A subword belongs to the slice it starts in.
        piece = raw[start : start + SLICE + 3]
        at, found = subwords(piece)
        counts += np.bincount(found[at < SLICE], minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.uint16), (counts[buckets] / max(1, counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, mean: np.ndarray) -> np.ndarray:
        return (mean @ self.weights + self.bias) / self.temperature

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, accepted). Texts without a letter, and all texts where nothing was learned, are ``und`` with score 0."""
        out: list = [("und", 0.0, False)] * len(texts)
        if not self.labels:
            return out
        todo = [(i, _raw(t)) for i, t in enumerate(texts) if has_letter(t)]
        # With few languages the product of embedding and softmax is narrower than the embedding.
        table = self.embeddings @ self.weights if len(self.labels) <= WIDTH else self.embeddings
        sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
        for group in _groups(todo):
            data = np.frombuffer(b"".join(part for _, part, _ in group), np.uint8)
            starts = np.cumsum([0] + [len(part) for _, part, _ in group])
            at, found = subwords(data)
            owner = np.searchsorted(starts, at, "right") - 1
            # Neither pieces across two texts nor those that start behind the slice count.
            own = np.array([min(limit, len(part)) for _, part, limit in group])
            inside = (at - starts[owner] < own[owner]) & (at < starts[owner + 1] - 2)
            owner, found = owner[inside], found[inside]
            for c in range(table.shape[1]):
                add = np.bincount(owner, table[found, c], minlength=len(group))
                np.add.at(sums[:, c], [i for i, _, _ in group], add)
            np.add.at(counts, [i for i, _, _ in group], np.bincount(owner, minlength=len(group)))
        rows = np.array([i for i, _ in todo], np.int64)
        if not len(rows):
            return out
        mean = sums[rows] / np.maximum(counts[rows], 1)[:, None]
        logits = (mean + self.bias) / self.temperature if table.shape[1] == len(self.labels) and len(self.labels) <= WIDTH else self.logits(mean)
        p = _softmax(logits)
        best = p.argmax(axis=1)
        for k, i in enumerate(rows):
            score = float(p[k, best[k]])
            out[i] = (self.labels[best[k]], score, score >= self.threshold)
        return out


def _groups(todo: list[tuple[int, bytes]]):
    """Parts (row, bytes, limit) of about ``SLICE`` bytes together; a long text comes in several, three bytes overlapping."""
    group, size = [], 0
    for i, raw in todo:
        for start in range(0, len(raw), SLICE):
            part = raw[start : start + SLICE + 3]
            if group and size + len(part) > SLICE:
                yield group
                group, size = [], 0
            group.append((i, part, SLICE))
            size += len(part)
    if group:
        yield group


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Stochastic gradient descent over (language, buckets, shares); every fifth sample is set aside for calibration."""
    labels = sorted({s[0] for s in samples})
    number = {label: i for i, label in enumerate(labels)}
    rng = np.random.default_rng(SEED)
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    order = rng.permutation(len(samples))
    aside, fit = (order[::5], np.delete(order, np.s_[::5])) if len(samples) >= 50 else (order, order)
    steps = max(1, EPOCHS * len(fit))
    for step in range(steps if labels else 0):
        if step % len(fit) == 0:
            fit = rng.permutation(fit)
        label, buckets, shares = samples[fit[step % len(fit)]]
        rate = RATE * (1 - step / steps)
        rows = embeddings[buckets]
        mean = shares @ rows
        slope = _softmax(mean @ weights + bias)
        slope[number[label]] -= 1
        back = weights @ slope
        weights -= rate * np.outer(mean, slope)
        bias -= 0.1 * rate * slope
        embeddings[buckets] = rows - (rate * shares)[:, None] * back
    model = LanguageModel(labels, embeddings, weights, bias)
    if labels:
        means = np.array([s[2] @ embeddings[s[1]] for s in (samples[i] for i in aside)])
        calibrate(model, means, np.array([number[samples[i][0]] for i in aside]))
    return model


def calibrate(model: LanguageModel, means: np.ndarray, truth: np.ndarray) -> None:
    """Temperature of the least log loss; lowest score from which on accepted predictions are right as often as asked."""
    raw = means @ model.weights + model.bias
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(raw / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-score)
    precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    model.threshold = float(score[order][precise[-1]]) if len(precise) else 1.0


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on a bounded sample of rows that have a language: about equally many of each, one at least, chosen by a hash of the key and taken whole.

    Executors turn the sampled texts into bucket shares, at most ``BUCKETS`` a row, so the driver's part is bounded by the sample. Rows without a text or a
    language are left out; with none left the model predicts ``und``. More than ``MAX_LANGUAGES`` languages raise a ``ValueError``.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit(SEED)), 11) / F.lit(float(1 << 53))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(draw).alias("least"))
    counts = counted.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return train([])
    quota = max(1, sample_rows // len(counts))
    # The row of the least draw is taken where the share alone might take none.
    shares = rows.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, quota / r["count"]), r["least"]) for r in counts], "lang string, share double, least double"
    )
    chosen = rows.join(F.broadcast(shares), "lang").where((draw < F.col("share")) | (draw == F.col("least"))).select("lang", "text")

    def make():
        def shares_of(texts):
            found = [bucket_counts(t) if has_letter(t) else (np.empty(0, np.uint16), np.empty(0, np.float32)) for t in texts]
            return [(b.tobytes(), s.tobytes()) for b, s in found]

        return shares_of

    found = map_texts(chosen, F.col("text"), make, "buckets binary, shares binary").drop("text").toPandas()
    samples = [
        (lang, np.frombuffer(bytes(b), np.uint16).astype(np.int64), np.frombuffer(bytes(s), np.float32))
        for lang, b, s in zip(found["lang"], found["buckets"], found["shares"], strict=True)
        if len(b)
    ]
    samples.sort(key=lambda s: (s[0], s[1].tobytes(), s[2].tobytes()))
    return train(samples)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (0 to 1) and ``accepted``, which is false where the calibrated score is too low.

    A null text and one without a letter are ``und`` with score 0. Rows are independent: no shuffle; repeated rows get equal results; an empty
    table gives no rows. Input columns named like a result column give way to it.
    """
    # Plain arrays and numbers travel to workers that have no copy of this package; the model is put together there.
    parts = (model.labels, model.embeddings, model.weights, model.bias, model.temperature, model.threshold)
    share = docs.sparkSession.sparkContext.broadcast(parts)
    rows = docs.select(packed(docs, carry), F.col(text).alias("text"))
    found = map_texts(rows, F.col("text"), lambda: LanguageModel(*share.value).predict, "lang_pred string, score double, accepted boolean")
    return unpacked(found, "lang_pred", "score", "accepted")


HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, false)"


@query("op5_language")
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = learn(docs.where(f"doc_id IS NOT NULL AND NOT {HELD_OUT}"))
    found = predict(docs, model, carry=["doc_id"])
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")
