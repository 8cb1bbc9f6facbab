"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, so a
misspelling that was never seen shares most of them with the word. A window's
vector is the mean over a few words, and a linear softmax gives its two class
scores. A document is as toxic as its most toxic window, which keeps one slur in
a long text from being averaged away. Embeddings and softmax are trained
together, first on all windows under their document's label, then through each
document's highest window. A final two-parameter calibration makes the highest
window's margin a probability.

Since all is linear up to the maximum, scoring needs one number for each n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bucket_of, map_rows, table, texts

_EDGE = b".,;:!?\"'()[]{}*#$%&|<>"
SIZES = (3, 4, 5)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without punctuation at the ends."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().encode("utf-8", "surrogatepass").split()) if w]


def ngrams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram of "<word>", index of the first n-gram of each word).

    A word is its own n-gram too, so none is without."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.append(0, np.cumsum(lens)[:-1])
    word_at = np.repeat(np.arange(len(words)), lens)
    hashes, owners = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        # h[i]: of the n bytes that end at i
        h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * np.uint64(0x100000001B3) + data + np.uint64(1) if n > 1 else data + np.uint64(1)
        if n in SIZES:
            i = np.arange(n - 1, len(data))
            inside = word_at[i] == word_at[i - (n - 1)]
            hashes.append(h[i[inside]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
            owners.append(word_at[i[inside]])
    # the whole word: a wrapping sum of its bytes by position
    power = np.cumprod(np.full(int(lens.max(initial=1)), 0x100000001B3, np.uint64))
    place = np.arange(len(data)) - starts[word_at]
    hashes.append(np.add.reduceat((data + np.uint64(1)) * power[place], starts) * np.uint64(0x9E3779B97F4A7C15))
    owners.append(np.arange(len(words)))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    got = ((hashed[order] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    count = np.bincount(owner, minlength=len(words))
    return got, np.append(0, np.cumsum(count)[:-1])


def window_starts(lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window of ``size`` words, windows ending with their document, over
    documents of the given positive lengths; and the first window of each document."""
    n = -(-lens // size)
    first = np.append(0, np.cumsum(n)[:-1])
    inside = np.arange(int(n.sum())) - np.repeat(first, n)
    return np.repeat(np.append(0, np.cumsum(lens)[:-1]), n) + inside * size, first


@dataclass(frozen=True)
class ToxicityModel:
    gram_scores: np.ndarray  # toxic minus clean, for each bucket
    bias: float
    slope: float
    offset: float
    window: int

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        grams, starts = ngrams(words, len(self.gram_scores))
        return np.add.reduceat(self.gram_scores[grams], starts) / np.diff(np.append(starts, len(grams)))

    def margins(self, scores: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Highest window margin of each document, from its words' scores; a text without words
        has the bias alone."""
        out = np.full(len(lens), self.bias)
        some = np.flatnonzero(lens)
        if len(some):
            starts, first = window_starts(lens[some], self.window)
            mean = np.add.reduceat(scores, starts) / np.diff(np.append(starts, len(scores)))
            out[some] = self.bias + np.maximum.reduceat(mean, first)
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))


def fit(rows: list[tuple[str, int]], *, buckets: int = 1 << 16, dim: int = 4, window: int = 8, warm: int = 40, rounds: int = 100, rate: float = 0.3, seed: int = 7) -> ToxicityModel:
    """Train on (text, toxic 0 or 1). With one class only, or no rows, the model says that class, or 0."""
    docs = [(words_of(t), y) for t, y in rows]
    docs = [(w, y) for w, y in docs if w]
    y = np.array([d[1] for d in docs], np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(buckets), 0.0, 0.0, 4.0 if len(y) and y[0] else -4.0, window)
    ids: dict[bytes, int] = {}
    token = np.fromiter((ids.setdefault(w, len(ids)) for d, _ in docs for w in d), np.int64)
    lens = np.array([len(d) for d, _ in docs])
    grams, gram_start = ngrams(list(ids), buckets)
    per_word = np.diff(np.append(gram_start, len(grams))).astype(np.float32)
    word_of_gram = np.repeat(np.arange(len(ids)), per_word.astype(np.int64))
    starts, first = window_starts(lens, window)
    per_window = np.diff(np.append(starts, len(token))).astype(np.float32)
    window_of_token = np.repeat(np.arange(len(starts)), per_window.astype(np.int64))
    n_windows = np.diff(np.append(first, len(starts)))
    doc_of_window = np.repeat(np.arange(len(docs)), n_windows)
    toxic = y[doc_of_window] == 1
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (dim, buckets)).astype(np.float32)
    soft = rng.normal(0, 0.1, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [[np.zeros_like(p), 0.0] for p in (emb, soft, bias)]

    def vectors() -> np.ndarray:
        out = np.empty((dim, len(starts)), np.float32)
        for d in range(dim):
            word = np.add.reduceat(emb[d][grams], gram_start) / per_word
            out[d] = np.add.reduceat(word[token], starts) / per_window
        return out

    def top_windows(margin: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(margin, first)
        at = np.flatnonzero(margin == best[doc_of_window])
        return at[np.unique(doc_of_window[at], return_index=True)[1]]

    for step in range(1, warm + rounds + 1):
        x = vectors()
        logits = soft @ x + bias[:, None]
        p1 = 1 / (1 + np.exp(-np.clip(logits[1] - logits[0], -30, 30)))
        weight = (share / n_windows)[doc_of_window]
        if step > warm:
            weight = np.where(toxic, 0, 0.3 * weight)
            weight[top_windows(logits[1] - logits[0])] += share
        g1 = (weight * (p1 - toxic)).astype(np.float32)
        g = np.stack([-g1, g1])
        dx = soft.T @ g
        d_emb = np.empty_like(emb)
        for d in range(dim):
            per_token = (dx[d] / per_window)[window_of_token]
            word = np.bincount(token, per_token, len(ids)) / per_word
            d_emb[d] = np.bincount(grams, word[word_of_gram], buckets)
        # momentum, at one rate for a whole array: an n-gram of few documents hardly moves
        for p, dp, st in zip((emb, soft, bias), (d_emb, g @ x.T, g.sum(1)), state, strict=True):
            st[0] += 0.2 * (dp - st[0])
            st[1] = max(float(np.abs(st[0]).max()), 0.9 * st[1], 1e-12)
            p -= rate * min(1, 2 - 2 * step / (warm + rounds + 1)) / st[1] * st[0]

    way = soft[1] - soft[0]
    margin = way @ vectors() + bias[1] - bias[0]
    top = np.maximum.reduceat(margin, first).astype(float)
    scale = max(1e-6, float(np.abs(top).max()))
    a, b, z = 1.0, 0.0, top / scale
    for _ in range(200):  # calibration, slightly held back
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * z).sum() + 0.01 * a, (p - y).sum()])
        hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum()]])
        step_ab = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        a, b = a - float(np.clip(step_ab[0], -2, 2)), b - float(np.clip(step_ab[1], -2, 2))
        if np.abs(step_ab).max() < 1e-6:
            break
    return ToxicityModel((way @ emb).astype(np.float64), float(bias[1] - bias[0]), a / scale, b, window)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, longest: int = 20_000) -> list[tuple[str, int]]:
    """Texts and labels to train on: of each class at most ``per_class`` of the documents with at
    most ``longest`` characters, those first by a hash of the id. Only these few come to the driver.

    A label or id that is null counts as none; of several labels of an id the highest counts, of
    several texts the one whose hash is the least. Without labelled documents it is empty."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # numbers only: texts are read again for the few that are picked
    sizes = docs.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), F.length("text").alias("n")).alias("t")).groupBy("doc_id").agg(F.min("t").alias("t"))
    fit = known.join(sizes.where(F.col("t.n") <= longest), "doc_id").select(F.col("doc_id").alias("p_id"), "toxic", F.col("t.hash").alias("p_hash"))
    picked = None
    for k in (0, 1):
        some = fit.where(F.col("toxic") == k).orderBy(F.xxhash64("p_id"), "p_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * per_class rows of three numbers
    joined = docs.join(F.broadcast(picked), (F.col("doc_id") == F.col("p_id")) & (F.xxhash64("text") == F.col("p_hash")))
    return [(r.text, int(r.toxic)) for r in joined.select("doc_id", "text", "toxic").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()]


def score(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (probability of toxic, 0 to 1) and predicted (1 from ``threshold`` on) of
    every row of docs (doc_id, text). Null and empty texts are scored by the bias; repeated
    rows are each scored, an empty table gives no rows, other columns play no part."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one number for each of a fixed number of buckets

    def make():
        m, known = sent.value, {}

        def step(cols: dict[str, list]) -> dict[str, list]:
            split = [words_of(t or "") for t in cols["text"]]
            if len(known) > 200_000:
                known.clear()
            new = [w for w in {w for d in split for w in d} if w not in known]
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                known.update(zip(part, m.word_scores(part).tolist(), strict=True))
            scores = np.fromiter((known[w] for d in split for w in d), float)
            p = m.probability(m.margins(scores, np.array([len(d) for d in split], np.int64)))
            return {"doc_id": cols["doc_id"], "score": p.tolist(), "predicted": (p >= threshold).astype(int).tolist()}

        return step

    return map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int", make)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(labelled_sample(docs, labels.where(bucket_of(F.col("doc_id"), 3) != 1)))
    return score(docs, model).select("doc_id", (bucket_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
