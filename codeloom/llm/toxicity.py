"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams and of itself, hashed into rows of one embedding table; a span of words is
the mean of its words' vectors, and a linear softmax gives its two classes. A document is as toxic as its most toxic span of
SPAN words, wherever it starts. What has more than LONG characters without white space is read in pieces of LONG characters,
each a word; consecutive ones share max(GRAMS) - 1 characters, so that no n-gram is lost at a cut. Training starts from the means of whole documents and goes on with the most toxic span of each, so that table
and softmax learn from a few words in long texts. An unseen misspelling is scored by the n-grams it shares.

The labels come from a sample of at most POSITIVE toxic and NEGATIVE other rows, taken by a hash of the id among those that
are not held out; whole texts are used. The scoring covers every text, and remembers the score of each word it has met.

Defined results: a null, empty or blank text has the score of no evidence, the lowest; repeated rows are scored each; a
null id is not held out, and labels without an id aren't learnt from; other columns than `score` are kept as they are; a
label that is null isn't learnt from; of repeated labels the largest counts; without both labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import written

POSITIVE, NEGATIVE = 1500, 2500
BUCKETS, DIMENSIONS, SPAN = 1 << 17, 6, 8
GRAMS, LONG = (3, 4, 5), 64


def held_out(doc_id="doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each word's n-grams, one word after the other, and the place where each word's begin."""
    wrapped = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, wrapped), np.int64, len(wrapped))
    codes = np.frombuffer("".join(wrapped).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, rows = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for k in range(max(GRAMS)):
        rolled[: len(codes) - k] = rolled[: len(codes) - k] * np.uint64(1_000_003) + codes[k:]
        if k + 1 in GRAMS:
            at = np.flatnonzero(left >= k + 1)
            owners.append(owner[at])
            rows.append(rolled[at] + np.uint64((k + 1) << 56))
    terms = codes * (np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(codes)) - np.repeat(starts, sizes)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4E))
    owners.append(np.arange(len(words)))
    rows.append(np.add.reduceat(terms, starts) if len(words) else np.zeros(0, np.uint64))
    owners, rows = np.concatenate(owners), np.concatenate(rows)
    rows = (rows ^ (rows >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rows = ((rows ^ (rows >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return rows[order], np.cumsum(counts) - counts


def words_of(text: str | None) -> list[str]:
    """The lower-cased words, those of more than LONG characters in pieces."""
    words = text.lower().split() if text else []
    if max(map(len, words), default=0) <= LONG:
        return words
    both = max(GRAMS) - 1
    return [w[at : at + LONG] for w in words for at in (range(0, len(w) - both, LONG - both) if len(w) > LONG else (0,))]


def top_span(scores: np.ndarray) -> tuple[int, int, float]:
    """Start, end and mean of the span of SPAN words with the highest mean; the first of equal ones."""
    n = len(scores)
    if n <= SPAN:
        return 0, n, float(scores.mean()) if n else 0.0
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    means = (total[SPAN:] - total[:-SPAN]) / SPAN
    k = int(means.argmax())
    return k, k + SPAN, float(means[k])


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name: str, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
        t = self.t // 3 + 1
        x -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)


def train(texts: list[str], labels: np.ndarray, whole_steps: int = 10, span_steps: int = 150, seed: int = 5) -> tuple[np.ndarray, float]:
    """The score of each row of the table (its vector against the difference of the softmax's classes) and the bias."""
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    own = [np.fromiter((vocabulary[w] for w in d), np.int32, len(d)) for d in docs]
    keep = [i for i, d in enumerate(own) if len(d)]
    own, labels = [own[i] for i in keep], labels[keep].astype(np.float32)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), -np.inf
    rows, starts = features(list(vocabulary))
    sizes = np.diff(np.append(starts, len(rows))).astype(np.float32)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    adam = _Adam(0.05)
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32) / len(labels)
    lengths = np.array([len(d) for d in own])
    flat, doc_of = np.concatenate(own), np.repeat(np.arange(len(own)), lengths)

    def update(which: np.ndarray, doc: np.ndarray, size: np.ndarray) -> float:
        """One step on bags of words: `which` words belong to `doc`s of `size` words."""
        used, at = np.unique(which, return_inverse=True)
        n = sizes[used].astype(np.int64)
        grams = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        grams = rows[grams]
        begin = np.cumsum(n) - n
        vectors = np.add.reduceat(table[grams], begin, axis=0) / sizes[used, None]
        share = 1 / size[doc]
        bags = np.stack([np.bincount(doc, vectors[at, k] * share, len(own)) for k in range(DIMENSIONS)], 1)
        logits = bags @ softmax + bias
        p = 1 / (1 + np.exp(-(logits[:, 1] - logits[:, 0])))
        d = ((p - labels) * weight).astype(np.float32)
        both = np.stack([-d, d], 1)
        d_bags = both @ softmax.T
        d_words = np.stack([np.bincount(at, d_bags[doc, k] * share, len(used)) for k in range(DIMENSIONS)], 1) / sizes[used, None]
        g = np.stack([np.bincount(grams, np.repeat(d_words[:, k], n), BUCKETS) for k in range(DIMENSIONS)], 1).astype(np.float32)
        g += 1e-7 * table
        adam.step("table", table, g)
        adam.step("softmax", softmax, (bags.T @ both).astype(np.float32))
        adam.step("bias", bias, both.sum(0))
        return float(-(weight * np.log(np.where(labels > 0, p, 1 - p) + 1e-9)).sum())

    for _ in range(whole_steps):
        update(flat, doc_of, lengths.astype(np.float32))
    for _ in range(span_steps):
        by_row = table @ (softmax[:, 1] - softmax[:, 0])
        scores = np.add.reduceat(by_row[rows], starts) / sizes
        tops = [top_span(scores[d]) for d in own]
        size = np.array([b - a for a, b, _ in tops], np.float32)
        which = np.concatenate([d[a:b] for d, (a, b, _) in zip(own, tops)])
        update(which, np.repeat(np.arange(len(own)), size.astype(int)), size)
    return (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Trains in one task on the bounded sample."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id", F.lit(3))
    some = known.where("toxic = 1").orderBy(order).limit(POSITIVE).unionByName(known.where("toxic <> 1").orderBy(order).limit(NEGATIVE))
    some = F.broadcast(written(some, "sample"))  # of at most POSITIVE + NEGATIVE rows
    rows = written(docs.select("doc_id", "text").join(some, "doc_id"), "labelled")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat([*batches, pd.DataFrame({"doc_id": [], "text": [], "toxic": []})]).sort_values(["doc_id", "text"])
        by_row, bias = train([x if isinstance(x, str) else "" for x in b.text], (b.toxic == 1).to_numpy(float))
        yield pd.DataFrame({"by_row": [by_row.tobytes()], "bias": [bias]})

    model = written(rows.repartition(1).mapInPandas(fit, "by_row binary, bias double"), "model").first()
    return np.frombuffer(model.by_row, np.float32), model.bias


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with `score`, the probability of the toxic class for the most toxic span."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by_row, bias = shared.value
        known: dict[str, float] = {}
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text)
                if new := list(set(words).difference(known)):
                    if len(known) > 1_000_000:
                        known.clear()
                        new = list(set(words))
                    rows, starts = features(new)
                    sums = np.add.reduceat(by_row[rows], starts)
                    known.update(zip(new, (sums / np.diff(np.append(starts, len(rows)))).tolist()))
                if not words:
                    out.append(0.0 if not np.isfinite(bias) else 1 / (1 + np.exp(-min(bias, -1.0))))
                    continue
                _, _, top = top_span(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))
                out.append(1 / (1 + np.exp(-np.clip(top + bias, -50, 50))) if np.isfinite(bias) else 0.0)
            yield pd.Series(out, dtype=float)

    return docs.withColumn("score", score("text"))
