"""Quality classifier: random-indexing word vectors under a two-layer network."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta.llm.common import encoded, held_out, per_batch
from sheetdelta.session import cut

# Words, numbers and runs of signs.
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")

#: Slots of the vocabulary; words share slots by hash, so the table has a fixed size.
SLOTS = 1 << 13
#: Dimensions of a word vector, and non-zeros of an index vector.
DIMENSIONS = 48
NONZERO = 2
#: Labelled rows the network is fitted on at most, drawn by a hash of the key.
LABELLED = 20_000
#: Rows scoring this or more are predicted to be good.
THRESHOLD = 0.3


def token_slots(text: bytes, slots: int) -> np.ndarray:
    found = _TOKEN.findall(text)
    return np.fromiter(map(zlib.crc32, found), np.int64, len(found)) & (slots - 1)


def index_vectors(slots: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random index vector of each slot: positions and signs of its non-zeros."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, dimensions, (slots, NONZERO)), draw.choice((-1.0, 1.0), (slots, NONZERO))


@dataclass
class WordSpace:
    """Vectors and relative frequencies of the vocabulary slots."""

    vectors: np.ndarray
    frequency: np.ndarray

    def pool(self, slots: np.ndarray) -> np.ndarray:
        """Weighted mean and spread of the word vectors, with how repetitive and long the text is."""
        if not len(slots):
            return np.zeros(2 * self.vectors.shape[1] + 3, np.float32)
        used, count = np.unique(slots, return_counts=True)
        weight = count * (1e-3 / (1e-3 + self.frequency[used]))
        own = self.vectors[used]
        mean = weight @ own / weight.sum()
        spread = np.sqrt(np.maximum(weight @ (own * own) / weight.sum() - mean * mean, 0))
        more = (len(used) / len(slots), float((slots[1:] == slots[:-1]).mean()) if len(slots) > 1 else 0.0, np.log1p(len(slots)) / 10)
        return np.concatenate([mean, spread, more]).astype(np.float32)


def learn_words(docs: DataFrame, text: str, slots: int = SLOTS, dimensions: int = DIMENSIONS, seed: int = 7) -> WordSpace:
    """Word vectors by random indexing over all texts.

    A word's vector is the sum of the index vectors of its neighbours (one word to each
    side). Each task adds up one table for all its texts and sends one row per slot it met.
    """
    where, sign = index_vectors(slots, dimensions, seed)
    width = dimensions + 1

    def run(batches):
        import pyarrow as pa

        total = np.zeros(slots * width)
        for batch in batches:
            for value in encoded(batch.column(0)):
                own = token_slots(value, slots)
                np.add.at(total, own * width + dimensions, 1.0)
                for word, near in ((own[:-1], own[1:]), (own[1:], own[:-1])):
                    for k in range(NONZERO):
                        np.add.at(total, word * width + where[near, k], sign[near, k])
        table = total.reshape(slots, width)
        met = np.flatnonzero(table[:, dimensions])
        values = pa.array(table[met].astype(np.float32).ravel())
        ends = pa.array(np.arange(len(met) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.ListArray.from_arrays(ends, values)], ["slot", "sums"])

    met = docs.select(F.col(text).cast("string")).mapInArrow(run, "slot int, sums array<float>")
    columns = [F.sum(F.get("sums", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(width)]
    # one row per slot: the number of slots is fixed
    rows = met.groupBy("slot").agg(F.array(*columns).alias("sums")).toArrow()
    table = np.zeros((slots, width))
    table[rows["slot"].to_numpy()] = rows["sums"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    counts = table[:, dimensions]
    norms = np.linalg.norm(table[:, :dimensions], axis=1, keepdims=True)
    vectors = table[:, :dimensions] / np.where(norms > 0, norms, 1)
    return WordSpace(vectors.astype(np.float32), (counts / max(1.0, counts.sum())).astype(np.float32))


@dataclass
class Network:
    """Two layers over standardised inputs, with a temperature for calibrated probabilities."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        hidden = np.maximum((inputs - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probabilities(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -60, 60)))


def fit(inputs: np.ndarray, labels: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Trains with Adam on four fifths of the rows and fits the temperature on the rest."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(labels))
    split = max(1, len(order) // 5) if len(order) > 4 else 0
    held, used = order[:split], order[split:]
    x, y = inputs[used].astype(np.float64), labels[used].astype(np.float64)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - centre) / scale
    params = [
        draw.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
        draw.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(len(y)), max(1, len(y) // 128)):
            w1, b1, w2, b2 = params
            raw = x[rows] @ w1 + b1
            out = np.maximum(raw, 0)
            error = (1 / (1 + np.exp(-np.clip(out @ w2 + b2, -60, 60))) - y[rows]) / len(rows)
            back = np.outer(error, w2) * (raw > 0)
            grads = [x[rows].T @ back + 1e-4 * w1, back.sum(axis=0), out.T @ error + 1e-4 * w2, np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                params[k] = params[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    net = Network(centre, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if split:
        logits, truth = net.logits(inputs[held]), labels[held]

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))

        net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss)
    return net


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", labelled: int = LABELLED,
) -> tuple[WordSpace, Network | float]:
    """Word space of all texts and a network fitted on labelled rows that are not held out.

    At most ``labelled`` rows are used, those with the smallest hash of their key. Without
    labels of both kinds the share of good ones stands in for the network (0.5 for none).
    """
    space = learn_words(docs, text)
    slots = SLOTS
    drawn = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(
        F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    drawn = cut(drawn.orderBy(F.xxhash64(F.lit(7), "key"), "key").limit(labelled))
    # the drawn labels are at most ``labelled`` short rows
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "key")
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def pooled(batch) -> dict[str, object]:
        return {"label": batch.column(0), "pooled": [shared.value.pool(token_slots(t, slots)).tolist() for t in encoded(batch.column(1))]}

    rows = per_batch(found.select("label", "text"), pooled, "label int, pooled array<float>").limit(2 * labelled).toArrow()
    truth = rows["label"].to_numpy()
    if len(np.unique(truth)) < 2:
        return space, float(truth.mean()) if len(truth) else 0.5
    inputs = rows["pooled"].combine_chunks().flatten().to_numpy().reshape(len(truth), -1)
    order = np.lexsort(inputs.T[:8])  # the result must not depend on the order of arrival
    return space, fit(inputs[order], truth[order])


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: key, held_out, score (0 to 1, calibrated) and predicted (1 from ``threshold`` on).

    Only the text decides. Null and empty texts have no words and get the score of an empty
    pool; a null key is never held out; repeated rows keep a row each; other columns are
    not read. Word statistics cover all rows; see ``train`` for the bounded fit.
    """
    space, net = train(docs, labels, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast((space, net))
    slots = SLOTS

    def score(batch) -> dict[str, object]:
        space, net = shared.value
        texts = encoded(batch.column(2))
        if isinstance(net, float):
            scores = np.full(len(texts), net)
        else:
            scores = net.probabilities(np.array([space.pool(token_slots(t, slots)) for t in texts]))
        return {"key": batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).cast("string"))
    return per_batch(plain, score, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)


def without_poor(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores below ``threshold``; the columns stay."""
    space, net = train(docs, labels, key, text)
    shared = docs.sparkSession.sparkContext.broadcast((space, net))
    slots, at = SLOTS, docs.columns.index(text)

    def keep(batches):
        import pyarrow as pa

        space, net = shared.value
        for batch in batches:
            texts = encoded(batch.column(at))
            if not texts:
                continue
            if isinstance(net, float):
                scores = np.full(len(texts), net)
            else:
                scores = net.probabilities(np.array([space.pool(token_slots(t, slots)) for t in texts]))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)
