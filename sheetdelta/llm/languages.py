"""Language proportions of documents by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta.llm.common import encoded, held_out, per_batch

#: Bytes of an n-gram and slots that n-grams share by hash.
GRAM = 3
SLOTS = 1 << 15
#: Languages the tables are sized for; more is an error.
MOST_LANGUAGES = 500
#: Rounds of expectation-maximisation at most; it stops once proportions settle.
ROUNDS = 30
#: Cost of a further language in log-likelihood, as a multiple of log(n-grams).
PENALTY = 3.0

_LETTER = re.compile(r"[^\W\d_]")


def gram_slots(text: bytes, gram: int = GRAM, slots: int = SLOTS) -> np.ndarray:
    """Slot of every n-gram of the lower-cased text, framed by spaces."""
    raw = np.frombuffer(b" " + text.decode("utf-8", "replace").lower().encode() + b" ", np.uint8).astype(np.uint32)
    if len(raw) < gram:
        return np.zeros(0, np.int64)
    mixed = np.zeros(len(raw) - gram + 1, np.uint32)
    for k in range(gram):
        mixed = (mixed * np.uint32(0x01000193)) ^ raw[k : k + len(mixed)]
    mixed *= np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - int(slots).bit_length() + 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Languages:
    """Learned languages and the log-likelihoods (language by slot) of n-grams."""

    names: list[str]
    chance: np.ndarray

    def proportions(self, counts: np.ndarray, chance: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Mixture weights of the given languages and the log-likelihood they reach."""
        share, total = start, counts.sum()
        for _ in range(ROUNDS):
            mixed = share @ chance
            new = share * (chance @ (counts / mixed)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(counts @ np.log(share @ chance))

    def infer(self, slots: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions over all languages (0 outside the selected set) and confidence.

        Starts from all languages and drops the weakest while the likelihood, less a
        penalty for each language, does not fall. Confidence is the share of the strongest.
        """
        used, counts = np.unique(slots, return_counts=True)
        chance, counts = self.chance[:, used], counts.astype(float)
        left = np.arange(len(self.names))
        price = PENALTY * np.log(1 + counts.sum())
        share, likelihood = self.proportions(counts, chance, np.full(len(left), 1 / len(left)))
        while len(left) > 1:
            order = np.argsort(share, kind="stable")[1:]
            order.sort()
            start = share[order] + 1e-6
            fewer, reached = self.proportions(counts, chance[left[order]], start / start.sum())
            if reached + price < likelihood:
                break
            left, share, likelihood = left[order], fewer, reached
        out = np.zeros(len(self.names))
        out[left] = share
        return out, float(min(1.0, out.max()))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held: bool = True) -> Languages:
    """Counts n-grams per language over all texts with a language (held-out keys left aside).

    Each task sends one row per language and slot it met; the table has languages x slots entries.
    """
    source = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if held:
        source = source.filter(~held_out(F.col(key)))

    def run(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                own = tables.setdefault(name, np.zeros(SLOTS, np.int64))
                own += np.bincount(gram_slots(value), minlength=SLOTS)
        for name, table in tables.items():
            met = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(table[met])], ["lang", "slot", "n"])

    met = source.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(run, "lang string, slot int, n long")
    by_lang = met.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = by_lang.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows.sort(key=lambda r: r.lang)
    table = np.full((len(rows), SLOTS), 0.5)
    for at, row in enumerate(rows):
        for slot, n in row.counts:
            table[at, slot] += n
    return Languages([r.lang for r in rows], table / table.sum(axis=1, keepdims=True))


def language_mixtures(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, held_out, lang_pred, score and mixture (map of language to proportion).

    The model learns from texts with a language whose key is not held out; a prediction
    reads the text alone. Null texts and texts without a letter are ``und`` with score 0,
    as are all rows where nothing could be learned. Ties go to the language first in order.
    A null key is never held out; repeated rows keep a row each; other columns are not read.
    """
    model = learn(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x slots, both bounded

    def predict(batch) -> dict[str, object]:
        model, names, scores, mixtures = shared.value, [], [], []
        for value, raw in zip(batch.column(2).to_pylist(), encoded(batch.column(2))):
            if not model.names or not has_letter(value):
                names.append("und")
                scores.append(0.0)
                mixtures.append([])
                continue
            share, score = model.infer(gram_slots(raw))
            names.append(model.names[int(share.argmax())])
            scores.append(score)
            mixtures.append([(model.names[i], float(share[i])) for i in np.flatnonzero(share)])
        return {"key": batch.column(0), "held_out": batch.column(1), "lang_pred": names, "score": scores, "mixture": mixtures}

    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).cast("string"))
    schema = f"key {kind}, held_out boolean, lang_pred string, score double, mixture map<string, double>"
    return per_batch(plain, predict, schema).withColumnRenamed("key", key)
