"""License scans with a positional index of rare licence words."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta.llm.common import encoded, per_batch

# Phrases whose places are counted, with their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Licence wordings (label, wording, phrases that must be present), lower case.
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license version 3",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0-1.0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", ("lesser general public license version 2 1",)),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("lesser general public license version 3",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
)

# Bytes that end a word (all ASCII but digits and lower-case letters).
_BREAKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

#: Words of each wording looked up in a file, the rarest that the file holds first.
LOOKED_UP = 24
#: Share of a wording's words that must stand at their place around the verified phrases.
LEAST_SHARE = 0.5


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BREAKS).split()


class Index:
    """Postings of all wordings by word: (wording, position), with the weight of each word."""

    def __init__(self, templates: tuple, base: dict[str, str], idf: dict[bytes, float]) -> None:
        self.idf = idf
        self.labels = [label for label, _, _ in templates]
        self.texts = [wording.encode().split() for _, wording, _ in templates]
        self.keys = [[key.encode().split() for key in keys] for _, _, keys in templates]
        self.needs = [frozenset(word for key in keys for word in key) for keys in self.keys]
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, text in enumerate(self.texts):
            for at, word in enumerate(text):
                self.postings[word].append((k, at))
        self.vocabulary = frozenset(self.postings) | {word for phrase, _ in self.base for word in phrase}

    def phrase_at(self, words: list[bytes], places: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
        """Starts of a phrase: places of its rarest word, checked by relative position."""
        rarest = max(range(len(phrase)), key=lambda i: (self.idf.get(phrase[i], 0.0), i))
        found = places.get(phrase[rarest], ())
        return [at - rarest for at in found if at >= rarest and words[at - rarest : at - rarest + len(phrase)] == phrase]

    def scan(self, words: list[bytes], looked_up: int, least: float) -> tuple[list[int], set[str], set[str], float]:
        """Starts of the base phrases, base labels, labels of the wordings and the best share."""
        present = self.vocabulary.intersection(words)
        starts: list[int] = []
        base: set[str] = set()
        if not present:
            return starts, base, set(), 0.0
        candidates = [k for k, need in enumerate(self.needs) if need <= present]
        phrases = [(p, label) for p, label in self.base if present.issuperset(p)]
        if not candidates and not phrases:
            return starts, base, set(), 0.0
        ranked = {k: sorted(present.intersection(self.texts[k]), key=lambda w: (-self.idf.get(w, 0.0), w))[:looked_up] for k in candidates}
        wanted = set().union(*ranked.values(), *(p for p, _ in phrases), *(self.needs[k] for k in candidates))
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in wanted:
                places[word].append(at)
        for phrase, label in phrases:
            if found := self.phrase_at(words, places, phrase):
                starts += found
                base.add(label)
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for k, rarest in ranked.items():
            for word in rarest:
                for own, at in self.postings[word]:
                    if own == k:
                        for place in places[word]:
                            votes[k, place - at] += 1
        more: set[str] = set()
        best = 1.0 if base else 0.0
        by_template: dict[int, list[int]] = defaultdict(list)
        for k, start in votes:
            by_template[k].append(start)
        for k, begun in by_template.items():
            text, verified = self.texts[k], [self.phrase_at(words, places, key) for key in self.keys[k]]
            if not all(verified):
                continue
            for start in begun:
                reach = range(start - len(text), start + 2 * len(text))
                if all(any(at in reach for at in places_of) for places_of in verified):
                    share = sum(
                        0 <= start + i < len(words) and words[start + i] == word for i, word in enumerate(text)
                    ) / len(text)
                    if share >= least:
                        more.add(self.labels[k])
                        best = max(best, share)
        return starts, base, more, best


def document_frequencies(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents and, per licence word, of documents that hold it; over all rows."""

    def count(batch) -> dict[str, object]:
        held: dict[bytes, int] = defaultdict(int)
        texts = encoded(batch.column(0))
        for value in texts:
            for word in vocabulary.intersection(words_of(value)):
                held[word] += 1
        return {"word": ["", *(w.decode() for w in held)], "n": [len(texts), *held.values()]}

    counted = per_batch(docs.select(F.col(text).cast("string")), count, "word string, n long")
    # one row per licence word at most
    found = {row.word.encode(): row.n for row in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def scan_licences(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple = TEMPLATES, base: dict[str, str] = BASE,
    looked_up: int = LOOKED_UP, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Licences named or quoted in each text.

    One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels,
    score. Word weights come from the document frequencies of the whole table; the index has
    as many entries as the wordings have words. A wording counts where the positions of rare
    words agree, its mandatory phrases stand near and enough of its words are in place; score
    is that share (1 for a base phrase, 0 for nothing). Null and empty texts have no words and
    no labels; repeated rows and null keys keep a row each; other columns are not read.
    """
    bare = Index(templates, base, {})
    n_docs, held = document_frequencies(docs, text, bare.vocabulary)
    idf = {word: math.log((n_docs + 1) / (held.get(word, 0) + 1)) for word in bare.vocabulary}
    index = Index(templates, base, idf)

    def scan(batch) -> dict[str, object]:
        out: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for value in encoded(batch.column(1)):
            words = words_of(value)
            starts, named, more, share = index.scan(words, looked_up, least_share)
            row = (
                len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(named)), ",".join(sorted(named | more)), share,
            )
            for name, item in zip(out, row, strict=True):
                out[name].append(item)
        return {"key": batch.column(0), **out, "score": np.array(out["score"], dtype=float)}

    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    return per_batch(docs.select(key, F.col(text).cast("string")), scan, schema).withColumnRenamed("key", key)
