"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lowers case, applies NFKC, drops zero-width characters, maps look-alike letters of other scripts
to Latin ones, and undoes digit and symbol substitutions. Lexicon and calibration are learnt from a
bounded sample of labelled rows: a term's weight is its log-odds between toxic and other texts,
counted over distinct contexts (word before, word after), so that copies of one text count once.
Hits inside exception phrases do not count, and hits must be whole words.

Defined cases: a null or empty text has no hits and so the lowest score; a repeated row gets the same
score twice; without toxic labels in the sample the lexicon is empty and all scores are equal; an
empty table gives an empty table; columns other than doc_id and text are ignored; a null doc_id stays
null and counts as not held out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

#: At most so many labelled documents are fitted on. That and MIN_SHARE also bound the lexicon that is broadcast.
FIT_DOCS = 10000
#: A term must stand in so many distinct contexts of toxic texts, and so large a share of the toxic texts.
MIN_CONTEXTS, MIN_SHARE, MIN_WEIGHT = 3, 0.004, 1.5
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double, predicted int, n_hits long, weight double, n_words long"

#: Letters of other scripts that look like Latin ones, and the digits used for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SYMBOLS = {"@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser", "rodeo clown", "pond scum", "idiot proof")
_DROP = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | _DROP
_SYMBOL = re.compile(r"(?<=[^\W\d_])[@$!]+(?=[^\W\d_])|(?<![\w@$!])[@$](?=[^\W\d_]{2})")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
    text = text.translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _SYMBOL.sub(lambda m: "".join(SYMBOLS[c] for c in m[0]), text)
    return text


def words_in(text: str) -> int:
    """Words, which end at any ASCII white space."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    return int(inside[:1].sum() + (inside[1:] > inside[:-1]).sum())


class Lexicon:
    """Terms with weights, exception phrases and calibration; builds its automaton where it is used."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, calibration: tuple[float, ...] = (-3.0, 2.0, 1.0)):
        self.weights, self.exceptions, self.calibration, self._found = weights, tuple(fold(x) for x in exceptions), calibration, None

    def __getstate__(self):
        return {**self.__dict__, "_found": None}

    @property
    def automaton(self):
        if self._found is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(w, (len(w), x))
            for p in self.exceptions:
                a.add_word(p, (len(p), None))
            if len(a):
                a.make_automaton()
            self._found = a
        return self._found

    def hits(self, folded: str) -> list[float]:
        """Weights of the whole-word hits outside exception phrases."""
        if not len(self.automaton):
            return []
        found, safe = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if (start and folded[start - 1].isalnum()) or (end + 1 < len(folded) and folded[end + 1].isalnum()):
                continue
            if weight is None:
                safe.append((start, end))
            else:
                found.append((start, end, weight))
        if safe:
            found = [x for x in found if not any(s <= x[0] and x[1] <= e for s, e in safe)]
        return [x[2] for x in found]

    def features(self, text: str) -> tuple[int, float, int]:
        hits = self.hits(fold(text))
        return len(hits), sum(hits), words_in(text)

    def score(self, weight, words):
        """Probability from the summed weight and the weight for each 100 words."""
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-(a + b * np.log1p(weight) + c * np.log1p(100 * weight / np.maximum(words, 20)))))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn terms and calibration from at most fit_docs labelled rows whose crc32(doc_id) mod 4 is not 2."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.training_rows(docs, labels, "toxic", fit_docs, common.fold_of(4) != 2).select("text", "label")

    def explode(batches):
        for b in batches:
            got = {(w, a, int(y)) for t, y in zip(b["text"], b["label"]) for w, a in contexts(t)}
            yield pd.DataFrame(list(got), columns=["term", "around", "label"])

    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon({}, exceptions)
    if not toxic or not other:
        return lexicon
    counts = (
        rows.mapInPandas(explode, "term string, around long, label int").distinct()
        .groupBy("term").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o"))
    )
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("o") + 0.5) / (other + 1.0))
    terms = (
        counts.where((F.col("t") >= max(MIN_CONTEXTS, MIN_SHARE * toxic)) & (weight >= MIN_WEIGHT))
        .select("term", weight.alias("w")).orderBy(F.desc("w"), "term").collect()
    )
    lexicon = Lexicon({r["term"]: r["w"] for r in terms}, exceptions)
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches):
        for b in batches:
            got = [shared.value.features(t) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "weight": [float(x[1]) for x in got], "words": [x[2] for x in got]})

    lexicon.calibration = calibrate(lexicon, rows.mapInPandas(measure, "label int, weight double, words long").toPandas())
    return lexicon


def contexts(text: str) -> set[tuple[str, int]]:
    """Each word with a checksum of the words before and after it."""
    words = _WORD.findall(fold(text))
    return {(w, zlib.crc32(f"{a} {b}".encode())) for w, a, b in zip(words, ["", *words], [*words[1:], ""])}


def calibrate(lexicon: Lexicon, seen: pd.DataFrame, steps: int = 400, rate: float = 0.1) -> tuple[float, ...]:
    """Logistic regression of the label on the two length-aware features, non-negative in both."""
    x = np.stack([np.ones(len(seen)), np.log1p(seen["weight"]), np.log1p(100 * seen["weight"] / np.maximum(seen["words"], 20))], 1)
    y, w = seen["label"].to_numpy(float), np.array(lexicon.calibration)
    m, v = np.zeros(3), np.zeros(3)
    for i in range(1, steps + 1):
        g = x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(x) - 1e-3 * w * [0, 1, 1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w[1:] = w[1:].clip(0)
    return tuple(w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        own = shared.value
        for b in common.bounded(batches):
            got = [own.features(t) for t in b.column("text").to_pylist()]
            hits, weight, words = (np.array([x[i] for x in got], kind) for i, kind in enumerate((np.int64, np.float64, np.int64)))
            score = own.score(weight, words)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, (score, (score >= threshold).astype("int32"), hits, weight, words))],
                ["doc_id", "score", "predicted", "n_hits", "weight", "n_words"],
            )

    return common.text_rows(docs).mapInArrow(run, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(common.fold_of(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "n_hits", "weight", "n_words")
