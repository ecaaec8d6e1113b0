"""Quality classifier: nearest-neighbour voting over labelled latent-semantic vectors.

A text becomes weighted counts of its words (hashed to WORD_TERMS terms), of pairs of character kinds, and a few terms for repetition;
a truncated singular value decomposition of the labelled sample gives the latent space. The sample's
vectors (at most FIT_DOCS x RANK floats) are broadcast, every document's cosine with all of them is
computed in blocks, and the K nearest vote with their similarity as weight.

Defined cases: a null or empty text has no direction, so its score is the sample's share of label 1;
ties in similarity go to the lower sample row; a repeated row gets the same score twice; without any
usable label all scores are 0.5; cosines are compared to DECIMALS places; an empty table gives an empty table; columns other than doc_id and
text are ignored. A null doc_id stays null and counts as not held out.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

#: At most so many labelled documents are vectors to vote with: the bound of the broadcast.
FIT_DOCS = 4096
WORD_TERMS, RANK, K, BLOCK, DECIMALS = 1024, 64, 15, 1024, 5
THRESHOLD = 0.3
REPEAT_WEIGHT = 1.5
SCHEMA = "doc_id long, score double, predicted int, nearest double"

#: Words: runs of letters, digits not among them, as UTF-8 in lower case.
_WORDS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_KINDS = np.zeros(256, np.int64)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 4
for _i, _c in enumerate(b" \t\n\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KINDS[_c] = 5 + _i
N_KINDS = int(_KINDS.max()) + 1
N_PAIRS = N_KINDS * N_KINDS
N_TERMS = N_PAIRS + WORD_TERMS
REPEATS = ("same_as_neighbour", "four_words_again", "line_again", "few_words")


def term_counts(text: str) -> np.ndarray:
    """ln(1 + count) of each pair of character kinds and of each word term; then the repetition terms as shares."""
    out = np.zeros(N_TERMS + len(REPEATS), np.float32)
    raw = text.encode()
    if not raw:
        return out
    kinds = _KINDS[np.frombuffer(raw, np.uint8)]
    counts = np.bincount(kinds[:-1] * N_KINDS + kinds[1:], minlength=N_PAIRS)
    out[:N_PAIRS] = np.log1p(counts) + (counts > 0) * 0.3
    found = _WORDS.findall(raw.lower())
    out[N_PAIRS:N_TERMS] = np.log1p(np.bincount(np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % WORD_TERMS, minlength=WORD_TERMS))
    words = raw.split()
    n = len(words)
    if n > 4:
        out[N_TERMS] = sum(map(eq, words, words[1:])) / n
        out[N_TERMS + 1] = 1 - len(set(zip(words, words[1:], words[2:], words[3:]))) / (n - 3)
    lines = raw.split(b"\n")
    out[N_TERMS + 2] = 1 - len(set(lines)) / len(lines)
    out[N_TERMS + 3] = n < 6
    return out


def directions(x: np.ndarray, rank: int, turns: int = 6) -> np.ndarray:
    """The first right singular vectors of x (rows x terms), by subspace iteration from a fixed start."""
    q = np.random.RandomState(7).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(turns):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T


class Space:
    """Term weights and latent directions learnt from the labelled sample."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        df = (counts > 0).sum(0)
        self.weight = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        x = self.weigh(counts)
        self.basis = directions(x, RANK).astype(np.float32)
        self.vectors = self.unit(x @ self.basis)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Weighted counts, words and pairs of kinds each of length 1, repetition beside them."""
        x = counts * self.weight
        for part in (x[:, :N_PAIRS], x[:, N_PAIRS:N_TERMS]):
            size = np.linalg.norm(part, axis=1, keepdims=True)
            part /= np.where(size > 0, size, 1)
        x[:, N_TERMS:] = REPEAT_WEIGHT * np.sqrt(counts[:, N_TERMS:])
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample rows of the K greatest cosines, and these, for each unit vector; equal ones by sample row."""
        cos = np.round((q @ self.vectors.T).astype(np.float64), DECIMALS)
        k = min(K, cos.shape[1])
        least = np.partition(cos, -k, axis=1)[:, -k, None]
        above = cos > least
        # Of those equal to the k-th greatest, the first rows fill the places that are left.
        chosen = above | ((cos == least) & (np.cumsum(cos == least, axis=1) <= k - above.sum(1, keepdims=True)))
        rows = np.nonzero(chosen)[1].reshape(-1, k)
        return rows, np.take_along_axis(cos, rows, 1)

    def vote(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and the nearest similarity for one block of documents."""
        q = self.unit(self.weigh(counts) @ self.basis)
        near, sims = self.nearest(q)
        w = sims.clip(0, 1) + 1e-12
        score = (w * self.labels[near]).sum(1) / w.sum(1)
        blank = ~q.any(axis=1)
        score[blank] = self.prior
        return score.clip(0, 1), np.where(blank, 0, w.max(1))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Space | None:
    """Fit on at most fit_docs labelled rows whose crc32(doc_id) mod 5 is not 0; None if there are none."""
    common.ship(docs.sparkSession)
    rows = common.training_rows(docs, labels, "quality", fit_docs, common.fold_of(5) != 0)

    def counts(batches):
        for b in batches:
            found = [term_counts(t) for t in b["text"]]
            places = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "places": [p.astype("<u2").tobytes() for p in places], "counts": [x[p].tobytes() for x, p in zip(found, places)]})

    sparse = rows.select("doc_id", "text", "label").mapInPandas(counts, "doc_id long, label int, places binary, counts binary")
    got = {r[0]: r[1:] for r in sparse.toLocalIterator()}
    if not got:
        return None
    dense = np.zeros((len(got), N_TERMS + len(REPEATS)), np.float32)
    for x, i in zip(dense, sorted(got)):
        x[np.frombuffer(got[i][1], "<u2")] = np.frombuffer(got[i][2], np.float32)
    return Space(dense, np.array([got[i][0] for i in sorted(got)]))


def score_quality(docs: DataFrame, space: Space | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and the nearest similarity for every row of docs."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(space)

    def run(batches):
        own = shared.value
        for b in common.bounded(batches):
            texts = b.column("text").to_pylist()
            score, nearest = np.full(len(texts), 0.5), np.zeros(len(texts))
            for i in range(0, len(texts), BLOCK) if own is not None else ():
                block = slice(i, i + BLOCK)
                score[block], nearest[block] = own.vote(np.stack([term_counts(t) for t in texts[block]]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype("int32")), pa.array(nearest)],
                ["doc_id", "score", "predicted", "nearest"],
            )

    return common.text_rows(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, space: Space | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least `threshold`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def judge(texts: list[str]) -> list[bool]:
        if shared.value is None:
            return [True] * len(texts)
        return [x >= threshold for some in common.chunks(texts, BLOCK) for x in shared.value.vote(np.stack([term_counts(t) for t in some]))[0].tolist()]

    return common.keep_rows(docs, judge)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(common.fold_of(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "nearest")
