"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Every document gets base counts (words, symbols, duplicate lines, words in repeated 8-word windows)
and the share of its words that stand in lines which the Viterbi path calls content. It is kept if
no base rule fails and that share is at least `min_content`.

Labels are given for documents, so lines get theirs by what they look like: a combination of features that is more frequent
among the lines of low-quality documents than among those of others marks boilerplate, in documents of either kind. The
field is then fitted on those line labels.

Defined cases: a null or empty text has no words, so it fails the base rule; a repeated row gets the
same answer twice; ties between paths go to content; an empty table gives an empty table; columns of
the input other than doc_id and text are ignored, whatever their names. A null doc_id stays null.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm import common

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
)
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
FEATURES = (
    "bias", "first_line", "last_line", "under_4_words", "over_25_words", "symbols_2pct", "symbols_8pct", "bars",
    "capitals_30pct", "capitals_60pct", "shouting", "digits_20pct", "neighbours_equal", "few_distinct",
    "seen_before", "ends_sentence", "digit_inside_short", "markup",
)
#: The model is fitted on at most so many labelled documents; of each, on at most DOC_BLOCKS blocks of BLOCK_LINES lines, spread evenly
#: from the first to the last. Features are taken from the whole text. This bounds the fitting only.
FIT_DOCS, DOC_BLOCKS, BLOCK_LINES = 1500, 8, 32
#: Lines that a combination's rate in both kinds of documents counts for before it is seen.
SMOOTH = 100
#: Words of a run in which distinct words are counted.
RUN = 64
MIN_CONTENT = 0.5
WINDOW = 8
_SYMBOLS, _UPPER, _LOWER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"


def _without(b: bytes, drop: bytes) -> int:
    return len(b) - len(b.translate(None, drop))


def line_features(lines: list[bytes]) -> list[tuple[list[int], int]]:
    """(indices of the features that hold, words) for each line that has a word."""
    seen: set[bytes] = set()
    out = []
    for line in lines:
        words = line.split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        symbols, upper = _without(line, _SYMBOLS), _without(line, _UPPER)
        lower, digits = _without(line, _LOWER), _without(line, _DIGITS)
        got = [0]
        if n < 4:
            got.append(3)
        elif n > 25:
            got.append(4)
        if symbols * 50 >= size:
            got.append(5)
            if symbols * 12 >= size:
                got.append(6)
            if line.count(b"|") * 6 >= n:
                got.append(7)
            if line.count(b"<") >= 2:
                got.append(17)
        if upper * 10 >= 3 * (upper + lower) and upper > 2:
            got.append(8)
            if upper * 10 >= 6 * (upper + lower):
                got.append(9)
        if line.count(b"!!") * 5 >= n:
            got.append(10)
        if digits * 5 >= size:
            got.append(11)
            if n < 8:
                got.append(16)
        if n > 3:
            if sum(map(eq, words, words[1:])) * 5 >= n:
                got.append(12)
            if sum(len(set(words[i : i + RUN])) for i in range(0, n, RUN)) * 2 < n:
                got.append(13)
        if line in seen:
            got.append(14)
        else:
            seen.add(line)
        if words[-1][-1:] in (b".", b"?", b"!"):
            got.append(15)
        out.append((got, n))
    if out:
        out[0][0].append(1)
        out[-1][0].append(2)
    return out


def viterbi(emit: list[tuple[float, float]], trans: np.ndarray) -> list[int]:
    """Best labels (1: content, 0: boilerplate) for one document's lines; ties go to content."""
    (t00, t01), (t10, t11) = trans.tolist()
    back, s0, s1 = [], emit[0][0], emit[0][1]
    for e0, e1 in emit[1:]:
        a0, b0, a1, b1 = s0 + t00, s1 + t10, s0 + t01, s1 + t11
        p0, p1 = int(b0 >= a0), int(b1 >= a1)
        s0, s1 = (b0 if p0 else a0) + e0, (b1 if p1 else a1) + e1
        back.append((p0, p1))
    y = int(s1 >= s0)
    path = [y]
    for p in reversed(back):
        y = p[y]
        path.append(y)
    return path[::-1]


def fit_crf(seqs: list[tuple[list[list[int]], list[int]]], steps: int = 100, rate: float = 0.2, decay: float = 1e-3):
    """Weights (features x 2) and transitions (2 x 2) that maximise the likelihood of labelled line sequences."""
    nf = len(FEATURES)
    w, tr = np.zeros((nf, 2)), np.zeros((2, 2))
    seqs = [s for s in seqs if s[1]]
    if not seqs:
        return w, tr
    n, longest = len(seqs), max(len(s[1]) for s in seqs)
    x, y, on = np.zeros((n, longest, nf), np.float32), np.zeros((n, longest), np.int8), np.zeros((n, longest), bool)
    for i, (feats, labels) in enumerate(seqs):
        for t, f in enumerate(feats):
            x[i, t, f] = 1
        y[i, : len(labels)], on[i, : len(labels)] = labels, True
    total = on.sum()
    gold = np.stack([(x * (on & (y == k))[..., None]).sum((0, 1)) for k in (0, 1)], 1)
    pair = on[:, 1:]
    gold_tr = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    m = [np.zeros_like(w), np.zeros_like(tr)]
    v = [np.zeros_like(w), np.zeros_like(tr)]
    for step in range(1, steps + 1):
        e = x @ w
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(alpha[:, t - 1, :1] + tr[0], alpha[:, t - 1, 1:] + tr[1]) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None], nxt, alpha[:, t - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            nxt = np.logaddexp(tr[:, 0] + ahead[:, :1], tr[:, 1] + ahead[:, 1:])
            beta[:, t] = np.where(on[:, t + 1, None], nxt, 0)
        p = np.exp(alpha + beta - z[..., None]) * on[..., None]
        want = np.stack([(x * p[..., k, None]).sum((0, 1)) for k in (0, 1)], 1)
        both = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None, None]) * pair[..., None, None]
        grads = [(gold - want) / total - decay * w, (gold_tr - both.sum((0, 1))) / total - decay * tr]
        for k, (value, g) in enumerate(zip((w, tr), grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            value += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w, tr


def blocks_of(lines: list[int]) -> list[list[int]]:
    """At most DOC_BLOCKS blocks of at most BLOCK_LINES lines, the first and the last among them."""
    every = list(common.chunks(lines, BLOCK_LINES))
    if len(every) <= DOC_BLOCKS:
        return every
    return [every[i * (len(every) - 1) // (DOC_BLOCKS - 1)] for i in range(DOC_BLOCKS)]


def line_labels(docs: list[tuple[int, list[list[int]]]]) -> list[list[list[int]]]:
    """1 (content) or 0 (boilerplate) for each line, given each document's label and its blocks of feature sets (as bit masks)."""
    seen = [Counter(), Counter()]
    for label, blocks in docs:
        seen[label].update(m for block in blocks for m in block)
    lines = [sum(c.values()) for c in seen]
    total = sum(lines)

    def rate(label: int, m: int) -> float:
        return (seen[label][m] + SMOOTH * (seen[0][m] + seen[1][m]) / total) / (lines[label] + SMOOTH)

    content = {m: int(not lines[0] or (lines[1] > 0 and rate(1, m) >= rate(0, m))) for m in {*seen[0], *seen[1]}}
    return [[[content[m] for m in block] for block in blocks] for _, blocks in docs]


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS):
    """Fit the field on a bounded sample of labelled documents (at most fit_docs of them)."""
    common.ship(docs.sparkSession)
    rows = common.training_rows(docs, labels, "quality", fit_docs)

    def lines(batches):
        for b in batches:
            masks = [[sum(1 << f for f in found) for found, _ in line_features(t.encode().split(b"\n"))] for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "blocks": [blocks_of(m) for m in masks]})

    got = sorted((int(r["label"] > 0), r["blocks"]) for r in rows.select("text", "label").mapInPandas(lines, "label int, blocks array<array<int>>").toLocalIterator())
    features = lambda m: [f for f in range(len(FEATURES)) if m >> f & 1]
    return fit_crf([([features(m) for m in block], own) for (_, blocks), marks in zip(got, line_labels(got)) for block, own in zip(blocks, marks)])


def repeat_words(words: list[list[bytes]]) -> list[int]:
    """For each document: words that stand in an 8-word window found twice or more in it.

    Hashes of all windows of a batch find the documents with a repeated window; only those are
    counted on the words themselves, so a clash of hashes changes nothing.
    """
    sizes = np.array([len(w) for w in words])
    out = [0] * len(words)
    total = int(sizes.sum())
    if total < WINDOW:
        return out
    h = np.fromiter((hash(x) for w in words for x in w), np.int64, total).view(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    roll = np.zeros(total - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[j : total - WINDOW + 1 + j]
    inside = owner[: total - WINDOW + 1] == owner[WINDOW - 1 :]
    own = owner[: total - WINDOW + 1][inside]
    key = (roll[inside] ^ (own.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    for d in np.unique(own[1:][key[1:] == key[:-1]]).tolist():
        w = words[d]
        ids: dict = {}
        code = [ids.setdefault(x, len(ids)) for x in w]
        windows = list(zip(*(code[j:] for j in range(WINDOW))))
        count = Counter(windows)
        covered, last = 0, 0
        for i, x in enumerate(windows):
            if count[x] > 1:
                covered += i + WINDOW - max(i, last)
                last = i + WINDOW
        out[d] = covered
    return out


def rule_rows(texts: list[str], weights: list, trans: np.ndarray, min_content: float) -> list[tuple]:
    """The columns of SCHEMA after doc_id for each text."""
    rows = []
    raws = [t.encode() for t in texts]
    words = [r.split() for r in raws]
    for text, raw, own, again in zip(texts, raws, words, repeat_words(words)):
        n = len(own)
        lines = raw.split(b"\n")
        feats = line_features(lines)
        blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
        seen, dup = set(), 0
        for line in lines:
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
        share, n_content = 0.0, 0
        if feats:
            path = viterbi([(sum(weights[f][0] for f in fs), sum(weights[f][1] for f in fs)) for fs, _ in feats], trans)
            share = sum(k for y, (_, k) in zip(path, feats) if y) / n
            n_content = sum(path)
        failed = n < 20 or 100 * again > 30 * n
        rows.append((n, len(text) - blank, _without(raw, _SYMBOLS), dup, again, failed, not failed and share >= min_content, share, len(feats), n_content))
    return rows


def apply_rules(docs: DataFrame, model, min_content: float = MIN_CONTENT) -> DataFrame:
    """Base counts, content share and verdict for every row of docs (columns: SCHEMA)."""
    common.ship(docs.sparkSession)
    weights, trans = np.asarray(model[0]).tolist(), np.asarray(model[1])

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in common.bounded(batches):
            rows = rule_rows(b.column("text").to_pylist(), weights, trans, min_content)
            columns = list(zip(*rows)) or [[] for _ in names[1:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], names)

    return common.text_rows(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    weights, trans = np.asarray(model[0]).tolist(), np.asarray(model[1])
    return common.keep_rows(docs, lambda texts: [r[6] for r in rule_rows(texts, weights, trans, min_content)])


def quality_rules(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT) -> DataFrame:
    return apply_rules(docs, train(docs, labels), min_content)
