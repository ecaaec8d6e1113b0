"""Token counts of a sentencepiece BPE vocabulary by a two-tier lookup on the map side.

No piece of the vocabulary has a space mark after another character, and no piece holds a line feed, so a text's tokens are
those of its pre-tokens: a run of spaces with the word that follows, also cut before each line feed.
Tier one is a compact hash table of the most frequent pre-tokens' lengths, broadcast; tier two is a cache in each worker
for what the library had to encode. The pre-tokens of the texts are not shuffled, before counting or after: each task keeps a
bounded summary of its own frequent pre-tokens; only these summaries are merged, in a tree, to a table of TABLE entries at most.

Defined cases: a null or empty text has 0 tokens; a repeated row gets the same count twice; very long
texts are counted whole; an empty table gives an empty table; columns other than doc_id and text are
ignored; a null doc_id stays null. A text of white space only is counted as the library does.
"""

from __future__ import annotations

import os
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import common

#: Entries of the broadcast table, entries of each task's summary, and entries a worker's cache may hold.
TABLE, SUMMARY, CACHE = 32768, 8192, 400_000
LIMIT = 4096
MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_workers: dict = {}


def worker(model: str):
    """The library's processor and this worker's cache, kept from task to task."""
    found = _workers.get(model)
    if found is None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in own):
            raise ValueError("pieces of this vocabulary cross the borders of pre-tokens")
        found = _workers[model] = (sp, {})
    return found


def pretokens(text: str) -> list[str]:
    """The pre-tokens of one text, each without the mark that it starts with.

    A part after a line feed starts with that line feed instead; the library then puts a mark before
    it that the text does not have, which count_tokens takes off again.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "):
        return text.replace("\n", " \n").split(" ")
    out = []
    for i, line in enumerate(text.split("\n")):
        parts, spaces = line.split(" "), 0
        if i:
            out.append("\n" + parts.pop(0))
        for part in parts:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(" " * (spaces - 1))
    return out


def lengths_of(words: list[str], model: str) -> list[int]:
    """Tokens of each pre-token: a mark alone is one; the mark before a line feed counts here."""
    sp, _ = worker(model)
    return [max(1, len(x)) for x in sp.encode(words, num_threads=1)] if words else []


def frequent(docs: DataFrame, size: int = TABLE, summary: int = SUMMARY) -> list[str]:
    """The pre-tokens that are frequent over all documents.

    Each task counts its own and hands on its `summary` most frequent as one row; rows are merged to
    1024, 32 and then one, each merge bounded by `size`. What reaches the driver has that bound.
    """

    def count(batches):
        seen: Counter = Counter()
        for b in common.bounded(batches):
            for t in b.column("text").to_pylist():
                seen.update(pretokens(t))
            if len(seen) > 40 * summary:
                seen = Counter(dict(seen.most_common(10 * summary)))
        top = seen.most_common(summary)
        yield pa.RecordBatch.from_arrays([pa.array([[w for w, _ in top]]), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["words", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        seen: Counter = Counter()
        for words, counts in zip(rows["words"], rows["counts"]):
            for w, n in zip(words, counts):
                seen[w] += int(n)
        top = seen.most_common(size)
        return pd.DataFrame({"words": [[w for w, _ in top]], "counts": [[n for _, n in top]]})

    schema = "words array<string>, counts array<long>"
    parts = docs.mapInArrow(count, schema).withColumn("task", F.spark_partition_id())
    for width in (1024, 32, 1):
        parts = parts.groupBy((F.col("task") % width).alias("task")).applyInPandas(lambda key, rows: merge(rows).assign(task=key[0]), f"{schema}, task int")
    return [w for r in parts.collect() for w in r["words"]]


def count_tokens(docs: DataFrame, model: str, size: int = TABLE) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text of docs under the vocabulary file `model`."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.text_rows(docs)
    words = frequent(rows.select("text"), size)
    table = spark.sparkContext.broadcast(dict(zip(words, lengths_of(words, model))))
    at = os.fspath(model)

    def run(batches):
        first = table.value
        cache = worker(at)[1]
        for b in common.bounded(batches):
            texts = b.column("text").to_pylist()
            split = [pretokens(t) for t in texts]
            misses = list({w for ws in split for w in ws if w not in first and w not in cache})
            if len(cache) + len(misses) > CACHE:
                cache.clear()
                misses = list({w for ws in split for w in ws if w not in first})
            for some in common.chunks(misses, 4096):
                cache.update(zip(some, lengths_of(some, at)))
            totals = []
            for t, ws in zip(texts, split):
                n = 0
                for w in ws:
                    k = first.get(w)
                    n += cache[w] if k is None else k
                totals.append(n - t.count("\n"))
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, SCHEMA)


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    return count_tokens(docs, model).withColumn("over_limit", F.col("n_tokens") > limit)
