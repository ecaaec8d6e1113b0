"""Two tokenizers' tokens of the same text, aligned at the byte places where both end one.

Texts are cut into chunks at spaces between words, where both tokenizers end a token. For a chunk the cumulative byte ends of both
token lists become dictionaries from end to index. The ends that both hold, sorted, cut both lists into groups; inside a group every
pair of tokens whose bytes overlap is a link. A chunk that its worker has met lately is read from a cache of such results. Of a
document only its distinct links and how often each stands in it go on. They are summed over the corpus to one count a pair. The
documents then look their links up in two tiers: the most frequent pairs, at most TABLE of them, are broadcast; the rest meets its
documents in a join, where no key is hot, because a pair outside the table has fewer links than each of the pairs inside.

Defined cases: a null or empty text, and one whose tokens do not give its bytes back (one with U+2581), has no tokens: zeros
and an empty digest; each copy of a repeated row counts and gets the same columns; texts of any length are aligned whole, in parts of
about SEGMENT characters; an empty table gives an empty table; columns other than doc_id and text are ignored; a null doc_id stays
null; ties of counts are all best.
"""

from __future__ import annotations

import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm import byte_bpe, common
from sightline.llm.token_counts import MARK

#: Characters taken at once, chunks in each of the two generations of a worker's cache, characters of a chunk that is remembered,
#: and pairs of the broadcast table (17 bytes each).
SEGMENT, CACHE, SHORT, TABLE = 200_000, 200_000, 100, 2**20
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
#: What a text without tokens has.
NOTHING = (0, 0, 0, 0, "", [], [])

_workers: dict = {}
#: A space between two words: both tokenizers end a token before it.
_BORDER = re.compile(r" (?<=\S )(?=\S)")


class Aligner:
    """Tokenizer A: a byte-level BPE vocabulary, of a space and the text. Tokenizer B: a sentencepiece model, which adds that space."""

    def __init__(self, vocabulary: str, model: str, unlike: tuple[str, str, str], cache_size: int = CACHE):
        import sentencepiece

        self.a = byte_bpe.Codec(vocabulary, unlike, special=False, cache_size=cache_size // 3)
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size, self.cache_size, self.young, self.old = sp.get_piece_size(), cache_size, {}, {}
        own = [sp.id_to_piece(i) for i in range(self.size)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in own)
        self.bytes_a = [x.as_py() for x in self.a.table]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(own)]
        self.length_a, self.length_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = ([str(i) for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))

    def align(self, part: str, ids_a: np.ndarray, ids_b: np.ndarray):
        """Ends of the part's groups in bytes and in tokens of A and B, their texts, its links, and the group of each link.

        None if either list of tokens does not give the part's bytes, after a space, back.
        """
        raw, list_a, list_b = (" " + part).encode(), ids_a.tolist(), ids_b.tolist()
        if b"".join(map(self.bytes_a.__getitem__, list_a)) != raw or b"".join(map(self.bytes_b.__getitem__, list_b)) != raw:
            return None
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]).tolist(), np.cumsum(self.length_b[ids_b]).tolist()
        index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
        ends = sorted(index_a.keys() & index_b.keys())
        stop_a, stop_b = list(map(index_a.__getitem__, ends)), list(map(index_b.__getitem__, ends))
        size, text_a, text_b, texts, links, of_group, i, j = self.size, self.text_a, self.text_b, [], [], [], 0, 0
        for k, m in zip(stop_a, stop_b):
            if k - i == 1 and m - j == 1:
                a, b = list_a[i], list_b[j]
                texts.append(f"{text_a[a]}|{text_b[b]}")
                links.append(a * size + b)
                of_group.append(1)
            else:
                texts.append(",".join([text_a[a] for a in list_a[i:k]]) + "|" + ",".join([text_b[b] for b in list_b[j:m]]))
                of_group.append(k - i + m - j - 1)
                while i < k and j < m:
                    links.append(list_a[i] * size + list_b[j])
                    i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
            i, j = k, m
        return ends, stop_a, stop_b, texts, links, of_group

    def learn(self, chunks: list[str]) -> dict:
        """What look_up() gives for chunks not met before: they are aligned side by side, as one part with a space between each two.

        A chunk that begins or ends with white space, as a text's first and last may, is a part of its own.
        """
        out, todo, at = {}, [[c] for c in chunks if c != c.strip()], 0
        chunks = [c for c in chunks if c == c.strip()]
        while at < len(chunks):
            some, chars = [], 0
            while at < len(chunks) and (not some or chars + len(chunks[at]) < SEGMENT):
                some.append(chunks[at])
                chars += len(chunks[at]) + 1
                at += 1
            todo.append(some)
        for some in todo:
            part = " ".join(some)
            ids_a = np.frombuffer(self.a.encode([" " + part])[0], "<u4").astype(np.int64)
            found = self.align(part, ids_a, np.array(self.b.encode([part], num_threads=1)[0], np.int64))
            if found is None:
                if len(some) == 1:
                    out[part] = None
                else:
                    half = len(some) // 2
                    out |= self.learn(some[:half]) | self.learn(some[half:])
                continue
            ends, stop_a, stop_b, texts, links, of_group = found
            stops = np.cumsum(np.fromiter((len(c.encode()) + 1 for c in some), np.int64, len(some)))
            at_stop = np.searchsorted(ends, stops)
            if (np.array(ends)[at_stop] != stops).any():
                raise ValueError("a chunk does not end where both tokenizers end a token")
            more = np.diff(np.array(stop_a)[at_stop] - np.array(stop_b)[at_stop], prepend=0).tolist()
            raw, starts, last = np.array(links, "<i8").tobytes(), (8 * np.cumsum([0, *of_group])).tolist(), 0
            for c, g, d in zip(some, (at_stop + 1).tolist(), more):
                out[c] = ";".join(texts[last:g]), raw[starts[last] : starts[g]], d
                last = g
        return out

    def look_up(self, chunks: list[str]) -> list:
        """(text of its groups, its links, tokens of A more than of B) of each chunk, or None where tokens do not give its bytes back; through the cache."""
        wanted = set(chunks)
        new = wanted.difference(self.young)
        if len(self.young) + len(new) > self.cache_size:
            self.young, self.old = {}, self.young
            new = wanted
        again = new.intersection(self.old)
        self.young.update((c, self.old[c]) for c in again)
        fresh = self.learn([c for c in new if c not in again])
        self.young.update((c, x) for c, x in fresh.items() if len(c) <= SHORT)
        return [fresh[c] if c in fresh else self.young[c] for c in chunks] if fresh else list(map(self.young.__getitem__, chunks))

    def parts(self, text: str):
        """The text's chunks, in lists of about SEGMENT characters."""
        at = 0
        while self.cuts and len(text) - at > SEGMENT:
            found = _BORDER.search(text, at + SEGMENT)
            if not found:
                break
            yield _BORDER.split(text[at : found.start()])
            at = found.end()
        yield _BORDER.split(text[at:]) if self.cuts else [text]

    def document(self, parts) -> tuple:
        """n_a, n_b, n_groups, n_links, digest, pairs and times of one text, given as lists of look_up()'s answers."""
        more_a = n_links = n_groups = 0
        digest, pairs, times = hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for answers in parts:
            if None in answers:
                return NOTHING
            texts, links, sums = zip(*answers)
            text = ";".join(texts)
            digest.update(((";" if n_groups else "") + text).encode())
            n_groups += text.count(";") + 1
            more_a += sum(sums)
            found = np.frombuffer(b"".join(links), "<i8")
            n_links += len(found)
            more, n = np.unique(found, return_counts=True)
            if len(pairs):
                more, back = np.unique(np.concatenate([pairs, more]), return_inverse=True)
                total = np.zeros(len(more), np.int64)
                np.add.at(total, back, np.concatenate([times, n]))
                n = total
            pairs, times = more, n
        # A group of a and b tokens has a + b - 1 links.
        both = n_links + n_groups
        return (both + more_a) // 2, (both - more_a) // 2, n_groups, n_links, digest.hexdigest(), pairs, times

    def documents(self, texts: list[str]):
        """Rows of many texts; short ones pass through the cache together."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > SEGMENT:
                yield self.document(map(self.look_up, self.parts(texts[at])))
                at += 1
                continue
            split, chars = [], 0
            while at < len(texts) and len(texts[at]) <= SEGMENT and chars < SEGMENT:
                split.append(next(self.parts(texts[at])) if texts[at] else [])
                chars += len(texts[at])
                at += 1
            answers, begin = self.look_up([c for chunks in split for c in chunks]), 0
            for chunks in split:
                yield self.document([answers[begin : begin + len(chunks)]]) if chunks else NOTHING
                begin += len(chunks)


def worker(vocabulary: str, model: str, unlike: tuple[str, str, str]) -> Aligner:
    if (vocabulary, model) not in _workers:
        _workers[vocabulary, model] = Aligner(vocabulary, model, unlike)
        # What is remembered has no cycles: the collector need not walk it again for every few thousand new chunks.
        gc.set_threshold(200_000, 50, 50)
    return _workers[vocabulary, model]


def aligned(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """One row for each document: its numbers, the digest of its groups, and its distinct links (a * size of B + b) with how often each stands in it."""
    common.ship(docs.sparkSession)
    unlike = byte_bpe.unlike_characters()

    def run(batches):
        own = worker(vocabulary, model, unlike)
        for b in common.bounded(batches):
            ids = b.column("doc_id")
            rows = own.documents(b.column("text").to_pylist())
            for at in range(0, b.num_rows, 64):
                some = [r for _, r in zip(range(min(64, b.num_rows - at)), rows)]
                columns = list(zip(*some))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 64), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), *(pa.array(c, pa.list_(pa.int64())) for c in columns[5:])],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return common.text_rows(docs).mapInArrow(run, SCHEMA)


def link_counts(rows: DataFrame, size: int) -> DataFrame:
    """pair, its links in the corpus, and whether no pair of the same B id has more. The maxima are one row for each B id."""
    total = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("total"))
    total = common.materialize(total)
    most = total.groupBy((F.col("pair") % size).alias("b")).agg(F.max("total").alias("most"))
    return total.join(F.broadcast(most), F.col("pair") % size == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, table: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count of the most frequent pairs, at most `table` of them, and these pairs, counts and marks.

    The bound is a power of two, found from how many pairs have each number of binary digits, so ties never exceed the table.
    """
    digits = {r["d"]: r["n"] for r in counts.groupBy(F.length(F.bin("total")).alias("d")).agg(F.count("*").alias("n")).collect()}
    least, held = 64, 0
    while least > 1 and held + digits.get(least - 1, 0) <= table:
        least -= 1
        held += digits.get(least, 0)
    bound = 1 << (least - 1) if least < 64 else 2**63 - 1
    found = counts.where(F.col("total") >= bound).toPandas().sort_values("pair")
    return bound, found["pair"].to_numpy(np.int64), found["total"].to_numpy(np.int64), found["best"].to_numpy(bool)


def token_alignment(docs: DataFrame, vocabulary: str, model: str, table: int = TABLE) -> DataFrame:
    """For each document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    import sentencepiece

    spark = docs.sparkSession
    size = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    rows = common.materialize(aligned(docs, vocabulary, model).withColumn("row", F.monotonically_increasing_id()))
    counts = common.materialize(link_counts(rows, size))
    bound, *top = frequent(counts, table)
    top = spark.sparkContext.broadcast(tuple(top))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches):
        pairs, totals, best = top.value
        for b in common.bounded(batches):
            mine, times = (b.column(c) for c in ("pairs", "times"))
            sizes = np.diff(mine.offsets.to_numpy())
            of_row = np.repeat(np.arange(len(sizes)), sizes)
            key, n = mine.flatten().to_numpy(), times.flatten().to_numpy()
            at = np.searchsorted(pairs, key)
            hit = np.zeros(len(key), bool) if not len(pairs) else pairs[np.minimum(at, len(pairs) - 1)] == key
            n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, of_row[hit], n[hit] * best[at[hit]])
            np.add.at(count_sum, of_row[hit], n[hit] * totals[at[hit]])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(of_row[~hit], minlength=len(sizes)))])
            rest = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[~hit], pa.int64())) for x in (key, n)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n_best), pa.array(count_sum), *rest], [*kept, "n_best", "count_sum", "pairs", "times"])

    known = common.materialize(rows.mapInArrow(look_up, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>"))
    common.drop_table(rows)
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    rare = rare.join(counts.where(F.col("total") < bound), "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("n") * F.col("total")).alias("more_sum"))
    out = known.drop("pairs", "times").join(rare, "row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")
