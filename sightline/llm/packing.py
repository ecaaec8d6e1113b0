"""Best-fit packing: documents as token pieces, packed into sequences by vector best-fit.

Each piece asks for tokens, one document place and an attention cost (length squared); a sequence has
a capacity of each. Pieces of one length are alike, so the plan needs only how many pieces there are of each length: at most
`tokens` numbers, whatever the size of the corpus. The plan opens a sequence with the longest length
left, then adds the length that fits all three residual capacities and is best by weighted dot
product (or leaves the least residual norm), and repeats that filling as often as the counts allow.
Every piece then finds its place from its rank among the pieces of its length. Ranks come from each
writing task's own counter plus the counts of the tasks before it, so no length, however common,
meets in one task.

Defined cases: a null or empty text is the end token alone; a repeated row is packed twice; a text of
any length is cut into whole pieces; an empty table gives an empty table; columns other than doc_id
and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common

TOKENS = 2048
END_ID = 0
#: Entries that a worker's cache of encoded words may hold.
CACHE = 450_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, own_rank long"

_workers: dict = {}
#: Parts of plain Latin letters, of ASCII marks, or of both: one word or mark run of the vocabulary's own splitting each.
_MARKS = rb"[!-&(-/:-@\[-`{-~]"
#: In UTF-8 the letters are a-z and, after 0xC3, the bytes 0x9F to 0xBF but 0xB7; no other lead byte is among them.
_SIMPLE = re.compile(rb"[a-z\x9f-\xb6\xb8-\xbf\xc3]*%b*" % _MARKS).fullmatch
#: Kinds of bytes in such parts: 0 between parts, 1 letters, 2 marks.
_KIND = np.ones(256, np.int8)
_KIND[32], _KIND[[b for b in range(33, 127) if re.match(_MARKS, bytes([b]))]] = 0, 2
#: Byte-level vocabularies show bytes that are no visible Latin-1 character as the characters from 256 on, in the bytes' order.
_SHOWN = np.arange(256, dtype="<u4")
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SHOWN[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_SHOWN[32] = 32
#: A stop or comma that ends a run of marks is not a part of its own.
_MARK_RUN = re.compile(r"[.,](?<=(?:[^\w \t\n\r\f\v]|_).)(?=\s|\Z)")
#: Letters whose lower case depends on more than the letter, and strings that the library finds before it lowers.
_ODD = ("Σ", "İ")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


class Encoder:
    """The vocabulary with a cache of the parts that white space leaves, kept in a worker from task to task.

    The cache has two generations of at most cache_size parts; what is used again moves to the young one.
    """

    def __init__(self, path: str, cache_size: int = CACHE):
        from tokenizers import Tokenizer

        self.tok, self.cache_size = Tokenizer.from_file(path), cache_size
        # For parts that are plain already: the same merges without normalisation and without the pattern that cuts words.
        bare = json.loads(self.tok.to_str())
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.bare.model._resize_cache(0)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: list[bytes]) -> None:
        """Encode simple parts as one text, cut where their words end; the others one by one."""
        simple = list(filter(_SIMPLE, parts))
        if len(simple) < len(parts):
            self.young.update((p, self.ids(p.decode())) for p in set(parts).difference(simple))
        for some in common.chunks(simple, 4096):
            raw = b" ".join(some)
            chars = np.frombuffer(raw, np.uint8)
            kind = _KIND[chars]
            border = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
            # Where a part's words end: after each space that was there; a border is another end inside its part.
            spaces = np.flatnonzero(kind == 0)
            ends = np.arange(len(some)) + 1 + np.searchsorted(border, np.append(spaces, len(chars)))
            shown = _SHOWN[np.insert(chars, border, 32)].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1))[ends - 1].tolist()
            raw = ids.tobytes()
            self.young.update(zip(some, (raw[i:j] for i, j in zip([0, *stops], stops))))

    def parts_of(self, text: str) -> list[bytes] | None:
        """Lower-cased parts of a text whose ids, one after another, are the text's; None where that does not hold."""
        low = text.lower()
        if any(x in text for x in _ODD) or any(x in low for x in _SPECIAL):
            return None
        raw = low.encode()
        if not _MARK_RUN.search(low):
            raw = (raw + b"\n").replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" . ").replace(b",\n", b" , ")
        return raw.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self.parts_of(t) for t in texts]
        wanted = set().union(*filter(None, split))
        new = wanted.difference(self.young)
        if len(self.young) + len(new) > self.cache_size:
            self.young, self.old = {}, self.young
            new = wanted
        again = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        self.learn(list(new - again))
        get = self.young.__getitem__
        return [self.ids(t) if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split)]


def worker(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def cut_pieces(docs: DataFrame, path: str, tokens: int = TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their checksum, writing task and rank among that task's pieces of the length."""
    common.ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        own = worker(path)
        task, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for b in common.bounded(batches):
            rows, owners = [], []
            for i, ids in enumerate(own.encode(b.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    size = len(part) // 4
                    rows.append((k, at // 4, size, zlib.crc32(part), task, ranks[size]))
                    ranks[size] += 1
                    owners.append(i)
            columns = zip((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), zip(*rows))
            arrays = [b.column("doc_id").take(pa.array(owners, pa.int32())), *(pa.array(c, t) for t, c in columns)]
            if rows:
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECES.split(", ")])

    return common.text_rows(docs).mapInArrow(run, PIECES)


def plan_bins(counts: dict[int, int], tokens: int, documents: int, attention: float, weights=(1.0, 0.05, 0.2), rule: str = "dot"):
    """Fillings for the counted lengths: rows (length, first rank, ranks, per sequence, first sequence, offset).

    rule 'dot' takes the length with the greatest weighted dot product of its demand with what is
    left of the capacities; 'norm' the one that leaves the least weighted norm. Both only look at
    lengths that fit every capacity. Each filling uses up at least one length, so there are at most
    as many fillings as lengths.
    """
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[int(x)] for x in lengths], np.int64)
    used = np.zeros_like(left)
    cap = np.array([tokens, documents, attention], float)
    demand = np.stack([lengths, np.ones_like(lengths), lengths.astype(float) ** 2], 1) / cap
    w = np.asarray(weights, float)
    rows, sequence = [], 0
    while left.any():
        fill: dict[int, int] = {}
        rest, free = np.ones(3), left.copy()
        k = int(np.flatnonzero(free)[-1])
        while k >= 0:
            fits = int(min(free[k], np.floor((rest / demand[k]).min() + 1e-9)))
            more = 1 if fill or fits < 1 else max(1, fits)
            if not fill and fits < 1:
                more = 1  # a piece that exceeds a capacity alone still gets a sequence
            fill[k] = fill.get(k, 0) + more
            free[k] -= more
            rest = rest - more * demand[k]
            ok = (free > 0) & (demand <= rest + 1e-9).all(1)
            if not ok.any():
                break
            if rule == "dot":
                value = np.where(ok, demand @ (w * np.maximum(rest, 0)), -1)
                k = int(value.argmax())
            else:
                value = np.where(ok, ((rest - demand) ** 2 @ w), np.inf)
                k = int(value.argmin())
        times = int(min(left[k] // n for k, n in fill.items()))
        offset = 0
        for k, n in fill.items():
            rows.append((int(lengths[k]), int(used[k]), times * n, n, sequence, offset))
            used[k] += times * n
            left[k] -= times * n
            offset += n * int(lengths[k])
        sequence += times
    return rows


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: float | None = None, rule: str = "dot") -> DataFrame:
    """sequence_id and offset for every piece. `pieces` must be a stored table, as from materialize(cut_pieces())."""
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_bins(counts, tokens, documents or tokens, attention or float(tokens) ** 2, rule=rule)
    plan = defaultdict(list)
    for length, first, ranks, each, sequence, offset in rows:
        plan[length].append((first, each, sequence, offset))
    shared = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in plan.items()})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        own = shared.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                table = own[int(x)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                over = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + over // row[:, 1], row[:, 3] + over % row[:, 1] * x
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("own_rank") + F.col("before"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str, tokens: int = TOKENS, end_id: int = END_ID, documents: int | None = None, attention: float | None = None, rule: str = "dot") -> DataFrame:
    return pack(common.materialize(cut_pieces(docs, path, tokens, end_id)), tokens, documents, attention, rule)
