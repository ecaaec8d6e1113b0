"""Encoding and decoding with a sentencepiece BPE vocabulary by suffix-array matching.

A batch's texts are cut into pre-tokens, and those that its worker has not met yet are concatenated, each once (a repeat has the same
ids). A suffix array over that text (suffixes ordered by their first `longest piece` characters) is searched for every
piece of the vocabulary, which gives the ranges of its occurrences. The occurrences are edges; sorted by position
they are relaxed from left to right, in all pre-tokens at once. An edge is relaxed if its piece may follow the piece that the
encoding up to its start ends with: no merge across their border may come before the merges that make the two pieces. That
is read from the merge ranks (`Merges`). Exactly one piece ends the encoding of each prefix, so the path to a word's end is what
merging by rank gives, and the ids equal the library's. Characters outside the vocabulary are edges to their bytes.

Defined cases: a null or empty text has no ids and decodes to an empty text; the space mark itself
decodes to a space, as in the library; a repeated row gets the same ids twice; an empty table gives an
empty table; columns other than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm import common
from sightline.llm.token_counts import MARK, pretokens

#: Characters of one indexed text, pre-tokens in each of the two generations of a worker's cache, and slots for verdicts on pairs.
BLOCK, CACHE, PAIR_SLOTS = 500_000, 600_000, 2**20
OTHER = 0xFFFF
SCHEMA = "doc_id long, n_tokens long, ids binary"

_workers: dict = {}


class Merges:
    """When each piece of the vocabulary is merged, and from what; tells which pieces may stand side by side."""

    def __init__(self, pieces: dict[int, str], scores: dict[int, float], size: int):
        by_text = {t: i for i, t in pieces.items()}
        order = sorted((i for i in pieces if len(pieces[i]) > 1), key=lambda i: (-scores[i], i))
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[order] = np.arange(len(order))
        ranks = {pieces[i]: k for k, i in enumerate(order)}
        #: Pieces that merging their characters does not give; no encoding has them.
        self.never = set()
        for i in order:
            parts = list(pieces[i])
            while len(parts) > 1:
                best, at = min((ranks.get(x + y, size), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
                if best == size:
                    break
                last, parts[at : at + 2] = parts[at : at + 2], [parts[at] + parts[at + 1]]
            if len(parts) == 1:
                self.left[i], self.right[i] = by_text[last[0]], by_text[last[1]]
            else:
                self.never.add(i)
        self.size, joined = size, []
        for t, i in by_text.items():
            joined += [(by_text[t[:k]] * size + by_text[t[k:]], ranks[t]) for k in range(1, len(t)) if t[:k] in by_text and t[k:] in by_text]
        keys, values = np.array(sorted(joined), np.int64).reshape(-1, 2).T
        self.keys, self.values = np.append(keys, np.iinfo(np.int64).max), np.append(values, size)
        self.seen, self.verdict = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)

    def rank_of_both(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that a and b make together; beyond every rank if there is none."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], self.size)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Is each a, followed by b, encoded as a and b? Undoes the later merge of the two until only characters meet.

        At equal ranks the merge further left comes first: that inside a before one across, one across before that inside b.
        """
        out, todo = np.ones(len(a), bool), np.arange(len(a))
        a, b, before = a.copy(), b.copy(), np.full(len(a), self.size)
        while len(todo):
            out[todo[self.rank_of_both(a, b) < before]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = out[todo] & (np.maximum(ra, rb) >= 0)
            todo, a, b, ra, rb = todo[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            before = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stay_apart() through a table of earlier verdicts."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 13) & (PAIR_SLOTS - 1)
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = self.stay_apart(fresh // self.size, fresh % self.size)
            out = self.verdict[slot]
            out[new] = found[back]
            at = (fresh * 0x9E3779B1 >> 13) & (PAIR_SLOTS - 1)
            self.seen[at] = fresh
            # Of two pairs with one slot the last stays, in both tables.
            kept = self.seen[at] == fresh
            self.verdict[at[kept]] = found[kept]
            return out
        return self.verdict[slot]


class Codec:
    def __init__(self, model: str, cache_size: int = CACHE):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.cache_size, self.young, self.old = cache_size, {}, {}
        n = sp.get_piece_size()
        ids = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {i: sp.id_to_piece(i) for i in ids}
        self.merges = Merges(pieces, {i: sp.get_score(i) for i in ids}, n)
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        table = [b""] * n
        for i, p in pieces.items():
            table[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            table[i] = bytes([b])
        self.table = pa.array(table, pa.binary())
        letters = sorted({c for p in pieces.values() for c in p})
        if len(letters) >= OTHER - 1:
            raise ValueError("more characters than two bytes can tell apart")
        self.code = np.full(0x110000, OTHER, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest = max(map(len, pieces.values()))
        used = [i for i in ids if i not in self.merges.never]
        low = np.zeros((len(used), self.longest), ">u2")
        high = np.full((len(used), self.longest), 0xFFFF, ">u2")
        for row, i in enumerate(used):
            codes = self.code[[ord(c) for c in pieces[i]]]
            low[row, : len(codes)] = high[row, : len(codes)] = codes
        self.sizes = np.array([len(pieces[i]) for i in used])
        key = f"S{2 * self.longest}"
        self.low, self.high = (np.ascontiguousarray(x).view(key).ravel() for x in (low, high))
        order = np.argsort(self.low)
        self.low, self.high, self.sizes = self.low[order], self.high[order], self.sizes[order]
        self.names = np.array(used)[order]

    def suffix_array(self, codes: np.ndarray) -> np.ndarray:
        """Places of the text in the order of the `longest` characters that start there, by doubling of ranked prefixes."""
        n, width = len(codes), 1
        rank = codes.astype(np.int64)
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - width, 0)] = rank[width:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            width *= 2
            array = np.argsort(key)
            if width >= self.longest:
                return array
            new = np.empty(n, np.int64)
            key = key[array]
            new[array] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            rank = new

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of a piece in the text."""
        width = self.longest
        padded = np.concatenate([codes, np.zeros(width, np.uint16)]).astype(">u2")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)]).view(self.low.dtype).ravel()
        array = self.suffix_array(codes)
        ordered = suffixes[array]
        first, last = np.searchsorted(ordered, self.low, "left"), np.searchsorted(ordered, self.high, "right")
        found = np.flatnonzero(last > first)
        many = (last - first)[found]
        at = np.repeat(first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        start, which = array[at], np.repeat(found, many)
        other = np.flatnonzero(codes == OTHER)
        end = np.concatenate([start + self.sizes[which], other + 1])
        return np.concatenate([start, other]), end, np.concatenate([self.names[which], np.full(len(other), -2)])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, each given with its marks, as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        chars = np.frombuffer("\0".join(words).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        begins = stops - sizes
        codes = self.code[chars]
        codes[stops[:-1]] = 0
        start, end, piece = self.edges(codes)
        # Edges by their place inside the word: words are relaxed side by side.
        place = start - np.repeat(begins, sizes + 1)[start]
        order = np.argsort(place, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        turns = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=1))])
        none = -9
        last, back = np.full(len(chars) + 1, none, np.int64), np.zeros(len(chars) + 1, np.int64)
        last[begins] = -1
        for lo, hi in zip(turns.tolist(), turns[1:].tolist()):
            now = np.flatnonzero((last[start[lo:hi]] != none) & (last[end[lo:hi]] == none)) + lo
            a, b = last[start[now]], piece[now]
            inner = np.flatnonzero((a >= 0) & (b >= 0))
            bad = inner[~self.merges.follows(a[inner], b[inner])]
            now = np.delete(now, bad)
            last[end[now]], back[end[now]] = piece[now], start[now]
        on_path = np.zeros(len(chars) + 1, bool)
        at = stops[sizes > 0]
        firsts = begins[sizes > 0]
        while len(at):
            on_path[at] = True
            at = back[at]
            more = at > firsts
            at, firsts = at[more], firsts[more]
        ends = np.flatnonzero(on_path)
        ids = last[ends]
        counts = np.ones(len(ends), np.int64)
        for k in np.flatnonzero(ids == -2).tolist():
            counts[k] = len(chr(chars[ends[k] - 1]).encode())
        cuts = np.concatenate([[0], np.cumsum(counts)])
        flat = np.repeat(ids, counts).astype("<u4")
        for k in np.flatnonzero(ids == -2).tolist():
            flat[cuts[k] : cuts[k + 1]] = [self.byte_ids[x] for x in chr(chars[ends[k] - 1]).encode()]
        raw = flat.tobytes()
        bounds = (4 * cuts[np.searchsorted(ends, stops, "right")]).tolist()
        return [raw[i:j] for i, j in zip([0, *bounds], bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each whole text."""
        split = [pretokens(t) for t in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.young)
        if len(self.young) + len(new) > self.cache_size:
            self.young, self.old = {}, self.young
            new = wanted
        again = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        block, size = [], 0
        for w in new - again:
            block.append(w)
            size += len(w) + 2
            if size > BLOCK:
                self._learn(block)
                block, size = [], 0
        self._learn(block)
        get = self.young.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def _learn(self, block: list[str]) -> None:
        full = [w if w[:1] == "\n" else MARK + w.replace(" ", MARK) for w in block]
        self.young.update(zip(block, self.encode_words(full)))

    def decode(self, many: list[bytes]) -> list[str]:
        """The texts of many ids: one gather from the table of pieces. The mark that encoding puts before a text is taken off."""
        sizes = np.cumsum([0, *(len(x) // 4 for x in many)])
        joined = self.table.take(pa.array(np.frombuffer(b"".join(many), "<u4"))).cast(pa.large_binary())
        places = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[sizes].tolist()
        data = joined.buffers()[2]
        raw = data.to_pybytes() if data else b""
        return [raw[i:j].decode("utf-8", "replace")[1:] for i, j in zip(places, places[1:])]


def worker(model: str) -> Codec:
    if model not in _workers:
        _workers[model] = Codec(model)
    return _workers[model]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        own = worker(model)
        for b in common.bounded(batches):
            ids = own.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return common.text_rows(docs).mapInArrow(run, SCHEMA)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of every row of encoded (doc_id, ids)."""
    common.ship(encoded.sparkSession)

    def run(batches):
        own = worker(model)
        for b in common.bounded(batches):
            texts = own.decode([x or b"" for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """For each document: n_tokens, the checksum of its ids, and whether decoding them gives its text back."""
    common.ship(docs.sparkSession)

    def run(batches):
        own = worker(model)
        for b in common.bounded(batches):
            texts = b.column("text").to_pylist()
            ids = own.encode(texts)
            back = own.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([len(x) for x in back], pa.int64()), pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                    pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_crc32", "exact"],
            )

    return common.text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_crc32 long, exact boolean")
