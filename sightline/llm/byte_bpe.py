"""Encoding and decoding with a byte-level BPE vocabulary: segment trees over the ranks of adjacent pairs.

A text is cut at the strings of the vocabulary's added tokens and into pre-tokens; merges never cross these cuts. For each pre-token
a segment tree holds one leaf for each pair of neighbours: the rank of its merge, then its place. The root is the least: the
leftmost pair of the lowest rank. Merging it changes three leaves (the pair itself, and the pairs before and after it), each in as many steps
as the tree has levels, until no pair can be merged. Trees of equal size grow side by side as rows of one array; words longer than
WIDE bytes get a tree of their own. A pre-token that its worker has met lately is read from a cache of such results.

Defined cases: a null or empty text has no ids and decodes to an empty text; a repeated row gets the same ids twice; texts of any length are
encoded whole, in parts of about SEGMENT characters; an empty table gives an empty table; columns other than doc_id and text are
ignored; a null doc_id stays null; ids that the vocabulary lacks decode to nothing; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sightline.llm import common

#: Longest pre-token, in bytes, whose tree grows beside others; leaves of all trees that grow together; pre-tokens in each of the
#: two generations of a worker's cache; characters of a text that are held as pre-tokens at once.
WIDE, LEAVES, CACHE, SEGMENT = 64, 2**18, 300_000, 200_000
NEVER = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_tokens long, ids binary"

#: Fixed value: how byte-level vocabularies cut a text, with the groups of letters and of numbers left open.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"

_workers: dict = {}


@lru_cache(1)
def unlike_characters() -> tuple[str, str, str]:
    """Ranges of the characters that the tokenizers library takes for (letters, numbers, neither) other than the regex module does.

    The two know different versions of Unicode. Asked once on the driver: in "xC1C!" a letter C joins the x, a number C joins the 1.
    """
    from tokenizers import pre_tokenizers

    split, ours = pre_tokenizers.ByteLevel(add_prefix_space=False), {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}")}
    out: dict[str, list[str]] = {"L": [], "N": [], "": []}
    for low in range(0x21, 0x40000, 0x4000):
        chars = [chr(c) for c in range(low, min(low + 0x4000, 0x40000)) if not 0xD800 <= c < 0xE000]
        begins = {a for _, (a, _) in split.pre_tokenize_str("".join(f"\nx{c}1{c}!" for c in chars))}
        for k, c in enumerate(chars):
            kind = "L" if 6 * k + 2 not in begins else "N" if 6 * k + 3 not in begins else ""
            if kind != next((n for n, p in ours.items() if p.match(c)), ""):
                out[kind].append(c)
    return ranges(out["L"]), ranges(out["N"]), ranges(out[""])


def ranges(chars: list[str]) -> str:
    """Ascending characters as the ranges of a regular expression's set."""
    ends: list[list[str]] = []
    for c in chars:
        if ends and ord(c) == ord(ends[-1][1]) + 1:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "".join(f"{a}-{b}" for a, b in ends)


class Splitter:
    """Cuts texts into pre-tokens as the library does."""

    def __init__(self, letters: str, numbers: str, neither: str):
        self.usual = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}"))
        group = lambda name, more, less: rf"[[\p{{{name}}}{more}]--[\n{less}]]"
        exact = PATTERN.format(L=group("L", letters, numbers + neither), N=group("N", numbers, letters + neither))
        self.exact, self.unlike = regex.compile("(?V1)" + exact), np.zeros(0x110000, bool)
        odd = letters + numbers + neither
        for first, last in zip(odd[::3], odd[2::3]):
            self.unlike[ord(first) : ord(last) + 1] = True
        self.border = regex.compile(r"\S\s")

    def segments(self, text: str):
        """The text in parts: a pre-token always ends where white space follows something else."""
        at = 0
        while len(text) - at > SEGMENT:
            found = self.border.search(text, at + SEGMENT)
            if not found:
                break
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:] if at else text

    def words(self, segment: str) -> list[str]:
        plain = segment.isascii() or not self.unlike[np.frombuffer(segment.encode("utf-32-le"), "<u4")].any()
        return (self.usual if plain else self.exact).findall(segment)


class Codec:
    def __init__(self, vocabulary: str, unlike: tuple[str, str, str], special: bool = True, cache_size: int = CACHE):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if (
            model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        ):
            raise ValueError("not a plain byte-level BPE vocabulary")
        # The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for those from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        letter = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(rest)}}
        byte_of = {c: b for b, c in letter.items()}
        vocab = model["vocab"]
        self.splitter, self.cache_size, self.young, self.old = Splitter(*unlike), cache_size, {}, {}
        self.byte_ids = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        table: list[bytes] = [b""] * size
        for piece, i in vocab.items():
            table[i] = bytes(byte_of[c] for c in piece)
        self.size = size
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], NEVER), np.append(order, -1)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.added = {}
        for t in added:
            table[t["id"]] = t["content"].encode()
            if special:
                self.added[t["content"]] = np.array([t["id"]], "<u4").tobytes()
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.table = pa.array([*table, b""], pa.binary())

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each a merges with the b after it, or -1."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def grow_many(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids of words of at most `leaves` bytes: one tree a row, all rows merge their root's pair in each turn."""
        many, shift, width = len(words), leaves.bit_length() - 1, leaves + 1
        sizes = np.fromiter(map(len, words), np.int64, many)
        place = np.arange(width)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
        ids = np.where(place < sizes[:, None], self.byte_ids[text].reshape(many, width), -1)
        after, before = np.tile(place + 1, many), np.tile(place - 1, many)
        pair = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        tree = np.full((many, 2 * leaves), NEVER, np.int64)
        tree[:, leaves:] = np.where((pair >= 0) & (ids[:, 1:] >= 0), pair << shift | place[:-1], NEVER)
        half = leaves // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        ids, tree = ids.ravel(), tree.ravel()

        def leaf(rows: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            ok = right >= 0
            rank = self.pair_ranks(left, np.where(ok, right, 0))
            tree[rows * (2 * leaves) + leaves + at] = np.where(ok & (rank >= 0), rank << shift | at, NEVER)

        def climb(rows: np.ndarray, at: np.ndarray) -> None:
            base, node = rows * (2 * leaves), (at + leaves) >> 1
            while len(node) and node[0]:
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                node = node >> 1

        rows = np.arange(many)
        while True:
            root = tree[rows * (2 * leaves) + 1]
            live = root != NEVER
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            at, base = root & (leaves - 1), rows * width
            right = after[base + at]
            beyond, prior = after[base + right], before[base + at]
            new = self.made[root >> shift]
            ids[base + at], ids[base + right] = new, -1
            after[base + at] = beyond
            inner = beyond < width
            before[(base + beyond)[inner]] = at[inner]
            tree[rows * (2 * leaves) + leaves + np.minimum(right, leaves - 1)] = NEVER
            leaf(rows, at, new, np.where(inner, ids[base + np.minimum(beyond, width - 1)], -1))
            led = prior >= 0
            leaf(rows[led], prior[led], ids[(base + prior)[led]], new[led])
            climb(rows, np.minimum(right, leaves - 1))
            climb(rows, at)
            climb(rows[led], prior[led])
        kept = ids >= 0
        ends = np.cumsum(kept.reshape(many, width).sum(1)) * 4
        raw = ids[kept].astype("<u4").tobytes()
        return [raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]

    def grow_one(self, word: bytes) -> bytes:
        """Ids of one long word, by a tree of its own."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        n = len(ids)
        leaves = 1 << (n - 1).bit_length()
        shift = leaves.bit_length() - 1
        pair = self.pair_ranks(ids[:-1], ids[1:])
        levels = [np.full(leaves, NEVER, np.int64)]
        levels[0][: n - 1] = np.where(pair >= 0, pair << shift | np.arange(n - 1), NEVER)
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NEVER, *np.concatenate(levels[::-1]).tolist()]
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n))
        size, rank_of, made, never = self.size, self.rank_of, self.made.tolist(), int(NEVER)

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            node >>= 1
            while node:
                low, high = tree[2 * node], tree[2 * node + 1]
                if high < low:
                    low = high
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        def value(at: int, left: int, right: int) -> int:
            rank = rank_of.get(left * size + right)
            return never if rank is None else rank << shift | at

        while tree[1] != never:
            at, new = tree[1] & (leaves - 1), made[tree[1] >> shift]
            right, prior = after[at], before[at]
            beyond = after[right]
            ids[at], ids[right], after[at], before[beyond] = new, -1, beyond, at
            put(right, never)
            put(at, value(at, new, ids[beyond]) if beyond < n else never)
            if prior >= 0:
                put(prior, value(prior, ids[prior], new))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def grow(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens as little-endian unsigned 32-bit numbers, by trees of 8, 16, ... leaves."""
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        of_size: dict[int, list[int]] = {}
        for k, w in enumerate(raw):
            if len(w) > WIDE:
                out[k] = self.grow_one(w)
            else:
                of_size.setdefault(max(8, 1 << (len(w) - 1).bit_length()), []).append(k)
        for leaves, places in of_size.items():
            for some in common.chunks(places, LEAVES // leaves):
                for k, found in zip(some, self.grow_many([raw[k] for k in some], leaves)):
                    out[k] = found
        return out

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, through the cache."""
        wanted = set(words)
        new = wanted.difference(self.young)
        if len(self.young) + len(new) > self.cache_size:
            self.young, self.old = {}, self.young
            new = wanted
        again = new.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        fresh = [w for w in new if w not in again]
        self.young.update(zip(fresh, self.grow(fresh)))
        return list(map(self.young.__getitem__, words))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.added)

    def parts(self, text: str):
        """Ids of a text, part by part."""
        pieces = self.special.split(text) if self.has_special(text) else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield self.added[piece]
            elif piece:
                for segment in self.splitter.segments(piece):
                    yield b"".join(self.ids_of(self.splitter.words(segment)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each whole text. Short texts pass through the cache together."""
        out: list[bytes] = [b""] * len(texts)
        short, words, sizes = [], [], []
        for k, t in enumerate(texts):
            if len(t) > SEGMENT or self.has_special(t):
                out[k] = b"".join(self.parts(t))
            elif t:
                own = self.splitter.words(t)
                short.append(k)
                words += own
                sizes.append(len(own))
                if len(words) > SEGMENT:
                    self._fill(out, short, words, sizes)
                    short, words, sizes = [], [], []
        self._fill(out, short, words, sizes)
        return out

    def _fill(self, out: list[bytes], places: list[int], words: list[str], sizes: list[int]) -> None:
        found, at = self.ids_of(words), 0
        for k, n in zip(places, sizes):
            out[k] = b"".join(found[at : at + n])
            at += n

    def decode(self, many: list[bytes]) -> list[str]:
        """The texts of many ids: one gather from the table of pieces."""
        ids = np.frombuffer(b"".join(many), "<u4")
        sizes = np.cumsum([0, *(len(x) // 4 for x in many)])
        joined = self.table.take(pa.array(np.minimum(ids, self.size))).cast(pa.large_binary())
        places = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[sizes].tolist() if len(joined) else [0] * len(sizes)
        data = joined.buffers()[2]
        raw = data.to_pybytes() if data else b""
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(places, places[1:])]


def worker(vocabulary: str, unlike: tuple[str, str, str], special: bool = True) -> Codec:
    """This worker's codec, kept from task to task."""
    if (vocabulary, special) not in _workers:
        _workers[vocabulary, special] = Codec(vocabulary, unlike, special)
    return _workers[vocabulary, special]


def encode_bytes(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text."""
    common.ship(docs.sparkSession)
    unlike = unlike_characters()

    def run(batches):
        own = worker(vocabulary, unlike)
        for b in common.bounded(batches):
            ids = own.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return common.text_rows(docs).mapInArrow(run, SCHEMA)


def decode_bytes(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of encoded (doc_id, ids)."""
    common.ship(encoded.sparkSession)
    unlike = unlike_characters()

    def run(batches):
        own = worker(vocabulary, unlike)
        for b in common.bounded(batches):
            texts = own.decode([x or b"" for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """For each document: n_tokens, the SHA-256 of its ids and of the text that they decode to."""
    common.ship(docs.sparkSession)
    unlike = unlike_characters()

    def run(batches):
        own = worker(vocabulary, unlike)
        for b in common.bounded(batches):
            ids = own.encode(b.column("text").to_pylist())
            back = own.decode(ids)
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(x.encode() for x in back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
