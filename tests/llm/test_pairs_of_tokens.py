"""Byte-level codec, aligned tokenizers and hard negatives against the libraries and brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import byte_bpe, common, hard_negatives, token_align
from sightline.llm.queries import BYTE_MODEL, PIECE_MODEL, QUERIES, vocabulary
from tests.conftest import DATA

ROWS = [(1, "Hello world. " * 30), (2, ""), (3, None), (None, "no id here"), (4, "lang word " * 20000), (5, "tie"), (6, "tie"), (5, "tie"), (7, "ÀÉ ﬁ ß <|endoftext|> x@y.zz +1 (988)\n\n  555"), (8, "a▁b"), (9, " \t\n ")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", F.lit("x").alias("ids"), F.lit(1).alias("n_tokens"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit(7).alias("pair"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTE_MODEL))


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(vocabulary(BYTE_MODEL), byte_bpe.unlike_characters())


def library_ids(library, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]


def made_texts():
    r = random.Random(3)
    pool = "abcde  \n\t'st'llé日本語١²<|endoftext|>՘₝\U00032000\x85　\x1c-_!🎉"
    made = ["".join(r.choice(pool) for _ in range(r.randrange(300))) for _ in range(1500)]
    made += ["<|endoftext|>", "a<|endoftext|><|endoftext|>b", " <|endoftext|> ", "don't we'll I'M", "\n\n \n  a", "a" * 64, "a" * 65, "é" * 33, "\x00\x01", "x" * 5000, "ab" * 700]
    return made + ["".join(chr(c) for c in range(k, k + 97) if not 0xD800 <= c < 0xE000) for k in range(0, 0x34000, 97)]


def test_byte_ids_equal_the_library(library, codec):
    texts = made_texts()
    ids = codec.encode(texts)
    assert ids == library_ids(library, texts)
    assert codec.decode(ids) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in ids]


def test_small_cache_and_small_segments_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SEGMENT", 17)
    own = byte_bpe.Codec(vocabulary(BYTE_MODEL), byte_bpe.unlike_characters(), cache_size=50)
    texts = made_texts()[:700]
    assert own.encode(texts) == library_ids(library, texts)


def test_special_strings_as_plain_text(codec):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(BYTE_MODEL))
    plain.encode_special_tokens = True
    own = byte_bpe.Codec(vocabulary(BYTE_MODEL), byte_bpe.unlike_characters(), special=False)
    texts = made_texts()[:500]
    assert own.encode(texts) == library_ids(plain, texts)


def test_ids_cut_inside_characters_decode_as_the_library_does(library, codec):
    r, many = random.Random(5), []
    for t in made_texts()[:300]:
        ids = np.frombuffer(codec.encode([t])[0], "<u4")
        a = r.randrange(len(ids) + 1)
        many.append(np.concatenate([ids[a:], ids[:a][::-1]]).astype("<u4").tobytes())
    assert codec.decode(many) == [library.decode(np.frombuffer(x, "<u4").tolist(), skip_special_tokens=False) for x in many]
    assert codec.decode([np.array([60000, 50256, 4_000_000_000], "<u4").tobytes(), b""]) == ["<|endoftext|>", ""]
    assert codec.decode([]) == []


def test_megabyte_words_and_texts_end_soon(library, codec):
    r = random.Random(7)
    word = "".join(r.choice("abcdefghij") for _ in range(1_000_000))
    began = time.time()
    got = codec.encode([word, "ab " * 700_000])
    assert time.time() - began < 60
    assert got == library_ids(library, [word, "ab " * 700_000])


def test_byte_query_and_odd_rows(spark, odd, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    for got, docs in ((QUERIES["op11_byte_codec"](spark, DATA), rows), (byte_bpe.digests(odd, vocabulary(BYTE_MODEL)), ROWS)):
        ids = library_ids(library, [t or "" for _, t in docs])
        expect = [(d, len(x) // 4, sha(x), sha((t or "").encode())) for (d, t), x in zip(docs, ids)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expect, key=str)
    assert byte_bpe.digests(odd.limit(0), vocabulary(BYTE_MODEL)).count() == 0
    back = byte_bpe.decode_bytes(byte_bpe.encode_bytes(odd, vocabulary(BYTE_MODEL)), vocabulary(BYTE_MODEL))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((d, t or "") for d, t in ROWS), key=str)


def aligned_by_hand(docs):
    """The contract of op13, step by step over all pairs of tokens that may overlap."""
    import collections

    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(BYTE_MODEL))
    plain.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte_of = {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(rest)}}
    found, counts = [], collections.Counter()
    for d, t in docs:
        whole = (" " + (t or "")).encode()
        a = plain.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        raw_a = [bytes(byte_of[c] for c in plain.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            found.append((d, [], [], "", 0))
            continue
        spans = []
        for raw in (raw_a, raw_b):
            ends = np.cumsum([len(x) for x in raw]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        at, links = 0, []
        for i, (p, q) in zip(a, spans[0]):
            while at and spans[1][at - 1][1] > p:
                at -= 1
            while at < len(b) and spans[1][at][0] < q:
                if spans[1][at][1] > p:
                    links.append((i, b[at]))
                at += 1
        ends = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups, low = [], 0
        for e in ends:
            inside = [",".join(str(i) for i, (p, q) in zip(ids, s) if low < q <= e) for ids, s in zip((a, b), spans)] if len(whole) < 3000 else None
            groups.append(inside and "|".join(inside))
            low = e
        counts.update(links)
        found.append((d, a, b, (links, ends, groups), len(ends)))
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for d, a, b, rest, n_groups in found:
        links, _, groups = rest or ([], [], [])
        digest = "" if not rest else hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((d, len(a), len(b), n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def same_alignment(got, expect):
    got, expect = sorted(map(tuple, got), key=str), sorted(expect, key=lambda r: str(r[:7]))
    got.sort(key=lambda r: str(r[:7]))
    assert [r[:7] for r in got] == [r[:7] for r in expect]
    assert all(e[7] is None or sorted(x[7] for x in got if x[:7] == e[:7]) == sorted(x[7] for x in expect if x[:7] == e[:7]) for e in expect)


def test_alignment_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    same_alignment(QUERIES["op13_token_alignment"](spark, DATA).collect(), aligned_by_hand(docs))


@pytest.mark.parametrize("table", [0, 40, token_align.TABLE])
def test_alignment_of_odd_rows_with_small_parts_and_tables(spark, odd, monkeypatch, table):
    monkeypatch.setattr(token_align, "SEGMENT", 50)
    rows = [(100 + k, t) for k, t in enumerate(made_texts()[:300])]
    docs = odd.select("doc_id", "text").where("doc_id <> 4 or doc_id is null").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = token_align.token_alignment(docs, vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL), table).collect()
    same_alignment(got, aligned_by_hand([r for r in ROWS if r[0] != 4] + rows))


def test_alignment_of_long_texts_and_empty_tables(spark, odd):
    run = lambda d: token_align.token_alignment(d, vocabulary(BYTE_MODEL), vocabulary(PIECE_MODEL))
    same_alignment(run(odd).collect(), aligned_by_hand(ROWS))
    assert run(odd.limit(0)).count() == 0
    long = [(1, "".join(random.Random(2).choice("abcdefg") for _ in range(200_000))), (2, "some words ▁ here " * 50_000), (3, "some words here " * 100_000)]
    began = time.time()
    got = {r["doc_id"]: r for r in run(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert got[2]["n_links"] == 0 and got[2]["groups_sha256"] == ""
    for d in (1, 3):
        assert got[d]["n_links"] == got[d]["n_a"] + got[d]["n_b"] - got[d]["n_groups"] > 0


def negatives_by_hand(rows):
    """The contract of op12 over all pairs, in Python's own integers."""
    take = []
    for vec, emb, label in rows:
        if vec is None or label is None or emb is None or any(x is None or not np.isfinite(x) for x in emb):
            continue
        take.append((vec, (label + 1) % 10 if vec % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in emb]))
    out = []
    for k, (a, la, va) in enumerate(take):
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lab) for m, (i, lab, v) in enumerate(take) if m != k]
        positives = sorted(x for x in scored if x[2] == la)[:5]
        others = sorted(x for x in scored if x[2] != la)
        for p, i, _ in positives:
            fit = [x for x in others if 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j, _) in enumerate(fit)]
    return out


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.select("*", F.lit("x").alias("rid"), F.lit(1).alias("score"), F.lit(2).alias("grp"))


def made_vectors(many, seed):
    """Clusters, copies of one vector in many labels, and free ones."""
    r = np.random.default_rng(seed)
    centres, hot = r.normal(size=(12, 24)), r.normal(size=24).tolist()
    rows = []
    for k in range(many):
        kind = k % 3
        v = hot if kind == 0 else (centres[k % 12] + 0.15 * r.normal(size=24)).tolist() if kind == 1 else (r.normal(size=24) * r.uniform(0.2, 2)).tolist()
        rows.append((int(k if k % 10 else 100 * (k // 10)), v, int(r.integers(0, 4))))
    return rows


def test_negatives_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in common.table(spark, DATA, "embeddings").select("vec_id", "embedding", "label").collect()]
    expect = negatives_by_hand(rows)
    assert len(expect) > 20
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, DATA).collect())) == sorted(expect)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_of_clusters_and_copies_in_small_blocks(spark, monkeypatch, seed):
    for name, value in {"BLOCK": 64, "WINDOW": 8, "GROUP_ROWS": 128, "DIRECTIONS": 6}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = made_vectors(1500, seed)
    got = hard_negatives.hard_negatives(vectors(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(negatives_by_hand(rows))


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (1, [0.5], 1), (2, [], 1), (3, [0.5, 0.3, 9.0], 2), (4, [nan, 1.0], 2), (5, [inf], 2), (6, [None, 1.0], 2), (7, [0.4, 0.3], 9), (8, None, 1),
        (9, [0.4, 0.3], None), (None, [0.4, 0.3], 2), (100, [0.0, 0.0], 3), (101, [0.0, 1.0], 3), (102, [-1.0], 4), (200, [-1.0, 0.0], 5), (201, [1.0, 0.0], 5), (300, [1e30, 1.0], 6), (-100, [0.5, 0.2], 2), (-7, [0.5, 0.2], 1),
    ]
    got = sorted(map(tuple, hard_negatives.hard_negatives(vectors(spark, rows)).collect()))
    assert got == sorted(negatives_by_hand(rows)) and len(got) > 5
    assert hard_negatives.hard_negatives(vectors(spark, rows).limit(0)).count() == 0
    large = [(100 * k, [2.0**16 * (k + 1), 3.0 + k], k % 2) for k in range(12)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(vectors(spark, large)).collect())) == sorted(negatives_by_hand(large))


def test_bounds_hold_and_filter():
    r = np.random.default_rng(5)
    v = np.floor(256 * np.concatenate([c + 0.1 * r.normal(size=(200, 16)) for c in r.normal(size=(20, 16))]))
    way = hard_negatives.fit_directions(v[::7], 20)
    angles, norms = hard_negatives.angles_to(v, way), np.linalg.norm(v, axis=1)
    order = np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))
    starts = np.arange(0, len(v), 50)
    edge = lambda f, x: f.reduceat(x[order], starts, axis=0)
    lower, upper = hard_negatives.bounds(angles, norms, edge(np.minimum, angles), edge(np.maximum, angles), edge(np.minimum, norms), edge(np.maximum, norms))
    exact = (v @ v[order].T).reshape(len(v), -1, 50)
    assert (lower[:, :, None] <= exact).all() and (exact <= upper[:, :, None]).all()
    best = np.sort(exact.reshape(len(v), -1), axis=1)[:, -5]
    assert (upper >= best[:, None]).mean() < 0.5
