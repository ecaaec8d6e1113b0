"""Text operators against brute force, the libraries, exact round trips and odd rows."""

import collections
import hashlib
import math
import random
from fractions import Fraction
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import common, fingerprints, license_scan, near_dedup, packing, pii, piece_codec, quality_knn, quality_rules, sql, token_counts, toxicity
from sightline.llm.queries import PIECE_MODEL, QUERIES, WORD_MODEL, vocabulary
from tests.conftest import DATA

LONG = "lang word " * 20000
ROWS = [(1, "Hello world. " * 30), (2, ""), (3, None), (None, "no id here"), (4, LONG), (5, "tie"), (6, "tie"), (5, "tie"), (7, "ÀÉ ﬁ ß x@y.zz +1 (988) 555-2485")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", F.lit("x").alias("score"), F.lit(1).alias("n_words"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit(1).alias("bands"), F.lit("k").alias("key"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, 1, None), (5, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def all_operators(labels):
    piece, word = vocabulary(PIECE_MODEL), vocabulary(WORD_MODEL)
    return {
        "rules": lambda d: quality_rules.quality_rules(d, labels), "licence": license_scan.scan, "toxicity": lambda d: toxicity.toxicity(d, labels), "tokens": lambda d: token_counts.token_counts(d, piece),
        "near": near_dedup.near_duplicates, "digest": fingerprints.fingerprints, "edited": fingerprints.edited_fingerprints, "private": pii.personal_data, "packing": lambda d: packing.best_fit_packing(d, word),
        "codec": lambda d: piece_codec.round_trip(d, piece), "classifier": lambda d: quality_knn.quality_classifier(d, labels),
    }


@pytest.mark.parametrize("name", ["rules", "licence", "toxicity", "tokens", "near", "digest", "edited", "private", "packing", "codec", "classifier"])
def test_odd_rows_and_empty_tables(odd, labels, name):
    run = all_operators(labels)[name]
    got = run(odd).collect()
    per_doc = [r for r in got if name != "packing" or r["piece"] == 0]
    assert len(per_doc) == len(ROWS) and sum(r["doc_id"] is None for r in per_doc) == 1
    twice = [tuple(r) for r in per_doc if r["doc_id"] == 5]
    assert len(twice) == 2 and (name == "packing" or twice[0] == twice[1])
    assert run(odd.limit(0)).count() == 0


def test_no_labels_at_all(odd, labels):
    none = labels.limit(0)
    assert {r["score"] for r in quality_knn.quality_classifier(odd, none).collect()} == {0.5}
    assert len({r["score"] for r in toxicity.toxicity(odd, none).collect()}) == 1
    assert quality_rules.quality_rules(odd, none).count() == len(ROWS)


def base_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = collections.Counter(zip(*(words[i:] for i in range(8))))
    again = {j for i, w in enumerate(zip(*(words[i:] for i in range(8)))) if windows[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen and re.search(r"[^\x20\x09-\x0D]", line):
            dup += 1
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_quality_rules_base_counts(spark, docs, texts):
    labels = common.table(spark, DATA, "labels")
    for r in quality_rules.quality_rules(docs, labels).collect():
        n, chars, symbols, dup, again = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 20 or 100 * again > 30 * n) and not (r["base_failed"] and r["kept"])


def plain_features(text):
    """Features of each line with a word, from their meaning, on characters."""
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = []
    for k, line in enumerate(lines):
        w, size, n = re.split(r"[\x20\x09-\x0D]+", line.strip(" \t\n\r\x0b\x0c")), len(line.encode()), 0
        n = len(w)
        count = lambda p: len(re.findall(p, line))
        sym, up, low, dig = count(r"[#*$%&|<>]"), count("[A-Z]"), count("[a-z]"), count("[0-9]")
        runs = sum(len(set(w[i : i + 64])) for i in range(0, n, 64))
        holds = {
            "bias": True, "first_line": k == 0, "last_line": k == len(lines) - 1, "under_4_words": n < 4, "over_25_words": n > 25, "symbols_2pct": 50 * sym >= size, "symbols_8pct": 50 * sym >= size and 12 * sym >= size,
            "bars": 50 * sym >= size and 6 * line.count("|") >= n, "capitals_30pct": up > 2 and 10 * up >= 3 * (up + low), "capitals_60pct": up > 2 and 10 * up >= 6 * (up + low), "shouting": 5 * line.count("!!") >= n,
            "digits_20pct": 5 * dig >= size, "neighbours_equal": n > 3 and 5 * sum(a == b for a, b in zip(w, w[1:])) >= n, "few_distinct": n > 3 and 2 * runs < n, "seen_before": line in lines[:k],
            "ends_sentence": w[-1][-1] in ".?!", "digit_inside_short": 5 * dig >= size and n < 8, "markup": 50 * sym >= size and line.count("<") >= 2,
        }
        out.append(([f for f, name in enumerate(quality_rules.FEATURES) if holds[name]], n))
    return out


def test_quality_rules_verdict_equals_brute_force(spark, docs, texts):
    """Content share and verdict from features by their meaning and the best of all paths (or max-sum tables on long texts)."""
    model = quality_rules.train(docs, common.table(spark, DATA, "labels"))
    w, tr = model
    extra = {10_001: "Buy | now | here\nA clean sentence of some words stands here.\n" * 40, 10_002: " ".join(f"w{i % 300}" for i in range(3000)), 10_003: None}
    every = texts | extra
    checked = 0
    for r in quality_rules.apply_rules(spark.createDataFrame(list(every.items()), "doc_id long, text string"), model).collect():
        lines = plain_features(every[r["doc_id"]] or "")
        emit = [w[f].sum(0) for f, _ in lines]
        if 0 < len(lines) <= 10:
            paths = np.array([[(k >> i) & 1 for i in range(len(lines))] for k in range(2 ** len(lines))])
            value = sum(np.array(emit)[i, paths[:, i]] for i in range(len(lines))) + sum(tr[paths[:, i], paths[:, i + 1]] for i in range(len(lines) - 1))
            best = paths[value.argmax()].tolist()
        else:
            best, tables = [], [np.zeros((0, 2))] if not lines else [emit[0]]
            for e in emit[1:]:
                tables.append(e + (tables[-1][:, None] + tr).max(0))
            for t in reversed(tables if lines else []):
                best.insert(0, int((t + (tr[:, best[0]] if best else 0)).argmax()))
        words = sum(n for _, n in lines)
        share = sum(n for (_, n), y in zip(lines, best) if y) / words if words else 0.0
        assert math.isclose(r["content_share"], share, abs_tol=1e-9) and r["kept"] == (not r["base_failed"] and share >= 0.5)
        checked += 0 < len(lines) <= 10
    assert checked > 50


def test_line_labels_differ_inside_documents():
    clean, bars = 1, 9
    docs = [(0, [[clean] + [bars] * 5])] * 20 + [(1, [[clean] * 6])] * 60
    got = quality_rules.line_labels(docs)
    assert got[0] == [[1, 0, 0, 0, 0, 0]] and got[-1] == [[1] * 6]
    assert quality_rules.line_labels(docs[:20])[0] == [[0] * 6] and quality_rules.line_labels(docs[20:])[0] == [[1] * 6]
    long = list(range(1000))
    assert [b[0] for b in quality_rules.blocks_of(long)][0] == 0 and quality_rules.blocks_of(long)[-1][-1] == 999


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        emit, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(emit[i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        best = max(value([(k >> i) & 1 for i in range(n)]) for k in range(2**n))
        assert math.isclose(value(quality_rules.viterbi([tuple(e) for e in emit], trans)), best)


def test_classifiers_on_held_out_rows(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    for scored, label in ((quality_knn.quality_classifier(docs, labels), "quality"), (toxicity.toxicity(docs, labels), "toxic")):
        rows = scored.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y")).collect()
        assert len(rows) > 50 and sum(r["predicted"] == r["y"] for r in rows) / len(rows) > 0.93
        assert scored.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_nearest_neighbours_equal_brute_force():
    """Scores equal a plain ranking by (cosine, sample row), with many equal sample vectors."""
    rng = np.random.default_rng(5)
    base = ["a clean text of words", "junk | junk | junk", "MORE!! NOISE!! HERE!!", "one two three four five six", "der die das und ein"]
    sample = [base[i] + (" and more" * (i % 3)) for i in rng.integers(0, 5, 200)]
    space = quality_knn.Space(np.stack([quality_knn.term_counts(t) for t in sample]), rng.integers(0, 2, 200))
    asked = [*base, "", "something else | with 12 words", *sample[:20]]
    counts = np.stack([quality_knn.term_counts(t) for t in asked])
    scores, _ = space.vote(counts)
    q = space.unit(space.weigh(counts) @ space.basis)
    for text, v, score in zip(asked, q, scores):
        cos = [round(float(c), quality_knn.DECIMALS) for c in (v[None] @ space.vectors.T)[0]]
        first = sorted(range(200), key=lambda i: (-cos[i], i))[: quality_knn.K]
        want = sum(max(cos[i], 0) * space.labels[i] for i in first) / sum(max(cos[i], 0) for i in first) if text else space.prior
        assert math.isclose(score, want, abs_tol=1e-6)


def test_classifier_reads_words(spark):
    """Texts alike in characters and form, told apart by their words alone."""
    rng = random.Random(4)
    words = [["lamo", "neri", "tosa", "vilu"], ["mola", "rine", "sato", "luvi"]]
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(30)) + ".") for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    got = quality_knn.quality_classifier(docs, labels).where("held_out").collect()
    assert len(got) > 50 and sum((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got) / len(got) > 0.95


def test_classifier_votes_with_4096_labels(spark):
    rng = random.Random(7)
    n = 5200
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(999)}" for _ in range(8))) for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    fit = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n))
    space = quality_knn.train(docs, labels)
    assert 4000 < len(space.vectors) <= min(4096, fit) and len(space.vectors) == len(space.labels)


def test_toxicity_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 1.0, "trash": 2.0, "stupid": 1.5})
    assert lex.hits(toxicity.fold("IDІ0T id1ot! $tupid tr@sh")) == [1.0, 1.0, 1.5, 2.0]
    assert lex.hits(toxicity.fold("trash can, trashcan idiots")) == [] and lex.hits(toxicity.fold("idiot$$$ !!idiot!!")) == [1.0, 1.0]


def test_token_counts_equal_the_library(spark, docs, texts):
    import sentencepiece

    path = vocabulary(PIECE_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng, parts = random.Random(1), ["a", "b", " ", " ", "\n", "the", "▁", "é", "\t", "日", "<s>", "1", "\x00", ".", " the", "　"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in made:
        assert sum(token_counts.lengths_of(token_counts.pretokens(t), path)) - t.count("\n") == len(sp.encode(t))
    codec = piece_codec.Codec(path)
    got = codec.encode(made)
    for t, ids, back in zip(made, got, codec.decode(got)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t) and back == t.replace("▁", " ")
    long = ["x" * 30_000, "word" * 20_000 + "é" * 5000, "\x01" * 2000, "日本" * 3000, "\n" * 5000, "aaaa bbbb" * 9000]
    for t, ids in zip(long, codec.encode(long)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t)
    for r in token_counts.token_counts(docs, path).collect():
        n = len(sp.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4096)
    encoded = common.materialize(piece_codec.encode_pieces(docs, path))
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode_pieces(encoded, path).collect()} == texts
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == sp.encode(texts[r["doc_id"]]) for r in encoded.collect())


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    holders = collections.defaultdict(list)
    for i in ids:
        shared = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_family(seed, size, n_words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    made = near_family(1, 120, 150, 8) + near_family(2, 60, 40, 3) + near_family(3, 40, 400, 12) + ["same text as others here"] * 30 + ["", "one", "one two", "One Two"]
    every = dict(texts) | {10_000 + i: t for i, t in enumerate(made)}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    want = brute_components(every)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == want
    kept = {r["doc_id"] for r in near_dedup.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_sketch_bound_keeps_pairs_at_the_similarity(spark):
    """Pairs exactly at 0.75: none may be lost by either sketch, from 5 to 200,000 shingles."""
    rng = np.random.default_rng(3)
    rows = []
    for n, times in ((5, 200), (20, 400), (60, 400), (150, 400), (400, 300), (1500, 200), (5000, 100), (20000, 40), (200000, 6)):
        for _ in range(times):
            shared = math.ceil(1.5 * n / 1.75)
            h = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            rng.shuffle(h)
            h = h[: 2 * n - shared]
            sides = []
            for s in (np.sort(h[:n]), np.sort(h[n - shared :])):
                fine, coarse = near_dedup.odd_sketch(s, near_dedup.FINE), near_dedup.odd_sketch(s, near_dedup.COARSE)
                sides.append((len(s), fine[0].tolist(), fine[1], coarse[0].tolist(), coarse[1]))
            rows.append(tuple(sides))
    side = "struct<n:long,fine:array<long>,fine_filled:int,coarse:array<long>,coarse_filled:int>"
    df = spark.createDataFrame(rows, f"l {side}, r {side}")
    assert df.where(near_dedup.passes("l", "r", "fine", 75)).count() == len(rows)
    assert df.where(near_dedup.passes("l", "r", "coarse", 75)).count() == len(rows)


def test_repeated_rows_stay_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0) for r in near_dedup.keep_one(df).collect())) == [0, 1, 3]


def test_fingerprints_equal_brute_force(docs, texts):
    import xxhash

    def form(t):
        return re.sub(fingerprints.SPACE, " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")

    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        b = form(t).encode()
        second = xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(fingerprints.SECOND.encode(), 42))
        r = got[i]
        assert r["fingerprint"] == f"{xxhash.xxh64_intdigest(b, 42):016x}{second:016x}" and r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"], r["near_next"]) == (float(form(edited) == form(t)), float(form(nxt) == form(t)))


def test_fingerprints_fold_case(spark):
    same = [("straße", "STRASSE"), ("ΣΊΣΥΦΟΣ", "σίσυφος"), ("ﬁne  x", "FINE X"), ("Ǆ", "ǆ")]
    df = spark.createDataFrame([(2 * i + k, t) for i, pair in enumerate(same) for k, t in enumerate(pair)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(same))) and len(set(got.values())) == len(same)


def test_clashing_digests_are_told_apart(spark):
    df = spark.createDataFrame([(1, "Aa"), (2, "aA"), (3, "bb"), (4, "bb")], "doc_id long, text string")
    same = df.select("doc_id", F.lit("d").alias("digest"))
    got = {r["doc_id"]: r["own"] for r in fingerprints.clashes(df, same).collect()}
    assert set(got) == {3, 4} and got[3] == got[4]


def brute_private(text):
    out = []
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, pattern in patterns:
        if {"email": "@", "ip": "."}.get(kind, "") not in text:
            continue
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_brute_force(spark, docs, texts):
    rng = random.Random(3)
    parts = ["a", "b@", "@c", ".d", "1", "22", "333", ".", "-", " ", "+", "(", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "é", "😀", "\n", "%", "+1 (988) 555-2485", "0"]
    made = {10_000 + i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for i in range(1500)}
    every = texts | made
    for r in pii.personal_data(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect():
        want = brute_private(every[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE] == want


def test_more_kinds_and_redaction(spark):
    df = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32, GB83 WEST 1234 5698 7654 32"), (2, "my ssn 123-45-6789"), (3, "code 123-45-6789"), (4, "mail x@y.zz or +1 (988) 555-2485.")], "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long"))
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert spans == {1: "iban:5:32", 2: "identity:7:18", 3: "", 4: "email:5:11,phone:15:32"}
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert clean[4] == ("mail [EMAIL] or [PHONE].", 24) and clean[3][0] == "code 123-45-6789"


def test_long_runs_do_not_overflow_the_stack(spark):
    n = 100_000
    long = {1: "7" * n, 2: "7 " * n, 3: "7-7 " * n}
    rows = [(i, f"{t} +1 (988) 555-2485") for i, t in long.items()] + [(4, "x@y" + ".zz" * n)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: f"phone:{len(t) + 1}:{len(t) + 18}" for i, t in long.items()} | {4: f"email:0:{3 + 3 * n}"}


def test_any_text_of_a_megabyte(spark):
    """Runs of one character or a few: every text operator with patterns ends, and base spans equal brute force."""
    n = 300_000
    runs = ["7", "7 ", ".", "a.", "@", "+", "+1 ", "\n", " ", "\n ", "0-", "A1", "x@", "1.", "f", "-"]
    every = {i: (r * (n // len(r))) for i, r in enumerate(runs)} | {100: "Released under the MIT License." + "\n" * 50_000, 101: "1.2.3.4 x@y.zz " * 3000}
    df = spark.createDataFrame(list(every.items()), "doc_id long, text string").repartition(18)
    for r in pii.personal_data(df).collect():
        want = brute_private(every[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
    blob = spark.createDataFrame([(1, "a1" * (n // 2) + " x@y.zz 1.2.3.4 " + "7" * n)], "doc_id long, text string")
    assert pii.personal_data(blob).first()["spans"] == f"email:{n + 1}:{n + 7},ip:{n + 8}:{n + 15}"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[101] == "[IP] [EMAIL] " * 3000 and clean[0] == every[0]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(df).collect()}
    assert got[100] == "MIT" and sum(x is not None for x in got.values()) == 1


def test_redaction_keeps_any_columns(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz", "n", "e", "r", 5), (2, None, "n", "e", "r", 7)], "doc_id long, text string, _null string, _email string, `row.a b` string, n_chars long")
    got = {r["doc_id"]: tuple(r) for r in pii.redact(df).collect()}
    assert got == {1: (1, "mail [EMAIL]", "n", "e", "r", 12), 2: (2, None, "n", "e", "r", 7)} and pii.redact(df).columns == df.columns
    swapped = df.select("n_chars", "text", F.lit(1).alias("row"), "doc_id")
    assert sorted(r["n_chars"] for r in pii.redact(swapped).collect()) == [7, 12]


def test_context_after_a_span(spark):
    token = "0123456789abcdef" * 2 + "01234567"
    df = spark.createDataFrame([(1, "123-45-6789 (SSN)"), (2, f"{token} is the api key"), (3, f"{token}{' ' * 40}api key"), (4, "123-45-6789, social")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()} == {1: "identity:0:11", 2: "token:0:40", 3: "", 4: "identity:0:11"}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[2] == "[TOKEN] is the api key"


def test_licence_scan_equals_brute_force(spark, docs, texts):
    t = license_scan.TEMPLATES
    made = {10_001: "x\n" + t["ISC"].replace(", ", ",\n") + "\ny", 10_002: t["MIT-permission"].replace("and", "&"), 10_003: "Foo\n\n" + t["MPL-2.0"].replace(" the ", " the\n") + "\n\nbar", 10_004: (t["Apache-2.0"] + " ") * 2}
    every = texts | made
    for r in license_scan.scan(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect():
        assert (r["license"], r["dice"], r["n_matches"]) == license_scan.brute_force(every[r["doc_id"]])


def test_licence_notices_among_other_words(spark):
    t, prose = license_scan.TEMPLATES, "Some words that stand before and have nothing to do with it. "
    cases = {
        1: ("This file is released under the MIT License.", "MIT", 1.0, 1),
        2: ("Released under the MIT License. See LICENSE for details.", "MIT", 1.0, 1),
        3: (prose * 20 + t["GPL-3.0"] + " " + prose * 20, "GPL-3.0", 1.0, 1),
        4: (prose * 3 + t["MIT-permission"].replace("deal in", "deal freely in") + " " + prose * 3, "MIT-permission", None, 1),
        5: (t["MIT"] + "\n" + prose + "Parts are " + t["CC-BY-4.0"] + " " + prose, "CC-BY-4.0", 1.0, 2),
        6: (" ".join(f"w{i}" for i in range(60)) + " " + t["ISC"].replace(" ", "\n", 9) + " " + prose, "ISC", 1.0, 1),
        7: (prose + "It was released under a licence that the MIT people like.", None, None, 0),
    }
    for r in license_scan.scan(spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "doc_id long, text string")).collect():
        _, license, dice, n = cases[r["doc_id"]]
        assert (r["license"], r["n_matches"]) == (license, n) and (dice is None or r["dice"] == dice), r


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary(WORD_MODEL)
    tok, enc = Tokenizer.from_file(path), packing.Encoder(path, 500)
    rng, parts = random.Random(1), ["a", "B.", " ", " ", "\n", "the", "É", "é", "\t", "日", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "\x00", ".", ", ", "'s", "Σ", "\x85", "\x1c", "İ", "ſ", "_", "-"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    rows = packing.best_fit_packing(docs, path).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(2048 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.02 + 1


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_plan_keeps_every_capacity(rule):
    rng = random.Random(5)
    counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(60)}
    bins, seen = collections.defaultdict(list), collections.Counter()
    for length, first, ranks, each, sequence, offset in packing.plan_bins(counts, 100, 4, 6000.0, rule=rule):
        assert first == seen[length]
        seen[length] += ranks
        for r in range(ranks):
            bins[sequence + r // each].append(length)
    assert seen == counts
    assert all(sum(b) <= 100 and (len(b) <= 4) and (sum(x * x for x in b) <= 6000 or len(b) == 1) for b in bins.values())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs, columns = common.table(spark, DATA, "documents"), None
    last = None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, DATA))
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
            last = docs
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in last.select("doc_id").collect()}
    direct = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert direct == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect())


def test_queries_have_contract_columns(spark):
    want = {
        "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3_toxicity": "doc_id held_out score predicted", "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op5_near_duplicates": "doc_id n_shingles component_id kept", "op7_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10_quality_classifier": "doc_id held_out score predicted",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(QUERIES[name](spark, DATA).columns)


def test_equal_ids_with_other_texts_are_other_documents(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (5, c + " end"), (6, ""), (6, a + " tail"), (6, ""), (7, "few words"), (7, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("k").alias("_set"), F.lit(1).alias("node")).drop("_set")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    expect = [(1, 26, 1, True), (1, 26, 1, True), (2, 26, 1, False), (3, 26, 1, False), (4, 26, 4, True), (4, 26, 4, True), (5, 27, 4, False), (6, 0, 6, True), (6, 0, 6, True), (6, 27, 1, False), (7, 1, 7, True), (7, 0, 7, True), (None, 26, None, True)]
    assert got == sorted(expect, key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, c), (6, ""), (7, "few words"), (7, None), (None, a)], key=str)


def test_toxicity_length_does_not_depend_on_the_kind_of_white_space():
    text = " ".join(f"word{k}" for k in range(100))
    assert [toxicity.words_in(t) for t in (text, text.replace(" ", "\n"), "", "  \t", " a\r\nb ")] == [100, 100, 0, 0, 2]


def licence_by_hand(text):
    """Lines, paragraphs and texts as brute_force() has them, then every window of every template in what they leave."""
    least = license_scan.LEAST
    sets = {k: set(license_scan.bigrams(license_scan.plain(v))) for k, v in license_scan.TEMPLATES.items()}

    def dice(own, name):
        return Fraction(2 * len(own & sets[name]), len(own) + len(sets[name]))

    def matching(part):
        own = set(license_scan.bigrams(part.split()))
        return [(-dice(own, k), k) for k in sets if own and dice(own, k) >= least]

    norm = re.sub(r"[^a-z0-9\n]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    blocks = re.split(r"\n[ \n]*\n", norm)
    hits = [h for p in {" ".join(x.split()) for x in [*norm.split("\n"), *blocks, norm]} for h in matching(p)]
    if not hits:
        left = norm
    elif matching(norm):
        left = ""
    else:
        left = " ".join("|" if matching(b) else " ".join("|" if matching(x) else x for x in b.split("\n")) for b in blocks)
    words = left.split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, own in sets.items():
        high = int((2 - least) / least * len(own))
        found = [dice(set(grams[s:e]), name) for s in range(len(grams)) if grams[s] in own for e in range(s + 1, min(s + high, len(grams)) + 1)]
        if max(found, default=0) >= least:
            hits.append((-max(found), name))
    return (min(hits)[1], round(float(-min(hits)[0]), 6), len(hits)) if hits else (None, None, 0)


def licence_mixture(r, chars):
    out = ""
    while len(out) < chars:
        words = r.choice(list(license_scan.TEMPLATES.values())).split()
        a = r.randrange(len(words)) if r.random() < 0.5 else 0
        piece = words[a : a + r.randrange(3, 60)]
        if r.random() < 0.4:
            piece[r.randrange(len(piece))] = "other"
        out += " ".join(piece) + r.choice([" ", " some prose ", "\n", "\n\n"])
    return out


def test_licence_windows_equal_brute_force(spark):
    r = random.Random(11)
    every = {k: licence_mixture(r, r.choice([60, 300, 1500])) for k in range(120)}
    got = license_scan.scan(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in got} == {k: licence_by_hand(t) for k, t in every.items()}


def test_a_megabyte_of_licence_wording_ends_soon(spark):
    began = time.time()
    (got,) = license_scan.scan(spark.createDataFrame([(1, licence_mixture(random.Random(2), 1_000_000).replace("\n", " "))], "doc_id long, text string")).collect()
    assert got["n_matches"] > 3 and time.time() - began < 90


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    words = "The committee said that the plan for the new school was ready and that work would begin in the spring of the next year because most people wanted it. "
    more = spark.createDataFrame([(20, words * 2), (20, words * 2), (21, words * 2), (22, words + "Call +1 (988) 555-2485 now. " + words), (23, words * 4000), (None, words)], "doc_id long, text string")
    docs = odd.unionByName(more.select("*", *(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes if c not in ("doc_id", "text"))))
    for start in (docs, docs.limit(0)):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            after = common.materialize(stage(spark, rows, DATA))
            if name == "packing":
                ids = collections.Counter(r["doc_id"] for r in after.where("piece = 0").collect())
                assert ids == collections.Counter(r["doc_id"] for r in rows.collect())
                continue
            assert after.columns == rows.columns and [t for _, t in after.dtypes] == [t for _, t in rows.dtypes]
            if name != "personal_data":
                lost = collections.Counter((r["doc_id"], r["text"]) for r in after.collect()) - collections.Counter((r["doc_id"], r["text"]) for r in rows.collect())
                assert not lost
            if name == "near_dedup":
                kept = collections.Counter(r["doc_id"] for r in after.collect())
                assert all(n == 1 for d, n in kept.items() if d is not None) and not {20, 21} <= set(kept)
            rows = after


def test_pipeline_near_dedup_equals_sql_on_what_came_before(spark):
    import duckdb

    import corpus_pipeline

    docs = common.table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, DATA))
        if name == "near_dedup":
            break
    con = duckdb.connect()
    con.register("documents", before.select("doc_id", "text").toPandas())
    want = {d for d, kept in con.sql(f"SELECT doc_id, kept FROM ({sql.SQL['op5_near_duplicates']})").fetchall() if kept}
    assert {r["doc_id"] for r in docs.collect()} == want and len(want) < before.count()
