"""MinHash near-duplicates: banded candidates, odd sketches, exact confirmation, connected components.

1. Each text becomes its set of 5-word shingles (64-bit hashes), a digest of that set, BANDS bands of ROWS MinHash
   values, and two odd sketches: MinHash samples (the least hash of each of 2^20 and of 2^12 ranges) folded into parity bitmaps.
2. Texts with equal sets form a class; its smallest id stands for it, so copies never meet again.
3. In every band bucket the members are compared with a hub, not with each other. Pairs whose sketches'
   XOR has too many bits for the similarity are dropped; the others are confirmed on the full sets.
4. Confirmed links give components (large-star and small-star steps). Buckets whose members are all in one component are
   done. In the others, whatever is outside the bucket's largest component meets the bucket's members in blocks of BLOCK;
   only ids and the fine sketch take part, and only pairs that pass size and sketch come out, each once for all its buckets.
   Those are confirmed like the first, which gives the final components. So no link is given up.

At a similarity of 0.75 a pair meets in no bucket with probability (1 - 0.75^4)^32 = 5e-6. A set of up to some thousand
shingles goes into the fine sketch whole, where its XOR never has more bits than the sets differ in; the coarse one serves
large sets. Both bounds lie well above what a pair at the similarity shows (tests measure it from 5 to 200,000 shingles).

Defined cases: a null or empty text, or one without words, has 0 shingles and is linked with nothing
(component_id is its own id); fewer than 5 words form one shingle; rows with the same doc_id and text get
equal answers; rows with the same doc_id and other texts are documents of their own under one name; rows without doc_id link nothing and are kept; ties cannot occur, since the smallest id of
a component decides; an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import common

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of a sketch, and of the number of a range: of the fine sketch and of the coarse one.
SKETCH_BITS, FINE, COARSE = 2048, 20, 12
#: Members of a bucket that meet in one block; pairs for one copy of a hub's text.
BLOCK, HUB_SHARE = 512, 512
SIGNATURES = "doc_id long, n_shingles long, set_id binary, bands array<long>, fine array<long>, fine_filled int, coarse array<long>, coarse_filled int"

_rng = np.random.RandomState(20011)
_MUL = (_rng.randint(0, 2**32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _rng.randint(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z are lowered, words end at ASCII white space."""
    import xxhash

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    roll = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        roll = roll * _P + h[j : n - width + 1 + j]
    return np.unique(_mix(roll))


def set_digest(hashes: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def minhash(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES minima under multiply-add permutations of the upper 32 bits."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[None, i : i + 4096] * _MUL + _ADD).min(1), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """Band keys (docs x BANDS) of stacked MinHash values."""
    values = minima.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(values), BANDS)).copy()
    for j in range(ROWS):
        keys = _mix(keys * _P + values[:, :, j] + np.uint64(1))
    return keys.view(np.int64)


def odd_sketch(hashes: np.ndarray, range_bits: int = COARSE) -> tuple[np.ndarray, int]:
    """Parity bitmap of the least hash in each of 2^range_bits equal ranges, and how many ranges have one. hashes: sorted."""
    place = hashes >> np.uint64(64 - range_bits)
    least = hashes[np.concatenate([[True], place[1:] != place[:-1]])]
    bit = (_mix(least * _P) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    parity = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64), len(least)


def signatures(docs: DataFrame) -> DataFrame:
    common.ship(docs.sparkSession)
    names = [c.split()[0] for c in SIGNATURES.split(", ")]

    def run(batches):
        for b in common.bounded(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sketches = [None] * len(sets), [[None, 0, None, 0] for _ in sets]
            if full:
                for i, x in zip(full, band_keys(np.stack([minhash(sets[i]) for i in full])).tolist()):
                    keys[i] = x
                    sketches[i] = [*odd_sketch(sets[i], FINE), *odd_sketch(sets[i], COARSE)]
            ids = [set_digest(s) for s in sets]
            lists, types = list(zip(*sketches)) or [()] * 4, (pa.list_(pa.int64()), pa.int32()) * 2
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, lists, types)], names
            )

    return common.text_rows(docs).mapInArrow(run, SIGNATURES)


def _bits(a: Column, b: Column) -> Column:
    """Bits that differ between two sketches."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def most_bits(n: Column, m: Column, filled: Column, percent: int, range_bits: int) -> Column:
    """The most bits that may differ between the sketches of two sets of n and m shingles that reach the similarity.

    A union of u shingles fills ranges * (1 - exp(-u / ranges)) ranges, and in the share j of them both
    sets have the same least hash; the other samples of either set are folded into one of the sketches only.
    """
    j, ranges, bits = percent / 100, float(2**range_bits), float(SKETCH_BITS)
    union = (n + m) / F.lit(1 + j)
    both = -ranges * F.expm1(-union / ranges)
    spread = 2 * F.sqrt(j * (1 - j) * both * F.greatest(1 - both / union, F.lit(0.0)))
    folded = filled - 2 * j * both + 7 * spread + 4
    shown = bits / 2 * (1 - F.exp(-2 * folded / bits)) + 4 * (folded / F.lit(bits**0.5) + 1)
    return F.least(folded, shown)


def similar_sizes(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def passes(a: str, b: str, kind: str, percent: int) -> Column:
    """May the pair reach the similarity by its sketches of one kind ('fine' or 'coarse')?"""
    range_bits = {"fine": FINE, "coarse": COARSE}[kind]
    x, y = F.col(a), F.col(b)
    most = most_bits(x["n"], y["n"], x[f"{kind}_filled"] + y[f"{kind}_filled"], percent, range_bits)
    return _bits(x[kind], y[kind]) <= most


def ends_of(pairs: DataFrame) -> DataFrame:
    """The distinct ids (doc_id) that stand in pairs (a, b); either side is made distinct where it lies."""
    return pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct())


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, repeated: bool = True) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets reach the similarity. repeated: may docs have rows with equal ids?

    The text of b travels with its pair; that of a goes once to each share of HUB_SHARE of its pairs and is read first there.
    """
    texts = common.text_rows(docs.where(F.col("doc_id").isNotNull()))
    ids = ends_of(pairs)
    texts = common.materialize(common.wanted_rows(texts, ids))
    own = texts.groupBy("doc_id").agg(F.first("text").alias("text")) if repeated else texts
    hubs = pairs.groupBy("a").agg((1 + F.count("*") / HUB_SHARE).cast("int").alias("copies"))
    shares = pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("share"))
    members = shares.join(own.withColumnRenamed("doc_id", "b"), "b").select("a", "share", "b", "text")
    heads = hubs.join(own.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "text")
    dealt = heads.unionByName(members).repartition("a", "share").sortWithinPartitions("a", "share", F.asc_nulls_first("b"))

    def run(batches):
        hub = np.zeros(0, np.uint64)
        for x in common.bounded(batches):
            ok = []
            for b, text in zip(x.column("b").to_pylist(), x.column("text").to_pylist()):
                own = shingles(text)
                if b is None:
                    hub = own
                    ok.append(False)
                else:
                    inter = len(np.intersect1d(hub, own, assume_unique=True))
                    ok.append(100 * inter >= percent * (len(hub) + len(own) - inter))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = common.materialize(dealt.mapInArrow(run, "a long, b long"))
    common.drop_table(texts)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node that is reachable.

    Alternates large-star and small-star steps until a step changes nothing; each step's edges are a
    table in the shared folder.
    """
    step = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    mark = None
    while True:
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = common.materialize(small.where("u > v").distinct())
        common.drop_table(step)
        step = after
        now = tuple(step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            out = step.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._sightline_path = step._sightline_path
            return out
        mark = now


def candidates_apart(in_buckets: DataFrame, fetch: Callable, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, are in different components, and may be similar by sizes and fine sketch.

    In each bucket the members outside its largest component meet all members, in blocks that are dealt by (key, block).
    """
    placed = common.materialize(in_buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = (
        parts.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"), (1 + F.sum("n") / BLOCK).cast("int").alias("blocks"))
        .where("roots > 1").drop("roots")
    )
    own = common.materialize(placed.join(mixed, "key").select("key", "blocks", "rep", "root", (F.col("root") == F.col("main")).alias("major")))
    known = fetch(own.select(F.col("rep").alias("doc_id"))).select("rep", F.struct("n", "fine", "fine_filled").alias("x"))
    rows = common.materialize(own.join(known, "rep"))
    for t in (placed, own):
        common.drop_table(t)
    left = rows.where("not major").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("rep").alias("a"), F.col("root").alias("root_a"), F.col("x").alias("l"))
    right = rows.select("key", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("b"), F.col("root").alias("root_b"), "major", F.col("x").alias("r"))
    apart = (F.col("root_a") != F.col("root_b")) & (F.col("major") | (F.col("a") < F.col("b")))
    near = apart & similar_sizes(F.col("l.n"), F.col("r.n"), percent) & passes("l", "r", "fine", percent)
    pairs = left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    out = common.materialize(pairs.distinct())
    common.drop_table(rows)
    return out


def near_classes(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(signatures of all rows; classes: set_id, rep; components: node, root over the classes' representatives; do ids clash).

    A row's node is its doc_id. Where one doc_id stands for different sets, each of them is a node of its own.
    """
    sketches = ("fine", "fine_filled", "coarse", "coarse_filled")
    sig = common.materialize(signatures(docs))
    again = common.materialize(
        sig.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("set_id") != F.max("set_id")).alias("clash")).where("n > 1").select("doc_id", F.coalesce("clash", F.lit(False)).alias("clash"))
    )
    repeated = not again.isEmpty()
    clash = again.where("clash").select("doc_id")
    clashing = repeated and not clash.isEmpty()
    if clashing:
        node = F.when(F.col("clash") & F.col("set_id").isNotNull(), node_of("doc_id", "set_id")).otherwise(F.col("doc_id"))
        sig = sig.join(clash.withColumn("clash", F.lit(True)), "doc_id", "left").withColumn("node", node).drop("clash")
        rows = docs.select("doc_id", "text")
        known = set_ids(rows.join(clash, "doc_id", "left_semi")).where("_sightline_set is not null")
        docs = rows.join(clash, "doc_id", "left_anti").union(known.select(node_of("doc_id", "_sightline_set").alias("doc_id"), "text"))
    else:
        sig = sig.withColumn("node", F.col("doc_id"))
    # The sketches stay where they were made; only those of texts that stand in a pair or a mixed bucket are fetched.
    reps = common.materialize(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("node").alias("rep"), F.min_by(F.struct("n_shingles", "bands"), "node").alias("x"))
        .select("set_id", "rep", F.col("x.n_shingles").alias("n"), "x.bands")
    )

    def fetch(ids: DataFrame) -> DataFrame:
        """rep, n and sketches of the representatives in ids (doc_id)."""
        rows = sig.where("n_shingles > 0 and node is not null").select(F.col("node").alias("doc_id"), F.col("n_shingles").alias("n"), *sketches)
        found = common.wanted_rows(rows, ids).withColumnRenamed("doc_id", "rep")
        return found.dropDuplicates(["rep"]) if repeated else found

    members = reps.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    in_buckets = common.materialize(members.join(buckets, "key").select("key", "rep", "hub", "size"))

    def check(pairs: DataFrame, *kinds: str) -> DataFrame:
        """The confirmed ones of distinct pairs, after sizes and the sketches of these kinds."""
        side = F.struct("n", *(c for k in kinds for c in (k, f"{k}_filled")))
        known = common.materialize(fetch(ends_of(pairs)).select("rep", side.alias("x")))
        a, b = known.select(F.col("rep").alias("a"), F.col("x").alias("l")), known.select(F.col("rep").alias("b"), F.col("x").alias("r"))
        near = pairs.join(a, "a").join(b, "b").where(similar_sizes(F.col("l.n"), F.col("r.n"), percent))
        for kind in kinds:
            near = near.where(passes("l", "r", kind, percent))
        near = common.materialize(near.select("a", "b"))
        found = confirm(near, docs, percent, repeated)
        for t in (near, known):
            common.drop_table(t)
        return found

    with_hubs = common.materialize(in_buckets.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    first = check(with_hubs, "fine", "coarse")
    roots = components(first)
    apart = candidates_apart(in_buckets.where("size > 2").select("key", "rep"), fetch, roots, percent)
    second = check(apart, "coarse")
    if not second.isEmpty():
        joined = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
        common.drop_table(roots)
        roots = joined
    for t in (in_buckets, with_hubs, first, apart, second):
        common.drop_table(t)
    return sig, reps, roots, clashing


def set_ids(docs: DataFrame) -> DataFrame:
    """docs with the digest of each text's shingle set as one more column, _sightline_set; null without words."""
    common.ship(docs.sparkSession)

    def run(batches):
        for b in common.bounded(batches):
            yield b.append_column("_sightline_set", pa.array([set_digest(shingles(t or "")) for t in b.column("text").to_pylist()], pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_sightline_set", T.BinaryType())]))


def node_of(doc_id: str, set_id: str) -> Column:
    """A number of its own, above all usual ids, for one of the sets that share a doc_id."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, set_id), 2).bitwiseOR(F.lit(2**62))


def placed_rows(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_id, root (the component's node; null where nothing is linked) and component_id of every row."""
    sig, classes, roots, clashing = near_classes(docs, percent)
    placed = classes.select("set_id", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("root", "rep").alias("root"))
    out = sig.select("doc_id", "n_shingles", "set_id").join(placed, "set_id", "left")
    name = F.col("root")
    if clashing:
        # Nodes are not all ids now: the smallest doc_id of a component names it.
        least = out.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("least"))
        out, name = out.join(least, F.col("root") == F.col("_root"), "left").drop("_root"), F.col("least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(name, "doc_id"))
    return out.select("doc_id", "n_shingles", "set_id", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    component = F.col("component_id")
    return placed_rows(docs, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that stay: one document of each group of near duplicates; a repeated row stays once.

    Rows that share a doc_id but not a component all stay, one for each component.
    """
    found = common.materialize(placed_rows(docs, percent))
    kept = found.where("doc_id = component_id").select("doc_id", "set_id", "root")
    gone = common.materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays").select("doc_id"))
    named = common.unwanted_rows(docs.where("doc_id is not null"), gone)
    twice = common.materialize(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.isEmpty():
        which = kept.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("set_id").alias("_of"), F.col("root").alias("_root")).distinct()
        again = set_ids(named.join(twice, "doc_id", "left_semi").select(docs.columns))
        again = again.join(which, (F.col("doc_id") == F.col("_id")) & F.col("_sightline_set").eqNullSafe(F.col("_of"))).dropDuplicates(["_id", "_root"])
        named = named.join(twice, "doc_id", "left_anti").select(docs.columns).union(again.select(docs.columns))
    return named.union(docs.where("doc_id is null"))
