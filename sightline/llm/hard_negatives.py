"""Hard negatives by exact integer inner products, behind angular triangle filtering.

Every vector stores its angles to a few reference directions. If a vector has angle x to a direction and the anchor has angle y, the
angle between the two is at least |x - y| and at most min(x + y, 2 pi - x - y). Over a window of vectors the least and
greatest stored angles give an interval for the cosine; multiplied by the norms and rounded outwards it bounds every score in the window. Only
windows whose bounds meet what the anchor still looks for are scored, in integers.

Rows are range-partitioned by label, nearest direction and angle into groups, sorted, and packed into blocks of BLOCK rows, of windows
of WINDOW rows. Group bounds (at most MAX_GROUPS rows) are broadcast and choose which anchors visit which groups; anchors travel
packed, and a join by group brings them to the blocks. Each task keeps the best five of an anchor and group; these are merged by rank.
Two passes: positives first, then negatives with each positive's window. The directions are fitted on a bounded sample: they decide
how much is filtered, never what is found.

Defined cases: rows without label, vector or vec_id, and rows with a null or non-finite component, take no part; a shorter vector counts as if
zeros followed; an empty vector scores 0; repeated rows are rows of their own, so a copy of an anchor is an anchor, and may be its
positive; equal scores go to the smaller vec_id; a positive of negative score
gives no rows; scores beyond 2^56 count as 2^56, components beyond 1e100 as 1e100; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common

#: Rows of a block and of a window, anchors packed together, reference directions, rows they are fitted on, rows a group aims at, most groups.
BLOCK, WINDOW, ANCHORS, DIRECTIONS, SAMPLE, GROUP_ROWS, MAX_GROUPS = 2048, 128, 512, 16, 1024, 65536, 4096
POSITIVES = NEGATIVES = 5
#: Contract: a negative's score is at least 80 and at most 100 hundredths of its positive's.
LOW, HIGH = 80, 100
#: Slack for the rounding of angles, the largest score, and a score below all.
SLACK, MOST = 1e-6, 2**56
NONE = -MOST - 1

_I8, _F8 = "<i8", "<f8"
ROW = "vec_id long, label long, vector array<double>, is_anchor boolean"
PACK = "n int, width int, wide boolean, rids binary, ids binary, labels binary, vectors binary, angles binary"
ANCHOR = "rid long, id long, label long, norm double, vector array<double>, angles array<double>"
BLOCKS = f"grp int, {PACK}, marks binary, label_low long, label_high long, norm_low double, norm_high double, angle_low array<double>, angle_high array<double>"
FOUND = "rid long, slot int, anchor_id long, positive_id long, positive_score long, other_id long, score long"


def usable(rows: DataFrame, anchor: Column) -> DataFrame:
    """vec_id, label (moved on by one where vec_id is divisible by 7), vector and anchor mark of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.col("label").cast("long")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("vector"), anchor.alias("is_anchor"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a column as floor(256 x), with zeros after the shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(256 * np.clip(column.flatten().to_numpy(zero_copy_only=False).astype(float), -1e97, 1e97))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def angles_to(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    width = min(vectors.shape[1], directions.shape[1])
    with np.errstate(all="ignore"):
        unit = vectors / np.abs(vectors).max(axis=1, initial=1e-300)[:, None]
        cosine = unit[:, :width] @ directions[:, :width].T / np.linalg.norm(unit, axis=1)[:, None]
    return np.arccos(np.clip(np.nan_to_num(cosine), -1, 1))


def fit_directions(sample: np.ndarray, many: int) -> np.ndarray:
    """Unit vectors spread over the sample: farthest first, then means of what is nearest."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1), 1e-300)[:, None]
    unit = unit[np.abs(unit).sum(axis=1) > 0]
    if not len(unit):
        return np.eye(1, max(sample.shape[1], 1))
    chosen = [unit[0]]
    nearest = unit @ chosen[0]
    while len(chosen) < min(many, len(unit)):
        chosen.append(unit[int(nearest.argmin())])
        nearest = np.maximum(nearest, unit @ chosen[-1])
    out = np.array(chosen)
    for _ in range(5):
        of = (unit @ out.T).argmax(axis=1)
        for k in range(len(out)):
            mean = unit[of == k].sum(axis=0)
            length = np.linalg.norm(mean)
            if length > 1e-9:
                out[k] = mean / length
    return out


def bounds(angles: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, norm_low: np.ndarray, norm_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each anchor (row) with any vector of each window (column), rounded outwards."""
    near, far = np.zeros((len(angles), len(low))), np.full((len(angles), len(low)), math.pi)
    for r in range(angles.shape[1]):
        y = angles[:, r, None]
        near = np.maximum(near, np.maximum(y - high[:, r], low[:, r] - y))
        least, greatest = y + low[:, r], y + high[:, r]
        far = np.minimum(far, np.where(greatest < math.pi, greatest, np.where(least > math.pi, 2 * math.pi - least, math.pi)))
    up, down = np.cos(np.clip(near - SLACK, 0, math.pi)), np.cos(np.clip(far + SLACK, 0, math.pi))
    upper = norms[:, None] * np.where(up > 0, norm_high, norm_low) * up
    lower = norms[:, None] * np.where(down > 0, norm_low, norm_high) * down
    room = 1 + 1e-6 * norms[:, None] * norm_high
    return lower - room, upper + room


class Pack:
    """Vectors of a block, or anchors that travel together, from the columns of PACK."""

    def __init__(self, row: dict):
        n, width = row["n"], row["width"]
        self.rids, self.ids, self.labels = (np.frombuffer(row[c], _I8) for c in ("rids", "ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], _F8 if row["wide"] else "<i2").reshape(n, width)
        self.angles = np.frombuffer(row["angles"], _F8).reshape(n, -1)
        self.norms = np.linalg.norm(self.vectors.astype(float), axis=1)


def packed(rids: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, angles: np.ndarray) -> dict:
    wide = bool(np.abs(vectors).max(initial=0) > 32767)
    return {
        "n": len(ids), "width": vectors.shape[1], "wide": wide, "rids": rids.astype(_I8).tobytes(), "ids": ids.astype(_I8).tobytes(), "labels": labels.astype(_I8).tobytes(),
        "vectors": vectors.astype(_F8 if wide else "<i2").tobytes(), "angles": angles.astype(_F8).tobytes(),
    }


def scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; `most` bounds them and all their partial sums, and so chooses the numbers that hold them."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if most < 2**52:
        kind = np.float32 if most < 2**23 else np.float64
        return a.astype(kind) @ b.astype(kind).T
    whole = [np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


class Best:
    """The best few rows, by score and then by smaller vec_id, of each anchor and each of its slots, a slot being a range of scores."""

    def __init__(self, anchors: Pack, low: np.ndarray, high: np.ndarray, size: int, same: bool, want: np.ndarray):
        self.anchors, self.low, self.high, self.size, self.same, self.want = anchors, low, high, size, same, want
        shape = (*low.shape, size)
        self.score, self.ids = np.full(shape, NONE, np.int64), np.full(shape, np.iinfo(np.int64).max)

    def visit(self, block: Pack) -> tuple[int, int]:
        """Scores what the bounds leave; how many pairs of anchor and window that were, and of how many."""
        rows = len(block.ids)
        starts = np.arange(0, rows, WINDOW)
        edge = lambda f, x: f.reduceat(x, starts, axis=0)
        label_low, label_high = edge(np.minimum, block.labels), edge(np.maximum, block.labels)
        lower, upper = bounds(self.anchors.angles, self.anchors.norms, edge(np.minimum, block.angles), edge(np.maximum, block.angles), edge(np.minimum, block.norms), edge(np.maximum, block.norms))
        mine = self.anchors.labels[:, None]
        if self.same:
            due = (label_low <= mine) & (mine <= label_high)
        else:
            due = (label_low != mine) | (label_high != mine)
        # What can still enter a slot: within its range, and not below its last member.
        least = np.maximum(self.low, self.score[:, :, -1])
        open_ = np.zeros_like(due)
        for s in range(self.low.shape[1]):
            open_ |= self.want[:, s, None] & (upper >= least[:, s, None]) & (lower <= self.high[:, s, None])
        due &= open_
        for w in np.flatnonzero(due.any(axis=0)).tolist():
            some, at = np.flatnonzero(due[:, w]), slice(w * WINDOW, min((w + 1) * WINDOW, rows))
            self._score(block, some, at, least[some])
        return int(due.sum()), due.size

    def _score(self, block: Pack, some: np.ndarray, at: slice, least: np.ndarray) -> None:
        who = self.anchors
        found = scores(who.vectors[some], block.vectors[at], float(who.norms[some].max() * block.norms[at].max()) * 1.001 + 1)
        ok = (who.labels[some, None] == block.labels[None, at]) == self.same
        ok &= who.rids[some, None] != block.rids[None, at]
        for s in range(self.low.shape[1]):
            inside = ok & self.want[some, s, None] & (found >= least[:, s, None]) & (found <= self.high[some, s, None])
            row, col = np.nonzero(inside)
            if len(row):
                self._merge(s, some[row], found[row, col].astype(np.int64), block.ids[at][col])

    def _merge(self, s: int, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes new members in: old and new of the anchors concerned are ranked together."""
        better = (score > self.score[row, s, -1]) | ((score == self.score[row, s, -1]) & (ids < self.ids[row, s, -1]))
        row, score, ids = row[better], score[better], ids[better]
        if not len(row):
            return
        who = np.unique(row)
        row = np.concatenate([np.repeat(who, self.size), row])
        score, ids = np.concatenate([self.score[who, s].ravel(), score]), np.concatenate([self.ids[who, s].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, who)
        take = first[:, None] + np.arange(self.size)
        self.score[who, s], self.ids[who, s] = score[take], ids[take]


def build_blocks(rows: DataFrame, directions: np.ndarray, groups: int) -> DataFrame:
    """The rows as BLOCKS: groups are ranges by label, nearest direction, angle and id, so hot labels and vectors are split too."""

    def measure(batches):
        for b in common.bounded(batches):
            angles = angles_to(matrix(b.column("vector")), directions) if b.num_rows else np.zeros((0, len(directions)))
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(angles[np.arange(len(near)), near], pa.float64())], [*b.schema.names, "cell", "angle"])

    def pack(batches):
        from pyspark import TaskContext

        group, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            vectors, ids, labels = matrix(table.column("vector").combine_chunks()), table.column("vec_id").to_numpy(), table.column("label").to_numpy()
            angles, norms = angles_to(vectors, directions), np.linalg.norm(vectors, axis=1)
            rids = (group << 43) + seq * BLOCK + np.arange(len(ids))
            row = packed(rids, ids, labels, vectors, angles) | {
                "grp": group, "marks": table.column("is_anchor").to_numpy().astype(bool).tobytes(), "label_low": int(labels.min()), "label_high": int(labels.max()), "norm_low": float(norms.min()), "norm_high": float(norms.max()),
                "angle_low": angles.min(axis=0).tolist(), "angle_high": angles.max(axis=0).tolist(),
            }
            return pa.RecordBatch.from_pylist([row], schema=block_schema)

        for b in common.bounded(batches):
            held.append(b)
            size += b.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                seq, held, size = seq + 1, table.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held))

    block_schema = arrow(BLOCKS)
    measured = rows.mapInArrow(measure, f"{ROW}, cell int, angle double")
    order = ["label", "cell", "angle", "vec_id"]
    return common.materialize(measured.repartitionByRange(groups, *order).sortWithinPartitions(*order).drop("cell", "angle").mapInArrow(pack, BLOCKS))


def names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in schema.split(", ")])


class Groups:
    """Bounds of every group: a few hundred bytes each, and at most MAX_GROUPS of them."""

    def __init__(self, blocks: DataFrame, many: int):
        each = lambda f, c: [f(F.col(c)[r]) for r in range(many)]
        rows = blocks.groupBy("grp").agg(
            F.min("label_low").alias("label_low"), F.max("label_high").alias("label_high"), F.min("norm_low").alias("norm_low"), F.max("norm_high").alias("norm_high"),
            F.array(*each(F.min, "angle_low")).alias("angle_low"), F.array(*each(F.max, "angle_high")).alias("angle_high"),
        ).orderBy("grp").collect()
        self.ids = np.array([r["grp"] for r in rows])
        self.label_low, self.label_high, self.norm_low, self.norm_high = (np.array([r[c] for r in rows]) for c in ("label_low", "label_high", "norm_low", "norm_high"))
        self.low, self.high = (np.array([r[c] for r in rows]).reshape(len(rows), many) for c in ("angle_low", "angle_high"))


def visits(anchors: list, groups: Groups, positives: list | None):
    """(group, PACK columns and, for negatives, positives) for each group that some of the anchors must visit; each takes only those anchors along."""
    labels = np.array([x["label"] for x in anchors])[:, None]
    angles, norms = np.array([x["angles"] for x in anchors]), np.array([x["norm"] for x in anchors])
    if positives is None:
        due = (groups.label_low <= labels) & (labels <= groups.label_high)
    else:
        lower, upper = bounds(angles, norms, groups.low, groups.high, groups.norm_low, groups.norm_high)
        due = np.zeros(lower.shape, bool)
        scores_of = np.array([[p[1] for p in ps] + [-1] * (POSITIVES - len(ps)) for ps in positives], float)
        for s in range(POSITIVES):
            p = scores_of[:, s, None]
            due |= (p >= 0) & (upper >= p * LOW / HIGH - 1) & (lower <= p)
        due &= (groups.label_low != labels) | (groups.label_high != labels)
    for g in np.flatnonzero(due.any(axis=0)).tolist():
        some = [anchors[k] for k in np.flatnonzero(due[:, g])]
        width = max(len(x["vector"]) for x in some)
        vectors = np.zeros((len(some), width))
        for k, x in enumerate(some):
            vectors[k, : len(x["vector"])] = x["vector"]
        row = packed(np.array([x["rid"] for x in some]), np.array([x["id"] for x in some]), np.array([x["label"] for x in some]), vectors, np.array([x["angles"] for x in some]))
        if positives is not None:
            known = np.zeros((len(some), POSITIVES, 2), np.int64)
            known[:, :, 1] = -1
            for k, x in enumerate(some):
                for s, p in enumerate(x["positives"]):
                    known[k, s] = p
            row["positives"] = known.tobytes()
        yield {"grp": int(groups.ids[g])} | row


def anchor_rows(blocks: DataFrame) -> DataFrame:
    """The marked rows of the blocks, one a row."""
    schema = arrow(ANCHOR)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                pack, marks = Pack(row), np.frombuffer(row["marks"], bool)
                some = [
                    {"rid": int(pack.rids[k]), "id": int(pack.ids[k]), "label": int(pack.labels[k]), "norm": float(pack.norms[k]), "vector": pack.vectors[k].tolist(), "angles": pack.angles[k].tolist()}
                    for k in np.flatnonzero(marks)
                ]
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    return common.materialize(blocks.select(*names(PACK), "marks").mapInArrow(run, ANCHOR))


def plan_visits(anchors: DataFrame, groups, with_positives: bool) -> DataFrame:
    """The anchors, packed for each group that they must visit."""
    schema = f"grp int, {PACK}" + (", positives binary" if with_positives else "")
    out = arrow(schema)

    def run(batches):
        for b in common.bounded(batches):
            some = b.to_pylist()
            for x in some:
                x["positives"] = [(p["other_id"], p["score"]) for p in x.get("positives") or []]
            for row in visits(some, groups.value, [x["positives"] for x in some] if with_positives else None) if some else ():
                yield pa.RecordBatch.from_pylist([row], schema=out)

    return common.materialize(anchors.mapInArrow(run, schema))


def search(plan: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """Best rows of each anchor and slot in each group that it visits: FOUND rows."""
    bring = plan.select("grp", F.monotonically_increasing_id().alias("visit"), F.struct(*[c for c in plan.columns if c != "grp"]).alias("anchors"))
    pairs = bring.join(blocks.select("grp", F.struct(*names(PACK)).alias("block")), "grp").select("visit", "anchors", "block")
    out_schema = arrow(FOUND)

    def results(best: Best, known: np.ndarray | None) -> pa.RecordBatch:
        who = best.anchors
        row, slot, place = np.nonzero(best.score >= -MOST)
        none = np.zeros(len(row), np.int64)
        about = (known[row, slot, 0], known[row, slot, 1]) if known is not None else (none, none)
        columns = [who.rids[row], slot, who.ids[row], *about, best.ids[row, slot, place], best.score[row, slot, place]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out_schema.types)], schema=out_schema)

    def run(batches):
        visit, best, known = None, None, None
        for b in batches:
            for at in range(b.num_rows):
                now = b.column("visit")[at].as_py()
                if now != visit:
                    if best is not None:
                        yield results(best, known)
                    row = b.column("anchors")[at].as_py()
                    anchors, visit = Pack(row), now
                    if same:
                        one = np.ones((len(anchors.ids), 1), np.int64)
                        best = Best(anchors, one * NONE, one * MOST, POSITIVES, True, one > 0)
                    else:
                        known = np.frombuffer(row["positives"], _I8).reshape(len(anchors.ids), POSITIVES, 2)
                        high = known[:, :, 1]
                        # The least whole number of hundredths: LOW * positive <= HIGH * negative.
                        best = Best(anchors, -(-high * LOW // HIGH), high, NEGATIVES, False, high >= 0)
                best.visit(Pack(b.column("block")[at].as_py()))
        if best is not None:
            yield results(best, known)

    return pairs.mapInArrow(run, FOUND)


def best_of(found: DataFrame, many: int) -> DataFrame:
    """FOUND rows with their rank among those of an anchor and slot; the ranks beyond `many` go before the shuffle too."""
    order = Window.partitionBy("rid", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def hard_negatives(rows: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, of the anchors that `anchor` marks (a condition on vec_id)."""
    spark = rows.sparkSession
    common.ship(spark)
    rows = usable(rows, F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    directions = fit_directions(matrix(sample.column("vector").combine_chunks()), DIRECTIONS)
    count = rows.count()
    aim = min(GROUP_ROWS, max(BLOCK, count // (4 * spark.sparkContext.defaultParallelism)))
    blocks = build_blocks(rows, directions, min(MAX_GROUPS, max(1, -(-count // aim))))
    groups = spark.sparkContext.broadcast(Groups(blocks, len(directions)))
    anchors = anchor_rows(blocks)
    first = plan_visits(anchors, groups, False)
    near = best_of(search(first, blocks, True), POSITIVES)
    near = near.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id", "score"))).alias("positives"))
    plan = plan_visits(anchors.join(near, "rid").sortWithinPartitions("rid"), groups, True)
    for done in (anchors, first):
        common.drop_table(done)
    out = best_of(search(plan, blocks, False), NEGATIVES)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
