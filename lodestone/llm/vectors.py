"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within and between near ones.

Vectors of equal labels (not null) whose cosine is ``least`` or more are linked. Equal vectors of one label are folded
into one first. A k-means on the unit sphere, fitted on the ``MAX_FIT`` vectors with the smallest hashes, deals all
vectors to cells. The distances t of two linked vectors x and y from the border between their cells c and d, t(x) =
x.(c - d) / |c - d|, add up to at most their chord, so of two cells only vectors with t(x) + t(y) <= chord are compared:
those of each cell in the order of t, a slice of the one with as many of the other as can be near. No link is lost by that
(the nearer of the two is what ``homes_and_guests`` calls a guest). Products are in double precision.

Vectors are shuffled and written once each, in the type they came in: a task takes a range of labels and cells and writes
blocks of up to ``block`` vectors of one label, a row a block. A block is compared with itself, and a label of several blocks in
every pair of them, by a Cartesian product that reads the written blocks again, without a shuffle. A pair of blocks returns
each vector's number of links and a spanning forest, not the pairs.

Linked with nothing: null ids, labels or vectors, empty and zero vectors, vectors with null or non-finite components.
Vectors of different lengths aren't compared; long ones are compared whole. Rows of one id are one node. Equal vectors of a
label are linked by their cosine of 1, and the smallest id stands for them. Empty tables give no rows. Only the three columns
named are read, so other columns' names can't clash.

There are as many cells as vectors ask for up to ``MAX_CELLS`` (what ``MAX_FIT`` vectors can tell apart). Tasks of the Cartesian
product grow with the square of the table (64 MB a side), the products with the square of a label, less what the cells save.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import components, groups, shared

LEAST = 0.93
MAX_FIT = 20_000
#: Vectors of a label in a cell, about.
CELL = 512
MAX_CELLS = 1024
#: Vectors of a block at most, and bytes of it, of a task that makes blocks, and of a side of a task that compares them, about.
BLOCK = 1 << 15
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 32 << 20
SIDE_BYTES = 64 << 20
#: Links that a pair of blocks holds before it contracts them.
HELD = 1 << 20


def margin(least: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * least)) / 2 + 1e-9  # more than rounding takes


def fit_cells(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of a spherical k-means; x: unit vectors in a fixed order."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def homes_and_guests(x: np.ndarray, centres: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell, and a table of the cells of which it is a guest."""
    dot = x @ centres.T
    home = np.argmax(dot, axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-300))
    guest = (dot[np.arange(len(x)), home][:, None] - dot) / apart[home] <= width
    guest[np.arange(len(x)), home] = False
    return home, guest


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(cells: np.ndarray) -> list[tuple[int, int, int]]:
    """(cell, start, end) of each run of equal cells."""
    edge = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
    return [(int(cells[s]), s, e) for s, e in zip(edge[:-1], edge[1:], strict=True)]


def linked(x: np.ndarray, x_cells: np.ndarray, y: np.ndarray | None, y_cells: np.ndarray | None, centres: np.ndarray | None, least: float, step: int = 512, fine: int = 64):
    """Index arrays (p, q) of the pairs x[p].y[q] >= least, each pair once; unit vectors in the order of cells. y None: within x.

    Between cells, products in single precision, with room for its error, tell what to compute in double precision.
    """
    own = y is None
    chord = 2 * margin(least)
    of_x = _runs(x_cells)
    of_y = of_x if own else _runs(y_cells)
    y = x if own else y
    if centres is not None:
        to_y = x @ centres[[c for c, _, _ in of_y]].T
        to_x = to_y if own else y @ centres[[c for c, _, _ in of_x]].T
    rough = x.astype(np.float32)
    rough_y = rough if own else y.astype(np.float32)
    low = least - 1e-6 - x.shape[1] * 2.0**-23  # more than rounding takes, whatever the order of the sum
    for i, (c, s, e) in enumerate(of_x):
        for j, (d, u, v) in enumerate(of_y):
            if own and j < i:
                continue
            if c == d:
                for at in range(s, e, step):
                    if own:
                        p, q = np.nonzero(np.triu(x[at : min(at + step, e)] @ x[at:e].T >= least, 1))
                        yield p + at, q + at
                    else:
                        p, q = np.nonzero(x[at : min(at + step, e)] @ y[u:v].T >= least)
                        yield p + at, q + u
                continue
            apart = max(float(np.linalg.norm(centres[c] - centres[d])), 1e-150)
            t = (x[s:e] @ centres[c] - to_y[s:e, j]) / apart
            w = (y[u:v] @ centres[d] - to_x[u:v, i]) / apart
            near, close = np.flatnonzero(t <= chord - w.min()), np.flatnonzero(w <= chord - t.min())
            if not len(near) or not len(close):
                continue
            near, close = near[np.argsort(t[near], kind="stable")], close[np.argsort(w[close], kind="stable")]
            reach = np.searchsorted(w[close], chord - t[near], "right")
            near = near[: np.searchsorted(-reach, 0)] + s
            close = close[: reach[0]] + u
            xs, ys = rough[near], rough_y[close]
            for at in range(0, len(near), fine):
                p, q = np.nonzero(xs[at : at + fine] @ ys[: reach[at]].T >= low)
                if len(p):
                    p, q = near[p + at], close[q]
                    sure = np.einsum("ij,ij->i", x[p], y[q]) >= least
                    yield p[sure], q[sure]


def _contract(n: int, held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    root = components.forest(n, *[np.concatenate(c) for c in zip(*held, strict=True)])
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def similar_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """One row a row of df: id, n_links, component_id (null for null ids), kept."""
    kind = df.select(F.col(f"`{vector}`").alias("v")).schema["v"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    item = np.dtype("<f4" if single else "<f8")
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("vector"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vector", lambda c: c != 0)
    folded = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("key", F.when(F.col("good"), F.unhex(F.sha2(F.concat_ws(",", "vector"), 256))))
    valid = folded.where("good")
    classes = shared.written(valid.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")), "vectors")
    size, labels, width = classes.agg(F.count("*"), F.count_distinct("label"), F.avg(F.size("vector"))).first()
    sample = [r[0] for r in classes.select("vector", "rep", "key").orderBy(F.xxhash64("rep"), "key").limit(MAX_FIT).select("vector").collect()]
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    centres: dict[int, np.ndarray] = {}
    k = min(MAX_CELLS, max(1, round(size / (max(1, labels) * cell))))
    for dim, v in by_dim.items():
        centres[dim] = fit_cells(_units(np.array(v)), min(k, len(v)))

    def assign(batches):
        for batch in batches:
            lists = batch.column("vector")
            dims = lists.value_lengths().to_numpy()
            values, ends = lists.flatten().to_numpy(), np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = values[(ends[at] - dim)[:, None] + np.arange(dim)].astype(item)
                home = np.argmax(_units(x) @ centres[dim].T, axis=1) if dim in centres else np.zeros(len(at), np.int64)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("rep"), part.column("n"), pa.array(np.full(len(at), dim), pa.int32()), pa.array(home, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=dealt.names)

    binary, whole = T.BinaryType(), T.IntegerType()
    dealt = T.StructType([classes.schema["label"], classes.schema["rep"], T.StructField("n", T.LongType()), T.StructField("dim", whole), T.StructField("cell", whole), T.StructField("vector", binary)])
    placed = classes.select("label", "rep", "n", "vector").mapInArrow(assign, dealt)
    id_type = classes.schema["rep"].dataType
    made = T.StructType([classes.schema["label"], T.StructField("dim", whole), T.StructField("no", T.LongType()), T.StructField("alone", T.BooleanType()), T.StructField("reps", T.ArrayType(id_type)), T.StructField("ns", binary), T.StructField("cells", binary), T.StructField("vectors", binary)])
    most = min(block, max(2048, size // 64))

    def blocks_of(batches):
        no = TaskContext.get().partitionId() << 32
        held = None

        def rows_of(table, alone):
            nonlocal no
            dim = table.column("dim")[0].as_py()
            step = min(most, max(16, BLOCK_BYTES // (dim * item.itemsize)))
            if alone and table.num_rows == 1:
                return
            for at in range(0, table.num_rows, step):
                t = table.slice(at, step)
                reps = t.column("rep").combine_chunks()
                no += 1
                yield pa.RecordBatch.from_arrays([t.column("label").slice(0, 1).combine_chunks(), pa.array([dim], pa.int32()), pa.array([no], pa.int64()), pa.array([alone and table.num_rows <= step]), pa.ListArray.from_arrays(pa.array([0, len(reps)], pa.int32()), reps), *[pa.array([b], pa.binary()) for b in (t.column("n").to_numpy().astype("<i8").tobytes(), t.column("cell").to_numpy().astype("<i4").tobytes(), b"".join(t.column("vector").to_pylist()))]], names=made.names)

        def runs():
            for table in groups.keyed_runs(batches, ["label", "dim"]):
                values, dims = np.array(table.column("label").to_pylist(), dtype=object), table.column("dim").to_numpy()
                edge = [0, *(np.flatnonzero((values[1:] != values[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), table.num_rows]
                yield from (table.slice(s, e - s) for s, e in zip(edge[:-1], edge[1:], strict=True))

        # the first and the last label of a range may go on in another task
        for k, table in enumerate(runs()):
            if held is not None:
                yield from rows_of(held, k > 1)
            held = table
        if held is not None:
            yield from rows_of(held, False)

    parts = max(1, math.ceil(size * (width or 0) * item.itemsize / RANGE_BYTES), math.ceil(size / (2 * most)))
    order = ["label", "dim", "cell", "rep"]
    blocks = shared.written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(blocks_of, made), "blocks")

    def compare(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                sides = []
                for side in ("a", "b"):
                    if batch.column(f"{side}_vectors")[r].is_valid:
                        read = lambda name, t: np.frombuffer(batch.column(f"{side}_{name}")[r].as_buffer(), dtype=t)  # noqa: B023, E731
                        sides.append((read("cells", "<i4"), read("ns", "<i8"), _units(read("vectors", item).reshape(-1, dim)), batch.column(f"{side}_reps")[r].values))
                (x_cells, n, x, reps), other = sides[0], sides[1] if len(sides) > 1 else None
                shift = len(x) if other else 0
                if other:
                    n, reps = np.concatenate([n, other[1]]), pa.concat_arrays([reps, other[3]])
                links, held, count = np.zeros(len(n), dtype=np.int64), [], 0
                for p, q in linked(x, x_cells, other and other[2], other and other[0], centres.get(dim), least):
                    if len(p):
                        q = q + shift
                        links += (np.bincount(p, weights=n[q], minlength=len(n)) + np.bincount(q, weights=n[p], minlength=len(n))).astype(np.int64)
                        held.append((p, q))
                        count += len(p)
                        if count > HELD:
                            held = [_contract(len(n), held)]
                            count = len(held[0][0])
                if not held:
                    continue
                a, b = _contract(len(n), held)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([reps.take(pa.array(np.concatenate([some, a]))), pa.concat_arrays([pa.nulls(len(some), reps.type), reps.take(pa.array(b))]), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))], names=["a", "b", "n"])

    found = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("n", T.LongType())])
    held = ("reps", "ns", "cells", "vectors")
    within = blocks.select("dim", *[F.col(c).alias(f"a_{c}") for c in held], *[F.lit(None).cast(made[c].dataType).alias(f"b_{c}") for c in held])
    several = blocks.where("not alone").coalesce(max(8, math.ceil(size * (width or 0) * item.itemsize / SIDE_BYTES)))
    side = lambda s: several.select(*[F.col(c).alias(f"{s}_{c}") for c in ("label", "dim", "no", *held)])
    # equal labels without an equi-join, which would gather a label in one task
    alike = (F.col("a_label") <= F.col("b_label")) & (F.col("a_label") >= F.col("b_label")) & (F.col("a_dim") <= F.col("b_dim")) & (F.col("a_dim") >= F.col("b_dim")) & (F.col("a_no") < F.col("b_no"))
    between = side("a").join(side("b"), alike).select(F.col("a_dim").alias("dim"), *[f"{s}_{c}" for s in "ab" for c in held])
    found = shared.written(within.unionByName(between).mapInArrow(compare, found), "links")
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    # equal vectors under another id link too
    reached = components.connected_components(found.where("b is not null"))
    per_class = classes.select("label", "key", "rep", "n").join(links, "rep", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = per_class.select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = folded.select("id", "label", "key").join(per_class, ["label", "key"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
