"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected on two random orthonormal bases of eight dimensions in each of ``TABLES`` tables and decoded to
the nearest points of the E8 lattice; the pair of points is the vector's cell. A vector also probes, block by block, the
cells of the lattice's roots nearest to what decoding left over. Vectors that meet in a cell are candidates; their cosine
in double precision decides. Equal vectors are one class and are compared once.

A cell with more than ``DENSE`` vectors is cut into blocks by a hash of the vector's id, and each pair of blocks is
compared in a task of its own, so no task holds more than two blocks; only verified links leave it.

Results in special cases: NULL, empty and zero vectors and those with NULL or non-finite components link with nothing and
are their own component; vectors of different lengths don't link; repeated ids are a vector each; a vector without an id
links like any other and is never ``kept``, its component_id is the smallest id there is in its component, NULL if there
is none; further columns are ignored; an empty table gives an empty result. Search is not exhaustive: tests measure recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import stored
from visitflow.llm.components import connected_components

TABLES, BLOCKS, SCALE, ROOTS, DENSE, BLOCK = 12, 2, 0.5, 2, 64, 256
CLOSE = 1e-9


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8, the integer points with an even sum."""
    near = np.rint(x)
    left = x - near
    worst = np.abs(left).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    at = worst[rows]
    near[rows, at] += np.where(left[rows, at] >= 0, 1, -1)
    return near


def e8_decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8, or D8 moved by one half."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def e8_roots() -> np.ndarray:
    """The 240 shortest points of E8."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            pairs.append([a if k == i else b if k == j else 0.0 for k in range(8)])
    halves = [s for s in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*pairs, *halves])


def projections(size: int, seed: int = 8) -> np.ndarray:
    """(table, block, size, 8): orthonormal columns, scaled so that a unit vector keeps its length on average."""
    random = np.random.default_rng(seed)
    draw = random.normal(size=(TABLES, BLOCKS, max(size, 8), 8))
    return np.linalg.qr(draw)[0][:, :, :size] * np.sqrt(max(size, 8) / 8) / SCALE


def cells(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cells (n, tables) and probed cells (n, tables, blocks * ROOTS) of unit vectors, as 64-bit codes."""
    n, size = units.shape
    bases, roots = projections(size), e8_roots()
    spread = np.random.default_rng(9).integers(1, 1 << 62, (BLOCKS, 8), np.int64) * 2 + 1
    homes, probes = np.empty((n, TABLES), np.int64), np.empty((n, TABLES, BLOCKS * ROOTS), np.int64)
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            points = [units @ bases[t, b] for b in range(BLOCKS)]
            near = [e8_decode(x) for x in points]
            codes = [((2 * x).astype(np.int64) * spread[b]).sum(axis=1) for b, x in enumerate(near)]
            whole = sum(codes) + np.int64(t * 1_000_003 + size)
            homes[:, t] = whole
            for b in range(BLOCKS):
                best = np.argpartition(-((points[b] - near[b]) @ roots.T), ROOTS, axis=1)[:, :ROOTS]
                for r in range(ROOTS):
                    move = (2 * roots[best[:, r]]).astype(np.int64)
                    probes[:, t, b * ROOTS + r] = whole + (move * spread[b]).sum(axis=1)
    return homes, probes


def _cell_rows(classes: DataFrame) -> DataFrame:
    """(id, cell, home) of every class: its home cells, and the cells it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column("v")])
            ids = batch.column("id").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), 4096):
                    own = rows[at:at + 4096]
                    units = np.array([batch.column("v")[int(i)].as_py() for i in own], float)
                    homes, probes = cells(units)
                    for found, home in ((homes, True), (probes.reshape(len(own), -1), False)):
                        yield pa.RecordBatch.from_pydict({
                            "id": np.repeat(ids[own], found.shape[1]), "cell": found.ravel(),
                            "home": np.full(found.size, home)})

    return classes.select("id", "v").mapInArrow(run, "id long, cell long, home boolean")


def _compare(least: float):
    def block(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, low, high = keys
        rows = rows.drop_duplicates(["id", "home"])
        left, right = rows[rows.part == low], rows[rows.part == high]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy())
        product = a @ b.T
        x, y = np.nonzero((product >= least - CLOSE) & (left.home.to_numpy()[:, None] | right.home.to_numpy()[None]))
        # Near the limit, the sum in order decides, as in small cells.
        edge = product[x, y] < least + CLOSE
        enough = ~edge
        enough[edge] = np.cumsum(a[x[edge]] * b[y[edge]], axis=1)[:, -1] >= least
        x, y = x[enough], y[enough]
        one, two = left.id.to_numpy()[x], right.id.to_numpy()[y]
        pairs = pd.DataFrame({"a": np.maximum(one, two), "b": np.minimum(one, two)})
        return pairs[pairs.a != pairs.b].drop_duplicates()

    return block


def links(classes: DataFrame, least: float, dense: int = DENSE, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a > b, of classes (id, v: unit vector) found with a cosine of at least ``least``."""
    rows = stored(_cell_rows(classes), "cells")
    crowd = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("used")).filter("n > 1 and used")
    rows = stored(rows.join(crowd.select("cell", "n"), "cell"), "shared-cells")
    few = rows.filter(F.col("n") <= dense)
    one, two = few.filter("home").alias("one"), few.alias("two")
    pairs = (
        one.join(two, (F.col("one.cell") == F.col("two.cell")) & (F.col("one.id") != F.col("two.id")))
        .select(F.greatest("one.id", "two.id").alias("a"), F.least("one.id", "two.id").alias("b")).distinct()
    )
    left = classes.select(F.col("id").alias("a"), F.col("v").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("v").alias("y"))
    cosine = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    near = pairs.join(left, "a").join(right, "b").filter(F.size("x") == F.size("y")).filter(cosine >= least)
    parts = F.ceil(F.col("n") / block).cast("int")
    many = (
        rows.filter(F.col("n") > dense).select("id", "cell", "home", parts.alias("parts"))
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(classes.select("id", "v"), "id")
        .groupBy("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        .applyInPandas(_compare(least), "a long, b long")
    )
    return near.select("a", "b").union(many).distinct()


def near_vectors(
    embeddings: DataFrame, least: float = 0.95, vector: str = "embedding", dense: int = DENSE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, ``vector``)."""
    v = F.col("v")
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("norm", F.when(whole, norm))
    fine = F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))
    ids = stored(rows.select("vec_id", F.when(fine, v).alias("v"), "norm"), "vectors")
    # A class is numbered when it is written, so no two vectors share a number, whatever their ids.
    classes = stored(
        ids.filter("v is not null").groupBy("v", "norm").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("id", F.monotonically_increasing_id()), "classes")
    units = classes.select("id", F.transform(v, lambda x: x / F.col("norm")).alias("v"))
    found = stored(links(units, least, dense, block), "links")
    both = found.union(found.select("b", "a"))
    sizes = classes.select(F.col("id").alias("b"), "n")
    degrees = both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("others"))
    rooted = classes.join(connected_components(found), F.col("id") == F.col("node"), "left").select(
        "id", "v", "n", "first", F.coalesce("root", "id").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = rooted.join(lowest, "root").join(degrees, F.col("id") == F.col("a"), "left").select(
        v, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = ids.filter("v is not null").join(by_class, "v").select("vec_id", "n_links", "component_id")
    alone = ids.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
