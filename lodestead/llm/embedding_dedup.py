"""Embedding near-duplicates by lattice hashing (operator 6).

Unit vectors are projected at random to 8 dimensions a block, scaled, shifted and decoded to the nearest point of the E8
lattice; a table's cell is the point of each of its blocks.  Every vector resides in its own cell and visits the nearest
neighbouring cells (E8 has 240 minimal vectors; those along the residual come first) of every table.  Residents and
visitors of a cell are candidates; a 128-bit sign sketch discards the hopeless ones inside the join, and the cosine of the
others is verified exactly, in double precision, on the original components.

The index is computed for every row.  Scale, blocks and tables are calibrated on the driver by simulating pairs at the
threshold (a fixed number of them, no data), so recall holds at the threshold itself and is higher above it; of the
settings whose chance candidates per vector stay under ``CHANCE`` at the row count, the one with fewest postings is used.

Identical vectors are collapsed before hashing and counted by multiplicity; links between different vectors are all
counted.  Only keys, ids and sketches are shuffled for candidate search; vectors are fetched for surviving pairs.

Defined results: null, empty, zero vectors and those with null or non-finite components link with nothing; vectors of
another length link only within that length; repeated rows count as other vectors linked directly; component_id is the
smallest vec_id; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import attach, components, stage
from lodestead.session import ship

SCALES, BLOCKS, PROBES, RECALL, SEED = (0.6, 0.7, 0.8, 0.9, 1.0), (1, 2, 3), 4, 0.95, 20240611
#: Unrelated vectors that a vector may meet in all its cells, about; they are told apart inside the join.
CHANCE = 1000.0
#: A sketch's expected distance at the threshold is 128 * angle / pi; this many standard deviations more are let pass.
SKETCH_SIGMAS = 5.0


#: A vector that may link.
VALID = "coalesce(size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0), false)"


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _decode_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=1)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the better of D8 and D8 + 1/2."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Hash tables over unit vectors of one dimension; the same everywhere for the same parameters."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int = PROBES, seed: int = SEED):
        rng = np.random.default_rng([seed, dim, blocks])
        self.dim, self.tables, self.blocks, self.probes = dim, tables, blocks, probes
        self.projection = rng.standard_normal((tables, dim, 8 * blocks)) * scale
        self.shift = rng.uniform(-1, 1, (tables, 8 * blocks))
        self.sketch_planes = np.random.default_rng([seed, dim, 64]).standard_normal((dim, 128))
        self.near = minimal_vectors()
        self.mixer = np.random.default_rng([seed, 8, blocks]).integers(1, 2**62, 8 * blocks, dtype=np.uint64) | np.uint64(1)

    def _key(self, points: np.ndarray, table: int) -> np.ndarray:
        k = ((2 * points).astype(np.int64).astype(np.uint64) * self.mixer).sum(axis=1, dtype=np.uint64) + np.uint64(table * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        k ^= k >> np.uint64(29)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        return (k ^ (k >> np.uint64(32))).view(np.int64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes) of keys; the first is the cell of residence."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        rows = np.arange(len(unit))
        for t in range(self.tables):
            x = unit @ self.projection[t] + self.shift[t]
            points = np.hstack([decode_e8(x[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)])
            out[:, t, 0] = self._key(points, t)
            along = np.hstack([(x - points)[:, 8 * b : 8 * b + 8] @ self.near.T for b in range(self.blocks)])
            best = np.argsort(-along, axis=1, kind="stable")[:, : self.probes]
            for p in range(self.probes):
                moved = points.copy()
                block, which = best[:, p] // 240, best[:, p] % 240
                for b in range(self.blocks):
                    moved[rows, 8 * b : 8 * b + 8] += np.where((block == b)[:, None], self.near[which], 0.0)
                out[:, t, 1 + p] = self._key(moved, t)
        return out

    def sketch(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits((unit @ self.sketch_planes > 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def calibrate(dim: int, threshold: float, blocks: int, scale: float, recall: float = RECALL, pairs: int = 1000) -> tuple[int, float]:
    """(tables needed to find pairs at the threshold with probability ``recall``, the share of all vectors that an
    unrelated vector meets by chance in those tables), by simulation."""
    rng = np.random.default_rng([SEED, dim, 1])
    a = rng.standard_normal((pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((pairs, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    lattice = Lattice(dim, 2, blocks, scale)
    x, y = lattice.cells(a), lattice.cells(b)
    hit = float(((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean())
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(max(hit, 1e-3), 0.999))))
    single = Lattice(dim, 2, 1, scale).cells(a)[:, :, 0]
    alike = np.mean([(np.unique(single[:, t], return_counts=True)[1].astype(float) ** 2).sum() - pairs for t in range(2)]) / pairs**2
    return tables, tables * max(alike, 1e-7) ** blocks * (1 + 2 * PROBES)


def plan_index(rows: int, dim: int, threshold: float) -> tuple[int, int, float]:
    """(tables, blocks, scale) for a row count."""
    found = []
    for blocks in BLOCKS:  # more blocks need more tables, so the first number of blocks that will do is the best
        for scale in SCALES:
            tables, chance = calibrate(dim, threshold, blocks, scale)
            found.append((rows * chance > CHANCE, tables if rows * chance <= CHANCE else chance, tables, blocks, scale))
        if not min(found)[0]:
            break
    return min(found)[2:]


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (double components), dim; only vectors that may link."""
    df = embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"))
    return df.where(VALID).withColumn("dim", F.size("v"))


def postings(vectors: DataFrame, lattices: dict[int, Lattice]) -> DataFrame:
    """(key, id, s0, s1, home): a row for each vector, table and cell it resides in or visits."""
    ship(vectors.sparkSession)
    held = vectors.sparkSession.sparkContext.broadcast(lattices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = batch.column(2).to_numpy(zero_copy_only=False)
                for dim in np.intersect1d(dims, list(held.value)):
                    lattice, some = held.value[int(dim)], np.flatnonzero(dims == dim)
                    part = batch.take(pa.array(some))
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(some), int(dim))
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    cells = lattice.cells(x)
                    each = cells.shape[1] * cells.shape[2]
                    home = np.zeros(cells.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), each)), *(pa.array(np.repeat(half, each)) for half in lattice.sketch(x).T), pa.array(home.reshape(-1))],
                        names=["key", "id", "s0", "s1", "home"])

    return vectors.select("id", "v", "dim").mapInArrow(run, "key bigint, id bigint, s0 bigint, s1 bigint, home boolean")


def similar_pairs(vectors: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Verified pairs (a, b), a < b, among distinct vectors(id, v, dim)."""
    # a length that one vector has links nothing; the others are as many as there are kinds of embeddings
    lattices = {r["dim"]: Lattice(r["dim"], *plan_index(rows, r["dim"], threshold)) for r in vectors.groupBy("dim").count().where("count > 1").collect()}
    angle = math.acos(threshold) / math.pi
    far = math.ceil(128 * angle + SKETCH_SIGMAS * math.sqrt(128 * angle * (1 - angle)))
    posts, _ = stage(postings(vectors, lattices), "postings")
    home = posts.where("home").select("key", F.col("id").alias("x"), F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    there = posts.select("key", F.col("id").alias("y"), "s0", "s1", "home")
    met = home.join(there, "key").where((F.col("x") < F.col("y")) | (~F.col("home") & (F.col("x") > F.col("y"))))
    met = met.where(F.bit_count(F.col("x0").bitwiseXOR(F.col("s0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("s1"))) <= far)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    norm = "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"
    unit = vectors.select("id", "v", "dim", F.expr(norm).alias("norm"))
    left = unit.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"), F.col("dim").alias("da"))
    right = unit.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"), F.col("dim").alias("db"))
    both = pairs.join(left, "a").join(right, "b").where("da = db")
    return both.where(F.expr(f"aggregate(zip_with(va, vb, (p, q) -> p * q), 0D, (s, x) -> s + x) / (na * nb) >= {threshold}D")).select("a", "b")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of ``embeddings``."""
    good, marked = valid_vectors(embeddings), F.struct(F.xxhash64("v").alias("x"), F.xxhash64("v", F.lit(3)).alias("y"))
    # equal vectors: grouped by a hash, told apart by the vector itself
    groups = good.groupBy(F.xxhash64("v").alias("h"), "v", "dim").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    # a number for each vector; rows find theirs by two hashes together, which no two vectors in practice share
    groups, _ = stage(groups.withColumn("id", F.monotonically_increasing_id()).withColumn("mark", marked), "vectors")
    rows = groups.count()
    pairs, _ = stage(similar_pairs(groups, threshold, rows), "pairs")
    roots, _ = stage(components(pairs), "roots")
    weight = groups.select("id", "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(weight.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    named = groups.select("id", "mark", "first_id", "copies").join(roots, groups.id == roots.node, "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = named.join(least, "root").join(counts, named.id == counts.a, "left")
    table, _ = stage(table.select("mark", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "copies"), "named")
    owners, _ = stage(good.select("vec_id", marked.alias("mark")), "owners")
    linked = attach(owners, table, "mark", "copies", owners.count()).select("vec_id", "n_links", "component_id")
    bad = embeddings.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v"))
    alone = bad.where(f"not ({VALID})").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
