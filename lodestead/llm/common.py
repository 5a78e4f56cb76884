"""Shared plumbing of the corpus operators: staged tables, skew-safe attachment, connected components.

Everything here is DataFrame code.  Intermediate results that are read more than once are written as Parquet into the
folder that all executors share, so a lost executor costs a re-read and never a recomputation of unknown length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestead.session import scratch_dir, settle, ship, stage, unstage

__all__ = ["attach", "broadcast_if_small", "components", "free_names", "lower_ascii", "one_of_each", "read_table", "scratch_dir", "settle", "small_table", "stage", "tidy", "unstage"]

#: A side is broadcast only if its counted rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20
#: A key is "hot" if it holds at least one row in this many; there are never more hot keys than this.
HOT_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put behind it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def one_of_each(df: DataFrame, keys: list, columns: list[str]) -> DataFrame:
    """One row of ``columns`` for each value of ``keys``: the one first in the order of a hash of the whole row, so that
    reruns agree.  Groups are reduced where they lie, whatever their size."""
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    first = df.groupBy(*keys).agg(F.min_by(whole, F.struct(F.xxhash64(F.to_json(whole)), F.to_json(whole))).alias("row"))
    return first.select("row.*")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a local relation.  createDataFrame on tuples starts Python workers on the executors to unpickle
    them, which stay for a minute beside those of the stage."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(kinds)], schema=kinds), schema=StructType.fromDDL(schema))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only for a side whose counted size is proven small; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def attach(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner-join ``rows`` to ``keyed`` (one row per key, ``weight`` = how many rows hold the key) without a hot task.

    Keys holding at least 1/HOT_SHARE of all rows are at most HOT_SHARE many: they are broadcast, so their rows are
    joined where they lie.  The rest is a plain shuffle join in which no key is large.  Both inputs should be staged,
    as both are read twice.  ``rows`` without the key (null) are left out.
    """
    heavy = F.col(weight) >= max(2, total // HOT_SHARE)
    hot, rest = keyed.where(heavy), keyed.where(~heavy)
    there = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(there.join(rest, key).select(*rows.columns, *[c for c in keyed.columns if c != key]))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) by alternating large-star and small-star steps.

    Returns (node, root), one row per node that has an edge to another; root is the smallest node reachable.  Every
    round is two aggregations and two joins over the edges, staged in the shared folder; hubs are joined where their
    edges lie (``attach``); only a row count and a checksum reach the driver.
    """
    spark = edges.sparkSession
    now, path = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seal = _seal(now)
    for _ in range(max_rounds):
        if not seal[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = stage(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held")).select("a", F.least("a", "m").alias("m"), "held"), "least")
        large, large_path = stage(attach(both, least, "a", "held", 2 * seal[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low, low_path = stage(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("held")), "least")
        small = attach(large, low, "a", "held", seal[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then, then_path = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        was, seal = seal, _seal(then)
        for done in (path, least_path, large_path, low_path):
            unstage(spark, done)
        now, path = then, then_path
        if was == seal:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _seal(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.cast("decimal(38,0)")), F.bit_xor(mixed)).first())


#: What empties the memories that operators keep in a Python worker between tasks.
KEPT: list[Callable[[], None]] = []


def tidy(run: Callable, keep: Callable[[], None] | None = None) -> Callable:
    """A task's function that gives memory back before and after: workers serve one stage after the other, so what an
    earlier one keeps would be held beside its own.  ``keep`` is left in place."""

    def task(batches):
        fresh_worker(keep)
        yield from run(batches)
        fresh_worker(keep)

    return task


def fresh_worker(keep: Callable[[], None] | None = None) -> None:
    for clear in KEPT:
        if clear is not keep:
            clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def lower_ascii(text):
    """Lower-case A-Z and nothing else; the built-in lower() serves where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
