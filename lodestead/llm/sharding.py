"""Reproducible shuffle into shards by a Feistel permutation over global row numbers (operator 3).

Rows are numbered 0..N-1: rows alike in doc_id, size and CRC are counted where they lie, hash buckets of the distinct
ones are counted (a bounded number of counts to the driver), and every row gets its bucket's offset plus its place within
the bucket.  So rows that repeat a doc_id, or lack one, spread over all buckets, and repeats of one row cost one.  The row number r is permuted to p = E(r) in
0..N-1; shard = p mod S and slot = p div S.  Both can be computed for any row number without touching data, and
``row_of`` inverts them.  The law kept is `rows`: shard counts differ by one at most and slots are gapless from 0.

E is a generalised Feistel network over Z_a x Z_b with a = ceil(sqrt N), b = ceil(N / a), so fewer than sqrt(N) points
lie outside 0..N-1.  Points that land outside are walked along their cycle until they are inside.  The longest such walk
is found exactly beforehand, by walking the points outside (under sqrt N of them, ~1e5 at 1e10 rows), and that many
steps are unrolled into the expression.

Defined results: a null text has size 1 and CRC 0; rows alike in doc_id, size and CRC are indistinguishable and numbered
one after the other; a null doc_id is numbered like any other; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.common import stage

#: Prime modulus of the round function and its odd multipliers, one pair of offsets for each round.
PRIME = 2147483647
ROUNDS = ((1103515245, 12345), (1664525, 1013904223), (22695477, 1), (134775813, 7919), (214013, 2531011), (1140671485, 12820163))
#: Numbering buckets: their counts and offsets are all that the driver holds.
BUCKETS = 1 << 14


def _round(x, k: tuple[int, int], seed: int):
    """A pseudo-random number below PRIME; works on ints and on Columns alike, within 64 bits."""
    t = (x + (k[1] + seed) % PRIME) % PRIME
    t = (t * t + k[0]) % PRIME
    t = (t * (k[0] % 65521 + 2) + seed % 65537) % PRIME
    return (t * t + t) % PRIME


class Permutation:
    """E over 0..n-1; ``of`` and ``back`` take ints, ``add`` works on a DataFrame."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.seed = n, seed
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.steps = 1 + max((self._walk(x) for x in range(n, self.a * self.b if n else 0)), default=0)

    def _walk(self, x: int) -> int:
        """Steps from a point outside until inside."""
        steps = 0
        while x >= self.n:
            x, steps = self._int(x), steps + 1
        return steps

    def _int(self, x: int) -> int:
        left, right = x % self.a, x // self.a
        for i, k in enumerate(ROUNDS):
            left, right = right, (left + _round(right, k, self.seed)) % (self.b if i % 2 else self.a)
        return left + right * self.a

    def _int_back(self, y: int) -> int:
        left, right = y % self.a, y // self.a
        for i in reversed(range(len(ROUNDS))):
            left, right = (right - _round(left, ROUNDS[i], self.seed)) % (self.b if i % 2 else self.a), left
        return left + right * self.a

    def of(self, x: int) -> int:
        x = self._int(x)
        while x >= self.n:
            x = self._int(x)
        return x

    def back(self, y: int) -> int:
        y = self._int_back(y)
        while y >= self.n:
            y = self._int_back(y)
        return y

    def add(self, df: DataFrame, row: str, out: str) -> DataFrame:
        """``df`` with the permuted row number; each round is a projection of its own, which keeps expressions small."""
        df = df.withColumn(out, F.col(row).cast("bigint"))
        for step in range(self.steps):
            outside = F.lit(True) if not step else F.col("_in") >= self.n
            df = df.withColumn("_in", F.col(out)).withColumns({"_left": F.expr(f"_in % {self.a}L"), "_right": F.expr(f"_in div {self.a}L")})
            for i, k in enumerate(ROUNDS):
                df = df.withColumn("_t", (F.col("_right") + F.lit((k[1] + self.seed) % PRIME).cast("bigint")) % PRIME)
                df = df.withColumn("_t", (F.col("_t") * F.col("_t") + F.lit(k[0]).cast("bigint")) % PRIME)
                df = df.withColumn("_t", (F.col("_t") * F.lit(k[0] % 65521 + 2).cast("bigint") + F.lit(self.seed % 65537).cast("bigint")) % PRIME)
                df = df.withColumn("_t", (F.col("_t") * F.col("_t") + F.col("_t")) % PRIME)
                size = F.lit(self.b if i % 2 else self.a).cast("bigint")
                df = df.withColumns({"_left": F.col("_right"), "_right": (F.col("_left") + F.col("_t")) % size})
            moved = F.col("_left") + F.col("_right") * F.lit(self.a).cast("bigint")
            df = df.withColumn(out, F.when(outside, moved).otherwise(F.col("_in")))
        return df.drop("_in", "_left", "_right", "_t")


def row_of(shard: int, slot: int, shards: int, permutation: Permutation) -> int:
    """The global row number that lies at ``slot`` of ``shard``."""
    return permutation.back(slot * shards + shard)


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (of the columns ``order``) with a dense BIGINT ``row`` from 0, and their number."""
    bucket = F.pmod(F.xxhash64(*order, *[F.col(c).isNull() for c in order]), F.lit(BUCKETS))
    alike, _ = stage(rows.groupBy(*order).agg(F.count("*").alias("alike")).withColumn("bucket", bucket), "numbered")
    counts = sorted(alike.groupBy("bucket").agg(F.sum("alike")).collect())  # BUCKETS rows at most
    at, offsets = 0, []
    for number, n in counts:
        offsets.append((number, at))
        at += n
    table = rows.sparkSession.createDataFrame(offsets, "bucket bigint, offset bigint")
    before = F.coalesce(F.sum("alike").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = alike.withColumn("before", before).join(F.broadcast(table), "bucket")
    numbered = numbered.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("alike") - 1)))
    return numbered.select(*order, (F.col("offset") + F.col("before") + F.col("nth")).alias("row")), at


def shard(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"])
    return Permutation(n, seed).add(numbered, "row", "p").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(f"cast(p % {shards} as int)").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"))
