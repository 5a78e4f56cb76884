"""Reuse across sites: which sites hold the same tokens, and how alike their sets are.

Sites with identical token sets are one weighted class; of each the set of one site is read.  Classes are numbered, and so
are the tokens that two classes or more hold.  A block of classes at a time goes to the workers as an index from token to
classes: a list, or a bit set where that is smaller.  Every class, where it lies, marks or counts the block's classes under
its own tokens.  So no pair of classes is ever a row, nothing grows with the square of a token's classes on disk, and a
block takes the same memory at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.session import settle, ship, stage, unstage

#: A token that more than one in so many of a block's classes hold is a bit set there.
LIGHT = 32
#: Of a block: bytes of its lists (bit sets take less than the lists they replace) and classes, at most.
BLOCK_BYTES, BLOCK = 32 << 20, 1 << 20
#: Tables up to so many bytes are broadcast; so many blocks' results are kept before they are added up.
SMALL, KEPT = 16 << 20, 16


def classes(sites: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """site -> sorted set; site -> class, staged; class -> one of its sites, number of tokens and of sites.  Sites without
    tokens or key are in none."""
    sets = sites.select(F.col(key).alias("site"), F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))).alias("set")).where(F.col("site").isNotNull() & (F.size("set") > 0))
    member, _ = stage(sets.select("site", F.unhex(F.sha2(F.to_json("set"), 256)).alias("class"), F.size("set").alias("n")), "member")
    return sets, member.select("site", "class"), member.groupBy("class").agg(F.min("site").alias("site"), F.min("n").alias("n"), F.count("*").alias("weight"))


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, staged, with a dense BIGINT ``no`` from 0, and the number of rows."""
    held, _ = stage(df.withColumn("at", F.monotonically_increasing_id()), name)
    offsets, n = [], 0
    for part, rows in sorted(held.groupBy(F.shiftright("at", 33)).count().collect()):  # as many rows as files were written
        offsets.append((part, n))
        n += rows
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "part bigint, offset bigint"))
    return held.join(table, F.shiftright("at", 33) == F.col("part")).withColumn("no", F.col("offset") + F.col("at") % (1 << 33)).drop("at", "part", "offset"), n


def small(table: DataFrame, column: str) -> bool:
    """Whether the table of a key and three numbers may be broadcast, by its counted size."""
    return (table.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 24)).first()[0] or 0) < SMALL


def postings(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """no, n, weight, tokens (sorted numbers of those that other classes hold too), staged; classes without such are left out."""
    near = small(groups, "site")
    own = sets.join(F.broadcast(groups) if near else groups, "site").select("no", "n", "weight", "set")
    if not near:
        own, _ = stage(own, "sets")
    posts = own.select("no", "n", "weight", F.explode("set").alias("token"))
    tokens, total = numbered(posts.groupBy("token").count().where("count > 1").select("token"), "tokens")
    settle(sets.sparkSession)  # the shuffle's files go
    tokens = tokens.select("token", F.col("no").cast("int" if total < 1 << 31 else "bigint").alias("t"))
    found = posts.join(F.broadcast(tokens) if small(tokens, "token") else tokens, "token")
    out, _ = stage(found.groupBy("no", "n", "weight").agg(F.array_sort(F.collect_list("t")).alias("tokens")), "postings")
    del found
    settle(sets.sparkSession)
    return out


def blocks(rows: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of class numbers that hold a block's classes and postings, at most; a class beyond that is a block."""
    most, room = rows.agg(F.max(F.size("tokens"))).first()[0], BLOCK_BYTES // 4
    if most is None:
        return
    step = max(1, min(BLOCK, 1024, room // most))
    start = end = filled = 0
    for at, n in rows.groupBy(F.floor(F.col("no") / step).alias("at")).agg(F.sum(F.size("tokens"))).orderBy("at").toLocalIterator():
        if filled and (filled + n > room or (at + 1) * step - start > BLOCK):
            yield start, end
            filled = 0
        if not filled:
            start = at * step
        end, filled = (at + 1) * step, filled + n
    yield start, end


def neighbours(rows: DataFrame, alike: bool) -> DataFrame:
    """no, value: of each class the sites of other classes that share a token or, if ``alike``, the largest Jaccard
    similarity with another class; classes without such are left out."""
    spark = rows.sparkSession
    ship(spark)
    add = F.max if alike else F.sum
    kept: list[tuple[DataFrame, str]] = []

    def added() -> DataFrame:
        out = kept[0][0]
        for part, _ in kept[1:]:
            out = out.unionByName(part)
        return out.groupBy("no").agg(add("value").alias("value"))

    for start, end in list(blocks(rows)):
        if len(kept) == KEPT:
            old, kept = kept, [stage(added(), "neighbours")]
            for _, path in old:
                unstage(spark, path)
        kept.append(_block(rows, start, end, alike))
    return added() if kept else spark.createDataFrame([], f"no bigint, value {'double' if alike else 'bigint'}")


def _index(rows: DataFrame, start: int, end: int) -> tuple:
    """The classes numbered start to end: their tokens, where the list of each starts, the lists; the tokens that are bit
    sets, and those; sizes and weights.  At most BLOCK_BYTES of lists reach the driver."""
    got = rows.where((F.col("no") >= start) & (F.col("no") < end)).toArrow().combine_chunks()
    no, n, weight, held = (got.column(c).combine_chunks() for c in ("no", "n", "weight", "tokens"))
    no = no.to_numpy() - start
    sizes, weights = np.ones(end - start, np.int64), np.ones(end - start, np.int64)
    sizes[no], weights[no] = n.to_numpy(), weight.to_numpy()
    token = held.flatten().to_numpy()
    order = np.argsort(token, kind="stable")
    lists = np.repeat(no.astype(np.int32), held.value_lengths().to_numpy())[order]
    tokens, starts = np.unique(token[order], return_index=True)
    starts = np.append(starts, len(lists)).astype(np.int32)
    counts = np.diff(starts)
    many = counts.astype(np.int64) * LIGHT > end - start
    bits = np.zeros((int(many.sum()), -(-(end - start) // 8)), np.uint8)
    for at, k in enumerate(np.flatnonzero(many)):
        flags = np.zeros(end - start, bool)
        flags[lists[starts[k] : starts[k + 1]]] = True
        bits[at] = np.packbits(flags, bitorder="little")
    light = ~many
    lists = lists[np.repeat(light, counts)]
    return tokens[light], np.append(0, np.cumsum(counts[light])).astype(np.int32), lists, tokens[many], bits, sizes, weights


def _found(values: np.ndarray, lens: np.ndarray, tokens: np.ndarray) -> tuple[list[int], list[int]]:
    """Places in ``tokens`` of the values that are there, and where those of each row end."""
    at = np.searchsorted(tokens, values)
    there = at < len(tokens)
    there[there] = tokens[at[there]] == values[there]
    ends = np.append(0, np.cumsum(there))[np.append(0, np.cumsum(lens))]
    return at[there], ends.tolist()


def _block(rows: DataFrame, start: int, end: int, alike: bool) -> tuple[DataFrame, str]:
    """What the classes numbered start to end give each class, staged."""
    held = rows.sparkSession.sparkContext.broadcast(_index(rows, start, end))
    width = end - start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, starts, lists, common, bits, sizes, weights = held.value
        single = bool((weights == 1).all())
        for batch in batches:
            own = batch.column("tokens")
            values, lens = own.flatten().to_numpy(), own.value_lengths().to_numpy()
            at, ends = _found(values, lens, tokens)
            begins, stops = starts[at].tolist(), starts[at + 1].tolist()
            many, many_ends = _found(values, lens, common)
            value = np.zeros(batch.num_rows, np.float64 if alike else np.int64)
            for i, (no, n) in enumerate(zip((batch.column("no").to_numpy() - start).tolist(), batch.column("n").to_pylist())):
                parts = [lists[a:b] for a, b in zip(begins[ends[i] : ends[i + 1]], stops[ends[i] : ends[i + 1]])]
                crowd = many[many_ends[i] : many_ends[i + 1]]
                if not parts and not len(crowd):
                    continue
                if alike:
                    shared = np.bincount(np.concatenate(parts), minlength=width) if parts else np.zeros(width, np.int64)
                    for k in crowd:
                        shared += np.unpackbits(bits[k], count=width, bitorder="little")
                    if 0 <= no < width:
                        shared[no] = 0
                    j = np.flatnonzero(shared)
                    if len(j):
                        value[i] = (shared[j] / (n + sizes[j] - shared[j])).max()
                    continue
                if len(crowd):
                    met = bits[crowd[0]].copy()
                    for k in crowd[1:]:
                        met |= bits[k]
                    seen = np.unpackbits(met, count=width, bitorder="little").view(bool)
                else:
                    seen = np.zeros(width, bool)
                if parts:
                    seen[np.concatenate(parts)] = True
                if 0 <= no < width:
                    seen[no] = False
                value[i] = np.count_nonzero(seen) if single else weights[seen].sum()
            some = np.flatnonzero(value)
            yield pa.RecordBatch.from_arrays([batch.column("no").take(pa.array(some)), pa.array(value[some])], names=["no", "value"])

    out = stage(rows.select("no", "n", "tokens").mapInArrow(run, f"no bigint, value {'double' if alike else 'bigint'}"), "block")
    held.destroy()
    return out


def _told(sites: DataFrame, key: str, tokens: str, alike: bool, value, out: str) -> DataFrame:
    """key, out: the ``value`` of a site's class (weight; what ``neighbours`` gives, or null), null for sites without tokens."""
    sets, member, groups = classes(sites, key, tokens)
    groups, _ = numbered(groups, "classes")
    found = neighbours(postings(sets, groups.drop("class")), alike)
    found = groups.select("no", "class", "weight").join(found, "no", "left").select("class", value.alias(out))
    return sites.select(key).join(member.join(found, "class").select(F.col("site").alias(key), out), key, "left")


def max_similarity(sites: DataFrame, key: str, tokens: str, out: str = "max_structure_similarity_other_site") -> DataFrame:
    """key, out: the largest Jaccard similarity with another site's set; 0.0 where there is none."""
    best = F.when(F.col("weight") > 1, 1.0).otherwise(F.col("value"))
    return _told(sites, key, tokens, True, best, out).select(key, F.coalesce(out, F.lit(0.0)).alias(out))


def sharing_sites(sites: DataFrame, key: str, tokens: str, out: str) -> DataFrame:
    """key, out: number of other sites that share at least one token."""
    others = F.col("weight") - 1 + F.coalesce("value", F.lit(0))
    return _told(sites, key, tokens, False, others, out).select(key, F.coalesce(out, F.lit(0)).cast("bigint").alias(out))


def add_cross_site_features(sites: DataFrame, key: str = "input_url") -> DataFrame:
    """``sites`` with the three features; the key must be unique."""
    pooled = sites.select(key, F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("ga_ua_ids", "ga4_ids", "gtm_ids", "fb_pixel_ids")])).alias("trackers"))
    out = sites.join(max_similarity(sites, key, "structure_hashes"), key, "left")
    out = out.join(sharing_sites(sites, key, "css_content_hashes", "n_sites_sharing_css_file"), key, "left")
    return out.join(sharing_sites(pooled, key, "trackers", "n_sites_sharing_tracker_id"), key, "left")
