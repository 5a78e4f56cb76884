"""SimHash near-duplicates by multi-index hashing (operator 5).

A fingerprint of 64 bits is cut into segments, each with a table of its own from segment value to fingerprints.  Of two
fingerprints within ``radius`` bits some segment differs in few: with r = m * a + rest bits over m segments either one of
the first rest + 1 segments differs in at most a bits or one of the others in at most a - 1.  So every fingerprint
enumerates the Hamming balls of these radii around its segments' values, fetches what the tables hold there, and the
complete distance is verified.  For 2 bits and two segments these are 33 + 1 look-ups.

A segment value that many fingerprints share would make a bucket whose pairs grow with its square.  Fingerprints that
reside in such a bucket or look into it are looked up by the ball around the whole fingerprint instead (half the radius
on either side), in which no key can hold more of them than the ball has points: every link is found there as well, in
rows proportional to the fingerprints.  Equal fingerprints are collapsed before, so copies cost one row.

For similarities below those of 2 bits (the pipeline's 0.8 differs in 15 % of the bits) there are fingerprints of 256 bits,
``wide_links``: the same tables, balls and look-ups over twelve segments of 21 or 22 bits, which hold all pairs within
``radius`` bits and part of those beyond; all pairs fetched within ``reach`` bits are given to the caller to be verified.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a shingle
make one shingle of the whole sequence; repeated rows get equal rows; an empty table gives none; component_id is the
smallest non-null doc_id of the component; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import attach, broadcast_if_small, components, free_names, one_of_each, stage, tidy
from lodestead.session import ship

CHUNK = 1 << 15
BITS = 64
#: Wide fingerprints: columns of 64 bits.
WORDS = ("w0", "w1", "w2", "w3")
#: Fingerprints that share a segment's value and are still compared one by one.
BUCKET = 64
#: The same for segments of wide fingerprints, after which an exact index finds what is left.
WIDE_BUCKET = 8


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash as a signed long; bytes.split() cuts exactly at space and \\x09-\\x0D, bytes.lower() lowers A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = np.fromiter((digest(line[x:y], 42) for x, y in zip(a[at : at + CHUNK], b[at : at + CHUNK])), np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view(np.int64)[0])


def wide(items: np.ndarray) -> list[int]:
    """SimHash of 64 bits a word of WORDS, as signed longs, over a set of 64-bit hashes; each word mixes them anew."""
    ones = np.zeros((len(WORDS), BITS), np.int64)
    for at in range(0, len(items), CHUNK):
        for k in range(len(WORDS)):
            z = items[at : at + CHUNK].view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << BITS))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            ones[k] += np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((ones * 2 > len(items)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, mark, fp) of every row; mark is a hash of the raw text that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], names=["doc_id", "mark", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("mark")).mapInArrow(tidy(run), "doc_id bigint, mark bigint, fp bigint")


def ball(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` bits set, as signed longs."""
    sums = (sum(1 << i for i in some) for n in range(radius + 1) for some in itertools.combinations(range(width), n))
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in sums]


def cuts(segments: int, radius: int, bits: int = BITS) -> list[tuple[int, int, int]]:
    """(first bit, width, look-up radius) of each segment that must be looked into, so that no pair is missed."""
    at = [bits * i // segments for i in range(segments + 1)]
    deep, rest = divmod(radius, segments)
    found = [(a, b - a, deep if i <= rest else deep - 1) for i, (a, b) in enumerate(zip(at, at[1:]))]
    return [x for x in found if x[2] >= 0]


def segment_rows(fps: DataFrame, segments: int, radius: int, around: bool) -> DataFrame:
    """(segment, value, fp): the tables' rows, or with ``around`` all look-ups."""
    each = []
    for i, (first, width, deep) in enumerate(cuts(segments, radius)):
        value = f"shiftrightunsigned(fp, {first}) & {(1 << width) - 1 if width < BITS else -1}L"
        points = ", ".join(f"{x}L" for x in ball(width, deep if around else 0))
        each.append(f"transform(array({points}), x -> named_struct('segment', {i}, 'value', ({value}) ^ x))")
    return fps.select("fp", F.expr(f"explode(concat({', '.join(each)}))").alias("at")).select("at.segment", "at.value", "fp")


def whole_ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) within ``radius`` bits that connect all such pairs, by balls of half the radius around whole
    fingerprints.  A key is in the balls of as many fingerprints at most as a ball has points."""
    half, distance = radius // 2, F.bit_count(F.col("a").bitwiseXOR(F.col("b")))

    def keys(deep: int) -> DataFrame:
        flips = F.array(*[F.lit(x).cast("bigint") for x in ball(BITS, deep)])
        return fps.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp")

    if radius % 2:
        met = keys(half + 1).withColumnRenamed("fp", "a").join(keys(half).withColumnRenamed("fp", "b"), "key").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:  # all that meet under a key are within the radius of each other, so neighbours connect them
        before = F.expr("lag(fp) over (partition by key order by fp)")
        met = keys(half).withColumn("other", before).where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return met.where(distance <= radius).distinct()


def ball_links(fps: DataFrame, radius: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a > b, between distinct fingerprints within ``radius`` bits that connect all such pairs."""
    table, looks = segment_rows(fps, segments, radius, False), segment_rows(fps, segments, radius, True)
    hot, _ = stage(table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket).drop("n"), "hot")
    n = hot.count()
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    crowded = None
    if n:
        few = broadcast_if_small(hot, n, 32)
        crowded = table.join(few, ["segment", "value"], "left_semi").select("fp").unionByName(looks.join(few, ["segment", "value"], "left_semi").select("fp")).distinct()
        table, looks = (x.join(few, ["segment", "value"], "left_anti") for x in (table, looks))
    met = looks.withColumnRenamed("fp", "a").join(table.withColumnRenamed("fp", "b"), ["segment", "value"]).where("a > b").select("a", "b")
    met = met.where(distance <= radius).distinct()
    return met if crowded is None else met.unionByName(whole_ball_links(crowded, radius)).distinct()


def wide_rows(fps: DataFrame, segments: int, radius: int) -> DataFrame:
    """(at, key, other, home): the look-ups, of which those ``home`` are the tables' rows; ``at`` holds the segment and its
    value, ``other`` a word that the segment is not cut from.  No segment spans two words."""
    each = []
    for i, (first, width, deep) in enumerate(cuts(segments, radius, BITS * len(WORDS))):
        word, bit = divmod(first, BITS)
        if bit + width > BITS:
            raise ValueError("segments must not span two words")
        value = f"({i}L << 48) | (shiftrightunsigned({WORDS[word]}, {bit}) & {(1 << width) - 1}L)"
        points = ", ".join(f"{x}L" for x in ball(width, deep))
        each.append(f"transform(array({points}), x -> named_struct('at', ({value}) ^ x, 'other', {WORDS[(word + 1) % len(WORDS)]}, 'home', x = 0))")
    return fps.select("key", F.expr(f"explode(concat({', '.join(each)}))").alias("of")).select("of.at", "key", "of.other", "of.home")


def bucket_pairs(at: np.ndarray, key: np.ndarray, other: np.ndarray, home: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a > b, of the keys that meet under each value of ``at``; rows lie by at, residents (home) first, then by
    other.  Up to ``bucket`` residents meet each other and all who look in, if ``other`` allows; of more each meets the
    one before it and the first.  So a row makes at most ``bucket`` pairs, whatever the size of its group."""
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))[np.cumsum(np.concatenate(([0], at[1:] != at[:-1])))]
    place = np.arange(len(at)) - start
    held = np.concatenate(([0], np.cumsum(home)))[np.append(start[1:][start[1:] != start[:-1]], len(at))]
    held = np.diff(held, prepend=0)[np.cumsum(np.concatenate(([0], at[1:] != at[:-1])))]
    few, one, two = held <= bucket, [], []
    for k in range(bucket):  # each row and the resident at place k
        i = np.flatnonzero(few & (place > k) & (held > k))
        j = start[i] + k
        close = np.bitwise_count((other[i] ^ other[j]).view(np.uint64)) <= 20
        one.append(i[close]), two.append(j[close])
    i = np.flatnonzero(~few & home & (place > 0))
    one.extend((i, i)), two.extend((i - 1, start[i]))
    a, b = key[np.concatenate(one)], key[np.concatenate(two)]
    return np.maximum(a, b)[a != b], np.minimum(a, b)[a != b]


def wide_links(fps: DataFrame, radius: int = 12, reach: int = 64, segments: int = 12, bucket: int = WIDE_BUCKET) -> DataFrame:
    """Pairs (a, b), a > b, of keys whose wide fingerprints (key, WORDS) meet in a segment's table and differ in ``reach``
    bits or fewer: all within ``radius`` and part of the others.

    Of a segment value that more than ``bucket`` keys share only neighbours and the first are paired, so pairs are in
    proportion to the fingerprints: the caller must have an exact way for the rest, as ``set_join`` has.  A pair that
    differs in more than 20 of the 64 bits of the word carried along goes at once (at the reach of 64 in 256 bits 16 are
    expected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last value's rows, which may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            now = left if batch is None else [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if batch is not None and left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            if now is None or not len(now[0]):
                continue
            cut = len(now[0]) if batch is None else int(np.searchsorted(now[0], now[0][-1]))
            left = [x[cut:] for x in now]
            if cut:
                a, b = bucket_pairs(*[x[:cut] for x in now], bucket)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ship(fps.sparkSession)
    rows = wide_rows(fps, segments, radius).repartition("at").sortWithinPartitions("at", F.desc("home"), "other", "key")
    met = rows.mapInArrow(tidy(run), "a bigint, b bigint").distinct()
    a, b = (fps.select(F.col("key").alias(k), *[F.col(w).alias(k + w) for w in WORDS]) for k in ("a", "b"))
    distance = " + ".join(f"bit_count(a{w} ^ b{w})" for w in WORDS)
    return met.join(a, "a").join(b, "b").where(f"{distance} <= {reach}").select("a", "b")


def first_row() -> F.Column:
    """The row that stands for its group: smallest doc_id, null last, then the smallest mark."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "mark"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, mark, kept (the row stands for its component)."""
    rows, _ = stage(fingerprints(docs, width), "fingerprints")
    groups, _ = stage(rows.groupBy("fp").agg(first_row().alias("first"), F.count("*").alias("held")), "groups")
    links, _ = stage(ball_links(groups.select("fp"), radius, segments), "links")
    table = with_components(groups.withColumnRenamed("fp", "key"), components(links)).withColumnRenamed("key", "fp")
    return judged(attach(rows, table, "fp", "held", rows.count()), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def with_components(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """groups(key, first, held) with ``first`` of the whole component, staged; roots(node, root) lacks lone keys."""
    roots, _ = stage(roots, "roots")
    linked = groups.join(roots, groups.key == roots.node, "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    linked, _ = stage(linked, "linked")
    named, _ = stage(linked.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("keys")), "named")
    table, _ = stage(attach(linked.drop("first"), named, "root", "keys", linked.count()).select("key", "first", "held"), "table")
    return table


def judged(rows: DataFrame, *more: F.Column) -> DataFrame:
    """doc_id, further columns, component_id, mark, kept."""
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    return rows.select("doc_id", *more, F.col("first.doc_id").alias("component_id"), "mark", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 3, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, less all but one document of each component: the one with the smallest doc_id.

    ``found`` (doc_id, mark, kept) may come from another method.  What is dropped is a narrow list (doc_id, mark); texts
    move only if it is too long to broadcast.  Null doc_ids come last, then the smallest hash of the text; of rows that
    repeat doc_id and text the first by a hash of the whole row stays; an empty table stays empty; columns of any name
    pass through, as added names give way to them.
    """
    found = near_duplicates(docs, width) if found is None else found
    rows, _ = stage(found.groupBy("doc_id", "mark").agg(F.max("kept").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "judged")
    lost, again = rows.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    if not lost and not again:
        return docs
    gone_id, of, stays = free_names(docs, "id_of_gone", "mark_of_gone", "gone_stays")
    gone = rows.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(of), F.col("stays").alias(stays))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(of))
    left = docs.join(broadcast_if_small(gone, lost + again, 24), same, "left_anti")
    if not again:
        return left
    twice = docs.join(broadcast_if_small(gone.where(stays), again, 24), same, "left_semi")
    return left.unionByName(one_of_each(twice, ["doc_id", "text"], docs.columns))
