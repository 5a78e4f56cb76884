import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestead.llm import exact_dedup, simhash
from lodestead.llm.common import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def test_exact_dedup_odd(make_docs, odd_docs):
    out = exact_dedup.exact_dedup(make_docs(*odd_docs)).collect()
    assert len(out) == len(odd_docs)
    groups = defaultdict(list)
    for i, t, *_ in odd_docs:
        groups[(t or "").translate(LOWER)].append(i)
    by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups)  # one of each, repeated rows too


def test_exact_dedup_empty(make_docs):
    assert exact_dedup.exact_dedup(make_docs((1, "a", None, None)).where("false")).count() == 0


def test_index_grows(spark, make_docs):
    index = exact_dedup.DigestIndex(spark, "grown_digests", buckets=4)
    first = make_docs((1, "a", None, None), (2, "b", None, None), (3, "A", None, None))
    was = sorted(map(str, index.add(first).collect()))
    second = {r.doc_id: r for r in index.add(make_docs((9, "a", None, None), (10, "c", None, None), (11, "C", None, None), (3, "A", None, None))).collect()}
    assert (second[9].keep_id, second[9].kept, second[9].in_index) == (3, False, True)
    assert (second[10].keep_id, second[10].kept, second[11].kept) == (11, False, True)
    assert second[3].kept and second[3].in_index  # the holder comes again
    held = sorted(map(str, index.read().collect()))
    assert sorted(r.keep_id for r in index.read().collect()) == [2, 3, 11]
    assert sorted(map(str, index.add(first).collect())) == was and sorted(map(str, index.read().collect())) == held  # a retry
    spark.sql("DROP TABLE grown_digests")


def test_index_plan(spark, make_docs):
    """The operator's own anti-join is a merge join that reads the index without a shuffle."""
    index = exact_dedup.DigestIndex(spark, "planned_digests", buckets=4)
    index.add(make_docs((1, "a", None, None)))
    plan = index.fresh(exact_dedup.digests(make_docs((2, "b", None, None))))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("LeftAnti") :]
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in side and "Exchange" not in side[side.rindex("FileScan") - 200 : side.rindex("FileScan")]
    spark.sql("DROP TABLE planned_digests")


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_do_not_matter(spark, make_docs, odd_docs, batches):
    rows = odd_docs + [(100 + i, f"T{i % 13}" if i % 2 else f"t{i % 13}", None, None) for i in range(60)]
    out = sorted(map(str, exact_dedup.exact_dedup(make_docs(*rows), batches=batches).drop("in_index").collect()))
    assert out == sorted(map(str, exact_dedup.exact_dedup(make_docs(*reversed(rows)), batches=3).drop("in_index").collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestead_digests")]


def test_index_outlives_its_catalog_entry(spark, make_docs, tmp_path):
    at = f"file://{tmp_path}/index"
    exact_dedup.DigestIndex(spark, "outer_digests", 4, at).add(make_docs((1, "a", None, None)))
    spark.sql("DROP TABLE outer_digests")
    again = exact_dedup.DigestIndex(spark, "outer_digests", 4, at).add(make_docs((5, "A", None, None))).first()
    assert (again.keep_id, again.kept) == (1, False)
    spark.sql("DROP TABLE outer_digests")


def test_hot_group(spark, make_docs):
    out = exact_dedup.exact_dedup(make_docs(*[(i, "hot" if i % 3 else f"t{i}", None, None) for i in range(3000)]))
    hot = out.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.count_if("kept")).first()
    assert tuple(hot) == (2000, 2999, 1)


def test_drop_copies(make_docs, odd_docs):
    left = exact_dedup.drop_copies(make_docs(*odd_docs))
    assert left.columns == make_docs(*odd_docs).columns
    texts = [(r.text or "").translate(LOWER) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t, *_ in odd_docs})


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one two", "a b c a b c a b c", "É é x Y z", "w " * 70_000])
@pytest.mark.parametrize("width", [3, 5])
def test_fingerprint(text, width):
    assert simhash.fingerprint(text, width) & (2**64 - 1) == brute_fingerprint(text, width)


def test_fingerprint_is_sparks_hash(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert xxhash.xxh64_intdigest(b"a b c", 42) == want & (2**64 - 1)


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == brute_components([(a, b) for a, b in pairs if a != b])
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_numbers(rng):
    """Fingerprints a few bits apart, and many that share one half."""
    fps = {0, -1, 1, 3, 7, 15}
    for _ in range(60):
        x = rng.getrandbits(64) - 2**63
        fps.add(x)
        for _ in range(3):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randint(0, 62)
            fps.add(y)
    half = rng.getrandbits(31) << 32
    fps |= {half | rng.getrandbits(7) for _ in range(60)} | {rng.getrandbits(31) << 32 | 5 for _ in range(30)}
    return sorted(fps)


@pytest.mark.parametrize(("radius", "segments", "bucket"), [(2, 2, 64), (2, 2, 3), (2, 3, 4), (3, 2, 64), (3, 2, 4), (4, 3, 64), (0, 2, 64)])
def test_ball_links_connect_all_within_the_radius(spark, radius, segments, bucket):
    u = near_numbers(random.Random(4))
    a = np.array(u, np.int64)
    far = np.bitwise_count((a[:, None] ^ a[None]).view(np.uint64))
    near = [(u[i], u[j]) for i, j in zip(*np.nonzero(far <= radius)) if j < i]
    edges = [(r.a, r.b) for r in simhash.ball_links(spark.createDataFrame([(x,) for x in u], "fp bigint"), radius, segments, bucket).collect()]
    assert set(edges) <= set(near) and all(x > y for x, y in edges)
    assert brute_components(edges) == brute_components(near)


@pytest.mark.parametrize(("radius", "segments"), [(2, 2), (2, 3), (5, 3), (9, 4), (1, 4)])
def test_segments_miss_no_pair(radius, segments):
    """Pairs at the radius, however its bits lie, differ within the look-up radius in some segment that is looked into."""
    rng = random.Random(1)
    found = simhash.cuts(segments, radius)
    for _ in range(3000):
        x = sum(1 << i for i in rng.sample(range(64), radius))
        assert any((x >> first & ((1 << width) - 1)).bit_count() <= deep for first, width, deep in found)


def test_whole_table_against_brute_force(spark, sf):
    from lodestead.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text, 3) for r in docs}
    ids = sorted(fps)
    near = [(i, j) for i in ids for j in ids if i != j and (fps[i] ^ fps[j]).bit_count() <= 2]
    root = brute_components(near)
    out = queries.op5_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fps[i]:016x}", root.get(i, i)) for i in ids} and len(out) == len(docs)


def test_near_duplicates_odd(make_docs, odd_docs):
    out = simhash.near_duplicates(make_docs(*odd_docs)).collect()
    assert len(out) == len(odd_docs)
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16} and {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in out if r.doc_id in (4, 5, None)} == {4}
    assert simhash.near_duplicates(make_docs((1, "a", None, None)).where("false")).count() == 0


def test_drop_near_copies(make_docs, odd_docs):
    left = simhash.drop_near_copies(make_docs(*odd_docs), 5)
    assert sorted(r.doc_id for r in left.collect()) == [1, 4, 6, 7, 8] and left.columns == make_docs(*odd_docs).columns
