"""The pipeline against a brute-force version on sf0.001, and the registered queries' guard."""

from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from lodestead.llm import common, language_id, mixing, queries
from lodestead.llm import sentencepiece_codec as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = defaultdict(list)
    for i, r in docs.items():
        if any(c.isalpha() for c in r.text or ""):
            groups[r.text.translate(LOWER)].append(i)
    left = sorted(max(g) for g in groups.values())
    # five-word shingles, Jaccard similarity of 0.8 or more
    sets = {}
    for i in left:
        words = docs[i].text.translate(LOWER).split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in left:
        for j in left:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    stay = {find(i) for i in left}
    out = corpus_pipeline.run(spark, sf).collect()
    times, total = Counter(r.doc_id for r in out), defaultdict(int)
    assert set(times) <= stay and max(times.values()) <= 2
    for i in stay:
        total[docs[i].source] += len(docs[i].text.split())
    names = sorted(total)
    goal = mixing.water_fill([total[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(total.values()), 2)
    for s, target in zip(names, goal):
        sizes = [len(docs[i].text.split()) for i in stay if docs[i].source == s]
        got = sum(n * len(docs[i].text.split()) for i, n in times.items() if docs[i].source == s)
        passes = min(2, int(target // sum(sizes)))
        sums = {0}
        for n in sizes:
            sums |= {x + n for x in sums}
        rest = round(target - passes * sum(sizes)) if passes < 2 else 0
        assert got == passes * sum(sizes) + max(x for x in sums if x <= rest)
    right = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert all(list(r.ids) == right.encode(docs[r.doc_id].text) for r in out)


NAMES = ["_id", "_n", "_copies", "_of", "_digest", "_lang_pred", "digest_of_row", "digest_of_gone", "id_of_gone", "mark_of_gone", "gone_stays", "cell_of_row", "draw_of_row", "times_of_row", "plan_n", "plan_last", "cell", "said", "row", "mark", "fp", "key", "copies", "times", "size", "last", "kept"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_clashing_names_nulls_and_empty_tables(spark, make_docs, odd_docs, stage):
    """Further columns pass through whatever their names; null ids, texts, repeated rows and empty tables have a result."""
    plain = make_docs(*odd_docs)
    wide = plain.withColumns({n: F.col("doc_id") for n in NAMES if n not in plain.columns})
    out = stage(spark, wide, "")
    assert out.columns == wide.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in stage(spark, plain, "").collect())
    assert all(r["_id"] == r.doc_id and r["cell"] == r.doc_id for r in got)
    assert stage(spark, wide.where("false"), "").count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:4]])
def test_reruns_agree(spark, make_docs, odd_docs, stage):
    """Rows alike in doc_id and text that differ elsewhere: the same ones stay, however the rows lie."""
    rows = odd_docs + [(50, "alike in text", lang, "a") for lang in ("en", "fr", "de", None)] + [(51, f"Alike in TEXT but for a word {i}", "en", "b") for i in (1, 2)]
    first, again = (sorted(map(str, stage(spark, make_docs(*x).repartition(n), "").collect())) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert first == again


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "sentencepiece"] and corpus_pipeline.ORACLE_SQL is None


def test_registered():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert [k for k in queries.QUERIES if k.startswith("op")] == sorted((k for k in queries.QUERIES if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))


def test_stages_give_memory_back(spark, make_docs, odd_docs):
    """Each stage has the JVMs collect before its work: what an earlier one made a heap grow to is not held beside it."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName()]
    for name, stage in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in whole)
        stage(spark, make_docs(*odd_docs), "")
        assert sum(b.getCollectionCount() for b in whole) > before, name


def test_small_tables_start_no_workers(spark):
    """Tables of rows that the driver has are local relations, not RDDs that Python workers unpickle."""
    schema = "lang string, kind int, least bigint, share double"
    rows = [("de", 0, 1 << 40, 0.25), (None, 3, 0, 1.0)]
    for some in (rows, []):
        table = common.small_table(spark, some, schema)
        assert [tuple(r) for r in table.collect()] == some and table.schema == StructType.fromDDL(schema)
        assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("a", "x", 3, 0), ("b", "y", 2, 0)], "lang string, name string, n bigint, kind int")
    histogram = spark.createDataFrame([("a", 3, 2), (None, 2, 1)], "source string, size bigint, n bigint")
    for module, call in ((language_id, lambda: language_id.most_frequent(words, 5)), (mixing, lambda: mixing.plan_mix(histogram, (5, 2, 1), 1.5, 2, 64))):
        made, was = [], module.small_table
        module.small_table = lambda *a: made.append(was(*a)) or made[-1]
        try:
            call()
        finally:
            module.small_table = was
        assert made and "ExistingRDD" not in made[0]._jdf.queryExecution().executedPlan().toString()
