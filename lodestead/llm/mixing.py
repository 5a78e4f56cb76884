"""Mixing sources to target weights by subset-sum budget fitting (operator 10).

1. Documents are counted by source and exact word count; the histogram is all that planning sees.
2. Each source's target is its weighted share of the budget, stopped at ``cap`` times the source (water filling).
3. Within a source whole passes are taken first.  Of the remaining budget every length gives its share, longest first
   and in step with the words passed; the small rest is fitted as closely as possible by a bounded-knapsack dynamic
   programme over the documents not yet taken.
4. Of each (source, length) the planned number of documents is chosen by seeded hash order: those up to a threshold.

Only (doc_id, source, size) rows move, those alike counted first.  A (source, length) group of n is cut into about
sqrt(n) hash ranges whose counts tell in which range the threshold lies, so ranking gathers about sqrt(n) rows.  What a
row gets then follows from its group's line of the plan, wherever the row lies: texts are not shuffled.

Defined results: null text has size 0 and is never taken; a null source is a source of its own, last in order; equal
texts are separate documents; rows repeating a doc_id count each; of rows alike in doc_id, text and source that share a
threshold some get one copy more; sources without words have target 0; an empty table gives no rows; ``mix`` ignores
further columns, whatever their names, and ``mixed_documents`` passes them through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestead.llm.common import attach, broadcast_if_small, free_names, small_table, stage
from lodestead.session import ship

WORD = "[^\\x20\\x09-\\x0D]+"
#: The last rest, in words, that the dynamic programme fits exactly.
DP_WORDS = 1 << 16
#: The mix is configured by its sources, so their list must fit on the driver; more than this is an error.
MAX_SOURCES = 1_000_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        whole = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / whole >= cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in full)
        free -= full
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to ``budget`` as can be told.

    lengths are positive and distinct.  A share of every length in step with the budget, then an exact bounded knapsack.
    """
    order = np.argsort(-lengths, kind="stable")
    size, there = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    take, rest = np.zeros_like(there), int(budget)
    spare = min(rest, dp_words)  # left for the programme, which needs documents to choose from
    whole, cum, spent = int((size * there).sum()), 0, 0
    for i in range(len(size)):  # longest first, the words taken keep step with the words passed
        w, n = int(size[i]), int(there[i])
        cum += w * n
        take[i] = max(0, min(n, ((rest - spare) * cum // whole - spent) // w))
        spent += w * int(take[i])
    rest -= spent
    for i in range(len(size)):  # while more is left than the programme can fit
        if rest <= dp_words:
            break
        more = min(int(there[i] - take[i]), (rest - dp_words) // int(size[i]))
        take[i] += more
        rest -= more * int(size[i])
    rest_cap = min(rest, dp_words)
    reach = np.zeros(rest_cap + 1, bool)
    reach[0] = True
    by, step = np.full(rest_cap + 1, -1, np.int32), np.zeros(rest_cap + 1, np.int64)
    for i in range(len(size)):
        left, bundle = int(there[i] - take[i]), 1
        while left and not reach[rest_cap]:
            n = min(bundle, left)
            w = n * int(size[i])
            if w > rest_cap:
                if n == 1:
                    break
                left, bundle = min(left, n - 1), max(1, n // 2)  # a larger bundle cannot fit; the smaller ones may
                continue
            new = np.flatnonzero(reach[: rest_cap + 1 - w] & ~reach[w:]) + w
            reach[new], by[new], step[new] = True, i, n
            left, bundle = left - n, bundle * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = int(by[at]), int(step[at])
        take[i] += n
        at -= n * int(size[i])
    out = np.zeros_like(take)
    out[order] = take
    return out


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def draw_of(seed: int, doc_id: Column, mark: Column) -> Column:
    """A row's place in the hash order."""
    return F.xxhash64(F.lit(seed), doc_id, mark)


def cell_of(source: Column, size: Column) -> Column:
    """The (source, size) group as one number."""
    return F.xxhash64(source, size, source.isNull())


def plan_mix(histogram: DataFrame, weights: tuple[float, ...], share: float, cap: int, dp_words: int) -> DataFrame:
    """(source, size, n, source_size, target, passes, chosen): passes for all, one more for ``chosen`` of the n."""
    spark = histogram.sparkSession
    per = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [int(r["words"]) for r in per]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(per))], share * sum(sizes), cap)
    rows = []
    for r, words, target in zip(per, sizes, targets):
        passes = min(cap, int(target // words)) if words else 0
        rows.append((r["source"], words, float(target), passes, int(round(target - passes * words)) if passes < cap else 0))
    goals = small_table(spark, rows, "source string, source_size bigint, target double, passes int, rest bigint")
    ship(spark)
    joined = histogram.join(broadcast_if_small(goals, len(rows), 64), histogram.source.eqNullSafe(goals.source)).drop(goals.source)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(chosen=np.zeros(len(f), np.int64))
        live = (f["size"] > 0).to_numpy()
        if live.any() and f["rest"].iloc[0] > 0:
            f.loc[live, "chosen"] = fit_lengths(f["size"].to_numpy()[live], f["n"].to_numpy()[live], int(f["rest"].iloc[0]), dp_words)
        return f

    return joined.groupBy("source").applyInPandas(one, "source string, size bigint, n bigint, source_size bigint, target double, passes int, rest bigint, chosen bigint")


def plan_rows(docs: DataFrame, weights: tuple[float, ...], share: float, cap: int, seed: int, dp_words: int) -> tuple[DataFrame, DataFrame]:
    """(units, plan), both staged.  units(doc_id, mark, size, cell, draw, alike): rows alike, counted.  plan(cell, n, units,
    source_size, target, passes, last, spare): each row gets ``passes`` copies and one more if its draw is below
    ``last``; of rows whose draw is ``last`` the first ``spare`` get it."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"))
    rows = rows.groupBy("doc_id", "mark", "source", "size").agg(F.count("*").alias("alike"))
    units, _ = stage(rows.withColumn("draw", draw_of(seed, F.col("doc_id"), F.col("mark"))).withColumn("cell", cell_of(F.col("source"), F.col("size"))), "units")
    histogram, _ = stage(units.groupBy("source", "size").agg(F.sum("alike").alias("n"), F.count("*").alias("units")), "histogram")
    goals, _ = stage(plan_mix(histogram.drop("units"), weights, share, cap, dp_words).withColumn("cell", cell_of(F.col("source"), F.col("size"))), "goals")
    goals = goals.join(histogram.select(cell_of(F.col("source"), F.col("size")).alias("cell"), "units"), "cell")
    goals, _ = stage(goals, "goals")
    cut = goals.where("chosen > 0 and chosen < n")
    # a range is a slice of the hash order; its number is monotone in draw
    ranges = F.ceil(F.sqrt("units"))
    piece = F.least(F.floor((F.col("draw") / F.lit(2.0**64) + F.lit(0.5)) * ranges), ranges - 1).cast("bigint")
    total = units.count()
    inside, _ = stage(attach(units.select("cell", "draw", "alike"), cut.select("cell", "chosen", "units"), "cell", "units", total).withColumn("piece", piece), "inside")
    counts = inside.groupBy("cell", "piece").agg(F.sum("alike").alias("held"), F.first("chosen").alias("goal"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("cell").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("before", before).where("before < goal and before + held >= goal").select("cell", "piece", (F.col("goal") - F.col("before")).alias("quota"))
    edge, _ = stage(edge, "edge")
    near = inside.drop("chosen", "units").join(broadcast_if_small(edge, edge.count(), 24), ["cell", "piece"])
    near = near.groupBy("cell", "draw").agg(F.sum("alike").alias("held"), F.first("quota").alias("quota"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("cell").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = near.withColumn("before", before).where("before < quota and before + held >= quota").select("cell", F.col("draw").alias("last"), (F.col("quota") - F.col("before")).alias("spare"), "held")
    plan = goals.join(last, "cell", "left").select(
        "cell", "size", "n", "units", "source_size", "target", "passes", F.when(F.col("chosen") >= F.col("n"), F.lit("all")).when(F.col("last").isNull(), F.lit("none")).otherwise(F.lit("part")).alias("rule"),
        "last", F.coalesce("spare", F.lit(0)).alias("spare"), F.coalesce("held", F.lit(0)).alias("held"))
    plan, _ = stage(plan, "plan")
    return units, plan


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 7, dp_words: int = DP_WORDS) -> DataFrame:
    """doc_id, mark, size, source_size, target, copies (times the document is taken), one row per row of ``docs``.

    mark is a hash of the text that tells rows of one doc_id apart.
    """
    units, plan = plan_rows(docs, weights, share, cap, seed, dp_words)
    rows = attach(units.select("doc_id", "mark", "cell", "draw", "alike"), plan, "cell", "units", units.count())
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("alike"))))
    more = F.col("rule").eqNullSafe("all") | (F.col("rule") == "part") & ((F.col("draw") < F.col("last")) | (F.col("draw") == F.col("last")) & (F.col("nth") <= F.col("spare")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.coalesce(more, F.lit(False)).cast("int")).otherwise(0)
    return rows.select("doc_id", "mark", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: int = 7, dp_words: int = DP_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as the mix takes it.

    The plan has a line for each (source, length), not for each document; it is broadcast if its counted size is small,
    else rows are joined by group, large groups where they lie.  Of rows alike in doc_id, text and source, those first by
    a hash of the whole row get what cannot be shared evenly, so reruns agree.  Null texts are not taken; an empty table
    stays empty; columns of any name pass through, as added names give way to them.
    """
    units, plan = plan_rows(docs, weights, share, cap, seed, dp_words)
    cell, draw, times = free_names(docs, "cell_of_row", "draw_of_row", "times_of_row")
    names = dict(zip(("n", "passes", "rule", "last", "spare", "held", "size"), free_names(docs, *(f"plan_{x}" for x in ("n", "passes", "rule", "last", "spare", "held", "size")))))
    lines = plan.select(F.col("cell").alias(cell), *[F.col(k).alias(v) for k, v in names.items()])
    text = F.col("text")
    rows = docs.withColumn(cell, cell_of(F.col("source").cast("string"), size_of(text))).withColumn(draw, draw_of(seed, F.col("doc_id").cast("bigint"), F.xxhash64(text)))
    n, held = plan.agg(F.count("*"), F.count_if((F.col("spare") > 0) & (F.col("spare") < F.col("held")))).first()
    few = broadcast_if_small(lines, n, 96)
    rows = rows.join(few, cell) if few is not lines else attach(rows, lines, cell, names["n"], units.count())
    c = {k: F.col(v) for k, v in names.items()}
    at = (c["rule"] == "part") & (F.col(draw) == c["last"])
    more = (c["rule"] == "all") | (c["rule"] == "part") & (F.col(draw) <= c["last"])
    given = F.when(c["size"] > 0, c["passes"] + F.coalesce(more, F.lit(False)).cast("int")).otherwise(0)
    shared = F.coalesce(at & (c["spare"] < c["held"]), F.lit(False))
    plain = rows.where(~shared) if held else rows
    out = plain.withColumn(times, given).where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{x}`") for x in docs.columns])
    if not held:
        return out
    # rows of one draw are alike in all that the mix sees: those alike altogether are counted, and the rest is dealt out
    whole = F.struct(*[F.col(f"`{x}`") for x in docs.columns])
    kinds = rows.where(shared).groupBy(F.col(cell).alias("cell"), F.to_json(whole).alias("said")).agg(F.first(whole).alias("row"), F.count("*").alias("alike"), F.first(c["passes"]).alias("passes"), F.first(c["spare"]).alias("spare"))
    order = Window.partitionBy("cell").orderBy(F.xxhash64("said"), "said").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.greatest(F.lit(0), F.least("alike", F.col("spare") - F.coalesce(F.sum("alike").over(order), F.lit(0))))
    kinds = kinds.withColumn("times", (F.col("passes") * F.col("alike") + rest).cast("bigint")).where("times > 0")
    return out.unionByName(kinds.withColumn("times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select("row.*"))
