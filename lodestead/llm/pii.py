"""Personal data by bootstrapped contextual extraction (operator 1).

Seeds are the spans of four base expressions (e-mail, IPv4, payment card, phone).  Every maximal run of tokens that
carry digits, `@` or `+` is an instance; a lexical pattern is its shape together with a context: the word on its left,
the two words there, the word on its right, or the words on both sides.  The bipartite graph of patterns and instances
is scored in rounds: a pattern's confidence for a kind is the mean score of the distinct instances it induces, an
instance's score is the noisy-or of its accepted patterns, seeds hold 1.  Instances of patterns that end with high
confidence and support, and that touch no base span, become new spans.

All of it is DataFrame code: one scan of the texts yields narrow staged rows (spans and instances), the graph is
aggregated before it is joined, patterns of many instances are joined where these lie, and texts are never shuffled.
Time is linear in a text, whatever it holds: positions are summed block by block, and instances meet the base spans that
they touch in the order of the text.

Defined results: a null or empty text has no spans; base spans always stay; repeated rows get equal rows; an empty table
gives none; ties between kinds go to the kind listed first; a context ends where the next instance begins; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import attach, stage

KINDS = ("email", "ip", "card", "phone")
#: The base expressions, written so that they find the same leftmost spans in linear time: possessive where nothing that
#: follows could use what is given back, anchored to the start of a run where a later start in the run cannot do better.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which an expression cannot match.
GUARD = {"email": "text like '%@%'", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9]'", "phone": "text like '%+%'"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
GAP, SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@+]*+[0-9@+][^\x20\x09-\x0D]*+"
INSTANCE = TOKEN + r"(?:\x20[^\x20\x09-\x0D0-9@+]*+[0-9@+][^\x20\x09-\x0D]*+)*+"


def _lit(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


#: Matches whose positions are summed together: arrays that grow one by one are copied each time, so they stay short.
BLOCK = 128


def matches(text: str, pattern: str, guard: str, around: bool = False) -> Column:
    """ARRAY<STRUCT<start, end, m>> of all matches, in code points: pieces between matches give the positions.  With
    ``around`` also before and after, the pieces on either side."""
    found, between = f"regexp_extract_all({text}, {_lit(pattern)}, 0)", f"split({text}, {_lit(pattern)}, -1)"
    none = "cast(array() as array<struct<start: int, end: int, m: string" + (", before: string, after: string>>)" if around else ">>)")
    sides = ", 'before', x.gaps[i], 'after', x.gaps[i + 1]" if around else ""
    last = f"least({BLOCK} * (b + 1), size(x.ms)) - 1"
    # where each block begins
    sums = f"transform(sequence(0, (size(x.ms) - 1) div {BLOCK}), b -> aggregate(sequence({BLOCK} * b, {last}), 0, (p, i) -> p + length(x.gaps[i]) + length(x.ms[i])))"
    starts = f"aggregate({sums}, array(0), (acc, n) -> concat(acc, array(acc[size(acc) - 1] + n)))"
    walk = (
        f"aggregate(sequence({BLOCK} * b, {last}), named_struct('p', y[b], 's', {none}), (acc, i) -> named_struct("
        "'p', acc.p + length(x.gaps[i]) + length(x.ms[i]), 's', concat(acc.s, array(named_struct("
        f"'start', acc.p + length(x.gaps[i]), 'end', acc.p + length(x.gaps[i]) + length(x.ms[i]), 'm', x.ms[i]{sides})))), acc -> acc.s)"
    )
    # transforms of one element bind the arrays, so each expression runs once
    blocks = f"flatten(transform(array({starts}), y -> transform(sequence(0, (size(x.ms) - 1) div {BLOCK}), b -> {walk}))[0])"
    bound = f"transform(array(struct({found} as ms, {between} as gaps)), x -> {blocks})[0]"
    return F.expr(f"case when {guard} and {text} rlike {_lit(pattern)} then {bound} else {none} end")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    step = f"ascii(substr({d}, i, 1)) - 48"
    twice = f"case when 2 * ({step}) > 9 then 2 * ({step}) - 9 else 2 * ({step}) end"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + case when (length({d}) - i) % 2 = 1 then {twice} else {step} end) % 10 = 0"


VALID = {
    "email": "true",
    "ip": f"s.m rlike {_lit('^' + BYTE + '(?:[.]' + BYTE + '){3}$')}",
    "card": f"length({_digits('s.m')}) between 14 and 19 and {_luhn(_digits('s.m'))}",
    "phone": f"length({_digits('s.m')}) between 10 and 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text and ``base``: ARRAY<STRUCT<start, rank, end>> sorted by start, then kind."""
    df = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("mark", F.xxhash64("text"))
    for kind in KINDS:
        df = df.withColumn(kind, matches("text", BASE[kind], GUARD[kind]))
    kept = [f"transform(filter({k}, s -> {VALID[k]}), s -> named_struct('start', s.start, 'rank', {i}, 'end', s.end))" for i, k in enumerate(KINDS)]
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(kept)}))"))


def instances(df: DataFrame, min_digits: int) -> DataFrame:
    """Adds ``seen``: ARRAY<STRUCT<start, end, instance, likely, patterns>>; instance and patterns are hashes."""
    found = df.withColumn("runs", matches("text", INSTANCE, "text rlike '[0-9@+]'", True))
    patterns = f"transform({contexts('s.before', 's.after')}, c -> xxhash64(c.side, c.words, {shape('s.m')}))"
    likely = f"s.m like '%@%' or length({_digits('s.m')}) >= {min_digits}"
    return found.withColumn("seen", F.expr(f"transform(runs, s -> named_struct('start', s.start, 'end', s.end, 'instance', xxhash64(s.m), 'likely', {likely}, 'patterns', {patterns}))")).drop("runs")


def contexts(before: str, after: str) -> str:
    """ARRAY<STRUCT<side, words>> of the contexts that have words; anchored on a reversed piece, so a long one costs little."""

    def words(piece: str, many: int) -> str:
        return f"lower(regexp_extract({piece}, {_lit(f'^{GAP}*({SOLID}+(?:{GAP}+{SOLID}+){{{many - 1}}})')}, 1))"

    back = f"reverse({before})"
    sides = f"array(struct(reverse({words(back, 1)}) as l, reverse({words(back, 2)}) as ll, {words(after, 1)} as r))"
    each = "array(struct('l' as side, w.l as words), struct('ll' as side, w.ll as words), struct('r' as side, w.r as words), struct('lr' as side, if(w.l = '' or w.r = '', '', concat(w.l, ' ', w.r)) as words))"
    return f"filter(transform({sides}, w -> {each})[0], c -> c.words <> '')"


def touching(spans: DataFrame) -> DataFrame:
    """spans(doc_id, mark, base, seen) -> a row for each instance with the kind (``rank``) of a base span it touches or null.

    A base span that begins before an instance ends touches it if it ends after the instance's start; so the one that
    ends last among those is enough.
    """
    some = spans.where("size(seen) > 0")
    seen = some.select("doc_id", "mark", F.explode("seen").alias("s")).select("doc_id", "mark", "s", F.lit(None).cast("struct<end: int, less: int>").alias("base"), (F.col("s.end") * 2 - 1).alias("at"))
    base = some.select("doc_id", "mark", F.explode("base").alias("b")).select(
        "doc_id", "mark", F.lit(None).cast(seen.schema["s"].dataType).alias("s"), F.expr("named_struct('end', b.end, 'less', -b.rank)").alias("base"), (F.col("b.start") * 2).alias("at"))
    rows = seen.unionByName(base).withColumn("met", F.expr("max(base) over (partition by doc_id, mark order by at)")).where("s is not null")
    return rows.select("doc_id", "mark", "s.*", F.expr("if(met.end > s.start, -met.less, null)").alias("rank"))


def shape(m: str) -> str:
    """Digits become 9, runs of letters a; the rest stands."""
    return f"regexp_replace(regexp_replace({m}, '\\\\p{{L}}+', 'a'), '[0-9]', '9')"


def score_patterns(edges: DataFrame, rounds: int, confidence: float, support: float, told: list | None = None) -> DataFrame:
    """edges(pattern, instance, rank) -> accepted (pattern, n, kind, conf): the graph scored for a number of rounds.
    ``told`` gets the number of accepted patterns and of instances with evidence after each round."""
    total = edges.count()
    sums = [F.sum(F.when(F.col("rank") == i, F.col("score")).otherwise(0.0)).alias(f"k{i}") for i in range(len(KINDS))]
    best = F.greatest(*[F.col(f"k{i}") for i in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"k{i}") == best, F.lit(i)) for i in range(len(KINDS))])
    scored = edges.withColumn("score", F.col("rank").isNotNull().cast("double"))
    accepted = None
    for at in range(rounds):
        pattern = scored.groupBy("pattern").agg(F.count("*").alias("n"), *sums)
        pattern = pattern.select("pattern", "n", kind.alias("kind"), best.alias("mass"), (best / F.col("n")).alias("conf"))
        accepted, _ = stage(pattern.where((F.col("mass") >= support) & (F.col("conf") >= confidence)).drop("mass"), "patterns")
        if at + 1 == rounds and told is None:
            break
        # noisy-or over the accepted patterns of an instance, for the kind with most evidence
        lift = attach(edges.where("rank is null"), accepted, "pattern", "n", total).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf") * 0.999)))).alias("new"))
        lift = lift.groupBy("instance").agg(F.max_by("kind", F.struct("new", -F.col("kind"))).alias("kind"), F.max("new").alias("new"))
        lift, _ = stage(lift, "lift")
        found = lift.count()
        if told is not None:
            told.append((accepted.count(), found))
        if not found:
            break
        scored = edges.join(lift, "instance", "left").select("pattern", "instance", F.coalesce("rank", "kind").alias("rank"), F.when(F.col("rank").isNotNull(), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score"))
    return accepted


def find_pii(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: float = 5.0, min_digits: int = 7, told: list | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, number of spans that the patterns added."""
    rows, _ = stage(instances(base_spans(docs), min_digits).select("doc_id", "mark", "base", "seen"), "spans")
    uses, _ = stage(touching(rows).withColumn("pattern", F.explode("patterns")).drop("patterns"), "uses")
    edges, _ = stage(uses.groupBy("pattern", "instance").agg(F.min("rank").alias("rank")), "graph")
    accepted = score_patterns(edges, rounds, confidence, support, told)
    each = attach(uses.where("likely and rank is null").select("doc_id", "mark", "start", "end", "pattern"), accepted, "pattern", "n", uses.count())
    each = each.groupBy("doc_id", "mark", "start", "end").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"))
    new, _ = stage(each.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", F.col("kind").alias("rank"), "end")).alias("extra")), "found")
    out = rows.drop("seen").join(new.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    every = F.expr("array_sort(concat(base, coalesce(extra, cast(array() as array<struct<start: int, rank: int, end: int>>))))")
    names = ", ".join(f"'{k}'" for k in KINDS)

    def joined(spans: str) -> Column:
        return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', array({names})[s.rank], s.start, s.end)), ',')")

    counts = [F.expr(f"cast(size(filter(base, s -> s.rank = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.withColumn("every", every).select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"), F.expr("cast(coalesce(size(extra), 0) as bigint)").alias("n_found"))
