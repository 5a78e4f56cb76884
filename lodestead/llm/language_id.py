"""Language identification, word first with backoff to character n-grams (operator 8).

A known word adds its log frequency in each language.  An unseen word falls back to its longest character n-grams that
the model knows (4, 3, 2, 1, with word ends marked): the mean log frequency of those, over the whole word, however long.
The language with the largest sum wins; the score is its posterior.  Each distinct word of a text is scored once and
weighted by its count.

Training counts words in Spark over a sample of labelled rows of bounded expected size (``max_train_docs``, drawn by
hash of the doc_id); the model keeps about ``max_words`` words a language, and ``max_grams`` n-grams of each length from
them.  It is held by the counts that are not zero, so its size is in proportion to the languages, and bounded by the
sample.  Prediction reads the text only.

Defined results: a null text or one without a letter is `und` with score 0; so is every text if nothing can be learned;
ties go to the language first by code point; repeated rows get equal rows; an empty table gives none; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import broadcast_if_small, small_table, stage, tidy
from lodestead.session import ship

UND = "und"
GRAMS = (4, 3, 2, 1)
#: Numbers, and characters of words, that a worker remembers beside the model; the memory is emptied when full.
MEMO, MEMO_CHARS = 1 << 19, 1 << 22
#: Numbers of a model that a worker lays out as a table.
CELLS = 1 << 22
#: Letters of a word from which n-grams are counted at a time in training.
STEP = 61
#: Texts longer than this are counted piece by piece, cut at a gap between words.
PIECE = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """languages; words and grams: row numbers.  A row's entries lie from starts[row] to starts[row + 1]: a language and
    what its log frequency has above that of a name never seen (base, a line for words and one for each gram length)."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    starts: np.ndarray
    langs: np.ndarray
    above: np.ndarray
    base: np.ndarray

    def total(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of rows, without their base, for each language."""
        first, many = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)
        return np.bincount(self.langs[at], np.repeat(weights, many) * self.above[at], len(self.languages))


class Scorer:
    """Scores texts with a model; one to a Python worker.  A model of few numbers is laid out as a table at once, a larger
    one word by word as they are met."""

    def __init__(self, model: Model):
        self.model, languages, rows = model, len(model.languages), len(model.starts) - 1
        self.words = model.words if rows * languages <= CELLS else {}
        self.laid = rows if self.words else 0
        self.table = np.zeros((self.laid + max(1024, MEMO // max(1, languages)), languages))
        self.step = len(self.table) - self.laid
        if self.laid:
            for names, line in ((model.words, lambda k: 0), (model.grams, lambda k: 1 + GRAMS.index(len(k)))):
                for name, row in names.items():
                    self.table[row] = model.base[line(name)]
            self.table[np.repeat(np.arange(rows), np.diff(model.starts)), model.langs] += model.above
        self.memo: dict[str, int] = {}
        self.chars = 0

    def _remember(self, word: str) -> int:
        """Where the table holds the word's log frequencies from now on."""
        at = self.laid + len(self.memo)
        known = self.model.words.get(word)
        self.table[at] = self._fallback(word) if known is None else self.model.total(np.array([known]), np.ones(1)) + self.model.base[0]
        self.memo[word] = at
        self.chars += len(word)
        return at

    def _fallback(self, word: str) -> np.ndarray:
        grams, marked = self.model.grams, f"\x02{word}\x03"
        for line, n in enumerate(GRAMS, 1):
            hits = [grams[g] for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g in grams]
            if hits and self.laid:
                return self.table[hits].sum(axis=0) / len(hits)
            if hits:
                return self.model.total(np.array(hits), np.ones(len(hits))) / len(hits) + self.model.base[line]
        return np.zeros(len(self.model.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = words_of(text)
        if not self.model.languages or not counts:
            return UND, 0.0
        known, memo, total, step = self.words, self.memo, np.zeros(len(self.model.languages)), self.step
        items = list(counts.items())
        for at in range(0, len(items), step):
            part = items[at : at + step]
            if len(memo) + len(part) > step or self.chars > MEMO_CHARS:  # between parts only: rows handed out stay until they are added up
                memo.clear()
                self.chars = 0
            ids = [r if (r := known.get(w)) is not None else r if (r := memo.get(w)) is not None else self._remember(w) for w, _ in part]
            total += np.fromiter((n for _, n in part), np.float64, len(part)) @ self.table[ids]
        best = int(total.argmax())
        odds = np.exp(np.clip(total - total[best], -700, 0))
        return self.model.languages[best], float(1.0 / odds.sum())

    def keeps(self, text: str | None) -> bool:
        """Whether a language is found; with a model of none, whether there is a letter to find one by."""
        return self.predict(text)[0] != UND or not self.model.languages and bool(words_of(text))


def words_of(text: str | None) -> Counter[str]:
    """Lower-case words, runs of letters, with their counts."""
    counts: Counter[str] = Counter()
    for piece in pieces(text or ""):
        counts.update(_WORD.findall(piece.lower()))
    return counts if any(c.isalpha() for w in counts for c in w) else Counter()


def pieces(text: str) -> Iterator[str]:
    """Consecutive parts of about PIECE characters, cut at spaces only."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, max_train_docs: int = 20_000, max_words: int = 30_000, max_grams: int = 8_000) -> Model:
    """Learn from rows with a language that are not held out; a bounded number of counts reaches the driver."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.select("doc_id").count()
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    sample = usable.where(draw < int(min(1.0, max_train_docs / max(n, 1)) * (1 << 30)))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("name"))
    words = most_frequent(words.groupBy("lang", "name").agg(F.count("*").alias("n")).withColumn("kind", F.lit(0)), max_words)
    # a word is taken apart in steps, each with the next three letters, so that a long one costs time in proportion
    marked = F.concat(F.lit("\x02"), "name", F.lit("\x03"))
    steps = words.withColumn("p", F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{STEP}}}"), F.lit(0))).select("lang", "n", F.expr("transform(p, (x, i) -> struct(x, coalesce(substr(get(p, i + 1), 1, 3), '') as more))").alias("p"))
    steps = steps.select("lang", "n", F.explode("p").alias("p")).select("lang", "n", "p.x", F.concat("p.x", "p.more").alias("y"))
    each = ", ".join(f"if(length(y) < {k}, cast(array() as array<string>), transform(sequence(1, least(length(x), length(y) - {k - 1})), i -> substr(y, i, {k})))" for k in GRAMS)
    grams = steps.select("lang", "n", F.explode(F.expr(f"flatten(array({each}))")).alias("name"))
    grams = most_frequent(grams.groupBy("lang", "name").agg(F.sum("n").alias("n")).withColumn("kind", F.length("name")), max_grams)
    return build(words.select("lang", "name", "n").toPandas(), grams.select("lang", "name", "n").toPandas())


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """counts(lang, name, n, kind), staged: about the ``most`` largest of each language and kind.

    How many names have each count tells the least count that is let in; of the names with just that count a share is
    taken by hash.  So no language is ranked in one task.
    """
    counts, _ = stage(counts, "counts")
    levels: dict[tuple, list[tuple[int, int]]] = {}
    for lang, kind, n, names in counts.groupBy("lang", "kind", "n").agg(F.count("*")).collect():
        levels.setdefault((lang, kind), []).append((n, names))
    rules = []
    for (lang, kind), found in levels.items():
        left = most
        for n, names in sorted(found, reverse=True):
            if names >= left:
                rules.append((lang, kind, n, left / names))
                break
            left -= names
        else:
            rules.append((lang, kind, 0, 1.0))
    table = small_table(counts.sparkSession, rules, "lang string, kind int, least bigint, share double")
    draw = F.pmod(F.xxhash64(F.lit(5), "name"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = counts.join(broadcast_if_small(table, len(rules), 64), ["lang", "kind"]).where((F.col("n") > F.col("least")) | (F.col("n") == F.col("least")) & (draw < F.col("share")))
    return stage(kept.drop("least", "share"), "frequent")[0]


def build(words: pd.DataFrame, grams: pd.DataFrame) -> Model:
    """The model of counts(lang, name, n)."""
    languages = sorted(set(words["lang"]))
    where = {x: i for i, x in enumerate(languages)}
    ids, starts, langs, above = [], [0], [], []
    base = np.zeros((1 + len(GRAMS), len(languages)))
    for frame, sized in ((words, False), (grams, True)):
        rows: dict[str, list[tuple[int, int]]] = {}
        for lang, name, n in frame[["lang", "name", "n"]].itertuples(index=False):
            rows.setdefault(name, []).append((where[lang], int(n)))
        sums, names = np.zeros_like(base), np.zeros(len(base))
        at: dict[str, int] = {}
        for name in sorted(rows):
            line = 1 + GRAMS.index(len(name)) if sized else 0
            at[name], names[line] = len(starts) - 1, names[line] + 1
            for lang, n in sorted(rows[name]):
                langs.append(lang)
                above.append(n)
                sums[line, lang] += n
            starts.append(len(langs))
        ids.append(at)
        # half a count for what was never seen
        lines = names > 0
        base[lines] = np.log(0.5) - np.log(sums[lines] + 0.5 * names[lines, None] + 1)
    return Model(languages, ids[0], ids[1], np.array(starts), np.array(langs, np.int32), np.log((np.array(above, float) + 0.5) / 0.5), base)


def identify(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score; with ``keep`` the rows of docs that have a language instead."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    if keep:
        schema, rows, at = docs.schema, docs, docs.columns.index("text")
    else:
        rows, at = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"), 2
        schema = "doc_id bigint, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            if keep:
                yield batch.filter(pa.array([scorer.keeps(t.as_py()) for t in batch.column(at)], pa.bool_()))
                continue
            found = [scorer.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tidy(run), schema)


def identify_languages(docs: DataFrame, **how) -> DataFrame:
    return identify(docs, train(docs, **how))


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text has a language; `und` goes.

    If no language can be learned from the table, texts with a letter stay all the same: nothing speaks against them.
    Null and empty texts go; an empty table stays empty; columns of any name pass through, as none is added.
    """
    return identify(docs, train(docs, **how), keep=True)
