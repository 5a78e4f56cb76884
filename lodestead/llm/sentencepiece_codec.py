"""SentencePiece encoding and decoding on the tokenizers library (operator 9).

The model's protobuf is parsed here; normaliser, metaspace marker, pieces with their scores and byte fallback are
rebuilt as a tokenizers pipeline, which encodes batches on several threads.  Unigram models keep their scores; BPE models
get the merges that their scores imply.  Where no piece carries the marker after another character, text is cut before
each word first, which changes no result and makes long texts linear in time.

Parity is verified, not assumed: every word that enters a worker's memory is encoded by the sentencepiece library too,
in runs of ``RUN`` words (no piece reaches from one word into the next, so equal ids of a run are equal ids of its words;
where a run's differ, word by word), and one whole text in ``PARITY`` besides; every whole text of a model that
normalises more than spaces.  The rebuilt BPE ranks the ways to merge one piece, where the original takes the leftmost;
where that shows, the original's ids are taken, and the row says so.

Defined results: a null or empty text has no tokens and decodes to itself (null: empty); line ends and control
characters are kept as the model's normaliser keeps them; text that the vocabulary lacks becomes bytes; very long texts
are encoded whole, a bounded number of bytes at a time in memory; repeated rows get equal rows; an empty table gives
none; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestead.llm.common import KEPT, tidy
from lodestead.session import ship

#: Where the vocabulary lies unless a path is given; never copied into the repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters cut at a time, new words encoded at a time, words that make one input of either library, words remembered,
#: and one text in how many is checked whole.
BATCH_CHARS, WORDS, RUN, MEMO, PARITY = 1 << 18, 4096, 64, 160_000, 64


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as ints, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Spec:
    """Field numbers are those of the public sentencepiece_model.proto."""
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, best score first; a tie goes to the longest left part."""
    rank = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER, UNUSED)}
    score = {p: s for p, s, _ in spec.pieces}
    out = []
    for piece in rank:
        cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
        out += [(-score[piece], rank[piece], -len(a), a, b) for a, b in cuts]
    return [(a, b) for *_, a, b in sorted(out)]


def build(spec: Spec):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), 0)
    if spec.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        # words are remembered by the codec, so the model's own cache would only be missed
        model = models.BPE(vocab, merges(spec), cache_capacity=0, unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.kind} is not supported")
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind in (NORMAL, USER)):
        # runs of markers stay with the word that follows, as pieces of several markers exist
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    parts = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if spec.byte_fallback else []) + [decoders.Fuse()]
    out.decoder = decoders.Sequence([*parts, decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else parts)
    return out


class Codec:
    """A model file ready to encode and decode; one to a Python worker.

    Where texts may be cut before each word, a batch's distinct new words are encoded together, on several threads, and
    remembered as packed ids; a text is then a join of packed ids.  Of at most ``MEMO`` words, those stay when the memory
    is full that came again since it last was.  A word is known by its text without the first marker; one without a
    marker, as a text may begin with, by itself behind a space, which no word holds.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        data = Path(path).read_bytes()
        import sentencepiece

        self.spec = parse_model(data)
        self.tokenizer = build(self.spec)
        self.normaliser = self.tokenizer.normalizer
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = self.tokenizer.pre_tokenizer is not None and self.spec.escape
        self.plain = not self.spec.charsmap and not self.spec.squeeze and self.spec.dummy_prefix
        if self.by_word:  # texts are normalised and cut here; the pipeline then sees single words
            self.tokenizer.normalizer = self.tokenizer.pre_tokenizer = None
        self.memo: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.marked = np.array([p.startswith(MARK) for p, *_ in self.spec.pieces])
        self.differ: set[str] = set()
        self.said = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " \u2047 ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.spec.pieces], pa.binary())

    def normalise(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else text
        return self.normaliser.normalize_str(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        return self.encode_told(texts)[0]

    def encode_told(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as packed 32-bit integers, and whether the original library's ids are among them."""
        if not self.by_word:
            out = [struct.pack(f"={len(e.ids)}i", *e.ids) for part in batches_of(texts) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            return out, [False] * len(out)
        out, own = [], []
        for part in batches_of(texts):
            cut = [self._cut(t) for t in part]
            words = set().union(*(window for text in cut for window in text))
            new = list(words.difference(self.memo))
            words.difference_update(new)
            self.again |= words
            if len(self.memo) + len(new) > MEMO:
                self._sweep(words, MEMO - len(new))
            for at in range(0, len(new), WORDS):
                self._remember(new[at : at + WORDS])
            known = self.memo.__getitem__
            out += [b"".join([b"".join(map(known, window)) for window in text]) for text in cut]
            own += [not all(map(self.differ.isdisjoint, text)) for text in cut] if self.differ else [False] * len(cut)
        return out, own

    def _cut(self, text: str) -> list[list[str]]:
        """The words of each window of a text, as they are known."""
        if self.plain and len(text) <= BATCH_CHARS and not text.startswith(" ") and "  " not in text and MARK not in text:
            return [text.split(" ")] if text else []  # each word has one marker, its own
        return [[w[1:] if w[0] == MARK else " " + w for w in _CHUNK.findall(window)] for window in windows(self.normalise(text))]

    def _sweep(self, needed: set[str], room: int) -> None:
        """Forget words that did not come again; all that are not needed now if there is no room for the others."""
        self.memo = {w: self.memo[w] for w in (self.again if len(self.again) <= room else needed)}
        self.again = set()

    def _remember(self, new: list[str]) -> None:
        """Encode words by both libraries; where they differ the original's ids are kept."""
        if self.spec.kind != BPE:
            return self._one_by_one(new)
        text = " ".join(new)
        if MARK in text or "" in new or text.count(" ") >= len(new):  # words with more or fewer markers than the one in front
            odd = [w for w in new if not w or w[0] == " " or MARK in w]
            self._one_by_one(odd)
            new = list(set(new).difference(odd))
        runs = [new[at : at + RUN] for at in range(0, len(new), RUN)]
        texts = [" ".join(run) for run in runs]
        found = self.tokenizer.encode_batch_fast([MARK + text.replace(" ", MARK) for text in texts], add_special_tokens=False)
        for run, text, ids in zip(runs, texts, (e.ids for e in found)):
            packed = np.array(ids, np.int32)
            starts = (4 * np.flatnonzero(self.marked[packed])).tolist()
            if len(starts) != len(run) or self.plain and self.original.encode(text) != ids:
                self._one_by_one(run)
                continue
            self.memo.update(zip(run, map(packed.tobytes().__getitem__, map(slice, starts, [*starts[1:], None]))))

    def _one_by_one(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast([w[1:] if w[:1] == " " else MARK + w for w in words], add_special_tokens=False)
        right = self.original.encode([w.replace(MARK, " ") for w in words], num_threads=1) if self.plain else itertools.repeat(None)
        for word, ids, theirs in zip(words, (e.ids for e in found), right):
            if self.plain and word and ids != theirs:  # nothing is put in front of an empty text
                self.differ.add(word)
                ids = theirs
            self.memo[word] = struct.pack(f"={len(ids)}i", *ids)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids: pieces with markers as spaces, bytes as they are, without the space put in front."""
        # the pieces that are taken lie one after the other in the result's data
        said = self.said.take(pa.array(ids, pa.int32())).buffers()[2]
        text = said.to_pybytes().decode("utf-8", "replace") if said else ""
        return text[1:] if self.spec.dummy_prefix and text.startswith(" ") else text


@functools.cache
def codec_of(path: str, threads: int) -> Codec:
    """One codec, and one memory, for all tasks of a worker."""
    return Codec(path, threads)


def forget() -> None:
    codec_of.cache_clear()


KEPT.append(forget)

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_EDGE = re.compile(f"[^{MARK}](?={MARK})")


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about BATCH_CHARS together; a longer one stands alone."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > BATCH_CHARS:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def windows(text: str) -> Iterator[str]:
    """Pieces of about BATCH_CHARS, cut where a word ends and the next marker begins."""
    at = 0
    while len(text) - at > BATCH_CHARS:
        edge = _EDGE.search(text, at + BATCH_CHARS)
        if not edge:
            break
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:] if at else text


def encode_documents(docs: DataFrame, model: str = MODEL, threads: int = 2, parity: int = PARITY) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoded equals the text), checked (parity was verified), original
    (the original library's ids were taken)."""
    # the model travels with the job, as executors need not have it
    spark = docs.sparkSession
    ship(spark)
    spark.sparkContext.addFile(model)
    name = os.path.basename(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(SparkFiles.get(name), threads)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                check = [bool(x) for x in batch.column(2).to_pylist()]
                (packed, own), same = codec.encode_told(texts), []
                for i, text in enumerate(texts):
                    check[i] |= not codec.plain
                    if check[i] and (right := np.array(codec.original.encode(text), np.int32).tobytes()) != packed[i]:
                        packed[i], own[i] = right, True
                    same.append(codec.decode(np.frombuffer(packed[i], np.int32)) == text)
                ends = np.cumsum([0] + [len(p) // 4 for p in packed])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(same), pa.array(check), pa.array(own)],
                    names=["doc_id", "ids", "n_tokens", "round_trip", "checked", "original"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", (F.pmod(F.xxhash64("text"), F.lit(parity)) == 0).alias("check"))
    return rows.mapInArrow(tidy(run, forget), "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean, checked boolean, original boolean")


def token_digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined), round_trip, checked, original."""
    out = encode_documents(docs, **how)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "round_trip", "checked", "original")
