"""Phrase collocations by Toivonen's mining: a sample proposes, a full pass counts, failures expand.

A sample of the documents proposes frequent phrases.  The full pass counts, in one go, every phrase
both of whose shorter parts (without its last, without its first word) are proposed: the proposed
phrases and their negative border, as far as it occurs.  All single words are proposed, so all pairs are
counted: which words are frequent depends on the corpus' size, and so would the work.  If phrases of the border turn out
frequent their extensions were not counted; they are added, and a further pass counts what that makes
countable and the first did not count.  A phrase that it counts passes as a part of longer ones without
a look at its count, so this pass closes the set: see ``frequent_phrases``.  Phrases and counts are plain
rows; tasks add up their own texts' counts first and Spark sums them.

Tasks ask whether a phrase is proposed in a bit filter of a fixed size.  A filter errs on one side
only: it may count phrases beyond the border, never leave one out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.llm.blocks import mix64
from panelcast.llm.common import settle, text_bytes

LONGEST = 5
SUPPORT = 100
TOP = 2000
#: One document in SAMPLE proposes; a phrase needs LOWERED of the support's share there.  A lower share
#: lets fewer frequent phrases fail, a higher one proposes, and so counts, fewer that are not frequent.
SAMPLE = 8
LOWERED = 0.8
#: Bits of the filter (16 MB) and bits set for a phrase.
FILTER_BITS = 27
PROBES = 3
#: Bits of the rows that Spark's bitmap functions build.
BUCKET_BITS = 15
CHUNK_BYTES = 3 << 20
#: Parts in which a language's candidates are ranked before they meet.
RANK_PARTS = 64
NO_LANG = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that end a piece, and bytes that stand between words of a piece.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = np.zeros(256, dtype=bool)
_GAPS[list(b" \t")] = True
_BREAKS = b".,;:!?\n\x0b\x0c\r"


@dataclass
class Words:
    """The words of many texts: their bytes one space apart, places there, numbers of equal words, and
    whether the next word is of the same piece."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    joined: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(lang: str, texts: list[bytes]) -> Words:
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
        ends = _ENDS[raw]
        word = ~(ends | _GAPS[raw])
        edge = np.flatnonzero(np.diff(word, prepend=False))
        first, last = edge[0::2], edge[1::2]
        size = last - first
        data = raw[word]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        column = pa.Array.from_buffers(
            pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        number = column.indices.to_numpy()
        seed = xxhash.xxh64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in column.dictionary.to_pylist()], dtype=np.uint64)
        piece = np.cumsum(ends, dtype=np.int32)[first] if len(first) else np.zeros(0, np.int32)
        spaced = np.full(len(data) + len(size), 32, dtype=np.uint8)
        end = (np.cumsum(size + 1) - 1).astype(np.int64)
        inside = np.ones(len(spaced), dtype=bool)
        inside[end] = False
        spaced[inside] = data
        joined = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        return Words(spaced, end - size, end, number, joined, hashes)

    def phrases(self, first: np.ndarray, length: int) -> pa.Array:
        """The phrases of ``length`` words that begin at the given words."""
        begin, size = self.start[first], self.end[first + length - 1] - self.start[first]
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.Array.from_buffers(
            pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.text[at])]
        )


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    out = []
    for _ in range(PROBES):
        hashes = mix64(hashes + _STEP)
        out.append((hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64))
    return out


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for bit in _bits(hashes):
        out &= (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return out


def _chained(chain: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix64(chain * _STEP + hashes)


def countable(words: Words, now: np.ndarray | None, before: np.ndarray | None, lengths: range, known: int):
    """(length, first words of distinct phrases, their counts) of the phrases to count.

    A phrase is countable under a filter if it holds both its parts and they are countable; without a
    filter, single words, or of more than ``known`` words, parts pass unasked.  Counted is what ``now`` makes countable and ``before`` did
    not; what is newly counted also passes as a part.  Single words are always countable, so they are
    counted where ``before`` is missing.
    """
    if not len(words.number):
        return
    # Of equal phrases one stands for all: only the number of each place's phrase is kept by place.
    at, code, size = np.arange(len(words.number), dtype=np.int32), words.number, len(words.hashes)
    hashes, old, count = words.hashes, np.full(size, before is not None), np.bincount(code, minlength=size)
    first = np.empty(size, dtype=np.int64)
    first[code[::-1]] = at[::-1]
    for length in range(1, lengths.stop):
        if length > 1:
            asked = 1 < length - 1 <= known
            holds = _holds(now, hashes) if asked and now is not None else np.ones(len(hashes), bool)
            if before is not None:
                holds |= ~old
            was = old & _holds(before, hashes) if asked and before is not None else old
            # The phrases at a place and at the next one are the parts of the longer one that begins there.
            held = holds[code]
            both = np.flatnonzero(
                (np.diff(at) == 1) & held[:-1] & held[1:] & words.joined[at[:-1] + length - 2]
            )
            if not len(both):
                return
            left, right, at = code[both], code[both + 1], at[both]
            last = words.number[at + length - 1]
            _, first, code, count = np.unique(
                left.astype(np.int64) * size + last, return_index=True, return_inverse=True, return_counts=True
            )
            hashes = _chained(hashes[left[first]], words.hashes[last[first]])
            old = was[left[first]] & was[right[first]]
        pick = np.flatnonzero(~old) if length in lengths else []
        if len(pick):
            yield length, at[first[pick]], count[pick]


def _cut(text: bytes) -> Iterator[bytes]:
    """A very long text in parts that end where a piece ends, so that no phrase is cut."""
    while len(text) > CHUNK_BYTES:
        stop = max(text.rfind(bytes([b]), 0, CHUNK_BYTES) for b in _BREAKS) + 1
        if stop == 0:
            stop = min((i for b in _BREAKS if (i := text.find(bytes([b]), CHUNK_BYTES)) >= 0), default=len(text)) + 1
        yield text[:stop]
        text = text[stop:]
    yield text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, body in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
            for part in _cut(body):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"), text_bytes().alias("body"))


def _count(
    texts: DataFrame, now: np.ndarray | None, before: np.ndarray | None = None,
    lengths: range = range(1, LONGEST + 1), known: int = LONGEST,
) -> DataFrame:
    """(lang, phrase, f) of the phrases that a pass counts; the empty phrase counts a language's words."""
    # Two filters of a fixed size, squeezed while few of their bits are set.
    sent = texts.sparkSession.sparkContext.broadcast(tuple(
        None if bits is None else zstandard.ZstdCompressor(level=1).compress(bits) for bits in (now, before)
    ))

    def run(batches):
        unsqueeze = zstandard.ZstdDecompressor().decompress
        now, before = (None if bits is None else np.frombuffer(unsqueeze(bits), np.uint8) for bits in sent.value)
        for lang, bodies in _chunks(batches):
            words = Words.of(lang, bodies)
            parts = [(pa.array([""]), np.array([len(words.number)]))] if 1 in lengths and before is None else []
            for length, first, count in countable(words, now, before, lengths, known):
                parts += [
                    (words.phrases(first[i : i + 65536], length), count[i : i + 65536]) for i in range(0, len(first), 65536)
                ]
                for phrase, n in parts:
                    # One key column makes a shorter row; no phrase holds a line feed.
                    both = pc.binary_join_element_wise(phrase, pa.scalar(lang), "\n")
                    yield pa.RecordBatch.from_arrays([both, pa.array(n.astype(np.int64))], ["both", "f"])
                parts = []

    counted = texts.mapInArrow(run, "both string, f long").groupBy("both").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("both", "\n", 1)
    return counted.select(F.substr("both", F.length(phrase) + 2).alias("lang"), phrase.alias("phrase"), "f")


def _filter(phrases: DataFrame) -> np.ndarray:
    """The bit filter of phrases (lang, phrase): at most 2^(FILTER_BITS - BUCKET_BITS) rows of bits, built
    by Spark's bitmap aggregate."""

    def places(batches):
        for batch in batches:
            chain = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                seed = xxhash.xxh64_intdigest(lang.encode())
                hashes = [xxhash.xxh64_intdigest(w, seed) for w in phrase.encode().split(b" ")]
                value = np.array(hashes[:1], dtype=np.uint64)
                for h in hashes[1:]:
                    value = _chained(value, np.uint64(h))
                chain.append(value[0])
            for bit in _bits(np.array(chain, dtype=np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(places, "bit long")
    width = 1 << BUCKET_BITS
    rows = bits.groupBy(F.floor(F.col("bit") / width).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("bit") % width).alias("bits")
    ).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in rows:
        body = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        start = int(r["bucket"]) * (width >> 3)
        out[start : start + len(body)] = body
    return out


def _propose(df: DataFrame, support: int, sample: int) -> tuple[DataFrame, np.ndarray]:
    """(lang, phrase) of two words and more that the sample finds frequent, and their filter: pairs, then the
    longer ones all of whose pairs are.  Every single word counts as proposed."""
    chosen = settle(_texts(df.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0)))
    enough = max(1, round(support / sample * LOWERED)) if sample > 1 else support
    found, now = None, None
    for lengths in (range(2, 3), range(3, LONGEST + 1)):
        counted = _count(chosen, now, lengths=lengths, known=lengths.start - 1)
        often = settle(counted.filter((F.col("f") >= enough) & (F.col("phrase") != "")).select("lang", "phrase"))
        found = often if found is None else found.unionByName(often)
        now = _filter(often) if now is None else now | _filter(often)
    return found, now


def n_words(phrase: str = "phrase") -> Column:
    return F.size(F.split(phrase, " "))


def frequent_phrases(df: DataFrame, support: int = SUPPORT, sample: int = SAMPLE) -> DataFrame:
    """(lang, phrase, f) of all phrases of one to five words with f >= support, and of the empty phrase,
    whose f is the number of words of the language; counts are exact.

    The parts of a frequent phrase are frequent.  Those that the first pass counted are proposed, or
    have failed and been added; those that it did not count are counted by the second pass, shorter
    ones first, and pass there.  So the second pass counts every frequent phrase that the first did not.
    """
    texts = _texts(df)
    proposed, now = _propose(df, support, sample)
    enough = (F.col("f") >= support) | (F.col("phrase") == "")
    found = settle(_count(texts, now).filter(enough))
    border = found.filter(n_words().between(2, LONGEST - 1)).select("lang", "phrase")
    failed = settle(border.join(proposed, ["lang", "phrase"], "left_anti"))
    if failed.isEmpty():
        return found
    return found.unionByName(settle(_count(texts, now | _filter(failed), now).filter(enough)))


def collocations(df: DataFrame, support: int = SUPPORT, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to five words.

    a is the phrase's count, n the language's words; of all cuts in two parts with counts l and r the
    one with the lowest floor(1000 a n / (l r)) is told, the earliest of equal ones.  Phrases inside a
    longer frequent phrase of the same count are left out.

    ``df`` has doc_id, text and lang; other columns do not matter.  Letters A to Z are lowered.  Null texts count as
    empty, a null lang is 'und'.  Repeated rows count as often as they stand.  A text of any length is
    counted whole.  Ties of score go to the larger a, then to the phrase's bytes.  An empty table, or
    one without a frequent phrase, gives an empty one.
    """
    known = frequent_phrases(df, support, sample)
    counts = known.filter("phrase != ''")
    totals = known.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    longer = counts.filter(n_words() > 2).select("lang", F.col("f").alias("a"), words.alias("w"))
    size = F.size("w")
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    # A phrase inside a longer one of its count is inside one that is a word longer and has it too.
    inside = longer.select("lang", "a", F.explode(F.array(part(1, size - 1), part(2, size - 1))).alias("phrase"))
    phrases = counts.filter(n_words() > 1).select("lang", "phrase", F.col("f").alias("a"))
    phrases = phrases.join(inside.distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = phrases.withColumn("w", F.split("phrase", " ")).withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))
    ).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    scored = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
        .withColumns({"up": F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n"), "down": wide("l") * wide("r")})
        .withColumn("score", F.expr("up div down"))
    )
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    rows = best.select("lang", "phrase", "b.*").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for dealt in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*dealt).orderBy(*order)))
        rows = rows.filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
