"""Scoring texts by a Katz backoff model of word pairs, learned from the same documents."""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import blocks as B
from panelcast.llm.common import total_bytes

#: Counts up to this are discounted by Good-Turing, larger ones are taken as they are.
DISCOUNTED = 5
FOLDS, HELD_OUT = 5, 1
WORDS, PAIRS, CONTEXTS = 1, 2, 3
WORD_COUNTS, PAIR_COUNTS, BACKOFFS, FIGURES = 4, 5, 6, 7
#: Bits of a pair's hash that are not sent.
CUT = np.uint64(8)
END = B.mix64(np.array([0xE0D], dtype=np.uint64))[0]
START = B.mix64(np.array([0x57A27], dtype=np.uint64))[0]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


class Discounts:
    """Good-Turing discounts of the counts 1 to k, from the numbers n_r of items with each count.

    The n_r are first smoothed by a straight line through log n_r over log r (copied documents make
    some counts too frequent), with slope b; then r* = r (1 + 1/r)^(b + 1), and Katz's rescaling keeps
    counts above k whole.  For b below -1 every discount lies in 0..1; otherwise, or with fewer than
    two n_r to fit, nothing is discounted.
    """

    def __init__(self, of_count: list[int], k: int = DISCOUNTED):
        self.k = k
        self.d = np.ones(k + 1)
        n = np.array(of_count[: k + 1], dtype=float)
        r = np.arange(1, len(n) + 1)
        if (n > 0).sum() < 2:
            return
        slope = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)[0]
        if slope < -1:
            r = np.arange(1, k + 1)
            tail = (k + 1.0) ** (slope + 1)
            self.d[1:] = ((1 + 1 / r) ** (slope + 1) - tail) / (1 - tail)

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Counts after discounting."""
        return counts * np.where(counts <= self.k, self.d[np.minimum(counts, self.k)], 1.0)


class Unigram:
    """Discounted word probabilities; what is left belongs to all words that training lacks."""

    def __init__(self, total: int, of_count: list[int]):
        self.discounts = Discounts(of_count)
        lost = sum(r * n * (1 - self.discounts.d[r]) for r, n in enumerate(of_count[:DISCOUNTED], 1))
        self.total = total if lost > 0 else total + 1
        self.unknown = (lost if lost > 0 else 1.0) / self.total

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.kept(counts) / self.total, self.unknown)


def backoff(count: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, weight) of each context from its count, the discounted counts of its seen pairs
    and the lower-order probabilities of their words.

    The weight gives the unseen words exactly what the seen ones leave.  A context whose counts are
    not discounted gets one more in its denominator, so that something is left.
    """
    whole = count - kept < 1e-9
    below = np.where(whole, count + 1.0, count)
    left = np.where(count > 0, 1.0 - kept / np.maximum(below, 1.0), 1.0)
    return below, left / np.maximum(1.0 - lower, 1e-300)


class Chunk:
    """Distinct words and word pairs of a chunk of documents, by hash, with training counts."""

    def __init__(self, ids: np.ndarray, vocab: np.ndarray, tokens: np.ndarray, counts: np.ndarray):
        self.ids, self.vocab, self.tokens, self.counts = ids, vocab, tokens, counts
        self.out = np.array([held_out(None if i == B.NO_ID else int(i)) for i in ids], dtype=bool)
        self.learn = ~np.repeat(self.out, counts)
        begin = np.cumsum(counts) - counts
        size = len(vocab)
        self.context = np.empty(len(tokens), dtype=np.int64)
        self.context[1:] = tokens[:-1]
        self.context[begin] = size  # a text's start
        codes, self.pair = np.unique(self.context * (size + 1) + tokens, return_inverse=True)
        left = np.append(vocab, START)[codes // (size + 1)]
        hashes = B.mix64(left * B.GOLD + B.mix64(vocab[codes % (size + 1)])) >> CUT
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.pair, self.hashes = place[self.pair], hashes[order]
        self.left, self.right = (codes // (size + 1))[order], (codes % (size + 1))[order]
        self.word_counts = np.bincount(tokens[self.learn], minlength=size)
        self.pair_counts = np.bincount(self.pair[self.learn], minlength=len(codes))

    @staticmethod
    def of(ids: np.ndarray, texts: list[bytes]) -> Chunk:
        words, counts = B.word_hashes([t.lower() for t in texts])
        ends = np.cumsum(counts + 1) - 1
        tokens = np.empty(len(words) + len(texts), dtype=np.uint64)
        is_end = np.zeros(len(tokens), dtype=bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = END, words
        vocab, local = np.unique(tokens, return_inverse=True)
        return Chunk(ids, vocab, local, counts + 1)

    def body(self) -> bytes:
        return B.pack(self.ids, self.counts, B.differences(self.vocab), self.tokens.astype(np.uint32))

    @staticmethod
    def read(body: bytes) -> Chunk:
        ids, counts, vocab, tokens = B.unpack(body, np.int64, np.int64, np.uint64, np.uint32)
        return Chunk(ids, np.cumsum(vocab, dtype=np.uint64), tokens.astype(np.int64), counts)


def _spans(hashes: np.ndarray, blocks: int, cut: int = 0):
    """(block, from, to) of the blocks that a chunk's sorted hashes fall into."""
    at = B.split(hashes, blocks) if not cut else np.append(
        np.searchsorted(hashes, np.array([((i << 64) // blocks) >> cut for i in range(blocks)], dtype=np.uint64)),
        len(hashes),
    )
    return [(int(b), int(at[b]), int(at[b + 1])) for b in np.nonzero(np.diff(at))[0]]


def _packets(chunk: int, kind: int, spans, hashes: np.ndarray, *values: np.ndarray):
    return B.rows([b for b, *_ in spans], kind, chunk, [
        B.pack(B.differences(hashes[i:j]), *(v[i:j] for v in values)) for _, i, j in spans
    ])


def _merge(packets: pa.Table, *kinds):
    """Keys of all packets together: group numbers, and the values side by side."""
    parts = [B.unpack(b, np.uint64, *kinds) for b in packets.column("body").to_pylist()]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    distinct, group = np.unique(keys, return_inverse=True)
    values = [np.concatenate([p[i + 1] for p in parts]) for i in range(len(kinds))]
    return group, len(distinct), values, np.cumsum([len(p[0]) for p in parts])[:-1]


def _of_count(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()


def score_texts(df: DataFrame, chunk_bytes: int = B.CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Training documents are those whose id does not fall into the held-out fold.  Chunks of documents
    send their distinct words and pairs with training counts to blocks of the hash space, which are
    the partitioned count tables; the answers are the counts over all documents.  A second exchange
    sums, for each context, what its seen pairs keep and their words' lower-order probabilities, and
    answers with its backoff weight.  Then every token is scored: its discounted pair count, else the
    context's weight times the word's own probability, that of the unknown words if training lacks it.

    Null and empty texts are a single end token.  A null id counts as an empty string.  Repeated rows
    count as often as they stand and are scored each.  Without training tokens every word is unknown.
    """
    blocks = max(1, ceil(total_bytes(df) / chunk_bytes))

    def start(batches):
        for chunk, ids, texts in B.gather(batches, chunk_bytes):
            c = Chunk.of(ids, texts)
            yield B.rows([chunk], B.STATE, chunk, [c.body()])
            yield _packets(chunk, WORDS, _spans(c.vocab, blocks), c.vocab, c.word_counts.astype(np.uint32))
            yield _packets(chunk, PAIRS, _spans(c.hashes, blocks, int(CUT)), c.hashes, c.pair_counts.astype(np.uint32))

    def figures(key: int, kind: int, values: list[int]) -> pa.RecordBatch:
        return B.rows([kind], FIGURES, -1 - key, [B.pack(np.array(values, dtype=np.int64))])

    def count_words(packets: pa.Table) -> list[pa.RecordBatch]:
        key = packets.column("key")[0].as_py()
        group, n, (counts,), cuts = _merge(packets, np.uint32)
        total = np.bincount(group, counts, n).astype(np.int64)
        out = [B.pack(x.astype(np.uint32)) for x in np.split(total[group], cuts)]
        return [
            B.rows([key] * len(out), WORD_COUNTS, packets.column("chunk").to_pylist(), out),
            figures(key, WORDS, [int(total.sum()), int((total > 0).sum()), *_of_count(total)]),
        ]

    def count_pairs(packets: pa.Table) -> list[pa.RecordBatch]:
        key = packets.column("key")[0].as_py()
        group, n, (counts,), cuts = _merge(packets, np.uint32)
        total = np.bincount(group, counts, n).astype(np.int64)
        # The first chunk that has a pair owns it: what a pair adds to its context is added once.
        _, first = np.unique(group, return_index=True)
        owner = np.zeros(len(group), dtype=bool)
        owner[first] = True
        out = [
            B.pack(t.astype(np.uint32), np.packbits(o))
            for t, o in zip(np.split(total[group], cuts), np.split(owner, cuts))
        ]
        return [
            B.rows([key] * len(out), PAIR_COUNTS, packets.column("chunk").to_pylist(), out),
            figures(key, PAIRS, [int(total.sum()), int((total > 0).sum()), *_of_count(total)]),
        ]

    def model(state: pa.Table, answers: pa.Table):
        """A chunk with the counts over all documents and the model's figures."""
        B.one_state(state, answers)
        c = Chunk.read(state.column("body")[0].as_py())
        told_words, told_pairs = B.bodies(answers, WORD_COUNTS), B.bodies(answers, PAIR_COUNTS)
        words = np.zeros(len(c.vocab), dtype=np.int64)
        for b, i, j in _spans(c.vocab, blocks):
            words[i:j] = B.unpack(told_words[b], np.uint32)[0]
        pairs, owner = np.zeros(len(c.hashes), dtype=np.int64), np.zeros(len(c.hashes), dtype=bool)
        for b, i, j in _spans(c.hashes, blocks, int(CUT)):
            counts, bits = B.unpack(told_pairs[b], np.uint32, np.uint8)
            pairs[i:j], owner[i:j] = counts, np.unpackbits(bits, count=j - i)
        word_figures = state.column("word_figures")[0].as_py()
        pair_figures = state.column("pair_figures")[0].as_py()
        unigram = Unigram(word_figures[0], word_figures[2:])
        return c, words, pairs, owner, word_figures, unigram, Discounts(pair_figures[2:])

    def contexts(c: Chunk):
        """Hashes of a chunk's contexts in order, and the place of each local context there."""
        hashes = np.append(c.vocab, START)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return hashes[order], place

    def ask(state: pa.Table, answers: pa.Table) -> pa.Table:
        c, words, pairs, owner, _, unigram, discounts = model(state, answers)
        hashes, place = contexts(c)
        mine = owner & (pairs > 0)
        at = place[c.left[mine]]
        kept = np.bincount(at, discounts.kept(pairs[mine]), len(hashes))
        lower = np.bincount(at, unigram.probability(words[c.right[mine]]), len(hashes))
        count = np.bincount(place[c.left], c.pair_counts, len(hashes)).astype(np.uint32)
        return B.table([_packets(
            state.column("key")[0].as_py(), CONTEXTS, _spans(hashes, blocks), hashes, count, kept, lower
        )])

    def weigh(packets: pa.Table) -> list[pa.RecordBatch]:
        key = packets.column("key")[0].as_py()
        group, n, (count, kept, lower), cuts = _merge(packets, np.uint32, np.float64, np.float64)
        below, weight = backoff(*(np.bincount(group, x, n) for x in (count, kept, lower)))
        out = [
            B.pack(b.astype(np.uint64), w)
            for b, w in zip(np.split(below[group], cuts), np.split(weight[group], cuts))
        ]
        return [B.rows([key] * len(out), BACKOFFS, packets.column("chunk").to_pylist(), out)]

    def finish(state: pa.Table, answers: pa.Table) -> pa.Table:
        c, words, pairs, _, (total, kinds, *_), unigram, discounts = model(state, answers)
        hashes, place = contexts(c)
        told = B.bodies(answers, BACKOFFS)
        below, weight = np.ones(len(hashes)), np.ones(len(hashes))
        for b, i, j in _spans(hashes, blocks):
            below[i:j], weight[i:j] = B.unpack(told[b], np.uint64, np.float64)
        at = place[c.left]
        lower = unigram.probability(words)
        log = np.log10(np.where(
            pairs > 0, discounts.kept(pairs) / below[at], weight[at] * lower[c.right]
        ))
        base = np.log10((words + 0.5) / (total + 0.5 * (kinds + 1)))
        begin = np.cumsum(c.counts) - c.counts
        known = (words > 0)[c.tokens].astype(np.int64)
        n = len(c.ids)
        return pa.table({
            "doc_id": pa.array(c.ids, pa.int64(), mask=c.ids == B.NO_ID), "held_out": pa.array(c.out),
            "n_tokens": pa.array(c.counts, pa.int64()), "n_known": pa.array(np.add.reduceat(known, begin), pa.int64()),
            "train_tokens": pa.array(np.full(n, total), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base[c.tokens], begin)),
            "score": pa.array(np.add.reduceat(log[c.pair], begin)),
        })

    states = B.dealt(df, start)
    counted = B.answer(states, WORDS, count_words).unionByName(B.answer(states, PAIRS, count_pairs))
    counted = B.spread(counted, "chunk")
    totals = _totals(counted)
    known = states.withColumns({
        "word_figures": totals(WORDS), "pair_figures": totals(PAIRS),
    })
    answers = counted.filter(F.col("kind") != FIGURES)
    asked = B.spread(B.with_answers(known, answers, ask, B.ROW), "key")
    weights = B.answer(asked, CONTEXTS, weigh)
    return B.with_answers(
        known, answers.unionByName(weights), finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _totals(counted: DataFrame):
    """Sums of the blocks' figures, a row for words and one for pairs, as scalar subqueries."""

    def numbers(batches):
        for batch in batches:
            kinds = batch.column("key")
            values = [B.unpack(b, np.int64)[0].tolist() for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([kinds, pa.array(values, pa.list_(pa.int64()))], ["kind", "figures"])

    rows = counted.filter(F.col("kind") == FIGURES).select("key", "body")
    rows = rows.mapInArrow(numbers, "kind long, figures array<long>")
    width = DISCOUNTED + 3

    def of(kind: int):
        sums = [F.coalesce(F.sum(F.get("figures", F.lit(i))), F.lit(0)) for i in range(width)]
        return rows.filter(F.col("kind") == kind).agg(F.array(*sums).alias("figures")).scalar()

    return of
