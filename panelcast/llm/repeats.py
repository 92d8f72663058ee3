"""Removing passages that repeat across documents, with a count-min sketch as the prefilter."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from panelcast.llm import blocks as B
from panelcast.llm.common import total_bytes

WINDOW = 13
#: Rows of the sketch, and counters of a row for each byte of text (about four a window).
DEPTH = 2
COUNTERS_PER_BYTE = 0.7
SKETCH, SKETCHED, EXACT, DECIDED = 1, 2, 3, 4


def windows(texts: list[bytes], width: int = WINDOW):
    """First and second hash of every window of ``width`` words, the number of its document in
    ``texts``, its place there, and the words of each document."""
    words, counts = B.word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(words) - width + 1)
    first, second = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(width):
        part = words[i : i + n]
        first = first * np.uint64(0xD1342543DE82EF95) + part
        second = second * np.uint64(0xAF251AF3B0F025B5) + (part ^ B.GOLD)
    inside = doc[:n] == doc[width - 1 :][:n] if n else np.zeros(0, dtype=bool)
    at = np.nonzero(inside)[0]
    begin = np.cumsum(counts) - counts
    return B.mix64(first[at]), B.mix64(second[at]), doc[at], at - begin[doc[at]], counts


def cells(first: np.ndarray, second: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each window in each row of the sketch: a number below ``width``."""
    return [B.mix64(first + np.uint64(row) * second) % np.uint64(width) for row in range(DEPTH)]


class Plan:
    """Sizes that follow the input: blocks of the sketch and counters of each."""

    def __init__(self, text_bytes: int, chunk_bytes: int = B.CHUNK_BYTES):
        self.chunk_bytes = chunk_bytes
        self.blocks = max(1, ceil(text_bytes / chunk_bytes))
        self.block_width = max(64, ceil(chunk_bytes * COUNTERS_PER_BYTE))
        self.width = self.blocks * self.block_width

    def sketch_packets(self, first, second):
        """(block, order of the windows, starts) for each row of the sketch."""
        for row, cell in enumerate(cells(first, second, self.width)):
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            edges = np.arange(self.blocks, dtype=np.uint64) * np.uint64(self.block_width)
            yield row, order, cell, np.append(np.searchsorted(cell, edges), len(cell))


def remove_repeats(df: DataFrame, width: int = WINDOW, chunk_bytes: int = B.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, joined by blanks) of every row.

    A word goes if a window of ``width`` words that covers it also starts in a document with a
    smaller doc_id.  First pass: chunks add their windows to the counters of a count-min sketch whose
    width follows the input; a block of counters sums what all chunks sent and tells each chunk which
    of its windows have a count of two or more in every row.  Counters only overestimate, so no
    repeated window is lost.  Second pass: the windows left are grouped exactly, by 128 bits of hash,
    for the smallest doc_id, and each chunk learns whether that is smaller than its own.

    Null and empty texts have no words; texts shorter than a window lose none.  Null ids count as
    larger than any other.  Rows repeated under one id have no smaller one among them and stay.
    """
    plan = Plan(total_bytes(df), chunk_bytes)

    def start(batches):
        for chunk, ids, texts in B.gather(batches, chunk_bytes):
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            body = B.pack(ids, sizes, zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))
            yield B.rows([chunk], B.STATE, chunk, [body])
            first, second, *_ = windows(texts, width)
            for row, _, cell, at in plan.sketch_packets(first, second):
                full = np.nonzero(np.diff(at))[0]
                if len(full):
                    yield B.rows(
                        full * DEPTH + row, SKETCH, chunk,
                        [B.pack(B.differences((cell[at[b] : at[b + 1]] - np.uint64(b * plan.block_width)).astype(np.uint32))) for b in full],
                    )

    def count(packets: pa.Table) -> list[pa.RecordBatch]:
        key, total = packets.column("key")[0].as_py(), np.zeros(plan.block_width, dtype=np.uint8)
        sent = packets.column("body").to_pylist()
        for body in sent:
            cell = np.cumsum(B.unpack(body, np.uint32)[0], dtype=np.int64)
            again = cell[1:][cell[1:] == cell[:-1]]
            total[cell] = np.minimum(total[cell] + 1, 2)
            total[again] = 2
        out = []
        for body in sent:
            cell = np.cumsum(B.unpack(body, np.uint32)[0], dtype=np.int64)
            out.append(B.pack(np.packbits(total[cell] > 1)))
        return [B.rows([key] * len(sent), SKETCHED, packets.column("chunk").to_pylist(), out)]

    def read(state: pa.Table, answers: pa.Table):
        """Documents of a chunk and its windows that may be repeated, by distinct hash."""
        B.one_state(state, answers)
        ids, sizes, raw = B.unpack(state.column("body")[0].as_py(), np.int64, np.int64, None)
        whole, ends = zstandard.ZstdDecompressor().decompress(raw), np.cumsum(sizes)
        texts = [whole[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
        first, second, doc, place, counts = windows(texts, width)
        told = B.bodies(answers, SKETCHED)
        maybe = np.ones(len(first), dtype=bool)
        for row, order, _, at in plan.sketch_packets(first, second):
            for b in np.nonzero(np.diff(at))[0].tolist():
                n = int(at[b + 1] - at[b])
                bits = np.unpackbits(B.unpack(told[b * DEPTH + row], np.uint8)[0], count=n)
                maybe[order[at[b] : at[b + 1]]] &= bits.astype(bool)
        at = np.nonzero(maybe)[0]
        first, second, doc, place = first[at], second[at], doc[at], place[at]
        order = np.lexsort((ids[doc], second, first))
        first, second, doc, place = first[order], second[order], doc[order], place[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return ids, texts, counts, doc, place, new, first, second

    def ask(state: pa.Table, answers: pa.Table) -> pa.Table:
        ids, _, _, doc, _, new, first, second = read(state, answers)
        chunk = state.column("key")[0].as_py()
        first, second, low = first[new], second[new], ids[doc[new]]
        at = B.split(first, plan.blocks)
        full = np.nonzero(np.diff(at))[0]
        return B.table([B.rows(full, EXACT, chunk, [
            B.pack(B.differences(first[at[b] : at[b + 1]]), second[at[b] : at[b + 1]], low[at[b] : at[b + 1]]) for b in full
        ])] if len(full) else [])

    def decide(packets: pa.Table) -> list[pa.RecordBatch]:
        key, parts = packets.column("key")[0].as_py(), []
        for body in packets.column("body").to_pylist():
            d, second, low = B.unpack(body, np.uint64, np.uint64, np.int64)
            parts.append((np.cumsum(d, dtype=np.uint64), second, low))
        first, second, low = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((second, first))
        new = np.ones(len(first), dtype=bool)
        f, s = first[order], second[order]
        new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
        least = np.minimum.reduceat(low[order], np.nonzero(new)[0])
        earlier = np.zeros(len(first), dtype=bool)
        earlier[order] = least[np.cumsum(new) - 1] < low[order]
        ends = np.cumsum([len(p[0]) for p in parts])
        out = [B.pack(np.packbits(x)) for x in np.split(earlier, ends[:-1])]
        return [B.rows([key] * len(out), DECIDED, packets.column("chunk").to_pylist(), out)]

    def finish(state: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, counts, doc, place, new, first, _ = read(state, answers)
        told, distinct = B.bodies(answers, DECIDED), first[new]
        at = B.split(distinct, plan.blocks)
        earlier = np.zeros(len(distinct), dtype=bool)
        for b in np.nonzero(np.diff(at))[0].tolist():
            n = int(at[b + 1] - at[b])
            earlier[at[b] : at[b + 1]] = np.unpackbits(B.unpack(told[b], np.uint8)[0], count=n)
        group = np.cumsum(new) - 1
        low = ids[doc[new]][group] if len(group) else np.zeros(0, dtype=np.int64)
        gone = (earlier[group] | (ids[doc] > low)) if len(group) else np.zeros(0, dtype=bool)
        begin = np.cumsum(counts) - counts
        change = np.zeros(int(counts.sum()) + width + 1, dtype=np.int64)
        np.add.at(change, begin[doc[gone]] + place[gone], 1)
        np.add.at(change, begin[doc[gone]] + place[gone] + width, -1)
        covered = np.cumsum(change) > 0
        kept, removed = [], []
        for i, text in enumerate(texts):
            words = text.split()
            cut = covered[begin[i] : begin[i] + counts[i]]
            removed.append(int(cut.sum()))
            kept.append(b" ".join(w for w, c in zip(words, cut.tolist()) if not c) if cut.any() else b" ".join(words))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=ids == B.NO_ID), "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()),
        })

    states = B.dealt(df, start)
    sketched = B.spread(B.answer(states, SKETCH, count), "chunk")
    asked = B.spread(B.with_answers(states, sketched, ask, B.ROW), "key")
    decided = B.answer(asked, EXACT, decide)
    out = B.with_answers(
        states, sketched.unionByName(decided), finish,
        "doc_id long, n_words long, n_removed long, kept_text binary",
    )
    return out.selectExpr("doc_id", "n_words", "n_removed", "cast(kept_text as string) as kept_text")
