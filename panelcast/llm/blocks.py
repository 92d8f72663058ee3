"""Chunks of documents that ask blocks of a hash space about their windows or n-grams.

Counting every window of a corpus by shuffling rows would move many times its size.  Here a task
gathers documents into chunks of some MB, hashes all of a chunk's items in numpy, and sends each
block of the hash space one packet: the chunk's hashes there, sorted, as differences.  A block joins
the packets of all chunks and answers each in the packet's order, so an answer needs no keys and a
few bits an item.  Chunks and blocks are bounded by CHUNK_BYTES of text, their number follows the
input, and everything moves by Spark's own shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import text_bytes

CHUNK_BYTES = 8 << 20
ROW = "key long, kind int, chunk long, body binary"
STATE = 0
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
NO_ID = np.iinfo(np.int64).max

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i below a power of two that holds ``size``."""
    room = 1 << max(16, (size - 1).bit_length())
    if room not in _powers:
        _powers.clear()
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.ones(room, dtype=np.uint64)
            have = 1
            while have < room:
                table[have : 2 * have] = table[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            out.append(table)
        _powers[room] = (out[0], out[1])
    return _powers[room]


def word_hashes(texts: list[bytes], slice_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, in order, and the number of words of each text."""
    hashes, counts, at = [], np.zeros(len(texts), dtype=np.int64), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < slice_bytes):
            size += len(texts[stop]) + 1
            stop += 1
        raw = np.frombuffer(b" " + b" ".join(texts[at:stop]) + b" ", dtype=np.uint8)
        word = ~_WHITE[raw]
        edge = np.diff(word.view(np.int8))
        starts, ends = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
        power, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        value = (total[ends] - total[starts]) * inverse[starts]
        hashes.append(mix64(value + (ends - starts).astype(np.uint64) * GOLD))
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts[at:stop]])
        counts[at:stop] = np.diff(np.searchsorted(starts, bounds))
        at = stop
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def squeeze(values: np.ndarray) -> bytes:
    """Numbers of a fixed width, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Several squeezed arrays in one body."""
    parts = [a if isinstance(a, bytes) else squeeze(a) for a in arrays]
    head = np.array([len(p) for p in parts], dtype="<i8").tobytes()
    return bytes([len(parts)]) + head + b"".join(parts)


def unpack(body: bytes, *kinds) -> list:
    """What ``pack`` put in; the kind None returns the bytes as they were given."""
    n = body[0]
    sizes = np.frombuffer(body, dtype="<i8", count=n, offset=1)
    ends = 1 + 8 * n + np.cumsum(sizes)
    return [
        body[end - size : end] if kind is None else unsqueeze(body[end - size : end], kind)
        for end, size, kind in zip(ends.tolist(), sizes.tolist(), kinds)
    ]


def differences(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def gather(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES):
    """(chunk id, doc ids, texts) from a task's rows.  The id comes from the task's place and the
    chunk's content, so a task that runs again gives the same ids, or, if its input came in another
    order, ids that no old answer fits."""
    place = TaskContext.get().partitionId() if TaskContext.get() else 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = number = 0

    def chunk():
        digest = xxhash.xxh3_64(f"{place}:{number}:{ids[:1]}:{len(ids)}".encode())
        for t in texts:
            digest.update(t)
        return digest.intdigest() >> 1, np.array(ids, dtype=np.int64), texts

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(NO_ID if doc_id is None else doc_id)
            texts.append(text)
            size += len(text) + 16
            if size >= limit:
                yield chunk()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield chunk()


def rows(keys, kind: int, chunk, bodies: list[bytes]) -> pa.RecordBatch:
    n = len(bodies)
    chunk = [chunk] * n if np.isscalar(chunk) else chunk
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(chunk, pa.int64()), pa.array(bodies, pa.binary())],
        ["key", "kind", "chunk", "body"],
    )


def table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches or [rows([], 0, [], [])])


def split(sorted_hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block's hashes start: blocks are equal ranges of the 64-bit hash space."""
    edges = np.array([(i << 64) // blocks for i in range(blocks)], dtype=np.uint64)
    return np.append(np.searchsorted(sorted_hashes, edges), len(sorted_hashes))


def dealt(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Chunk states and packets of all documents, each dealt by its key.  Spark filters before it
    shuffles, so states and each kind of packets are shuffled once; the states' shuffle is used again
    by the later steps of the same plan."""
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return spread(source.mapInArrow(make, ROW), "key")


def spread(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def answer(packets: DataFrame, kind: int, merge: Callable[[pa.Table], list[pa.RecordBatch]]) -> DataFrame:
    """Run a block's merge over its packets."""
    return packets.filter(F.col("kind") == kind).groupBy("key").applyInArrow(
        lambda t: table(merge(t.sort_by("chunk"))), ROW
    )


def with_answers(
    states: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Run a chunk's next step over its state and the answers to its packets."""
    state = states.filter(F.col("kind") == STATE)
    return state.groupBy("key").cogroup(answers.groupBy("chunk")).applyInArrow(use, schema)


def one_state(state: pa.Table, answers: pa.Table) -> bool:
    """Whether the group is a chunk.  Answers without their chunk, or two chunks of one id, mean that
    a lost task came back with other rows; the job must not go on with them."""
    if state.num_rows != 1:
        raise RuntimeError("documents changed between two runs of a task; write them to a table first")
    return True


def bodies(answers: pa.Table, kind: int) -> dict[int, bytes]:
    """Answers of a kind by block."""
    return {
        k: b for k, c, b in zip(answers.column("key").to_pylist(), answers.column("kind").to_pylist(), answers.column("body").to_pylist())
        if c == kind
    }
