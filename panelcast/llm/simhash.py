"""SimHash near duplicates: fingerprints embedded as segment bit counts, grid join, exact check."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import settle, text_bytes
from panelcast.llm.graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BITS = 64


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(shingle), SEED)
            for shingle in zip(*(words[i:] for i in range(width)))
        ]
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[start : start + (1 << 15)], dtype="<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) of every row, with long columns to carry along; null and wordless texts have the
    fingerprint 0."""
    held = ["doc_id", *carry]

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in held), pa.array(fps, pa.int64())], [*held, "fp"]
            )

    source = df.select(F.col("doc_id").cast("long"), *carry, text_bytes().alias("body"))
    return source.mapInArrow(run, ", ".join(f"{c} long" for c in [*held, "fp"]))


def segments_for(nodes: int, per_node: int = 128) -> int:
    """Smallest number of segments at which a fingerprint meets at most ``per_node`` chance
    candidates, if bits are even coin flips.  Any number gives the same links; more segments mean
    more probes and fewer candidates."""
    for count in (8, 16):
        width = BITS // count
        counts = np.array([1.0])
        for _ in range(width):
            counts = np.convolve(counts, [0.5, 0.5])
        gaps = np.convolve(counts, counts[::-1])
        at = [gaps[width], 2 * gaps[width + 1], 2 * gaps[width + 2]]
        near = at[0] ** count + count * (at[1] + at[2]) * at[0] ** (count - 1)
        near += count * (count - 1) / 2 * at[1] ** 2 * at[0] ** (count - 2)
        if nodes * near <= per_node:
            break
    return count


def cell(fp: Column, segments: int) -> Column:
    """The segments' bit counts as digits of one number."""
    width = BITS // segments
    mask = (1 << width) - 1
    digits = [
        F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask).cast("long")))
        * F.lit((width + 1) ** i).cast("long")
        for i in range(segments)
    ]
    total = digits[0].cast("long")
    for digit in digits[1:]:
        total = total + digit
    return total


def offsets(segments: int, radius: int = MAX_BITS) -> list[int]:
    """Differences of cells within Manhattan distance 2, one of each pair of opposite signs."""
    if radius != 2:
        raise ValueError("the probes are written for two bits")
    base = BITS // segments + 1
    steps = [base**i for i in range(segments)]
    found = [0, *steps, *(2 * s for s in steps)]
    for low, high in combinations(steps, 2):
        found += [high + low, high - low]
    return found


def links(nodes: DataFrame, segments: int) -> DataFrame:
    """Pairs (u, v) of different fingerprints that differ in at most two bits, each once.

    The Manhattan distance of two bit-count vectors never exceeds the fingerprints' Hamming
    distance, so every link lies within two steps of the grid.  One side takes the cells around it,
    the other its own; digits stay below half the base, so no difference is reached twice.
    """
    held = nodes.select(F.col("fp").alias("v"), cell(F.col("fp"), segments).alias("cell"))
    steps = F.array(*(F.lit(x).cast("long") for x in offsets(segments)))
    probes = nodes.select(
        F.col("fp").alias("u"), cell(F.col("fp"), segments).alias("home"), F.explode(steps).alias("step")
    ).select("u", (F.col("home") + F.col("step")).alias("cell"), (F.col("step") == 0).alias("own"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS
    once = ~F.col("own") | (F.col("u") < F.col("v"))
    return probes.join(held, (probes["cell"] == held["cell"]) & near & once).select("u", "v")


def _groups(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of each fingerprint of rows (doc_id, fp): the smallest doc_id reachable over
    links of at most MAX_BITS bits, null only if the group has no id; and root, the group itself."""
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(nodes, segments_for(nodes.count())))
    roots = linked.join(nodes, linked["id"] == nodes["fp"]).select("fp", "root", "first_id")
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("least_id"))
    moved = roots.join(smallest, "root").select("fp", "root", "least_id")
    return nodes.join(moved, "fp", "left").select(
        "fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(df: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id
    reachable over links of at most two differing bits.

    Rows with equal fingerprints are one node, whatever their number, so a group of copies costs one
    probe set and no pairs among itself.  Null texts count as empty; wordless texts share the
    fingerprint zero and link like any other.  Repeated rows come back repeated.  A null doc_id keeps
    its row and takes its group's id; the id is null only if the group has no other.  Texts of any
    length are hashed whole.  An empty table gives an empty one.
    """
    rows = settle(fingerprints(df))
    return rows.join(_groups(rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def distinct_documents(df: DataFrame) -> DataFrame:
    """The rows of df that stay when one of each group of near duplicates does: the one with the
    smallest doc_id, a row without an id only if no other row of its group has one.

    Rows are told apart by their place in a written table, not by their id, so different texts under
    one id, or without an id, all stay.  All wordless texts (null, empty, blanks) have the fingerprint
    zero and are one group.  All columns of df come back as they were, whatever their names; an empty
    table gives an empty one.
    """
    packed = settle(df.select(
        F.struct(*df.columns).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.monotonically_increasing_id().alias("place"),
    ))
    rows = settle(fingerprints(packed.select("doc_id", "text", "place"), ["place"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    # First within a fingerprint, with map-side combine, so a hot one is a row when groups meet.
    by_fp = rows.groupBy("fp").agg(first.alias("first"))
    roots = _groups(rows).select("fp", "root")
    keep = by_fp.join(roots, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.place")
    return packed.join(keep, "place", "left_semi").select("_doc.*")
