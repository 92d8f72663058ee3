"""Shards of nearly equal bytes by histogram sort: counted probes, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.llm.common import keep_others, settle

SHARDS = 40
#: Candidate boundaries of an interval in one round.
PROBES = 256
#: How far a boundary may be from its place, as a share of a shard.
TOLERANCE = 0.001
#: Bytes that one task should sort, and pieces that a shard is cut into for it at most.
PIECE_BYTES = 64 << 20
MAX_PIECES = 25
ROW_BYTES = 16
#: A row's sort key is four numbers: the halves of its key, a hash of its text, and its place in the
#: written table, so that even a key or a row that fills a third of the table can be cut anywhere.
DIGITS = ("d0", "d1", "d2", "d3")
LOWEST = (None, 0, 0, 0)


@dataclass(frozen=True)
class Probe:
    """Rows whose first digits are ``prefix`` and whose next one is in low..high, inclusive;
    ``below`` bytes lie in front of them."""

    prefix: tuple[int, ...]
    low: int
    high: int
    below: int

    @property
    def step(self) -> int:
        return max(1, ceil((self.high - self.low + 1) / PROBES))

    def holds(self) -> str:
        same = [f"{d} = {v}L" for d, v in zip(DIGITS, self.prefix)]
        return " AND ".join([*same, f"{DIGITS[len(self.prefix)]} BETWEEN {self.low}L AND {self.high}L"])

    def bin(self) -> str:
        return f"({DIGITS[len(self.prefix)]} - {self.low}L) DIV {self.step}L"


def cases(branches: list[tuple[str, object]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + " END"


def keyed(df: DataFrame, key: str, text: str, row_bytes: int = ROW_BYTES) -> DataFrame:
    """The input as a struct with its digits and size, written once; rounds read only the numbers."""
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)).cast("long"))
    return settle(df.select(
        F.struct(*df.columns).alias("row"),
        F.shiftright(k, 32).alias("d0"),
        k.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("d1"),
        F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1).cast("long")).alias("d2"),
        F.monotonically_increasing_id().alias("d3"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long").alias("bytes"),
    ))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Boundaries between shards: a row belongs to the right of those that are not above its key.

    Each round sums the bytes in all probed bins of all open intervals in one aggregation, with
    map-side combine; the driver gets at most shards * PROBES sums.  An interval that holds one value
    goes on with the next digit.  A boundary is done when it is within the tolerance of its place, or
    when a single row is in the way, at that row's nearer side.
    """
    first = rows.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)),
        *(f(d) for d in DIGITS for f in (F.min, F.max)),
    ).first()
    total, ends = first[0], [(first[1 + 2 * i], first[2 + 2 * i]) for i in range(len(DIGITS))]
    if not total:
        return []
    slack = tolerance * total / shards
    done: dict[int, tuple[int, ...]] = {}
    open_ = {s: Probe((), *ends[0], 0) for s in range(1, shards)}
    while open_:
        probes = list(dict.fromkeys(replace(p, below=0) for p in open_.values()))
        # Expressions are built as text: one call for hundreds of nodes.
        which = cases([(p.holds(), i) for i, p in enumerate(probes)])
        at = cases([(p.holds(), p.bin()) for p in probes])
        value = cases([(p.holds(), DIGITS[len(p.prefix)]) for p in probes])
        sums = (
            rows.selectExpr("bytes", f"{which} AS probe", f"{at} AS bin", f"{value} AS value")
            .filter("probe is not null").groupBy("probe", "bin")
            .agg(
                F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                F.min("value").alias("low"), F.max("value").alias("high"),
            )
            .orderBy("probe", "bin").collect()
        )
        bins: dict[int, list] = {}
        for r in sums:
            bins.setdefault(r.probe, []).append(r)
        number = {p: i for i, p in enumerate(probes)}
        for s, probe in list(open_.items()):
            target, below = total * s / shards, probe.below
            for r in bins[number[replace(probe, below=0)]]:
                if below + r.bytes > target:
                    break
                below += r.bytes
            left, right = target - below, below + r.bytes - target
            depth = len(probe.prefix)
            single = r.low == r.high
            if min(left, right) <= slack or r.rows == 1:
                edge = r.low if left <= right else r.high + 1
                done[s] = (*probe.prefix, edge, *LOWEST[depth + 1 :])
                del open_[s]
            elif single:
                open_[s] = Probe((*probe.prefix, r.low), *ends[depth + 1], below)
            else:
                open_[s] = Probe(probe.prefix, r.low, r.high, below)
    return [done[s] for s in sorted(done)]


def shard_of(bounds: list[tuple[int, ...]], first: int = 0) -> str:
    """SQL text for the number of boundaries not above a row's key, by bisection."""
    if not bounds:
        return str(first)
    mid = len(bounds) // 2
    left, right = shard_of(bounds[:mid], first), shard_of(bounds[mid + 1 :], first + mid + 1)
    return f"CASE WHEN {_less(bounds[mid])} THEN {left} ELSE {right} END"


def _less(bound: tuple[int, ...]) -> str:
    """Whether a row's digits come before a boundary's; digits at their lowest decide nothing."""
    last = max(i for i, v in enumerate(bound) if i == 0 or v)
    out = f"{DIGITS[last]} < {bound[last]}L"
    for i in range(last - 1, -1, -1):
        out = f"({DIGITS[i]} < {bound[i]}L OR {DIGITS[i]} = {bound[i]}L AND {out})"
    return out


def shard_by_bytes(
    df: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
    tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """df with ``shard`` (0 to shards - 1) and ``slot`` (its place there, without gaps from 0).

    Shards are ranges of the sort key whose bytes (text in UTF-8 plus 16 a row) differ by the
    tolerance, or by a row's size where that is more.  A large shard is sorted in pieces, which are
    ranges of the key as well, found by the same probes; slots follow the key whatever the pieces.
    Null texts have no bytes, null keys come first, equal keys and repeated rows are cut like any
    others.  Input columns named shard or slot are replaced.
    """
    rows = keyed(df, key, text)
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    pieces = min(MAX_PIECES, max(1, ceil(total / (shards * piece_bytes))))
    bounds = splitters(rows, shards * pieces, tolerance / pieces if pieces > 1 else tolerance)
    cuts = bounds[pieces - 1 :: pieces]
    placed = rows.withColumns({
        "shard": F.expr(shard_of(cuts)).cast("int"), "piece": F.expr(shard_of(bounds)).cast("int"),
    })
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece")
    starts = counts.select("shard", "piece", (F.sum("rows").over(before) - F.col("rows")).alias("start"))
    order = Window.partitionBy("shard", "piece").orderBy(*DIGITS)
    ranked = placed.withColumn("place", F.row_number().over(order).cast("long") - 1)
    kept = keep_others(df, ["shard", "slot"])
    return ranked.join(starts, ["shard", "piece"]).select(
        *(F.col("row")[c].alias(c) for c in kept), "shard", (F.col("start") + F.col("place")).alias("slot")
    )
