"""Near-duplicate vectors by counting collisions on sorted one-dimensional projections."""

from __future__ import annotations

from math import ceil, comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from panelcast.llm.common import settle
from panelcast.llm.graph import components

COSINE = 0.95
PROJECTIONS = 24
#: Half widths of windows in standard deviations of a boundary pair's difference: of the sorted
#: projections (two decide which slabs meet, a third which rows), and of all those that are counted.
LEAD_SPREAD = 3.3
WINDOW_SPREAD = 1.5
#: Share of boundary pairs that the required count may miss.
MISS = 0.0005
SLAB = 2048
SEED = 7


def directions(dims: int, number: int = PROJECTIONS) -> np.ndarray:
    """Normal directions, drawn component by component: shorter vectors see the same first ones."""
    return np.stack([np.random.default_rng([SEED, i]).standard_normal(number) for i in range(dims)])


def calibrate(number: int = PROJECTIONS, spread: float = WINDOW_SPREAD, miss: float = MISS) -> int:
    """Largest count that all but ``miss`` of the pairs at the similarity bound reach.

    The difference of two unit vectors at the bound projects to a normal variable, so a window of
    ``spread`` deviations catches it with a known chance, independently on every projection."""
    p = erf(spread / sqrt(2))
    below, need = 0.0, 0
    while True:
        below += comb(number, need) * p**need * (1 - p) ** (number - need)
        if below > miss:
            return need
        need += 1


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in double precision, padded with zeros; their unit forms and lengths."""
    sizes = np.array([len(v) for v in vectors], dtype=np.int64)
    x = np.zeros((len(vectors), int(sizes.max()) if len(sizes) else 0))
    for size in np.unique(sizes):
        rows = np.nonzero(sizes == size)[0]
        x[rows, :size] = np.array([vectors[i] for i in rows], dtype=np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1.0)
    return x / np.sqrt((x * x).sum(1, keepdims=True)), x, sizes


class Slabs:
    """Slabs of about SLAB vectors: strips of the first sorted projection, cut on the second."""

    def __init__(self, strips: list[float], cuts: dict[int, list[float]], half: float):
        self.strips, self.half = np.array(strips), half
        self.cuts = [np.array(cuts.get(i, [])) for i in range(len(strips) + 1)]
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])])
        low = np.concatenate([[-np.inf], self.strips])
        high = np.concatenate([self.strips, [np.inf]])
        self.box = np.array([
            (low[i], high[i], a, b)
            for i, c in enumerate(self.cuts)
            for a, b in zip(np.concatenate([[-np.inf], c]), np.concatenate([c, [np.inf]]))
        ])

    def of(self, p0: np.ndarray, p1: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.strips, p0, side="left")
        out = np.zeros(len(p0), dtype=np.int64)
        for i in np.unique(strip):
            rows = strip == i
            out[rows] = self.first[i] + np.searchsorted(self.cuts[i], p1[rows], side="left")
        return out

    def near(self, slab: int) -> np.ndarray:
        """Slabs within reach of a slab's box on both projections, itself included."""
        a, b, c, d = self.box[slab]
        other, h = self.box, self.half
        return np.nonzero(
            (other[:, 0] - b <= h) & (a - other[:, 1] <= h) & (other[:, 2] - d <= h) & (c - other[:, 3] <= h)
        )[0]


def _local_roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each place reaches over the pairs (a, b)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def linked(classes: DataFrame, cosine: float = COSINE, slab_rows: int = SLAB) -> DataFrame:
    """(u, v, links): for each class and each pair of slabs in which it is linked, a class v of the
    same component (at most u) and the number of vectors linked to it there.

    ``classes`` has id, n (vectors that are equal to it) and embedding.  A slab meets those that its
    windows on the two sorted projections reach; each pair of slabs is one bounded task.  There the
    collisions of every pair are counted over all projections, and pairs that reach the calibrated
    count are verified in double precision.  A pair of classes meets in exactly one task.
    """
    deviation = sqrt(2 - 2 * cosine)
    half, lead, need = WINDOW_SPREAD * deviation, LEAD_SPREAD * deviation, calibrate()

    def project(batches):
        for batch in batches:
            x, _, sizes = unit(batch.column("embedding").to_pylist())
            p = x @ directions(x.shape[1])[:, :2]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p[:, 0]), pa.array(p[:, 1])], [*batch.schema.names, "p0", "p1"]
            )

    schema = StructType([*classes.schema.fields]).add("p0", "double").add("p1", "double")
    spots = settle(classes.mapInArrow(project, schema))
    count = spots.count()
    side = max(1, ceil(sqrt(count / slab_rows)))
    shares = [i / side for i in range(1, side)]
    strips = sorted(set(spots.approxQuantile("p0", shares, 0.002))) if shares and count else []
    cuts: dict[int, list[float]] = {}
    if shares and count:
        # The bounds of the slabs, a few numbers for each.
        strip = sum((F.col("p0") > s).cast("int") for s in strips)
        for r in spots.groupBy(strip.alias("strip")).agg(F.percentile_approx("p1", shares, 2000).alias("at")).collect():
            cuts[r.strip] = sorted(set(r["at"]))
    slabs = Slabs(strips, cuts, lead)

    def deal(batches):
        reach: dict[int, np.ndarray] = {}
        for batch in batches:
            slab = slabs.of(batch.column("p0").to_numpy(), batch.column("p1").to_numpy())
            for s in np.unique(slab).tolist():
                rows = pa.array(np.nonzero(slab == s)[0])
                part = batch.take(rows)
                if s not in reach:
                    reach[s] = slabs.near(s)
                for t in reach[s].tolist():
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([min(s, t)] * n, pa.int64()), pa.array([max(s, t)] * n, pa.int64()),
                            pa.array([s] * n, pa.int64()), part.column("id"), part.column("n"), part.column("embedding"),
                        ],
                        ["low", "high", "slab", "id", "n", "embedding"],
                    )

    def match(key, group):
        low, high = key[0].as_py(), key[1].as_py()
        slab, ids = group.column("slab").to_numpy(), group.column("id").to_numpy()
        weight = group.column("n").to_numpy()
        x, raw, sizes = unit(group.column("embedding").to_pylist())
        p = (x @ directions(x.shape[1])).astype(np.float32)
        norm = np.sqrt((raw * raw).sum(1))
        # Both sides stand in the order of a third projection: a block of queries only meets the rows
        # in the window around it.
        by = np.argsort(p[:, 2], kind="stable")
        left, all_right = by[slab[by] == low], by[slab[by] == high]
        along = p[all_right, 2]
        links, pairs = np.zeros(len(ids), dtype=np.int64), []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            first, last = p[rows[0], 2] - lead - 1e-5, p[rows[-1], 2] + lead + 1e-5
            right = all_right[np.searchsorted(along, first) : np.searchsorted(along, last, side="right")]
            hits = np.zeros((len(rows), len(right)), dtype=np.uint8)
            for j in range(p.shape[1]):
                hits += np.abs(p[rows, j][:, None] - p[right, j][None, :]) <= half + 1e-5
            a, b = np.nonzero(hits >= need)
            a, b = rows[a], right[b]
            keep = (a < b if low == high else a >= 0) & (sizes[a] == sizes[b])  # each pair once
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 1 << 16):
                i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                near = (raw[i] * raw[j]).sum(1) / (norm[i] * norm[j]) >= cosine
                i, j = i[near], j[near]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                roots = _local_roots(i, j, np.arange(len(ids)))
                moved = np.nonzero(roots != np.arange(len(ids)))[0]
                pairs.append((moved, roots[moved]))
        some = np.nonzero(links)[0]
        i = np.concatenate([q[0] for q in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        j = np.concatenate([q[1] for q in pairs]) if pairs else np.zeros(0, dtype=np.int64)
        roots = _local_roots(i, j, ids) if len(i) else ids
        return pa.table({
            "u": pa.array(ids[some], pa.int64()), "v": pa.array(roots[some], pa.int64()),
            "links": pa.array(links[some], pa.int64()),
        })

    dealt = spots.select("id", "n", "embedding", "p0", "p1").mapInArrow(
        deal, "low long, high long, slab long, id long, n long, embedding array<double>"
    )
    return dealt.groupBy("low", "high").applyInArrow(match, "u long, v long, links long")


def near_duplicates(df: DataFrame, cosine: float = COSINE, slab_rows: int = SLAB) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one class, compared once, however many there are.  Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, and neither does a row
    without vec_id, which gets no component and is not kept; vectors of different length never link.
    Repeated rows are equal vectors like any others.
    """
    e = F.col("embedding").cast("array<double>")
    finite = ~F.exists(e, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    sound = F.col("vec_id").isNotNull() & finite & F.exists(e, lambda c: c != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    good = rows.filter("sound")
    classes = settle(good.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
    ))
    # Classes that only differ in vec_id order share no id, unless a vec_id is repeated: then the
    # smallest id stands for both.
    found = settle(linked(classes.select("id", "n", "embedding"), cosine, slab_rows))
    roots = components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links"))
    about = (
        classes.select("h1", "h2", "id", "n")
        .join(links, F.col("id") == F.col("u"), "left").drop("u")
        .join(roots.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
        .select(
            "h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        )
    )
    ok = good.select("vec_id", "h1", "h2").join(about, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return ok.unionByName(rest).withColumn("kept", kept)
