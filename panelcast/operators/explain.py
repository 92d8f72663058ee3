"""Attributions of predictions to features: linear exactly, trees by path-dependent Shapley values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from panelcast.operators.boosted import BoostedModel, saved_nodes
from panelcast.operators.shape import attach, drop_incomplete

# A pooled ensemble is bounded by its parameters, not by the data; checked before it is broadcast.
MAX_NODES = 1_000_000


def linear_contributions(
    model: DataFrame, df: DataFrame, keys: Sequence[str], xs: Sequence[str], ds: str = "ds"
) -> DataFrame:
    """``(keys..., ds, feature, phi)`` with phi = coef * (x - train mean of the series)."""
    rows = attach(df, model, keys, ["coef", "x_mean"])
    terms = F.array(
        *[
            F.struct(
                F.lit(x).alias("feature"),
                (F.col("coef")[i] * (F.col(x) - F.col("x_mean")[i])).alias("phi"),
            )
            for i, x in enumerate(xs)
        ]
    )
    return rows.select(*keys, ds, F.explode(terms).alias("_t")).select(*keys, ds, "_t.*")


@dataclass
class _Leaf:
    """Path to one leaf: per distinct feature its interval and the share of train rows kept."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _leaves(nodes: pd.DataFrame, weights: Sequence[float]) -> tuple[list[_Leaf], float]:
    out, base = [], 0.0
    for tree, table in nodes.groupby("treeID"):
        at = {node.id: node for node in table.itertuples()}
        weight = weights[tree]
        stack = [(0, {})]
        while stack:
            node_id, path = stack.pop()
            node = at[node_id]
            if node.leftChild < 0:
                feats = list(path)
                low, high, share = (np.array([path[f][i] for f in feats]) for i in range(3))
                out.append(_Leaf(weight * node.prediction, feats, low, high, share))
                base += weight * node.prediction * float(np.prod(share)) if feats else weight * node.prediction
                continue
            f, cut = int(node.feature), float(node.threshold)
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, lo, hi in (
                (int(node.leftChild), low, min(high, cut)),
                (int(node.rightChild), max(low, cut), high),
            ):
                kept = at[child].cover / node.cover
                stack.append((child, {**path, f: (lo, hi, share * kept)}))
    return out, base


def _subset_weights(d: int) -> np.ndarray:
    return np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])


def _path_parts(inside: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Attributions (rows, leaves, d) of the d features of each leaf's path.

    Coefficient k of the product of (share + inside * t) over a path's features sums the coalitions of
    k known features.  The product is extended feature by feature; what it is without a feature comes
    from unwinding that factor again, top coefficient first, which never divides by less than a share.
    """
    d = share.shape[1]
    by_size = _subset_weights(d)
    poly = np.zeros((d + 1, *inside.shape[:2]))
    poly[0] = 1.0
    for j in range(d):
        poly[1 : j + 2] = poly[1 : j + 2] * share[:, j] + poly[: j + 1] * inside[:, :, j]
        poly[0] *= share[:, j]
    absent = np.tensordot(by_size, poly[:d], 1)[:, :, None] / share
    rest = np.broadcast_to(poly[d][:, :, None], inside.shape)
    known = by_size[d - 1] * rest
    for k in range(d - 1, 0, -1):
        rest = poly[k][:, :, None] - share * rest
        known = known + by_size[k - 1] * rest
    return value[:, None] * (inside - share) * np.where(inside > 0, known, absent)


def shapley_values(x: np.ndarray, leaves: list[_Leaf], cells: int = 1 << 20) -> np.ndarray:
    """Shapley values of many rows at once.

    For a leaf with d distinct features on its path, the coalition game is a product of one factor
    per feature: 1 or 0 when the feature is known (row inside the interval or not), the kept share
    when it is not.  Leaves of equal d are taken together, some rows and some leaves at a time, so
    that no array holds more than ``cells`` numbers whatever the depth; time grows with d * d.
    """
    phi = np.zeros(x.shape)
    by_depth: dict[int, list[_Leaf]] = {}
    for leaf in leaves:
        by_depth.setdefault(len(leaf.features), []).append(leaf)
    by_depth.pop(0, None)
    for d, group in by_depth.items():
        some_leaves = max(1, min(len(group), 256, cells // (d + 1)))
        some_rows = max(1, min(len(x), cells // ((d + 1) * some_leaves)))
        for at in range(0, len(group), some_leaves):
            part = group[at : at + some_leaves]
            features = np.array([leaf.features for leaf in part])
            low, high, share = (np.stack([getattr(leaf, n) for leaf in part]) for n in ("low", "high", "share"))
            value = np.array([leaf.value for leaf in part])
            belongs = np.zeros((features.size, x.shape[1]))
            belongs[np.arange(features.size), features.reshape(-1)] = 1.0
            for row in range(0, len(x), some_rows):
                block = x[row : row + some_rows][:, features]
                inside = ((block > low) & (block <= high)).astype(float)
                parts = _path_parts(inside, share, value)
                phi[row : row + some_rows] += parts.reshape(len(parts), -1) @ belongs
    return phi


def tree_contributions(
    model: BoostedModel, df: DataFrame, ds: str = "ds"
) -> tuple[DataFrame, float]:
    """``(keys..., ds, feature, phi)`` in target units, and the base value on the scaled target.

    yhat = y_mean + y_sd * base + sum of phi, per series.
    """
    saved, weights = saved_nodes(model)
    flat = saved.select(
        "treeID",
        "nodeData.id",
        "nodeData.leftChild",
        "nodeData.rightChild",
        "nodeData.prediction",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.rawCount").cast("double").alias("cover"),
    )
    size = flat.count()
    if size > MAX_NODES:
        raise ValueError(f"ensemble has {size} nodes, more than {MAX_NODES}")
    leaves, base = _leaves(flat.toPandas(), weights)
    shared = df.sparkSession.sparkContext.broadcast(leaves)
    keys, xs = model.keys, model.xs
    rows = attach(df.select(*keys, ds, *xs), model.scales, keys, ["_ys", "_xm", "_xs"])
    rows = drop_incomplete(rows, ["_ys", *xs]).select(
        *keys, ds, "_ys",
        F.array(*[(F.col(x) - F.col("_xm")[i]) / F.col("_xs")[i] for i, x in enumerate(xs)]).alias("_z"),
    )
    index = [*keys, ds]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            phi = shapley_values(np.stack(batch["_z"].to_numpy()), shared.value)
            out = batch[index].copy()
            out["phi"] = list(phi * batch["_ys"].to_numpy()[:, None])
            yield out

    schema = T.StructType(
        [df.schema[c] for c in index] + [T.StructField("phi", T.ArrayType(T.DoubleType()))]
    )
    wide = rows.mapInPandas(explain, schema)
    named = F.arrays_zip(F.array(*[F.lit(x) for x in xs]).alias("feature"), F.col("phi").alias("phi"))
    long = wide.select(*index, F.explode(named).alias("_c"))
    return long.select(*index, F.col("_c.feature").alias("feature"), F.col("_c.phi").alias("phi")), base


def global_attribution(contributions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature."""
    return contributions.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("importance"))
