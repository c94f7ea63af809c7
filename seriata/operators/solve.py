"""Weighted least squares on graphs: positions from pairwise differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def solve_graph(i: np.ndarray, j: np.ndarray, delta: np.ndarray, weight: np.ndarray, n: int, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """x with x_i - x_j = delta, both sides weighted (so weights count squared), centred per component; and the components.

    Normal equations by conjugate gradients, scaled by the nodes' degrees: work
    space is a few numbers a node and edge, and no matrix is made. Graphs
    without a fixed node have no single solution, so components are centred.
    """
    w2 = weight * weight
    degree = np.bincount(i, w2, n) + np.bincount(j, w2, n) + ridge
    scale = 1 / np.where(degree > 0, degree, 1)
    label = _labels(n, i[w2 > 0], j[w2 > 0])
    size = np.bincount(label, minlength=n)
    centred = lambda v: v - (np.bincount(label, v, n) / np.maximum(size, 1))[label]

    def times(v: np.ndarray) -> np.ndarray:
        flow = w2 * (v[i] - v[j])
        return np.bincount(i, flow, n) - np.bincount(j, flow, n) + ridge * v

    x = np.zeros((n, delta.shape[1]))
    for c in range(delta.shape[1]):
        r = np.bincount(i, w2 * delta[:, c], n) - np.bincount(j, w2 * delta[:, c], n)
        least, z = 1e-13 * np.linalg.norm(r), scale * r
        p, rz = z, r @ z
        for _ in range(20 * n + 100):
            if np.linalg.norm(r) <= least or rz <= 0:
                break
            q = times(p)
            a = rz / (p @ q)
            x[:, c] += a * p
            r = r - a * q
            z = scale * r
            before, rz = rz, r @ z
            p = z + rz / before * p
        x[:, c] = centred(x[:, c])
    return x, label


def group_least_squares(edges: DataFrame, keys: list[str], ridge: float = 0.0, smallest: int = 0) -> DataFrame:
    """keys, node, x, y, component: solve_graph per group of edges (src, dst, dx, dy, w).

    A group is one solve (a section, an mFOV, a grid vertex): its nodes must fit
    a task, as the reconcile windows and tile counts do. Nodes of components of
    fewer than smallest nodes are 0. component is its smallest node.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema if f.name in keys) + ", node long, x double, y double, component long"

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(["src", "dst", "dx", "dy", "w"])
        names, at = np.unique(np.concatenate([pdf.src, pdf.dst]), return_inverse=True)
        if not len(names):
            return pd.DataFrame(columns=[*keys, "node", "x", "y", "component"])
        x, label = solve_graph(at[: len(pdf)], at[len(pdf) :], pdf[["dx", "dy"]].to_numpy(float), pdf.w.to_numpy(float), len(names), ridge)
        x[np.bincount(label, minlength=len(names))[label] < smallest] = 0
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "node": names, "x": x[:, 0], "y": x[:, 1], "component": names[label]})

    return edges.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("src", "dst")), *(F.col(c).cast("double").alias(c) for c in ("dx", "dy", "w"))).groupBy(*keys).applyInPandas(solve, schema)


def residuals(edges: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with rx, ry: what their solved difference has beyond the measured one."""
    a = solved.select(*keys, F.col("node").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = solved.select(*keys, F.col("node").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    r = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    return r.withColumn("rx", F.col("xa") - F.col("xb") - F.col("dx")).withColumn("ry", F.col("ya") - F.col("yb") - F.col("dy")).drop("xa", "ya", "xb", "yb")


def reconcile(deltas: DataFrame, chunk: int, reach: int, least_edges: int = 1) -> DataFrame:
    """vertex, z, x, y: positions of every section at every grid vertex from its deltas (vertex, z, k, dx, dy, w) to sections z + k.

    The stack is solved in chunks of z with reach sections of context on both
    sides; a delta belongs to every chunk that holds both of its sections, the
    chunk's own sections are kept. Chunks overlap by their context, so the work
    of a task does not follow the length of the stack.
    """
    z, far = F.col("z"), F.col("z") + F.col("k")
    first = F.floor((F.greatest(z, far) - reach - 1) / chunk)
    last = F.floor((F.least(z, far) + reach) / chunk)
    chunks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    inside = lambda c: (F.least(z, far) >= c * chunk - reach) & (F.greatest(z, far) < (c + 1) * chunk + reach) & (c >= 0)
    e = deltas.where("w > 0").withColumn("chunk", F.explode(F.filter(chunks, inside)))
    e = e.select("vertex", "chunk", far.alias("src"), z.alias("dst"), "dx", "dy", "w")
    some = e.groupBy("vertex", "chunk").agg(F.count("*").alias("n")).where(F.col("n") >= least_edges)
    solved = group_least_squares(e.join(some.select("vertex", "chunk"), ["vertex", "chunk"], "left_semi"), ["vertex", "chunk"])
    own = (F.col("node") >= F.col("chunk") * chunk) & (F.col("node") < (F.col("chunk") + 1) * chunk)
    return solved.where(own).select("vertex", F.col("node").alias("z"), "x", "y")
