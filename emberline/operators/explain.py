"""What a model's log-odds rest on, hour by hour: parts that add up to them exactly, over a base."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import shared_dir


def linear_parts(rows: DataFrame, names: list[str], beta: np.ndarray, means: dict[str, float]) -> DataFrame:
    """hr, name, part: coefficient times distance from the mean, so that base + parts are the log-odds; the base are those of the means."""
    part = {x: F.struct(F.lit(x).alias("name"), (float(b) * (F.col(x) - F.lit(means[x]))).alias("part")) for x, b in zip(names, beta[1:], strict=True)}
    return rows.select("hr", F.explode(F.array(*part.values())).alias("x")).select("hr", "x.name", "x.part")


@dataclass(frozen=True)
class Leaf:
    """What a leaf adds to the log-odds, and for each feature on its path the range (above, up to] that leads there and the share of training rows that took these turns."""

    value: float
    path: dict[int, tuple[float, float, float]]


def leaves(model: GBTClassificationModel, spark: SparkSession) -> list[Leaf]:
    """All leaves of a boosted ensemble, as its published file format has them: at most trees x 2^depth."""
    where = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(where)
    rows = spark.read.parquet(f"{where}/data").select("treeID", "nodeData.*").collect()
    nodes = {(r["treeID"], r["id"]): r for r in rows}
    out: list[Leaf] = []

    def walk(tree: int, node: int, path: dict[int, tuple[float, float, float]]) -> None:
        r = nodes[tree, node]
        if r["leftChild"] < 0:
            # a boosted classifier's probability is that of twice its margin
            out.append(Leaf(2 * model.treeWeights[tree] * r["prediction"], path))
            return
        feature, at = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        for child, ends in ((r["leftChild"], (low, min(high, at))), (r["rightChild"], (max(low, at), high))):
            walk(tree, child, {**path, feature: (*ends, share * nodes[tree, child]["rawCount"] / r["rawCount"])})

    for tree in range(len(model.treeWeights)):
        walk(tree, 0, {})
    return out


def shapley(x: np.ndarray, found: list[Leaf]) -> tuple[float, np.ndarray]:
    """Base, and rows x features of Shapley parts: a feature that is left out of a set takes each turn with the share of training rows that took it.

    In a leaf the game is a product over the path's features, so the sum over all sets
    needs only the sums over sets of each size: coefficients of a product of polynomials.
    """
    parts, base = np.zeros(x.shape), 0.0
    for leaf in found:
        features = list(leaf.path)
        m = len(features)
        share = np.array([leaf.path[f][2] for f in features])
        base += leaf.value * float(np.prod(share))
        inside = np.stack([((x[:, f] > leaf.path[f][0]) & (x[:, f] <= leaf.path[f][1])).astype(float) for f in features], axis=1) if m else np.zeros((len(x), 0))
        for j, f in enumerate(features):
            sizes = np.zeros((len(x), m))  # sets of the other features, by size
            sizes[:, 0] = 1
            for k in range(m):
                if k != j:
                    sizes[:, 1:] = sizes[:, 1:] * share[k] + sizes[:, :-1] * inside[:, [k]]
                    sizes[:, 0] *= share[k]
            weight = np.array([1 / (m * comb(m - 1, s)) for s in range(m)])
            parts[:, f] += leaf.value * (inside[:, j] - share[j]) * (sizes @ weight)
    return base, parts


def tree_parts(rows: DataFrame, names: list[str], found: list[Leaf]) -> DataFrame:
    """hr, name, part, base of every row: base + parts are the ensemble's log-odds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            base, parts = shapley(f[names].to_numpy(dtype=float), found)
            yield pd.DataFrame({"hr": f["hr"], "base": base, "parts": list(parts)})

    listed = rows.select("hr", *names).mapInPandas(run, "hr timestamp_ntz, base double, parts array<double>")
    return listed.select("hr", "base", F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("parts").alias("part"))).alias("x")).select("hr", "x.name", "x.part", "base")
