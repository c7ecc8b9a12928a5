"""Operators without a relational form: matching, suppression and distribution distance, one group a call.

A group is one sample's candidate pairs; samples are small by nature and independent of one another.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def maximum(pairs: DataFrame, sample: str, left: str, right: str, sim: str, least: float) -> DataFrame:
    """A matching of the most pairs with ``sim`` of at least ``least`` in each sample, by augmenting paths.

    Better pairs are tried first, so of matchings with equally many pairs a good one is found.
    """

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        near = group[group[sim] >= least].sort_values([sim, left, right], ascending=[False, True, True])
        edges = {a: g[right].tolist() for a, g in near.groupby(left, sort=False)}
        partner: dict = {}

        def place(a, seen: set) -> bool:
            for b in edges[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in partner or place(partner[b], seen):
                        partner[b] = a
                        return True
            return False

        for a in edges:
            place(a, set())
        found = pd.DataFrame([(a, b) for b, a in partner.items()], columns=[left, right])
        return group.merge(found, on=[left, right])[[sample, left, right, sim]]

    kinds = pairs.select(sample, left, right, sim).schema
    return pairs.select(sample, left, right, sim).groupBy(sample).applyInPandas(solve, kinds)


def greedy(pairs: DataFrame, sample: str, left: str, right: str, sim: str, least: float) -> DataFrame:
    """Highest score first, each side used once."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        kept, used_left, used_right = [], set(), set()
        for i, row in enumerate(group.sort_values([sim, left, right], ascending=[False, True, True]).itertuples(index=False)):
            a, b = getattr(row, left), getattr(row, right)
            if getattr(row, sim) >= least and a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                kept.append(tuple(getattr(row, c) for c in (sample, left, right, sim)))
        return pd.DataFrame(kept, columns=[sample, left, right, sim])

    kinds = pairs.select(sample, left, right, sim).schema
    return pairs.select(sample, left, right, sim).groupBy(sample).applyInPandas(solve, kinds)


def suppress(boxes: DataFrame, sample: str, most_overlap: float) -> DataFrame:
    """Greedy non-maximum suppression of (sample, box, x0, y0, x1, y1, score): the kept (sample, box)."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["score", "box"], ascending=[False, True]).reset_index(drop=True)
        xy = g[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = (xy[:, 2] - xy[:, 0]) * (xy[:, 3] - xy[:, 1])
        alive, kept = np.ones(len(g), bool), []
        for i in range(len(g)):
            if alive[i]:
                kept.append(i)
                wide = np.minimum(xy[i, 2], xy[:, 2]) - np.maximum(xy[i, 0], xy[:, 0])
                high = np.minimum(xy[i, 3], xy[:, 3]) - np.maximum(xy[i, 1], xy[:, 1])
                both = np.clip(wide, 0, None) * np.clip(high, 0, None)
                alive &= both <= most_overlap * (area[i] + area - both)
        return g.loc[kept, [sample, "box"]]

    return boxes.groupBy(sample).applyInPandas(solve, boxes.select(sample, "box").schema)


def _alike(a: str, b: str, ratio: float) -> bool:
    match = SequenceMatcher(None, a, b, autojunk=False)
    return match.real_quick_ratio() > ratio and match.quick_ratio() > ratio and match.ratio() > ratio


def fuzzy_dedupe(labels: DataFrame, sample: str, label: str, overlap: float = 0.3, ratio: float = 0.9) -> DataFrame:
    """Within a sample, longest first: a label goes if its string ratio with a kept one exceeds ``ratio``, if it is part
    of it, or if it shares over ``overlap`` of its words with it."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        for text in sorted(set(group[label]), key=lambda t: (-len(t), t)):
            words = set(text.split())
            if not any(text in k or (words and len(words & set(k.split())) / len(words) > overlap) or _alike(text, k, ratio) for k in kept):
                kept.append(text)
        return pd.DataFrame({sample: [group[sample].iloc[0]] * len(kept), label: kept})

    return labels.groupBy(sample).applyInPandas(solve, labels.select(sample, label).schema)


def domain_shift(rows: DataFrame, domain: str, vector: str) -> DataFrame:
    """(fid, cosine_distance) between domains 0 and 1 of ``rows``.

    Means and second moments are aggregated by position, width * width numbers a domain; only those reach the last step.
    """
    spread = rows.select(domain, F.posexplode(vector).alias("i", "x"), vector)
    moments = spread.select(domain, "i", F.col("x").cast("double").alias("x"), F.posexplode(vector).alias("j", "y")).groupBy(domain, "i", "j").agg(
        F.avg("x").alias("mean"), F.covar_pop("x", F.col("y").cast("double")).alias("cov"))

    def distance(cells: pd.DataFrame) -> pd.DataFrame:
        width = int(cells["i"].max()) + 1
        mean, cov = np.zeros((2, width)), np.zeros((2, width, width))
        d, i, j = (cells[c].to_numpy(int) for c in (domain, "i", "j"))
        mean[d, i], cov[d, i, j] = cells["mean"], cells["cov"]
        values, vectors = np.linalg.eigh(cov[0])
        root = vectors @ np.diag(np.sqrt(np.clip(values, 0, None))) @ vectors.T
        cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cov[1] @ root), 0, None)).sum()
        fid = float(((mean[0] - mean[1]) ** 2).sum() + np.trace(cov[0]) + np.trace(cov[1]) - 2 * cross)
        cosine = float(mean[0] @ mean[1] / (np.linalg.norm(mean[0]) * np.linalg.norm(mean[1])))
        return pd.DataFrame({"fid": [round(fid, 6)], "cosine_distance": [round(1 - cosine, 6)]})

    return moments.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(distance, "fid double, cosine_distance double")
