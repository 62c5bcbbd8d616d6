"""Exact Shapley attributions of tree ensembles from compact path tables.

A leaf is reached where every feature on its path lies in one interval, so a path is a short list of (feature, low,
high), one entry for each distinct feature. Which of them a row satisfies is a bit set of the path's length. For a row
and a background row only the features that exactly one of them satisfies matter, with weights that are factorials of
the two numbers of such features. Rows with one bit set are alike to a path, so each path pairs its distinct bit sets
of rows with its distinct bit sets of the background, never the rows themselves; the cost for one row is one step for
each entry of its paths.

Paths are built on the executors, one tree at a time, and depths of nodes from parent links in a few joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 2_000_000  # rows x leaves x path entries that are worked on at once


@dataclass(frozen=True)
class TreePaths:
    """Leaves of an ensemble as entries of flat arrays; leaf i owns entries first[i] .. first[i + 1].

    A leaf holds where low < x <= high for all its entries and adds value to the score. The score is the probability,
    or with ``boosted`` the margin m of 1 / (1 + exp(-2 m)).
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    value: np.ndarray
    depth: np.ndarray
    n_nodes: int
    n_trees: int
    boosted: bool = False
    mean_tree_depth: float = 0.0

    def blocks(self, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Features, lows, highs (leaf by entry) and values of leaves of one path length, a bounded number at a time."""
        size = np.diff(self.first)
        for length in np.unique(size[size > 0]).tolist():
            leaves = np.flatnonzero(size == length)
            step = max(1, CELLS // (max(n_rows, 1) * length))
            for at in range(0, len(leaves), step):
                own = leaves[at: at + step]
                entry = self.first[own][:, None] + np.arange(length)
                yield self.feature[entry], self.low[entry], self.high[entry], self.value[own]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.value[np.diff(self.first) == 0].sum())
        for feature, low, high, value in self.blocks(len(x)):
            out += ((x[:, feature] > low) & (x[:, feature] <= high)).all(2) @ value
        return out


def tree_paths(nodes: DataFrame, weights: Sequence[float] | None = None) -> TreePaths:
    """Paths of the node table of one model (see ``models.node_table``); weights: of boosted trees."""
    def walk(tree: pd.DataFrame) -> pd.DataFrame:
        """One tree: entries of its leaves; a leaf without entries, of a tree of one node, has feature -1."""
        rows = tree.set_index("id")
        left, right, feature, cut = (rows[c].to_dict() for c in ("left", "right", "feature", "cut"))
        n0, n1, prediction = (rows[c].to_dict() for c in ("n0", "n1", "prediction"))
        out, stack = [], [(0, {}, 0)]
        while stack:
            node, bounds, level = stack.pop()
            if left[node] < 0:
                value = prediction[node] if weights else n1[node] / (n0[node] + n1[node])
                out += [(node, level, f, lo, hi, value) for f, (lo, hi) in (bounds or {-1: (-np.inf, np.inf)}).items()]
                continue
            f, at = feature[node], cut[node]
            lo, hi = bounds.get(f, (-np.inf, np.inf))
            stack += [(left[node], {**bounds, f: (lo, min(hi, at))}, level + 1),
                      (right[node], {**bounds, f: (max(lo, at), hi)}, level + 1)]
        found = pd.DataFrame(out, columns=["leaf", "depth", "feature", "low", "high", "value"])
        return found.assign(tree=tree["tree"].iloc[0], n_nodes=len(tree))

    schema = "leaf int, depth int, feature int, low double, high double, value double, tree int, n_nodes int"
    table = nodes.groupBy("tree").applyInPandas(walk, schema).toPandas().sort_values(["tree", "leaf", "feature"])
    key = table[["tree", "leaf"]].to_numpy()
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    per_tree = table.drop_duplicates("tree")
    scale = np.array([weights[t] for t in key[first, 0]]) if weights else 1.0 / len(per_tree)
    own = table["feature"].to_numpy() >= 0
    edges = np.append(0, np.cumsum(own))[np.append(first, len(table))]
    return TreePaths(table["feature"].to_numpy()[own].astype(np.int64), table["low"].to_numpy()[own], table["high"].to_numpy()[own],
                     edges, table["value"].to_numpy()[first] * scale, table["depth"].to_numpy()[first],
                     int(per_tree["n_nodes"].sum()), len(per_tree), bool(weights),
                     float(table.groupby("tree")["depth"].max().mean()))


def _bits(x: np.ndarray, feature: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bit set of the satisfied entries of each (row, leaf)."""
    place = np.int64(1) << np.arange(feature.shape[1], dtype=np.int64)
    return ((x[:, feature] > low) & (x[:, feature] <= high)) @ place


def _sets(bits: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bit sets of each leaf: leaf, set, how often, and for each (row, leaf) which one."""
    leaves = np.arange(bits.shape[1], dtype=np.int64) << length
    found, back, count = np.unique(bits | leaves, return_inverse=True, return_counts=True)
    return found >> length, found & ((1 << length) - 1), count, back.reshape(bits.shape)


def _weights(p: np.ndarray, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries only p has, entries only q has, and the weight of one of either; both bit sets together must be full."""
    fact = np.array([float(factorial(i)) for i in range(2 * length + 1)])
    mine, theirs = p & ~q, q & ~p
    a, b = np.bitwise_count(mine).astype(int), np.bitwise_count(theirs).astype(int)
    both = fact[a + b]
    return (mine, theirs, np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / both, 0.0),
            np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / both, 0.0))


def probability_shapley(x: np.ndarray, background: np.ndarray, paths: TreePaths) -> np.ndarray:
    """Interventional Shapley values of the score, averaged over the background rows."""
    out = np.zeros(x.size)
    at_row = np.arange(len(x))[:, None] * x.shape[1]
    for feature, low, high, value in paths.blocks(max(len(x), len(background))):
        length = feature.shape[1]
        leaf, p, _, which = _sets(_bits(x, feature, low, high), length)
        other, q, count, _ = _sets(_bits(background, feature, low, high), length)
        n = np.bincount(other, minlength=len(feature))
        before = np.cumsum(n) - n
        times = n[leaf]
        i = np.repeat(np.arange(len(leaf)), times)
        j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + before[leaf][i]
        live = (p[i] | q[j]) == (1 << length) - 1
        i, j = i[live], j[live]
        mine, theirs, up, down = _weights(p[i], q[j], length)
        share = value[leaf[i]] * count[j]
        up, down = up * share, down * share
        for slot in range(length):
            part = up * (mine >> slot & 1) - down * (theirs >> slot & 1)
            own = np.bincount(i, weights=part, minlength=len(leaf))[which]
            out += np.bincount((at_row + feature[:, slot]).ravel(), weights=own.ravel(), minlength=x.size)
    return out.reshape(x.shape) / len(background)


def margin_shapley(x: np.ndarray, background: np.ndarray, paths: TreePaths) -> np.ndarray:
    """Shapley values of the margin for each background row, rescaled to the change in probability, then averaged."""
    margins = paths.score(x)[:, None], paths.score(background)[None]
    p, q = (1 / (1 + np.exp(-2 * m)) for m in margins)
    gap = margins[0] - margins[1]
    close = np.abs(gap) < 1e-9  # the slope in place of the quotient
    ratio = np.where(close, 2 * p * (1 - p), (p - q) / np.where(close, 1.0, gap))
    out = np.zeros(x.size)
    at_row = np.arange(len(x))[:, None] * x.shape[1]
    for feature, low, high, value in paths.blocks(len(x) * len(background)):
        length = feature.shape[1]
        s, t = _bits(x, feature, low, high)[:, None], _bits(background, feature, low, high)[None]
        mine, theirs, up, down = _weights(s, t, length)
        live = ((s | t) == (1 << length) - 1) * value * ratio[:, :, None]
        up, down = up * live, down * live
        for slot in range(length):
            own = (up * (mine >> slot & 1) - down * (theirs >> slot & 1)).sum(1)
            out += np.bincount((at_row + feature[:, slot]).ravel(), weights=own.ravel(), minlength=x.size)
    return out.reshape(x.shape) / len(background)


def node_depths(nodes: DataFrame) -> DataFrame:
    """(tree, id, depth) of a node table by pointer doubling over parent links: joins grow with the log of the depth."""
    links = nodes.filter("left >= 0").select("tree", F.col("id").alias("up"), F.explode(F.array("left", "right")).alias("id"))
    at = nodes.select("tree", "id").join(links, ["tree", "id"], "left").select(
        "tree", "id", "up", F.col("up").isNotNull().cast("int").alias("depth"))
    while not at.filter("up is not null").isEmpty():
        above = at.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        at = at.join(above, ["tree", "up"], "left").select(
            "tree", "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
    return at.select("tree", "id", "depth")
