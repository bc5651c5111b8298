"""Connected components of a table of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settle


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component (its smallest node) for every node in links (a, b: longs, not null).

    A round gives each node the least label among its neighbours', then the label of its label. Labels are
    settled before each join, so that both sides of it are plain shuffles whose hot keys can be split.
    """
    both = links.select("a", "b").filter("a <> b")
    both = settle(both.union(both.select("b", "a")).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        wide = settle(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least")))
        up = wide.select(F.col("node").alias("_node"), F.col("least").alias("up"))
        jumped = settle(wide.join(up, F.col("least") == F.col("_node")).select("node", "label", F.least("least", "up").alias("new")))
        changed = jumped.filter("new <> label").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def forest(left, right, root_of: dict | None = None) -> dict:
    """Union-find over the links left[i] - right[i] of one task: node -> least node of its tree."""
    root: dict = root_of or {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for x, y in zip(left, right):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}
