"""Splits that keep related records together (problem 2).

Rows tied by blueprint, parentage or author form components; components of equal size and label
profile form bundles; a min-cost flow from bundles to splits with a cost per row of deviation gives
the shares; each bundle's share is rounded to whole components, which are picked by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.functions.keys import id_key
from lodestat.operators.components import connected_components
from lodestat.operators.ordering import group_rank, hash_order
from lodestat.operators.skew import salted_join
from lodestat.session import cut

#: Author entries that name nobody (compared without case and outer blanks).
PLACEHOLDERS = ["unknown", "n/a", "none", "anonymous"]
#: Labels of the scenario table and the split of split_targets each corresponds to.
LABEL_OF = {"train": "train", "valid": "valid", "dev": "test", "final": "test", "test": "test"}


def related_groups(rows: DataFrame, row: str = "scenario_row", own: str = "blueprint_id", author: str = "author_id", parent: str = "search.parent_blueprint_id") -> DataFrame:
    """The rows with group_row, the smallest row number of their group.

    Null and blank ids, null and placeholder authors tie nothing; a parent that no row has ties
    nothing either. A row without any tie is a group of its own. An empty table gives no rows.
    Links go from keys to keys, never between all rows that share one, so a key held by a third of
    all rows costs one link per distinct pair of keys.
    """
    a = id_key(F.col(author))
    d = rows.select(
        F.col(row).alias("__row"),
        id_key(F.col(own)).alias("__own"),
        F.when(~a.isin(PLACEHOLDERS), F.col(author)).alias("__author"),
        id_key(F.col(parent)).alias("__parent"),
    )
    d = d.withColumn("__node", F.coalesce(F.concat(F.lit("b:"), "__own"), F.concat(F.lit("r:"), F.col("__row").cast("string"))))
    by_author = d.select(F.col("__node").alias("a"), F.concat(F.lit("a:"), "__author").alias("b")).distinct()
    known = d.select(F.col("__own").alias("__parent")).distinct()
    by_parent = d.where("__parent IS NOT NULL").select("__node", "__parent").distinct().join(known, "__parent", "left_semi")
    links = by_author.where("b IS NOT NULL").union(by_parent.select("__node", F.concat(F.lit("b:"), "__parent")))
    part = connected_components(links, "a", "b")
    nodes = d.groupBy("__node").agg(F.min("__row").alias("__least"), F.count(F.lit(1)).alias("n"))
    # groups are settled on nodes; rows, of which a node may hold a third, meet them once
    tied = cut(nodes.join(part, F.col("__node") == F.col("node"), "left").select("__node", "n", "__least", F.coalesce("component", "__node").alias("__component")))
    least = tied.groupBy("__component").agg(F.min("__least").alias("group_row"), F.count(F.lit(1)).alias("n"))
    named = salted_join(tied.select("__node", "__component"), least.drop("n"), ["__component"], F.col("__node"), counts=least.select("__component", "n"))
    group = salted_join(d.select("__row", "__node"), named.select("__node", "group_row"), ["__node"], F.col("__row"), counts=tied.select("__node", "n")).select("__row", "group_row")
    return rows.join(group, rows[row] == group["__row"]).drop("__row")


def broken_groups(grouped: DataFrame, split: str = "split", row: str = "scenario_row") -> DataFrame:
    """(row, group_row) of the groups that hold two or more different non-null splits."""
    s = id_key(F.col(split))
    per = grouped.groupBy("group_row").agg(F.min(s).alias("lo"), F.max(s).alias("hi"), F.count(F.lit(1)).alias("n"))
    bad = per.where("lo != hi").select("group_row", "n")
    return salted_join(grouped.select(row, "group_row"), bad.select("group_row"), ["group_row"], F.col(row), "left_semi", counts=bad).select(row, "group_row")


def min_cost_flow(supply: np.ndarray, cost: np.ndarray, quota: np.ndarray, deviation: float) -> np.ndarray:
    """Rows sent from each source to each sink: all supply is sent; a row beyond a sink's quota costs
    `deviation` on top. Successive shortest paths; paths run over sinks, rerouting earlier rows."""
    n, k = cost.shape
    x = np.zeros((n, k))
    for b in np.argsort(-supply, kind="stable"):
        left = float(supply[b])
        while left > 1e-9:
            used = x.sum(0)
            room = quota - used
            dist = np.where(room > 1e-9, 0.0, deviation)
            to = np.full(k, -1)
            via = np.full((k, k), -1)
            w = np.full((k, k), np.inf)
            for s in range(k):
                have = np.flatnonzero(x[:, s] > 1e-9)
                if len(have):
                    gain = cost[have] - cost[have, s][:, None]
                    best = gain.argmin(0)
                    w[s], via[s] = gain[best, range(k)], have[best]
                    w[s, s] = np.inf
            for _ in range(k):
                for s in range(k):
                    t = int(np.argmin(w[s] + dist))
                    if w[s, t] + dist[t] < dist[s] - 1e-12:
                        dist[s], to[s] = w[s, t] + dist[t], t
            path = [int(np.argmin(cost[b] + dist))]
            while to[path[-1]] >= 0 and len(path) <= k:
                path.append(int(to[path[-1]]))
            amount = left
            if room[path[-1]] > 1e-9:
                amount = min(amount, room[path[-1]])
            for s, t in zip(path, path[1:]):
                amount = min(amount, x[via[s, t], s])
            x[b, path[0]] += amount
            for s, t in zip(path, path[1:]):
                m = via[s, t]
                x[m, s] -= amount
                x[m, t] += amount
            left -= amount
    return x


def allocate(bundles: Sequence[tuple[int, tuple[int, ...], int]], shares: Sequence[float], deviation: float = 1000.0) -> list[list[int]]:
    """For bundles (component size, label profile in quarters per split, number of components): how
    many components go to each split. The cost of a row is the part of its component that changes
    label. Bundles with one profile cost the same, so the flow runs over profiles."""
    total = sum(s * c for s, _, c in bundles)
    k = len(shares)
    if not total:
        return [[0] * k for _ in bundles]
    quota = np.array(shares, float) / sum(shares) * total
    profiles = sorted({p for _, p, _ in bundles})
    at = {p: i for i, p in enumerate(profiles)}
    supply = np.zeros(len(profiles))
    for s, p, c in bundles:
        supply[at[p]] += s * c
    # a null label costs nothing wherever it goes
    cost = np.array([[(sum(p) - p[s]) / 4 for s in range(k)] for p in profiles])
    x = min_cost_flow(supply, cost, quota, deviation)
    got = np.zeros(k)
    out = [[0] * k for _ in bundles]
    goal = x.sum(0)
    order = sorted(range(len(bundles)), key=lambda i: (-bundles[i][0], bundles[i][1]))
    rest = []
    for i in order:
        size, p, count = bundles[i]
        part = x[at[p]] * (size * count / supply[at[p]]) / size
        out[i] = [int(v + 1e-9) for v in part]
        got += np.array(out[i]) * size
        rest.append((i, count - sum(out[i])))
    for i, n in rest:  # the largest first, so that the small ones level the shares
        size, p, _ = bundles[i]
        for _ in range(n):
            s = min(range(k), key=lambda s: (round(got[s] - goal[s], 6), cost[at[p]][s]))
            out[i][s] += 1
            got[s] += size
    sizes = np.array([b[0] for b in bundles], float)
    costs = np.array([cost[at[p]] for _, p, _ in bundles])
    have = np.array(out)
    while True:  # move single components as long as that brings shares nearer to the quotas
        dev = got - quota
        a, b = int(dev.argmax()), int(dev.argmin())
        span = dev[a] - dev[b]
        fit = np.flatnonzero((have[:, a] > 0) & (np.abs(dev[a] - sizes) + np.abs(dev[b] + sizes) < span - 1e-9))
        if not len(fit):
            return have.tolist()
        gap = min(dev[a], -dev[b])
        i = fit[np.lexsort((costs[fit, b] - costs[fit, a], np.abs(sizes[fit] - gap)))[0]]
        have[i, a] -= 1
        have[i, b] += 1
        got[a] -= sizes[i]
        got[b] += sizes[i]


def assign_splits(grouped: DataFrame, targets: Sequence[tuple[str, float]], split: str = "split", row: str = "scenario_row", seed: int = 0) -> DataFrame:
    """(row, group_row, new_split): whole groups in one split, row shares near the targets.

    What the driver gets is one line per bundle: sizes of components times label profiles in
    quarters, at most 35 * sqrt(2 * rows) of them, not the components. No targets is an error; an
    empty table gives no rows. The same seed gives the same splits whatever the partitioning.
    """
    names = [n for n, _ in targets]
    if not names or sum(v for _, v in targets) <= 0:
        raise ValueError("split targets must name splits with positive shares")
    label = F.coalesce(*[F.when(id_key(F.col(split)) == k, F.lit(v)) for k, v in LABEL_OF.items() if v in names], F.lit(None).cast("string"))
    g = grouped.select(F.col(row), "group_row", label.alias("__label"))
    size = F.count(F.lit(1))
    parts = [F.floor(4 * F.count(F.when(F.col("__label") == n, 1)) / size + F.lit(1e-9)).cast("int").alias(f"__q{i}") for i, n in enumerate(names)]
    comp = g.groupBy("group_row").agg(size.alias("__size"), *parts)
    keys = ["__size", *[f"__q{i}" for i in range(len(names))]]
    comp = cut(comp.withColumn("__h", hash_order(seed, F.col("group_row"))))
    bundles = [(r["__size"], tuple(r[k] for k in keys[1:]), r["n"]) for r in comp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).toLocalIterator()]
    plan = allocate(bundles, [v for _, v in targets])
    lines = []
    for (s, p, _), per in zip(bundles, plan):
        lo = 0
        for name, n in zip(names, per):
            if n:
                lines.append((s, *p, lo, lo + n, name))
                lo += n
    schema = ", ".join([f"{k} {'bigint' if k == '__size' else 'int'}" for k in keys]) + ", __lo bigint, __hi bigint, new_split string"
    ranges = grouped.sparkSession.createDataFrame(lines, schema)
    ranked = group_rank(comp, keys, "__h", "__rank", tie=["group_row"])
    sizes = comp.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    chosen = salted_join(ranked, ranges, keys, F.col("group_row"), counts=sizes).where("__rank > __lo AND __rank <= __hi").select("group_row", "new_split")
    return salted_join(g.select(row, "group_row"), chosen, ["group_row"], F.col(row), counts=comp.select("group_row", F.col("__size").alias("n"))).select(row, "group_row", "new_split")


def targets_of(spark: SparkSession, split_targets: DataFrame) -> list[tuple[str, float]]:
    """The target table: one line per split, so it may come to the driver."""
    d = split_targets.groupBy(id_key(F.col("split")).alias("split")).agg(F.max("target_share").alias("share"))
    return sorted(((r["split"], r["share"]) for r in d.where("split IS NOT NULL AND share > 0").collect()), key=lambda t: (-t[1], t[0]))
