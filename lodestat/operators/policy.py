"""Policies over candidate methods: targets, projections, weights, as expressions over long tables
(scenario, method, probability, regret)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestat.operators.ordering import hash_order, running_total
from lodestat.session import cut


def _over(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def normalised(df: DataFrame, keys: Sequence[str], value: str, into: str = "regret") -> DataFrame:
    """Min-max per scenario; 0 where all candidates are equal."""
    w = _over(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(into, F.when(hi - lo > 1e-12, (F.col(value) - lo) / (hi - lo)).otherwise(0.0))


def softmax(df: DataFrame, keys: Sequence[str], value: str, temperature: float, into: str = "probability") -> DataFrame:
    """Shifted by the maximum; larger values get more."""
    w = _over(*keys)
    e = F.exp((F.col(value) - F.max(value).over(w)) / temperature)
    return df.withColumn("__e", e).withColumn(into, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def regret_of(df: DataFrame, keys: Sequence[str], probability: str, temperature: float, into: str = "regret") -> DataFrame:
    """Regret back from soft targets; probability 0 gives 1."""
    top = F.max(probability).over(_over(*keys))
    r = F.when(F.col(probability) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -temperature * F.log(F.col(probability) / top)))).otherwise(1.0)
    return df.withColumn(into, r)


def projected(df: DataFrame, keys: Sequence[str], parent: str, regret: str, mix: float = 0.1, tilt: float = 2.0, step: float = 0.5) -> DataFrame:
    """Parent mixed with uniform, tilted by exp(-tilt * regret), stepped towards it; taken per scenario only
    if the expected regret does not rise. Adds `projected`, `accepted` and the divergence `kl` from the parent."""
    w = _over(*keys)
    n = F.count(F.lit(1)).over(w)
    d = df.withColumn("__a", (1 - mix) * F.col(parent) + mix / n).withColumn("__t", F.col("__a") * F.exp(-tilt * F.col(regret)))
    d = d.withColumn("__t", F.col("__t") / F.sum("__t").over(w)).withColumn("__q", (1 - step) * F.col(parent) + step * F.col("__t"))
    d = d.withColumn("accepted", F.sum(F.col("__q") * F.col(regret)).over(w) <= F.sum(F.col(parent) * F.col(regret)).over(w) + 1e-12)
    d = d.withColumn("projected", F.when(F.col("accepted"), F.col("__q")).otherwise(F.col(parent)))
    term = F.when(F.col("projected") > 0, F.col("projected") * F.log(F.col("projected") / F.greatest(F.col(parent), F.lit(1e-300)))).otherwise(0.0)
    return d.withColumn("kl", F.sum(term).over(w)).drop("__a", "__t", "__q")


def direct_target(df: DataFrame, keys: Sequence[str], probability: str, regret: str, strength: float) -> DataFrame:
    """p * (1 - strength * (regret - expected regret)), normalised, negatives cut."""
    w = _over(*keys)
    mean = F.sum(F.col(probability) * F.col(regret)).over(w)
    d = df.withColumn("__q", F.greatest(F.lit(0.0), F.col(probability) * (1 - strength * (F.col(regret) - mean))))
    return d.withColumn("target", F.col("__q") / F.sum("__q").over(w)).drop("__q")


def tail_weights(groups: DataFrame, key: str, loss: str, fraction: float, floor: float) -> DataFrame:
    """Mean-one weights: the worst round(n * fraction) groups share what the floor leaves. Few rows: groups."""
    n = groups.count()
    tail = max(1, round(n * fraction))
    r = F.row_number().over(Window.orderBy(F.desc(loss), key))
    return groups.withColumn("__r", r).select(key, loss, (F.lit(floor) + F.when(F.col("__r") <= tail, (1 - floor) * n / tail).otherwise(0.0)).alias("weight"))


def latin_hypercube(spark, families: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points per family: (family_id, point, parameters). Each parameter is cut into n strata, one point
    per stratum in hash order with a hash jitter; integers are rounded, at least 2. families has one line
    per family and parameter with its bounds."""
    unit = lambda *c: (hash_order(seed, *c).cast("double") / float(1 << 63))
    d = families.crossJoin(spark.range(n).select(F.col("id").alias("point")))
    d = d.withColumn("__h", hash_order(seed, F.lit("order"), F.col("family_id"), F.col("parameter_name"), F.col("point")))
    d = running_total(d, ["family_id", "parameter_name"], "__h", F.lit(1), "stratum", tie=["point"])
    u = (F.col("stratum") - 1 + unit(F.lit("jitter"), F.col("family_id"), F.col("parameter_name"), F.col("point"))) / n
    v = F.col("lower_bound") + u * (F.col("upper_bound") - F.col("lower_bound"))
    v = F.when(F.col("is_integer"), F.greatest(F.round(v), F.lit(2.0))).otherwise(F.round(v, 6))
    return d.withColumn("v", v).groupBy("family_id", "point").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter_name", "v")))).alias("parameters"))


def scaled(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def simulate(points: DataFrame, keys: Sequence[str], method: str, stages: Sequence[int] = (128, 256, 512), seed: int = 0, gap: float = 0.035) -> DataFrame:
    """Regret estimates with common random numbers: all methods of a scenario share the draws (hash of seed,
    scenario, repetition). A scenario whose best two methods differ by less than gap + 1.25 standard
    errors goes on to the next number of repetitions; each stage only sees the open ones.

    points: keys, method, mean, sd. Returns keys, method, estimate, repetitions."""
    open_, done = points, None
    for i, reps in enumerate(stages):
        z = _normal(seed, keys)
        draws = open_.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("z", z)
        part = draws.groupBy(*keys).agg(F.avg("z").alias("zm"), F.stddev_pop("z").alias("zs"))
        est = open_.join(part, list(keys)).withColumn("estimate", F.col("mean") + F.col("sd") * F.col("zm"))
        w = _over(*keys).orderBy("estimate", method)
        r = est.withColumn("__r", F.row_number().over(w))
        two = r.where("__r <= 2").groupBy(*keys).agg((F.max("estimate") - F.min("estimate")).alias("g"), F.max(F.col("sd") * F.col("zs") / F.sqrt(F.lit(reps))).alias("se"), F.count(F.lit(1)).alias("m"))
        unsure = two.where((F.col("m") > 1) & (F.col("g") < gap + 1.25 * F.col("se"))).select(*keys)
        cols = [*keys, method, "estimate", F.lit(reps).alias("repetitions")]
        closed = est if i + 1 == len(stages) else est.join(unsure, list(keys), "left_anti")
        done = closed.select(*cols) if done is None else done.unionByName(closed.select(*cols))
        open_ = open_.join(unsure, list(keys), "left_semi")
    return done


def _normal(seed: int, keys: Sequence[str]) -> Column:
    u = lambda tag: (hash_order(seed, F.lit(tag), *keys, "rep").cast("double") + 0.5) / float(1 << 63)
    return F.sqrt(-2 * F.log(u("radius"))) * F.cos(2 * F.pi() * u("angle"))


#: References that a cell of the search holds about, cells of a family at most, most cuts of one parameter.
CELL_ROWS, CELLS, CUTS = 2048, 4096, 64


def nearest(points: DataFrame, refs: DataFrame, family: str, key: str, parameters: str, ranges: Mapping[str, Mapping[str, float]], largest: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, novelty, nearest): least normalised distance of each point to the other references of its family, and
    the reference there (ties: smallest key): root mean square over the parameters, or with `largest` the largest
    difference. A parameter one side lacks counts as a whole range; families without ranges have no distance.

    Exact, by cells: references are cut into cells between quantiles of their parameters (a missing one is a cut of its
    own), of about `cell_rows` and at most some CELLS a family. A point first meets the cell whose box is nearest, then
    those cells only that may hold a better reference: none whose box is farther than what is found, or as far with
    larger keys only. The boxes are bounded and go to the driver; a cell of many equal references is worked in parts
    of bounded size, and of the pairs only the best of a point and part leave a task."""
    names = {f: sorted(r) for f, r in ranges.items()}
    dims = range(max((len(k) for k in names.values()), default=0))
    if not dims:
        return points.where("false").select(key, F.lit(0.0).alias("novelty"), F.col(key).alias("nearest"))
    order = F.create_map(*[x for f, k in names.items() for x in (F.lit(f), F.array(*[F.lit(v) for v in k]))])

    def flat(df: DataFrame) -> DataFrame:
        d = df.where(F.col(family).isin(list(names)) & F.col(key).isNotNull()).select(F.col(family).alias("f"), F.col(key).alias("key"), F.col(parameters).alias("p")).withColumn("k", order[F.col("f")])
        return d.select("f", "key", *[F.try_element_at("p", F.try_element_at("k", F.lit(i + 1))).cast("double").alias(f"v{i}") for i in dims])

    a, b = flat(points), flat(refs)
    ask = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    bounds: dict[str, list[list[float]]] = {}
    for r in b.groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f"v{i}", ask, F.lit(1000)).alias(f"q{i}") for i in dims]).collect():
        m = int(min(max(1, r["n"] / cell_rows), CELLS) ** (1 / len(names[r["f"]])) + 1e-9)
        at = [round(j * CUTS / m) - 1 for j in range(1, min(m, CUTS))]
        bounds[r["f"]] = [sorted({(r[f"q{i}"] or [])[j] for j in at if r[f"q{i}"]}) if i < len(names[r["f"]]) else [] for i in dims]
    empty = F.array().cast("array<array<double>>")
    of = F.create_map(*[x for f, c in bounds.items() for x in (F.lit(f), F.array(*[F.array(*[F.lit(float(v)) for v in q]).cast("array<double>") for q in c]))]) if bounds else F.create_map(F.lit(""), empty)
    b = b.withColumn("c", of[F.col("f")])
    below = lambda v: lambda q: q < v
    cell = F.lit(0).cast("bigint")
    for i in dims:  # 0: the parameter is missing
        place = F.when(F.col(f"v{i}").isNull(), 0).otherwise(1 + F.size(F.filter(F.col("c")[i], below(F.col(f"v{i}")))))
        cell = cell * (CUTS + 1) + place
    b = b.withColumn("cell", cell).drop("c")
    boxes = b.groupBy("f", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), *[x for i in dims for x in (F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"))]).toPandas()
    boxes["parts"] = -(-boxes["n"] // (4 * cell_rows))
    by_family = {}
    for f, g in boxes.sort_values("least").groupby("f"):
        edges = [(g[f"lo{i}"].to_numpy(float), g[f"hi{i}"].to_numpy(float)) for i in range(len(names[f]))]
        by_family[f] = (edges, g["least"].to_numpy(), g["cell"].tolist(), g["parts"].tolist())
    parts = b.sparkSession.createDataFrame([(r.f, int(r.cell), int(r.parts)) for r in boxes[boxes["parts"] > 1].itertuples()], "f string, cell bigint, parts bigint")
    b = b.join(F.broadcast(parts), ["f", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("bigint")).drop("parts")
    widths = {f: [float(ranges[f][k]) for k in names[f]] for f in names}
    kind = dict(a.dtypes)["key"]
    cols = [f"v{i}" for i in dims]
    schema = f"f string, key {kind}, {', '.join(f'{c} double' for c in cols)}, cell bigint, part bigint"

    def visits(first: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """The cells a point has to meet: the nearest box, or all others that may be better than `novelty`, `nearest`."""

        def of_point(x) -> list[tuple]:
            edges, least, cells, n_parts = by_family[x.f]
            w, v = widths[x.f], [getattr(x, c) for c in cols]
            low = _distance([np.maximum(np.maximum(lo - q, q - hi), 0.0) / u for (lo, hi), q, u in zip(edges, v, w)], largest)
            at = int(low.argmin())  # of equals the one with the smallest key
            take = [at]
            if not first:
                any_ = x.novelty == float("inf")
                take = [i for i in np.flatnonzero(low <= x.novelty).tolist() if i != at and (any_ or low[i] < x.novelty or least[i] < x.nearest)]
            return [(x.f, x.key, *v, cells[i], p) for i in take for p in range(n_parts[i])]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [r for x in pdf.itertuples(index=False) if x.f in by_family for r in of_point(x)]
                yield pd.DataFrame(rows, columns=["f", "key", *cols, "cell", "part"])

        return run

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values("key")
            w, keys = widths[y["f"].iloc[0]], y["key"].to_numpy()
            v = [y[k].to_numpy(float) for k in cols[: len(w)]]
            for p in x.itertuples(index=False):
                d = _distance([np.abs(getattr(p, k) - q) / u for k, q, u in zip(cols, v, w)], largest)
                d = np.where((keys == p.key) | np.isnan(d), np.inf, d)
                i = int(d.argmin())
                if keys[i] != p.key:
                    out.append((p.key, d[i], keys[i]))
        return pd.DataFrame(out, columns=["key", "novelty", "nearest"])

    def met(asked: DataFrame) -> DataFrame:
        on = ["f", "cell", "part"]
        return asked.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(meet, f"key {kind}, novelty double, nearest {kind}")

    best = lambda d: d.groupBy("key").agg(F.min(F.struct("novelty", "nearest")).alias("m")).select("key", "m.novelty", "m.nearest")
    found = cut(best(met(a.mapInPandas(visits(True), schema))))
    known = a.join(found, "key", "left").withColumns({"novelty": F.coalesce("novelty", F.lit(float("inf"))), "nearest": F.coalesce("nearest", "key")})
    rest = met(known.mapInPandas(visits(False), schema))
    return best(found.unionByName(rest))


def _distance(gaps: Sequence[np.ndarray], largest: bool) -> np.ndarray:
    """Of the gaps by parameter; a missing one (null on either side) counts as 1."""
    out = None
    for g in gaps:
        g = np.where(np.isnan(g), 1.0, g)
        g = g if largest else g * g
        out = g if out is None else (np.maximum(out, g) if largest else out + g)
    return out if largest else np.sqrt(out / len(gaps))


def novelty(points: DataFrame, refs: DataFrame, family: str, key: str, parameters: str, ranges: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(key, novelty): least root-mean-square distance to the other references of the family."""
    return nearest(points, refs, family, key, parameters, ranges).select("key", "novelty")


def raw_regret(m: Callable[[str], Column]) -> Column:
    """Of metrics by name (type1_error, coverage, invalidity, bias, rmse, calibration_error, power, cost). Validity goes
    first: from .25 on a method is worse than any valid one. All numbers are fixed values."""
    over = lambda x, scale: F.greatest(F.lit(0.0), x) / scale
    invalid = F.greatest(m("invalidity"), over(m("type1_error") - 0.06, 0.19), over(0.90 - m("coverage"), 0.35))
    part = lambda x, most, weight: weight * F.least(x, F.lit(most)) / most
    error = part(F.abs(m("bias")), 1.0, 0.42) + part(m("rmse"), 1.5, 0.34) + part(m("calibration_error"), 0.5, 0.24)
    return F.when(invalid >= 0.25, 2.0 + invalid + 0.10 * error + 0.02 * m("cost")).otherwise(error + 0.18 * (1.0 - m("power")) + 0.05 * m("cost"))


def learning_signal(parent: Column, candidate: Column) -> Column:
    """A half plus a quarter of the squashed relative gain over the parent's regret (fixed values)."""
    gain = (parent - candidate) / F.greatest(F.lit(0.05), parent)
    return 0.5 + 0.25 * F.tanh(gain / 0.25)


def frontier_reward(regret: Column, target: float, sigma: float, *more: Column) -> Column:
    """Bell around a target regret, times further factors."""
    out = F.exp(-((regret - target) ** 2) / (2.0 * sigma * sigma))
    for m in more:
        out = out * m
    return out


def relative_improvement(before: Column, after: Column) -> Column:
    """(before - after) / before, 0 where before is 0."""
    return F.when(before != 0, (before - after) / before).otherwise(0.0)


def excess_loss(student: Column, teacher: Column) -> Column:
    """Of two arrays of token losses: a struct of the mean losses, the mean difference, the mean of its positive part
    (mass), the share of tokens above, and utility = mass / (1 + teacher) + .02 * student (fixed values).
    Arrays of unequal length or without tokens give null."""
    n = F.size(student)
    delta = F.zip_with(student, teacher, lambda s, t: s - t)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / n
    mass, s, t = mean(F.transform(delta, lambda x: F.greatest(x, F.lit(0.0)))), mean(student), mean(teacher)
    share = F.size(F.filter(delta, lambda x: x > 0)) / n
    made = F.struct(s.alias("student"), t.alias("teacher"), mean(delta).alias("mean_excess"), mass.alias("mass"), share.alias("positive_share"), (mass / (1 + t) + 0.02 * s).alias("utility"))
    return F.when((n > 0) & (n == F.size(teacher)), made)


def triggered_target(df: DataFrame, keys: Sequence[str], parent: str, oracle: str, regret: str, valid: str, role: str, threshold: float, floor: float, ceiling: float, invalid_pull: float) -> DataFrame:
    """Parent probabilities drawn to the oracle's where the role is `repair` and the oracle expects less regret. The pull
    rises from floor to ceiling between the threshold and regret 1 of the parent's expected regret; it is at
    least invalid_pull where the parent's most probable candidate (first by method) is invalid, and never
    above the ceiling. Anchors keep the parent. Adds `pull` and `target`; one line per key and `method`."""
    w = _over(*keys)
    total = lambda c: F.sum(c).over(w)
    p, q = F.col(parent) / total(F.col(parent)), F.col(oracle) / total(F.col(oracle))
    d = df.withColumns({"__p": p, "__q": q})
    mine, best = total(F.col("__p") * F.col(regret)), total(F.col("__q") * F.col(regret))
    top = F.first(valid).over(w.orderBy(F.desc("__p"), "method").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mine - threshold) / (1 - threshold)))
    pull = floor + (ceiling - floor) * progress
    pull = F.least(F.lit(ceiling), F.when(~top, F.greatest(pull, F.lit(invalid_pull))).otherwise(pull))
    d = d.withColumn("pull", F.when((F.col(role) == "repair") & (best < mine - 1e-12), pull).otherwise(0.0))
    return d.withColumn("target", (1 - F.col("pull")) * F.col("__p") + F.col("pull") * F.col("__q")).drop("__p", "__q")


def kept_if_no_worse(df: DataFrame, keys: Sequence[str], parent: str, target: str, regret: str, slack: float = 1e-10) -> DataFrame:
    """Per key the target, or the parent where the target's expected regret is larger by more than the slack; adds
    `taken` and the probability `kept`."""
    w = _over(*keys)
    taken = F.sum(F.col(target) * F.col(regret)).over(w) <= F.sum(F.col(parent) * F.col(regret)).over(w) + slack
    return df.withColumn("taken", taken).withColumn("kept", F.when(F.col("taken"), F.col(target)).otherwise(F.col(parent)))


def trigger_summary(df: DataFrame, group: str, view: str, family: str, expected: str, invalid: str, views: int = 4) -> DataFrame:
    """(group, n_views, n_families, most_expected, any_invalid, complete): complete groups have exactly `views`
    different views, each once, of one family."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(view).alias("n_views"), F.countDistinct(family).alias("n_families"), F.max(expected).alias("most_expected"), F.max(F.col(invalid)).alias("any_invalid"))
    return g.withColumn("complete", (F.col("n_rows") == views) & (F.col("n_views") == views) & (F.col("n_families") == 1)).drop("n_rows")


def arms(df: DataFrame, target_of: Mapping[str, Column], regret: str, keys: Sequence[str], weight: str) -> DataFrame:
    """Every record under every arm: its target, the expected regret of that target, and the weight. Few arms."""
    per = F.array(*[F.struct(F.lit(a).alias("arm"), t.cast("double").alias("target")) for a, t in target_of.items()])
    d = df.withColumn("__a", F.explode(per)).select(*df.columns, "__a.arm", "__a.target")
    return d.withColumn("expected_regret", F.sum(F.col("target") * F.col(regret)).over(_over(*keys, "arm"))).withColumn("arm_weight", F.col(weight))


def regret_vector(ids: Column, regrets: Column, clarify: str = "needs_clarification") -> Column:
    """Regrets in the order of a menu; the request for clarification costs 1, a candidate without one null."""
    return F.transform(ids, lambda i: F.when(i == clarify, 1.0).otherwise(F.try_element_at(regrets, i)))


#: Points of a parameter's range that a level pushes to (the main key, a second one), and of the
#: sample's size, from above.
BOUNDARY = {1: (0.82, 0.82, 0.20), 2: (0.96, 0.82, 0.08)}


def boundary(parameters: Column, low: Column, high: Column, whole: Column, level: int, key: Column, second: Column, low_risk: Sequence[str], size: Column) -> Column:
    """A point moved to the boundary of what a family assumes: the main key, and the second where there is one, to
    high points of their ranges (to low ones for parameters of which low values are the risk), the size of
    the sample to a low one. Whole numbers are rounded, at least 2. Other parameters stay."""
    main, other, small = BOUNDARY[level]

    def push(k: Column, v: Column) -> Column:
        lo, hi = F.try_element_at(low, k), F.try_element_at(high, k)
        at = F.when(k == size, 1 - small).when(k == second, other).when(k == key, main)
        at = F.when(k.isin(list(low_risk)), 1 - at).otherwise(at)
        new = lo + at * (hi - lo)
        new = F.when(F.coalesce(F.try_element_at(whole, k), F.lit(False)), F.greatest(F.round(new), F.lit(2.0))).otherwise(new)
        return F.when(at.isNull() | lo.isNull(), v).otherwise(new)

    return F.transform_values(parameters, push)
