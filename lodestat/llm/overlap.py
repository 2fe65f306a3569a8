"""Same or nearly same scenarios in different splits (problem 6).

The tolerance is a largest difference of numbers, not an edit distance, so the segment join is
carried over to cells: a scenario is its vector of parameters in units of their ranges; each
parameter is one segment, its cell number the segment's content; an evaluation vector looks up
exactly the cell combinations where a vector within the tolerance can lie (one or two per
parameter), and the pairs met are verified on the numbers themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.functions.keys import code_key, id_key
from lodestat.operators.skew import LEAST, both_salted_join, hot_keys, salted_join
from lodestat.session import cut


def vectors(scenarios: DataFrame, bounds: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("valid", "dev", "final")) -> DataFrame:
    """(scenario_row, source, split, family, vec, range): rows of either side whose family has bounds
    and whose every bounded parameter is a finite number; other rows can't be near anything.

    `bounds` is a fixed table of a few lines per family; it is gathered to one line per family.
    """
    per = bounds.where("upper_bound > lower_bound").groupBy(code_key(F.col("family_id")).alias("family")).agg(F.array_sort(F.collect_set(F.struct(F.col("parameter_name").alias("name"), (F.col("upper_bound") - F.col("lower_bound")).alias("range")))).alias("params"))
    s = id_key(F.col("split"))
    d = scenarios.where(s.isin(train, *evaluation)).select("scenario_row", "source", s.alias("split"), code_key(F.col("family_id")).alias("family"), "parameters")
    d = d.join(per, "family").select("scenario_row", "source", "split", "family", F.expr("transform(params, p -> try_element_at(parameters, p.name))").alias("vec"), F.expr("transform(params, p -> p.range)").alias("range"))
    return d.where(F.expr("vec IS NOT NULL AND forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"))


def near_pairs(v: DataFrame, tolerance: float = 0.005, width: float = 0.04, segments: int = 6, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Pairs (class_a, class_b) of different or equal vectors across the two sides, and the
    membership (scenario_row, side, class, ...). Copies are joined once per class, not per row.

    No pair is lost: along each of the first `segments` parameters an evaluation vector is sent to
    every cell that the tolerance reaches (with width 0.04 it is 1.25 cells on average).
    """
    v = v.withColumn("is_train", F.col("split") == train)
    classes = v.groupBy("family", "vec", "is_train").agg(F.min("scenario_row").alias("class"), F.first("range").alias("range"))
    reach = tolerance * (1 + 1e-6) + 1e-12
    cell = lambda shift: f"cast(floor((vec[i] / range[i] + {shift!r}) / {width!r}) AS bigint)"
    dims = f"sequence(0, least(size(vec), {segments}) - 1)"
    own = F.expr(f"concat_ws(',', transform({dims}, i -> cast({cell(0.0)} AS string)))")
    combos = F.expr(
        f"aggregate(transform({dims}, i -> array_distinct(array({cell(-reach)}, {cell(reach)}))), array(''), "
        "(acc, cells) -> flatten(transform(acc, a -> transform(cells, c -> concat(a, ',', cast(c AS string))))))"
    )
    left = classes.where("is_train").select(F.col("class").alias("class_a"), "family", F.col("vec").alias("va"), "range", F.concat(F.lit(","), own).alias("cells"))
    right = classes.where("NOT is_train").select(F.col("class").alias("class_b"), F.col("family").alias("fb"), F.col("vec").alias("vb"), F.explode(combos).alias("cb"))
    met = left.join(right, (F.col("family") == F.col("fb")) & (F.col("cells") == F.col("cb")))
    close = F.expr(f"forall(sequence(0, size(va) - 1), i -> abs(va[i] - vb[i]) / range[i] <= {tolerance!r})")
    pairs = met.where(close).select("class_a", "class_b", (F.col("va") == F.col("vb")).alias("exact"))
    members = v.join(classes.select("family", "vec", "is_train", "class"), ["family", "vec", "is_train"]).select("scenario_row", "source", "split", "is_train", "class")
    return pairs, members


def row_pairs(pairs: DataFrame, members: DataFrame, least: int = LEAST) -> DataFrame:
    """(row_a, row_b) with row_a < row_b: the class pairs spread over their members; classes of many copies in slots."""
    pairs, members = cut(pairs), cut(members)
    n = members.groupBy("class", "is_train").agg(F.count(F.lit(1)).alias("n"))
    a_n = n.where("is_train").select(F.col("class").alias("class_a"), "n")
    b_n = n.where("NOT is_train").select(F.col("class").alias("class_b"), "n")
    a = members.where("is_train").select(F.col("class").alias("class_a"), F.col("scenario_row").alias("ra"))
    b = members.where("NOT is_train").select(F.col("class").alias("class_b"), F.col("scenario_row").alias("rb"))
    first = salted_join(a, pairs.select("class_a", "class_b"), ["class_a"], F.col("ra"), counts=a_n, least=least)
    loads = pairs.join(a_n, "class_a").groupBy("class_b").agg(F.sum("n").alias("n"))
    hot = hot_keys(loads, ["class_b"], least=least), hot_keys(b_n, ["class_b"], least=least)
    d = both_salted_join(first.select("class_b", "ra"), b, ["class_b"], F.col("ra"), F.col("rb"), *hot)
    return d.select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def overlap_report(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per split and source: rows, rows with an equal and with a near partner on the other side."""
    a = pairs.groupBy(F.col("class_a").alias("class")).agg(F.max("exact").alias("exact")).withColumn("is_train", F.lit(True))
    b = pairs.groupBy(F.col("class_b").alias("class")).agg(F.max("exact").alias("exact")).withColumn("is_train", F.lit(False))
    hit = a.unionByName(b)
    d = members.join(hit, ["class", "is_train"], "left")
    return d.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("exact"), 1)).alias("n_exact"), F.count(F.when(~F.col("exact"), 1)).alias("n_near"))
