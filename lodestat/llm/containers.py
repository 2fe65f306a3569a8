"""Filling containers of fixed capacity with whole items (problem 8).

Minimum bin slack on the table of lengths: the capacity bounds the number of different lengths, so
the histogram of the corpus is small whatever its size. For a bin, a bitset of reachable sums over
the available lengths gives the fullest combination around the longest item left; the combination is
used as often as its lengths last. Items then find their bin by their rank among items of their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.operators.ordering import group_rank, hash_order
from lodestat.session import cut


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[tuple[int, int], ...]  # (length, how many of it in one bin)
    bins: int

    @property
    def fill(self) -> int:
        return sum(a * n for a, n in self.lengths)


def fullest(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within the capacity that holds the
    longest length left. `order` has the lengths left, longest first."""
    seed = order[0]
    room = capacity - seed
    chosen = {seed: 1}
    steps: list[tuple[int, int, int]] = []  # length, copies, sums reachable before it
    reach, full, bit = 1, (1 << (room + 1)) - 1, 1 << room
    for a in order:
        have = counts[a] - (a == seed)
        if a > room or have <= 0:
            continue
        have, part = min(have, room // a), 1
        while have and not reach & bit:  # copies by powers of two
            k = min(part, have)
            steps.append((a, k, reach))
            reach |= (reach << (a * k)) & full
            have -= k
            part *= 2
        if reach & bit:
            break
    at = reach.bit_length() - 1
    for a, k, before in reversed(steps):
        if not before >> at & 1:
            at -= a * k
            chosen[a] = chosen.get(a, 0) + k
    return chosen


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all items of a histogram of lengths between 1 and the capacity."""
    if any(a < 1 or a > capacity for a in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    left = {a: n for a, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        combo = fullest(left, order, capacity)
        times = min(left[a] // n for a, n in combo.items())
        out.append(Pattern(tuple(sorted(combo.items(), reverse=True)), times))
        for a, n in combo.items():
            left[a] -= n * times
        order = [a for a in order if left[a]]
    return out


def pieces(sized: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, tokens): an item within the capacity is one piece; a larger one is divided
    into full pieces and a rest, by token positions."""
    n = F.greatest(F.ceil(F.col(size) / F.lit(capacity)), F.lit(1)).cast("int")
    d = sized.select(key, size, F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return d.select(key, "piece", start.alias("start"), F.least(F.col(size) - start, F.lit(capacity)).cast("bigint").alias("tokens"))


def fill_containers(sized: DataFrame, key: str, size: str, kind: str, capacity: int, seed: int = 0) -> DataFrame:
    """(container_kind, container_no, key, piece, start, tokens), one row per piece.

    Container numbers start at 0. Items without tokens (null, empty texts) take no room: they keep
    their row with a null container_no. Only the histogram (at most `capacity` lines) reaches the
    driver, and the ranges that go back are bounded by the lengths used per pattern.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = sized.sparkSession
    p = cut(pieces(sized, key, size, capacity).withColumn("__h", hash_order(seed, F.col(key), F.col("piece"))))
    counts = {r["tokens"]: r["n"] for r in p.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines, base = [], 0
    used = dict.fromkeys(counts, 0)
    for x in pack_lengths(counts, capacity):
        for a, n in x.lengths:
            lines.append((a, used[a], used[a] + n * x.bins, n, base))
            used[a] += n * x.bins
        base += x.bins
    ranges = spark.createDataFrame(lines, "tokens bigint, lo bigint, hi bigint, per bigint, base bigint")
    ranked = group_rank(p.where("tokens > 0"), ["tokens"], "__h", "__rank", tie=[key, "piece"])
    put = ranked.join(ranges, "tokens").where("__rank > lo AND __rank <= hi")
    cols = [F.lit(kind).alias("container_kind"), F.col("container_no"), key, "piece", "start", "tokens"]
    full = put.withColumn("container_no", F.col("base") + F.floor((F.col("__rank") - 1 - F.col("lo")) / F.col("per"))).select(*cols)
    empty = p.where("tokens <= 0").withColumn("container_no", F.lit(None).cast("bigint")).select(*cols)
    return full.unionByName(empty)


def container_report(filled: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, share of room used and the fewest containers thinkable."""
    used = filled.where("container_no IS NOT NULL").groupBy("container_kind").agg(F.countDistinct("container_no").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("tokens").alias("tokens"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return used.join(specs, "container_kind").select("container_kind", "capacity_tokens", "n_containers", "n_pieces", "tokens", (F.col("tokens") / room).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"))
