"""Strings of evaluation splits that are nearly equal to strings of the training split (problem 6).

An edit-distance segment join: an evaluation string is cut into k + 1 segments; a training string within k
edits holds at least one of them, at a place that the edits before and behind it allow. Only such
substrings of the training strings are looked up, and the pairs met are verified by banded dynamic
programming. Strings too short to be cut meet by what is left when up to k characters are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.operators.skew import LEAST, both_salted_join, hot_keys
from lodestat.session import cut


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 segments of about equal size; the longer ones come last."""
    n = k + 1
    size, more = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        own = size + (i >= n - more)
        out.append((at, own))
        at += own
    return out


def _deleted(s: str, k: int) -> set[str]:
    return {"".join(c for i, c in enumerate(s) if i not in gone) for d in range(min(k, len(s)) + 1) for gone in map(set, combinations(range(len(s)), d))}


def evaluation_signs(s: str, k: int) -> set[str]:
    if len(s) <= k:
        return {f"d|{v}" for v in _deleted(s, k)}
    return {f"{len(s)}|{i}|{s[a : a + n]}" for i, (a, n) in enumerate(cuts(len(s), k))}


def training_signs(s: str, k: int) -> set[str]:
    """Substrings at the places where a segment of a string within k edits may lie: before segment i lie at most i
    edits, behind it at most k - i, so it is moved by no more than that."""
    out = {f"d|{v}" for v in _deleted(s, k)} if len(s) <= 2 * k else set()
    for length in range(max(k + 1, len(s) - k), len(s) + k + 1):
        gap = len(s) - length
        for i, (a, n) in enumerate(cuts(length, k)):
            for move in range(max(-i, gap - (k - i)), min(i, gap + (k - i)) + 1):
                at = a + move
                if 0 <= at and at + n <= len(s):
                    out.add(f"{length}|{i}|{s[at : at + n]}")
    return out


def _signed(classes: DataFrame, k: int, training: bool) -> DataFrame:
    """(class, sign): a row per sign of each class; signs as 64-bit hashes."""
    kind = classes.schema["class"].dataType.simpleString()
    signs = training_signs if training else evaluation_signs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                for v in signs(s, k):
                    at.append(i)
                    out.append(xxhash.xxh3_64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.int64())], ["class", "sign"])

    return classes.select("class", "text").mapInArrow(run, f"class {kind}, sign bigint")


def near_strings(rows: DataFrame, key: str, text: str, is_train: Column, k: int = 2, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (class_a, class_b, distance) of equal or nearly equal strings, a in training, b not,
    and the members (key, is_train, class) of all classes. A class is a string on one side, named by its
    smallest key; copies are not expanded. Null strings and rows with a null side are left out; empty
    strings are strings. Signs many strings share are spread over slots; no candidate is dropped."""
    d = rows.select(F.col(key), F.col(text).alias("text"), is_train.alias("is_train")).where("text IS NOT NULL AND is_train IS NOT NULL")
    members = cut(d.withColumn("h", F.unhex(F.sha2("text", 256))).select(key, "is_train", "h", "text"))
    classes = cut(members.groupBy("h", "is_train").agg(F.min(key).alias("class"), F.first("text").alias("text")))
    a = cut(_signed(classes.where("is_train"), k, True).withColumnRenamed("class", "class_a"))
    b = cut(_signed(classes.where("NOT is_train"), k, False).withColumnRenamed("class", "class_b"))
    hot = [hot_keys(x.groupBy("sign").agg(F.count(F.lit(1)).alias("n")), ["sign"], least=least) for x in (a, b)]
    met = both_salted_join(a, b, ["sign"], F.col("class_a"), F.col("class_b"), *hot).select("class_a", "class_b").distinct()
    texts = lambda side, c, t: classes.where(side).select(F.col("class").alias(c), F.col("text").alias(t))
    both = met.join(texts("is_train", "class_a", "ta"), "class_a").join(texts("NOT is_train", "class_b", "tb"), "class_b")
    pairs = both.withColumn("distance", F.levenshtein("ta", "tb", k)).where("distance >= 0").select("class_a", "class_b", "distance")
    named = classes.select("h", "is_train", "class")
    return pairs, members.drop("text").join(named, ["h", "is_train"]).select(key, "is_train", "class")
