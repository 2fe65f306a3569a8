import json
import random

import pytest
from pyspark.sql import functions as F

from lodestat.functions import text as X
from lodestat.functions.keys import code_key, id_key
from lodestat.operators.components import connected_components
from lodestat.operators.nested import flatten, nested_rows
from lodestat.operators.ordering import group_rank, hash_order, running_total


def test_keys(spark):
    rows = spark.createDataFrame([(" A-b ",), ("　x ",), ("  ",), (None,)], "v string")
    got = [tuple(r) for r in rows.select(id_key(F.col("v")), code_key(F.col("v"))).collect()]
    assert got == [("a-b", "a_b"), ("x", "x"), (None, None), (None, None)]


def test_running_total_with_a_hot_group_and_ties(spark):
    rows = [("hot", i, float(i % 3)) for i in range(300)] + [("cold", 1, 2.0), (None, 5, 1.0), (None, 6, 1.0)]
    df = spark.createDataFrame(rows, "g string, id int, v double").withColumn("h", hash_order(1, F.col("id")))
    out = running_total(df, ["g"], "h", F.col("v"), "upto", tie=["id"], slices=16).collect()
    assert len(out) == len(rows)
    by = {}
    for r in sorted(out, key=lambda r: (str(r["g"]), r["h"], r["id"])):
        by[r["g"]] = by.get(r["g"], 0.0) + r["v"]
        assert r["upto"] == pytest.approx(by[r["g"]])
    ranks = group_rank(df, ["g"], "h", tie=["id"]).collect()
    assert sorted(r["rank"] for r in ranks if r["g"] == "hot") == list(range(1, 301))
    assert sorted(r["rank"] for r in ranks if r["g"] is None) == [1, 2]
    assert running_total(df.where("id < 0"), ["g"], "h", F.col("v"), "upto").count() == 0


def _components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(80):03}", f"n{rng.randrange(80):03}") for _ in range(60)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [(None, "a"), ("z", "z")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == _components(edges)
    assert {r["node"]: r["component"] for r in connected_components(df, "a", "b", least_rows=5).collect()} == got
    assert connected_components(df.where("false"), "a", "b").count() == 0


def _brute(text, wrapper="report"):
    if not text or not text.strip():
        return None
    try:
        v = json.loads(text)
        while True:
            if isinstance(v, str):
                v = json.loads(v)
            elif isinstance(v, dict) and isinstance(v.get(wrapper), (dict, str)):
                v = v[wrapper]
            else:
                return v
    except ValueError:
        return None


def _value(rng, depth):
    kind = rng.randrange(8 if depth else 5)
    if kind == 0:
        return rng.choice([0, -3, 1.5, 2e-7, 10**20])
    if kind == 1:
        return rng.choice([True, False, None])
    if kind in (2, 3, 4):
        return rng.choice(["", "x", 'q"uo\\te', "[{,:}]", "中文 \U0001f600", "line\nbreak\t", "\\\\"])
    if kind == 5:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "report", 'k"y']): _value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_flatten_against_json_library():
    rng = random.Random(5)
    texts = []
    for i in range(600):
        v = {"a": [_value(rng, 3) for _ in range(rng.randrange(4))], "b": {"c": _value(rng, 2)}, "k": _value(rng, 3)}
        t = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            t = json.dumps(rng.choice([t, {"report": json.loads(t)}, {"report": t}]) if t[0] != '"' else t)
        if rng.random() < 0.25:
            cut = rng.randrange(len(t))
            t = rng.choice([t[:cut], t[:cut] + rng.choice('{}[],:"x\\ ') + t[cut:], t[:cut] + t[cut + 1 :]])
        texts.append(t)
    texts += [None, "", "  ", "null", "[]", '""', "nope", "1", "{} {}", "[1,]", '{"a":}', "[1 2]", '{"a":[1,{"c":2}]}']
    want = []
    for i, t in enumerate(texts):
        v = _brute(t)
        if not isinstance(v, dict):
            continue
        if isinstance(v.get("a"), list):
            want += [(i, "a[]", n) for n in range(len(v["a"]))]
        if isinstance(v.get("b"), dict) and "c" in v["b"]:
            want.append((i, "b.c", 0))
    got = [(r[0], r[1], r[4]) for r in flatten(texts, ["a[]", "b.c"], "report")]
    assert sorted(got) == sorted(want)


def test_nested_rows_links_and_empty_table(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, null, {"b": "x"}], "pos": 1}', "other"), (None, "[", "z"), (3, None, "y")], "id bigint, text string, pos string")
    rows = nested_rows(df, "text", ["id"], ["a[]", "a[].b"]).collect()
    tops = {r["node"]: r["pos"] for r in rows if r["path"] == "a[]"}
    assert sorted(tops.values()) == [0, 1, 2]
    assert sorted((tops[r["parent_node"]], r["kind"], r["value"]) for r in rows if r["path"] == "a[].b") == [(0, "number", "1"), (2, "string", "x")]
    assert nested_rows(df.where("false"), "text", ["id"], ["a[]"]).count() == 0


def test_text_functions(spark):
    t = "We use $x = 2 + 3$ and\n```python\nprint(1)  \n```\nresult 3.5, C++17, x2 and -4e-3"
    df = spark.createDataFrame([(t, "A  B c D")], "t string, w string")
    r = df.select(X.code_blocks(F.col("t")).alias("code"), X.formulas(F.col("t")).alias("math"), X.numbers(F.col("t")).alias("nums"), X.word_ngrams(F.col("w"), 2).alias("grams"), X.word_ngrams(F.col("w"), 5).alias("none"), X.char_ngrams(F.lit("abc"), 2, 3).alias("chars"), X.normalize_text(F.lit(" Ｆｕｌｌ  Width ")).alias("norm")).first()
    assert r["code"] == ["print(1)"] and r["math"] == ["x=2+3"]
    assert r["nums"] == ["2", "3", "1", "3.5", "17", "-4e-3"]
    assert r["grams"] == ["a b", "b c", "c d"] and r["none"] == [] and r["chars"] == ["ab", "bc", "abc"] and r["norm"] == "full width"


def test_preservation(spark):
    df = spark.createDataFrame([("a $x$ 1", "b $x$ 1"), ("a $x$ 1", "b $y$ 2")], "a string, b string")
    got = [r[0] for r in df.select(X.preservation_errors(F.col("a"), F.col("b"))).collect()]
    assert got == [[], ["formulas changed", "numbers changed"]]
