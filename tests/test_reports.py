import json

from lodestat.plans import reports as R


def _payloads():
    dev = {"cycles": [{"cycle": 4, "validation": {"candidate": {"normalized_regret": "0.25"}}}, {"cycle": 2, "validation": {"candidate": [None, {"normalized_regret": 1}, {"normalized_regret": None}, {"normalized_regret": "NaN"}, {"normalized_regret": True}, 3, {"normalized_regret": " 1e-3 "}]}}, {"cycle": 3, "validation": None}, {}, None]}
    man = {"manifest": {"split": "v4", "seed": 7}, "groups": [{"manifest": {"split": "inner"}}]}
    return [
        (1, "development", json.dumps(dev, indent=1)),
        (2, "family-router-replication", json.dumps({"received": "x", "report": man})),
        (3, "family-router-replication", json.dumps(json.dumps({"report": json.dumps(man)}))),
        (4, "family-router-replication", json.dumps({"manifest": {"split": None}})),
        (5, "family-experts", json.dumps({"selection": {"selection_surfaces": ["a", None, {"name": "b", "count": 2}]}})),
        (6, "family-experts", json.dumps({"selection": {"selection_surfaces": "solo"}, "historical": {"selection_surfaces": ["x"]}})),
        (7, "development", json.dumps(dev)[:-5]),
        (8, None, None),
        (9, "family-experts", ""),
        (10, "family-experts", "[]"),
        (11, "family-experts", json.dumps(man)),
    ]


def test_found_and_links(spark):
    df = spark.createDataFrame(_payloads(), "report_id bigint, report_kind string, payload string")
    nodes = R.report_nodes(df).cache()
    got = sorted(map(tuple, R.found(nodes).collect()))
    assert got == [
        (1, "candidate", 2, 1),
        (1, "candidate", 2, 6),
        (1, "candidate", 4, 0),
        (2, "manifest", 0, 0),
        (3, "manifest", 0, 0),
        (5, "surface", 0, 0),
        (5, "surface", 0, 2),
        (6, "surface", 0, 0),
    ]
    cycles = {r["cycle_node"]: r["cycle"] for r in R.cycles(nodes).collect() if r["report_id"] == 1}
    assert sorted(v for v in cycles.values() if v) == [2, 3, 4]
    assert all(cycles[r["cycle_node"]] == r["cycle"] for r in R.candidates(nodes).collect())
    assert sorted((r["report_id"], r["surface"], r["rows"]) for r in R.surfaces(nodes).collect()) == [(5, "a", None), (5, "b", 2), (6, "solo", None)]
    assert {r["report_id"]: r["split"] for r in R.manifests(nodes).collect()} == {2: "v4", 3: "v4", 4: None, 11: "v4"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "report_id bigint, report_kind string, payload string")
    assert R.found(R.report_nodes(df)).count() == 0
