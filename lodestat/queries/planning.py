"""Questions compiled to procedures over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestat.plans import compiler, procedures
from lodestat.sources.tables import table

#: (table, columns, question)
QUESTIONS = [
    ("lineitem", ["l_extendedprice", "l_linestatus", "l_returnflag", "l_quantity"], "Do the mean values of l_extendedprice differ between the two l_linestatus groups?"),
    ("lineitem", ["l_extendedprice", "l_linestatus", "l_returnflag", "l_quantity"], "How does l_extendedprice differ across l_returnflag?"),
    ("lineitem", ["l_extendedprice", "l_linestatus", "l_returnflag", "l_quantity"], "Is l_linestatus related to l_returnflag?"),
    ("part", ["p_retailprice", "p_size", "p_brand"], "Is p_retailprice associated with the p_size of a part, by ranks?"),
    ("predictions", ["valid", "normalized_regret", "domain"], "Is the proportion of valid predictions greater than 50%?"),
    ("customer", ["c_acctbal", "c_mktsegment", "c_nationkey"], "What is the posterior for c_acctbal under a weak prior?"),
    ("events", ["value", "event_type", "props"], "What happens?"),
]


def compile_plan(s: SparkSession, d: str) -> DataFrame:
    rows = []
    for i, (t, cols, q) in enumerate(QUESTIONS):
        for rank, p in enumerate(compiler.plans(compiler.columns(table(s, d, t).select(*cols)), q), 1):
            rows.append((i, rank, p.request.method_id, round(p.score, 3), p.ready, str(p.request.roles.get("outcome")), str(p.request.roles.get("group"))))
    return s.createDataFrame(rows, "question int, rank int, method_id string, score double, ready boolean, outcome string, `group` string")


def procedure_catalogue(s: SparkSession, d: str) -> DataFrame:
    return procedures.catalogue_frame(s).selectExpr("method_id", "array_join(roles, ',') AS roles", "needs_predictors")


def queries() -> dict:
    return {"compile_plan": compile_plan, "procedure_catalogue": procedure_catalogue}


def oracle_sql() -> dict[str, str]:
    return {}
