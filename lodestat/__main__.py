"""Command line: questions about tables, and named queries.

    python -m lodestat analyze --data trial.csv --question "Does the mean score differ by arm?"
    python -m lodestat query chi_square --folder /data/sf0.1 --out /data/out
    python -m lodestat queries
"""

from __future__ import annotations

import argparse
import json
import sys

from lodestat.config import load_settings
from lodestat.operators.preprocess import AnalysisError
from lodestat.plans import compiler
from lodestat.queries import registered
from lodestat.session import local_session
from lodestat.sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestat")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="plan and run a procedure for a question")
    a.add_argument("--data", action="append", required=True, help="a table; repeat for several (joined on columns they share)")
    a.add_argument("--question", required=True)
    a.add_argument("--glossary", default="", help="a file with lines 'column: what it means'")
    a.add_argument("--settings", default="")
    q = sub.add_parser("query", help="run a named query over a folder of parquet tables")
    q.add_argument("name")
    q.add_argument("--folder", required=True)
    q.add_argument("--out", default="", help="where to write parquet; without it the plan is shown")
    sub.add_parser("queries", help="names of the queries")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(registered())))
        return 0
    spark = local_session()
    if args.command == "query":
        if args.name not in registered():
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        df = registered()[args.name](spark, args.folder)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.explain("formatted")
        return 0
    try:
        limits = load_settings(args.settings).section("inputs") if args.settings else {}
        paths = files.check_inputs(spark, args.data, **{k: limits[k] for k in ("most", "most_bytes") if k in limits})
        df = files.read_table(spark, paths[0])
        for p in paths[1:]:
            other = files.read_table(spark, p)
            shared = [c for c in df.columns if c in other.columns]
            if not shared:
                raise AnalysisError(f"{p} shares no column with the tables before it")
            df = df.join(other, shared)
        glossary = open(args.glossary, encoding="utf-8").read() if args.glossary else ""
        out = compiler.analyze(df, args.question, glossary)
    except AnalysisError as e:
        out = {"status": "error", "error": str(e)}
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 2 if out["status"] == "error" else 0


if __name__ == "__main__":
    sys.exit(main())
