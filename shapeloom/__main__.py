"""Command line: version, inspect, validate, infer.

    python -m shapeloom inspect --shapes shapes.ttl
    python -m shapeloom validate --data data.ttl --shapes shapes.ttl [--mode union] [--minimum Info] [--no-infer] [--format text]
    python -m shapeloom infer --data data.ttl --shapes shapes.ttl
"""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shapeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("inspect", "validate", "infer"):
        c = commands.add_parser(name)
        c.add_argument("--shapes", action="append", required=True)
        if name != "inspect":
            c.add_argument("--data", action="append", required=True)
        if name == "validate":
            c.add_argument("--mode", choices=("data", "union", "union-all"), default="union")
            c.add_argument("--minimum", choices=("Info", "Warning", "Violation"), default="Info")
            c.add_argument("--no-infer", action="store_true")
            c.add_argument("--format", choices=("text", "json"), default="text")
    a = parser.parse_args(args)
    if a.command == "version":
        print(VERSION)
        return 0
    from shapeloom import api

    shapes = api.load(a.shapes)
    if a.command == "inspect":
        print(inspect(shapes), end="")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("shapeloom").getOrCreate()
    data = api.TripleTable.of(spark, api.load(a.data))
    if a.command == "infer":
        for r in api.infer(spark, data, shapes).all().orderBy("s", "p", "o").toLocalIterator():
            print(f"{r.s} {r.p} {r.o} .")
        return 0
    if not a.no_infer:
        data = data.union(api.infer(spark, data, shapes))
    result = api.Validator(spark, shapes).validate(data, a.mode, a.minimum)
    rows = [r.asDict() for r in result.rows.orderBy("focus", "source_shape", "component").toLocalIterator()]
    for d in result.diagnostics:
        print(f"diagnostic: {d}", file=sys.stderr)
    if a.format == "json":
        print(json.dumps({"conforms": result.conforms, "results": rows}, ensure_ascii=False))
    else:
        print("conforms" if result.conforms else "does not conform")
        for r in rows:
            print(f"{r['severity']} {r['focus']} {r['path'] or '-'} {r['value'] or '-'} {r['component']}: {r['message']}")
    return 0 if result.conforms else 1


def inspect(graph) -> str:
    """Shapes in normal form with their targets, in the order of their strata."""
    from shapeloom.plans.shapes import lower, normalize, render, strata

    schema = lower(graph)
    out = [f"diagnostic: {d}\n" for d in schema.diagnostics]
    for k, part in enumerate(strata(schema)):
        for name in sorted(part):
            targets = ", ".join(f"{t.kind} {t.term}" for t in schema.shapes[name].targets) or "no target"
            out.append(f"[{k}] {name} ({targets}): {render(normalize(schema.formula(name)))}\n")
    return "".join(out)


if __name__ == "__main__":
    sys.exit(main())
