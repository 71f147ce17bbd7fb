"""Command line: normalize, parse, validate, geocode one address, or ``batch`` a table."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

USAGE, CRASH = 64, 70
COMMANDS = ("normalize", "parse", "validate", "geocode", "batch")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"{self.prog}: error: {message}\n")


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="chomeflow", description="Japanese addresses: canonical text, components, validation")
    sub = top.add_subparsers(dest="command")
    for name in COMMANDS[:4]:
        p = sub.add_parser(name)
        p.add_argument("address", help="an address, or - for standard input")
        p.add_argument("--json", action="store_true")
        p.add_argument("--registry", help="JSON or Parquet file of municipalities")
        if name == "normalize":
            p.add_argument("-c", "--canonical", action="store_true")
        if name == "geocode":
            p.add_argument("--provider", default="gsi")
            p.add_argument("--timeout", type=float, default=5.0)
    b = sub.add_parser("batch", help="normalise a column of a Parquet table")
    b.add_argument("source")
    b.add_argument("target")
    b.add_argument("--column", default="address")
    b.add_argument("--registry")
    return top


def _pretty(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2)


def run(spark: SparkSession, args: argparse.Namespace, resolver=None) -> tuple[str, int]:
    """(output, exit code) of a parsed command line."""
    from chomeflow.operators.geocode import SUCCESS, geocode
    from chomeflow.plans import formats
    from chomeflow.plans.normalize import normalize
    from chomeflow.plans.validate import EXIT_CODES, validate
    from chomeflow.sources.registry import Registry

    registry = Registry(spark, args.registry) if args.registry else None
    if args.command == "batch":
        normalize(spark.read.parquet(args.source), args.column, registry=registry).write.mode("overwrite").parquet(args.target)
        return "", 0
    one = spark.createDataFrame([(args.address,)], "address string")
    if args.command == "validate":
        r = validate(one, registry=registry).select(F.col("validation.status").alias("s"), formats.to_json(F.col("validation")).alias("j"), formats.validation_text(F.col("validation")).alias("t")).first()
        return (_pretty(r["j"]) if args.json else r["t"]), EXIT_CODES[r["s"]]
    if args.command == "geocode":
        g = geocode(one, resolver, registry=registry, timeout=args.timeout)
        r = g.select(F.col("geocoded.status").alias("s"), formats.to_json(F.col("geocoded")).alias("j"), formats.geocoded_text(F.col("geocoded")).alias("t")).first()
        return (_pretty(r["j"]) if args.json else r["t"]), 0 if r["s"] == SUCCESS else 1
    n = F.col("normalized")
    text = formats.normalized_text(n) if args.command == "normalize" else formats.parsed_text(n)
    parts = F.struct(n["input_raw"].alias("raw_input"), n["components"].alias("components"), n["tier_map"].alias("tier_map"), n["confidence_score"].alias("confidence_score"))
    as_json = formats.to_json(n if args.command == "normalize" else parts)
    r = normalize(one, registry=registry).select(n["confidence_score"].alias("c"), n["canonical"].alias("canonical"), as_json.alias("j"), text.alias("t")).first()
    out = _pretty(r["j"]) if args.json else r["canonical"] if getattr(args, "canonical", False) else r["t"]
    return out, 0 if r["c"] > 0 else 1


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, resolver=None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv:
        parser().print_help()
        return 0
    if argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "normalize")
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if getattr(args, "address", None) == "-":
        args.address = sys.stdin.read().strip()
    if getattr(args, "address", "x").strip() == "":
        print("chomeflow: error: empty address", file=sys.stderr)
        return USAGE
    try:
        spark = spark or SparkSession.builder.appName("chomeflow").getOrCreate()
        out, code = run(spark, args, resolver)
    except Exception as e:  # noqa: BLE001
        print(f"chomeflow: {e}", file=sys.stderr)
        return CRASH
    if out:
        print(out)
    return code


if __name__ == "__main__":
    sys.exit(main())
