"""``python -m narrata build|evaluate``; submit with Spark's own settings on a cluster."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from narrata.operators import packets
from narrata.plans import build
from narrata.sources import files


def main() -> None:
    parser = argparse.ArgumentParser(prog="narrata", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="curate raw reports into leakage-safe splits")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--license")
    b.add_argument("--config")
    b.add_argument("--resume", help="folder of the stages; a run that failed is taken up there")
    e = commands.add_parser("evaluate", help="score saved outputs of two models")
    e.add_argument("--eval", required=True)
    e.add_argument("--predictions", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--limit", type=int)
    e.add_argument("--seed", type=int, default=42)
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        build.build(spark, args.input, args.output, args.license, files.read_config(args.config) if args.config else None, args.resume)
        return
    if args.limit is not None and args.limit <= 0:
        parser.error("--limit must be positive")
    rows = files.read_jsonl(spark, args.eval, "report_id string, narrative string, gold_text string, near_miss_gold boolean")
    side = "struct<text string, tokens int>"
    told = files.read_jsonl(spark, args.predictions, f"report_id string, base {side}, adapter {side}")
    if args.limit:
        rows = rows.orderBy("report_id").limit(args.limit)
        told = told.join(rows.select("report_id"), "report_id", "left_semi")
    scores, table, gates = build.evaluate(rows, told, smoke=bool(args.limit))
    files.write_jsonl(scores, f"{args.output}/scores")
    files.write_jsonl(table, f"{args.output}/metrics")
    files.write_jsonl(gates, f"{args.output}/gates")
    packets.report_lines(table, gates).coalesce(1).orderBy("place").select("line").write.text(f"{args.output}/report")
    for name, blocks in (("rubric", packets.rubric_packet(rows, told, scores, args.seed)), ("lessons", packets.lesson_packet(rows, told, args.seed))):
        blocks.orderBy("rank").select("block").write.text(f"{args.output}/{name}")


if __name__ == "__main__":
    main()
