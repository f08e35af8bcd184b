"""``python -m sedgeway info | ingest FOLDER | query QUESTION | eval``; exit code 1 on failure."""

from __future__ import annotations

import argparse
import sys
import uuid

from sedgeway import __version__


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="sedgeway")
    args.add_argument("--warehouse", default="sedgeway-warehouse")
    args.add_argument("--namespace", default="default")
    sub = args.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    sub.add_parser("ingest").add_argument("folder")
    sub.add_parser("query").add_argument("question")
    sub.add_parser("eval")
    got = args.parse_args(argv)
    if got.command == "info":
        print(f"sedgeway {__version__}; warehouse {got.warehouse}; namespace {got.namespace}")
        return 0
    from pyspark.sql import SparkSession

    from sedgeway.config import Scope, WarehouseConfig
    from sedgeway.operators import evaluate
    from sedgeway.plans.engine import Engine, golden_run
    from sedgeway.sources import models, shared

    spark = SparkSession.builder.appName("sedgeway").getOrCreate()
    try:
        if got.command == "eval":
            engine = Engine(spark, WarehouseConfig(f"{shared.shared_dir(spark)}/eval-{uuid.uuid4().hex}", 256))
            report = evaluate.report(golden_run(engine))
            for name, value in report.first().asDict().items():
                print(f"{name:20} {value:.3f}" if isinstance(value, float) else f"{name:20} {value}")
            failed = [r["message"] for r in evaluate.below_floor(report).collect()]
            print(*failed, sep="\n")
            return int(bool(failed))
        engine, scope = Engine(spark, WarehouseConfig(models.location(got.warehouse), 256)), Scope(got.namespace)
        if got.command == "ingest":
            for r in engine.ingest_folder(scope, got.folder).orderBy("source").toLocalIterator():
                print(f"{r['source']}: {r['error'] or ('known' if r['deduplicated'] else str(r['chunk_count']) + ' chunks')}")
            return 0
        reply = engine.ask(scope, spark.createDataFrame([(1, got.question)], "query_id long, question string")).first()
        print(reply["text"])
        return 0 if reply["outcome"] != "not_found" else 1
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
