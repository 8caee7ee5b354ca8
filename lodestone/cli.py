"""Command line: seed a collection from a folder of markdown, or run a golden set against one.

python -m lodestone.cli seed FOLDER --root ROOT --collection KEY --tenant TENANT
python -m lodestone.cli eval FILE --root ROOT --tenant TENANT
python -m lodestone.cli healthcheck --root ROOT
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .runtime import ship
from .sources.documents import markdown_folder


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("command", choices=["seed", "eval", "healthcheck"])
    parser.add_argument("path", nargs="?")
    parser.add_argument("--root", required=True)
    parser.add_argument("--collection")
    parser.add_argument("--tenant")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    engine = Engine(spark, a.root)
    if a.command == "healthcheck":
        health = engine.health()
        print(json.dumps(health))
        return int(not all(health.values()))
    if not (a.path and a.tenant):
        parser.error(f"{a.command} needs a path and --tenant")
    if a.command == "seed":
        if not a.collection:
            parser.error("seed needs --collection")
        engine.upsert_collection(a.tenant, a.collection)
        report = engine.upsert_documents(a.tenant, a.collection, markdown_folder(spark, a.path))
        told = report.agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changed"), F.count_if(F.col("status") != 200).alias("failed")).first().asDict()
        print(json.dumps(told))
        return int(told["failed"] > 0)
    golden = spark.read.text(a.path, wholetext=True).first()[0]
    golden = json.loads(golden)
    report, _ = engine.evaluate(a.tenant, golden["collection"], golden["cases"], golden.get("locale"), golden.get("mode"))
    print(json.dumps(report))
    return 0 if report["meets"] else 1


if __name__ == "__main__":
    sys.exit(main())
