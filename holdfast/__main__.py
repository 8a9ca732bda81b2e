"""python -m holdfast: write the splits of a table, or list the families and queries.

    python -m holdfast splits --input T.parquet --output DIR --config C.json [--splits F ...] [--skip-splits F ...]
    python -m holdfast splits --list-splits
    python -m holdfast query NAME --data SF_DIR --output DIR
    python -m holdfast query --list

The config maps a dataset to its families and their options, such as
{"orders": {"time": {"date": "o_orderdate", "groups": ["o_custkey"]}, "random_grouped": {"key": "o_custkey"}}}.
Each family goes to DIR/<dataset>/<family>, as train, val and test with a manifest.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from holdfast.plans import splits
from holdfast.sources import io

TABLE_FAMILIES = {"time": splits.time_split, "random_grouped": splits.random_grouped_split}


def options_of(own: dict) -> dict:
    out = dict(own)
    if "fractions" in out:
        out["fractions"] = splits.Fractions(**out["fractions"])
    return out


def write_splits(spark: SparkSession, source: str, output: str, config: dict, only: list[str] | None, skip: list[str]) -> list[str]:
    """Every dataset and family that the config names, of those wanted; returns the folders written. A family that leaks a group is an error."""
    done = []
    for dataset, family in splits.dispatch(config, only or list(TABLE_FAMILIES)):
        if family in skip or family not in TABLE_FAMILIES:
            continue
        own = options_of(config[dataset][family])
        got = TABLE_FAMILIES[family](spark.read.parquet(source), **own)
        keys = own.get("groups") or ([own["key"]] if "key" in own else [])
        if keys and splits.leaks(got.withColumn("_key", F.to_json(F.struct(*keys))), "_key").limit(1).count():
            raise ValueError(f"{dataset}, {family}: a group is in two splits")
        path = f"{output}/{dataset}/{family}"
        io.write_named_splits(got, path, {"source": source, "family": family, "options": config[dataset][family], "rows": {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}})
        done.append(path)
    return done


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="holdfast", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("splits")
    for name in ("--input", "--output", "--config"):
        s.add_argument(name)
    s.add_argument("--splits", nargs="*", choices=sorted(TABLE_FAMILIES))
    s.add_argument("--skip-splits", nargs="*", default=[])
    s.add_argument("--list-splits", action="store_true")
    q = commands.add_parser("query")
    q.add_argument("name", nargs="?")
    q.add_argument("--data")
    q.add_argument("--output")
    q.add_argument("--list", action="store_true")
    args = parser.parse_args(argv)

    if args.command == "splits":
        if args.list_splits:
            print("\n".join(sorted(TABLE_FAMILIES)))
            return
        spark = SparkSession.builder.appName("holdfast").getOrCreate()
        print("\n".join(write_splits(spark, args.input, args.output, json.loads(Path(args.config).read_text()), args.splits, args.skip_splits)))
        return
    from holdfast.plans.catalog import QUERIES

    if args.list or not args.name:
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("holdfast").getOrCreate()
    QUERIES[args.name](spark, args.data).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
