"""Command line: ``python -m evaquery validate|reexport|queries``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    spark = SparkSession.builder.appName("evaquery").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def validate(args: argparse.Namespace) -> int:
    """Errors of each document by path; 2 if there are any."""
    from .operators.dq import schema_errors

    with open(args.schema, encoding="utf-8") as f:
        schema = json.load(f)
    docs = session().read.text(args.model, wholetext=True).select(F.input_file_name().alias("file"), "value")
    found = schema_errors(docs, "file", "value", schema, args.max_errors).orderBy("file", "n").collect()
    for e in found:
        print(f"{e['file']}: {e['path']} {e['message']}")
    print(f"{len(found)} errors shown" if found else "valid")
    return 2 if found else 0


def rebuild(args: argparse.Namespace) -> int:
    """Writes the models that the documents' source features describe, built anew, a line each."""
    from .plans import builder, reexport
    from .sources import documents, sinks
    from .sources.storage import stored

    spark = session()
    kept = documents.source_features(spark, args.model)
    if kept.isEmpty():
        print("no source features: nothing to build from", file=sys.stderr)
        return 1
    cells, bounds = (stored(x) for x in reexport.rebuilt(stored(kept)))
    nodes, edges = builder.dual(cells, bounds, args.edge_mode)
    of = cells.select("cell", "model")
    rows = [
        cells.withColumnRenamed("cell", "id"), bounds.join(of.withColumnRenamed("cell", "a"), "a").withColumnRenamed("boundary", "id"),
        nodes.join(of, "cell").withColumnRenamed("node", "id"), edges.join(of.withColumnRenamed("cell", "a"), "a").withColumnRenamed("edge", "id"),
    ]
    sinks.model_json(*rows, by="model").select("value").write.mode("overwrite").text(args.out)
    return 0


def queries(args: argparse.Namespace) -> int:
    """Names of the queries, or the result of one over a folder of tables."""
    from . import catalog

    if args.name is None:
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    catalog.QUERIES[args.name](session(), args.tables).show(args.rows, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evaquery", description=__doc__)
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("validate", help=validate.__doc__)
    one.add_argument("model")
    one.add_argument("--schema", required=True)
    one.add_argument("--max-errors", type=int, default=80)
    one.set_defaults(run=validate)
    two = commands.add_parser("reexport", help=rebuild.__doc__)
    two.add_argument("model")
    two.add_argument("out")
    two.add_argument("--edge-mode", choices=("navigation", "all_adjacency"), default="navigation")
    two.set_defaults(run=rebuild)
    three = commands.add_parser("queries", help=queries.__doc__)
    three.add_argument("name", nargs="?")
    three.add_argument("--tables")
    three.add_argument("--rows", type=int, default=20)
    three.set_defaults(run=queries)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
