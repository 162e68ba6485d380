"""What the jobs share: configuration, folders, and how a run is started from the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object from a file that Spark can read, over the defaults; unknown names are an error."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    given = json.loads(text)
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return defaults | given


def main(doc: str, inputs: list, config: str, run: Callable) -> None:
    """``python -m jobs.<name> INPUT... OUT [--config FILE]``: one session for one run."""
    parser = argparse.ArgumentParser(description=doc.splitlines()[0])
    for name in inputs:
        parser.add_argument(name, help=f"path of the Parquet table {name}")
    parser.add_argument("out", help="folder of the job's output and state")
    parser.add_argument("--config", default=config, help="JSON file of settings (%(default)s)")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(parser.prog).getOrCreate()
    try:
        run(spark, *(getattr(given, n) for n in inputs), given.out, given.config)
    finally:
        spark.stop()
