"""What the jobs share: configuration, logs and the session's settings. Files are touched through Spark alone, so every
path may be remote."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str, defaults: dict) -> dict:
    """``defaults`` with what the JSON file at ``path`` sets; a name that they lack raises."""
    row = spark.read.option("multiLine", True).json(path).first()
    given = {k: v for k, v in (row.asDict(recursive=True) if row else {}).items() if v is not None}
    if strange := set(given) - set(defaults):
        raise ValueError(f"{path} sets {', '.join(sorted(strange))}; known are {', '.join(sorted(defaults))}")
    return {**defaults, **given}


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that are put back afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def command(name: str, about: str, paths: dict[str, str], run: Callable, defaults: dict) -> None:
    """The command line of a job: its paths, a configuration file, and a session that ends with it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for k, what in paths.items():
        parser.add_argument(f"--{k}", required=True, help=what)
    parser.add_argument("--config", help="JSON file with the job's settings")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = args.pop("config")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **args, **(configured(spark, config, defaults) if config else defaults))
    finally:
        spark.stop()
