"""Run a job list over tables in a folder: python -m stressframe TABLES JOBS OUT [--form csv] [--set key=value ...]."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import templates


def settings(given: Sequence[str], environment: dict[str, str]) -> dict:
    """Settings of the environment, then those of ``--set``."""
    pairs = {f"S_{k.replace('.', '__')}": v for k, v in (g.split("=", 1) for g in given)}
    return templates.merged(templates.from_environment(environment), templates.from_environment(pairs, "S_"))


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stressframe", description=__doc__)
    parser.add_argument("tables", help="folder of Parquet tables, such as element_states.parquet")
    parser.add_argument("jobs", help="job list, JSON or YAML")
    parser.add_argument("out", help="folder for a table of each job")
    parser.add_argument("--form", choices=("csv", "json", "parquet"), default="parquet")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a default of all jobs")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("stressframe").getOrCreate()
    tables = {p.stem: spark.read.parquet(str(p)) for p in sorted(Path(given.tables).glob("*.parquet"))}
    defaults = settings(given.set, dict(os.environ))
    jobs = [templates.merged(defaults, job) for job in templates.load_jobs(Path(given.jobs).read_text())]
    for name, table in templates.run_jobs(tables, jobs).items():
        getattr(table.write.mode("overwrite"), given.form)(f"{given.out}/{name}")
        print(json.dumps({"job": name, "columns": table.columns}))


if __name__ == "__main__":
    main()
