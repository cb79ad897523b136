"""Time the reports and print one JSON line.

Every report runs once to warm up; then each is timed REPEATS times, built anew from the
files, and its figure is the median. Reports with the same table and output are timed
once. ``all_reports`` is all 22 sharing their work, ``rpt_channel_starts_skewed`` the
channels with a third of applications and history on one user and of installs on one id.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.queries import AS_OF
from lendlens.plans.reports import REPORTS, report, reports
from lendlens.sources.sample import sample
from lendlens.sources.tables import Sources

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))
EXTRA = ("all_reports", "rpt_channel_starts_skewed")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lendlens-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def skewed(spark: SparkSession) -> Sources:
    plain = sample(spark, SF_DIR)

    def read(relation: str) -> DataFrame:
        df = getattr(plain, relation)
        third = F.pmod(F.xxhash64("date_created"), F.lit(3)) == 0
        if "user_id_ref" in df.columns:
            df = df.withColumn("user_id_ref", F.when(third, 1).otherwise(F.col("user_id_ref")))
        if "attribution_id" in df.columns:
            hot = F.when(third, "att-0").otherwise(F.col("attribution_id"))
            df = df.withColumn("attribution_id", hot)
        return df

    return Sources(spark, read)


def run(spark: SparkSession, name: str) -> None:
    if name == "all_reports":
        with reports(sample(spark, SF_DIR), REPORTS, AS_OF) as made:
            for df in made.values():
                df.collect()
    elif name == "rpt_channel_starts_skewed":
        report(skewed(spark), "rpt_channel_starts", AS_OF).collect()
    else:
        report(sample(spark, SF_DIR), name, AS_OF).collect()


def seconds(work: Callable[[], None]) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    first_of = {made: name for name, made in reversed(REPORTS.items())}
    names = [*first_of.values(), *EXTRA]
    for name in names:
        run(spark, name)
    timings = {
        name: round(statistics.median(seconds(lambda n=name: run(spark, n)) for _ in range(REPEATS)), 4)
        for name in names
    }
    queries = {name: timings[name] for name in sorted(first_of.values())}
    print(
        json.dumps(
            {
                "metric": "total seconds over all distinct reports (warm median each)",
                "value": round(sum(queries.values()), 4),
                "unit": "sec",
                "queries": queries | {name: timings[name] for name in EXTRA},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
