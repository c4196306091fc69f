"""Runs a program: python -m millrace PROGRAM [--batch] [--config FILE --section NAME] [--input PATH] ..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from millrace.plans.programs import PROGRAMS, lines_of
from millrace.sinks.writers import console
from millrace.sources.config import from_args
from millrace.streaming.jobs import state_settings


def main(argv: list[str]) -> None:
    if not argv or argv[0] not in PROGRAMS:
        sys.exit(f"{__doc__}\nPrograms: {', '.join(PROGRAMS)}")
    program, rest = PROGRAMS[argv[0]], [a for a in argv[1:] if a != "--batch"]
    config, batch = from_args(rest), "--batch" in argv
    spark = SparkSession.builder.appName(argv[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    state_settings(spark)
    results = program(lines_of(spark, config, streaming=not batch), config)
    if batch:
        for name, df in results.items():
            print(name)
            df.show(100, truncate=False)
        return
    mode = "update" if argv[0] == "word_count" else "append"
    for name, df in results.items():
        console(df, mode, name, f"{config.checkpoint}/{name}" if config.checkpoint else None)
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
