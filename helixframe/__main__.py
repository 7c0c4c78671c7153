"""python -m helixframe QUERY TABLES [OUT]: run a registered query over a folder of tables."""

import sys


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    from helixframe.plans import catalog

    known = catalog.queries()
    if len(args) not in (2, 3) or args[0] not in known:
        sys.exit(f"{__doc__}\n\nqueries: {' '.join(sorted(known))}")
    frame = known[args[0]](SparkSession.builder.getOrCreate(), args[1])
    if len(args) == 3:
        frame.write.mode("overwrite").parquet(args[2])
    else:
        frame.show(50, False)


if __name__ == "__main__":
    main(sys.argv[1:])
