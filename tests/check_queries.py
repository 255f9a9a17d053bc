"""Run registered queries against their oracles: python tests/check_queries.py [sf] [name-part ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from compare import connect, differences  # noqa: E402


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("CHECK_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, bad = oracle_sql(), 0
    for name, run in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problems = differences(con, df, oracles[name])
                note = f"{df.count()} rows" if not problems else ""
            else:
                problems, note = [], f"{df.count()} rows, no oracle"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {note}", flush=True)
        for line in problems[:4]:
            print("     ", line[:900], flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
