"""CLI: python tests/check_oracles.py [--plain] [sf_dir] [name ...] -- Spark vs DuckDB per query.

``--plain`` uses a bare session like an external driver would (no caseflow defaults:
session time zone +05:30, ANSI off, default shuffle partitions, no checkpoint dir)."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import compare, duck, spark_pdf  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from caseflow.session import get_session  # noqa: E402


def main():
    args = [a for a in sys.argv[1:] if a != "--plain"]
    plain = "--plain" in sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    if plain:
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false")
                 .config("spark.sql.session.timeZone", "Asia/Kolkata")
                 .config("spark.sql.ansi.enabled", "false").getOrCreate())
    else:
        spark = get_session("local[8]", 8)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            sp = spark_pdf(df)
            ts = time.time() - t
            if name in orc:
                ok, msg = compare(sp, duck(orc[name], sf_dir))
            else:
                ok, msg = True, f"{len(sp)} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg, ts = False, f"ERROR {type(e).__name__}: {str(e)[:400]}", time.time() - t
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:40s} {ts:6.2f}s  {msg}", flush=True)
    print(f"{bad} failing", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
