"""python tests/try_queries.py SF NAME...: run queries and hold them against their SQL."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
import __spark_entry__ as entry
from compare import compare
from pyspark.sql import SparkSession

if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names, bad = f"/root/testdata/{sys.argv[1]}", sys.argv[2:], 0
    q, o = entry.queries(), entry.oracle_sql()
    for name in names or q:
        t = time.time()
        try:
            df = q[name](spark, sf)
            said = compare(df, o[name], sf) if name in o else f"rows {df.count()}"
        except Exception as e:
            said = f"ERROR {str(e)[:1500]}"
        bad += bool(said) and name in o
        print(f"{name}: {'ok' if not said else said[:1800]} ({time.time() - t:.1f} s)", flush=True)
    print("different:", bad)
