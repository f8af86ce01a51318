"""Check registered queries against their SQL: python tests/check_queries.py SF [name part ...]"""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from oracle import differences  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

sf, parts = sys.argv[1], sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
bad = 0
queries, sqls = entry.queries(), entry.oracle_sql()
for name in queries:
    if parts and not any(p in name for p in parts):
        continue
    start = time.time()
    try:
        if name in sqls:
            found = differences(spark, f"/root/testdata/sf{sf}", queries[name], sqls[name])
        else:
            found = [] if queries[name](spark, f"/root/testdata/sf{sf}").count() else ["no rows"]
    except Exception as e:  # noqa: BLE001
        found = [f"{type(e).__name__}: {str(e)[:400]}"]
    took = time.time() - start
    if found or took > 9:
        print(name, "ok" if not found else "FAIL", f"{took:.1f}s", *found, sep="\n   ", flush=True)
    bad += bool(found)
print(f"{bad} bad of {len([n for n in queries if not parts or any(p in n for p in parts)])}; {len(sqls)} with SQL")
