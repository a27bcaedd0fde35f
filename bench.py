"""Times the headline queries; prints one line of JSON.

Data: ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1); cores: ``$BENCH_CPUS`` (default 8). Each query runs once to warm up and then
``$BENCH_RUNS`` times (default 3); the median counts. Reads end in a no-op sink, so all columns asked for are decoded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from lodestone.functions.column import Col
from lodestone.operators.stats import StatsBuilder
from lodestone.session import get_session
from lodestone.sources import files
from lodestone.sources.reader import Reader
from lodestone.sources.writer import Writer

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
RECORDS = 524_288


def main() -> None:
    spark = get_session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    table = lambda t: f"{SF_DIR}/{t}.parquet"
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    work = files.scratch(spark, "bench")
    record = spark.range(RECORDS).select(
        F.col("id").cast("int").alias("i"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("dict"),
        F.when(F.col("id") % 2 == 0, F.struct(F.rand(1).alias("fraction"), F.md5(F.col("id").cast("string")).alias("text"))).alias("embedded"),
    )
    wide = record.select("*", *[F.element_at(F.array(*map(F.lit, "xyz")), (F.floor(F.col("i") / 3**k) % 3 + 1).cast("int")).alias(c) for k, c in enumerate("abcde")])
    Reader(spark).read(table("customer")).df.select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment")).write.mode("overwrite").partitionBy("segment").parquet(f"{work}/parts")
    Writer(spark).options(page_size=32 << 10, row_group_size=64 << 10).write_and_close(f"{work}/single.parquet", record)
    count = iter(range(1 << 30))
    orders, customers = Reader(spark).read(table("orders")), Reader(spark).read(table("customer"))
    queries = {
        "full_scan": lambda: drain(Reader(spark).read(table("lineitem")).df),
        "one_column": lambda: drain(Reader(spark).projected_generic(Col("l_extendedprice")).read(table("lineitem")).df),
        "selective_filter": lambda: drain(Reader(spark).filter((Col("l_orderkey") >= 1000) & (Col("l_orderkey") < 1100)).read(table("lineitem")).df),
        "pruned_partition": lambda: drain(Reader(spark).filter(Col("segment") == "BUILDING").read(f"{work}/parts").df),
        "stats": lambda: StatsBuilder(spark).stats(table("lineitem")).summary("l_extendedprice").collect(),
        "inner_join": lambda: drain(orders.inner_join(customers, "o_custkey", "c_custkey").df),
        "full_join": lambda: drain(orders.full_join(customers, "o_custkey", "c_custkey").df),
        "concat": lambda: drain(orders.concat(orders).df),
        "partitioned_write": lambda: Writer(spark).write_dataset(f"{work}/w{next(count)}", Reader(spark).read(table("orders")).df, ("o_orderstatus",)),
        "single_file_write": lambda: Writer(spark).write_and_close(f"{work}/s{next(count)}.parquet", record),
        "single_file_read": lambda: drain(Reader(spark).read(f"{work}/single.parquet").df),
        "write_3_partitions": lambda: Writer(spark).write_dataset(f"{work}/p{next(count)}", record, ("dict",)),
        "write_243_partitions": lambda: Writer(spark).write_dataset(f"{work}/v{next(count)}", wide, tuple("abcde")),
    }
    took: dict[str, float] = {}
    for name, run in queries.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
