"""Write a larger copy of the given tables: ``grow.py SF_DIR TARGET_DIR [TIMES]``.

Orders, line items, events and documents are repeated with shifted keys, all other tables are
copied. ``BENCH_SF_DIR=TARGET_DIR python bench.py`` then times the queries on it, which is how the
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from budgetstar.session import build_session

SHIFTED = {"orders": ("o_orderkey",), "lineitem": ("l_orderkey",), "events": ("event_id",), "documents": ("doc_id",)}


def main(source: str, target: str, times: int) -> None:
    spark = build_session("budgetstar-grow", {"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    for name in sorted(n.removesuffix(".parquet") for n in os.listdir(source) if n.endswith(".parquet")):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        for key in SHIFTED.get(name, ()):
            step = (table.agg(F.max(key)).first()[0] or 0) + 1
            copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))
            table = table.withColumn("copy", copies).withColumn(key, F.col(key) + F.col("copy") * step).drop("copy")
        table.write.option("compression", "zstd").parquet(f"{target}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 8)
