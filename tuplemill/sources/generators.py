"""Integer rows for tests and benchmarks, made in closed form by Spark.

Values grow by an increment that goes up by 2 and down by 1 in turn and starts
over after a fixed number of rows; field j holds the row's value plus j.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First value, sign of the increment, rows in a cycle.
SHAPES = {"asc": (0, 1, 17), "desc": (100_000, -1, 17), "mix": (1, 1, 18)}
MIRROR = 10_000


def offsets(cycle: int) -> list[int]:
    """What the value has grown by at each place of a cycle, and after it."""
    out, increment = [0], 1
    for k in range(cycle):
        out.append(out[-1] + increment)
        increment += 2 if k % 2 == 0 else -1
    return out


def int_rows(spark: SparkSession, kind: str, rows: int, fields: int = 3) -> DataFrame:
    """``rows`` rows (rid, f0, f1, ...) of the kind asc, desc or mix."""
    start, sign, cycle = SHAPES[kind]
    steps = offsets(cycle)
    place = F.pmod("rid", F.lit(cycle)).cast("int")
    value = F.lit(start) + sign * (F.floor(F.col("rid") / cycle) * steps[-1] + F.element_at(F.array(*[F.lit(s) for s in steps[:-1]]), place + 1))
    if kind == "mix":
        value = F.when(place % 2 == 1, MIRROR - value).otherwise(value)
    return spark.range(rows).withColumnRenamed("id", "rid").withColumn("f0", value.cast("bigint")).select("rid", *[(F.col("f0") + j).alias(f"f{j}") for j in range(fields)])
