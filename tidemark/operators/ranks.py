"""Exact order statistics per key by refining histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import stable

#: Cells of a histogram, and rows of a range that are ranked directly.
CELLS, DIRECT = 1_024, 10_000


def order_statistics(rows: DataFrame, key: str, value: str, at: dict[str, float], cells: int = CELLS, direct: int = DIRECT) -> DataFrame:
    """Per key the smallest value that has at least the share `at[name]` of the key's values at or under it.

    Values that are null or NaN, or have no key, do not count. The range that holds a rank is cut into `cells` cells of equal width, their
    rows are counted, and the cell that holds the rank becomes the next range, until it has one value or at most
    `direct` rows, which are ranked. Counts combine map-side, so no key's rows are sorted or gathered, however many.
    """
    v = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    total = v.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in at.items()])).alias("x")
    state = stable(total.select("k", names, "n", "lo", "hi").select("k", "x.name", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("x.p"))).alias("need"), "n", "lo", "hi"))
    span = ["k", "lo", "hi"]
    wide = (F.col("n") > direct) & (F.col("hi") > F.col("lo"))
    inside = lambda ranges: v.join(ranges.select(*span).distinct(), "k").where(F.col("v").between(F.col("lo"), F.col("hi")))
    while not (todo := state.where(wide)).isEmpty():
        cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))
        count = inside(todo).groupBy(*span, cell.alias("cell")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        upto = F.sum("m").over(Window.partitionBy(*span).orderBy("cell"))  # over at most `cells` rows
        found = todo.join(count.withColumn("upto", upto), span).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("m") < F.col("need")))
        step = found.select("k", "name", (F.col("need") - F.col("upto") + F.col("m")).alias("need"), F.col("m").alias("n"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
        state = stable(state.where(~wide).unionByName(step))
    few = state.where("hi > lo")
    ranked = inside(few).withColumn("need", F.row_number().over(Window.partitionBy(*span).orderBy("v")).cast("bigint"))  # at most `direct` rows
    got = few.join(ranked, [*span, "need"]).select("k", "name", "v").unionByName(state.where("hi = lo").select("k", "name", F.col("lo").alias("v")))
    return got.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in at])
