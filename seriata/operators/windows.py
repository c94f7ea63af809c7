"""Windows over long series, in blocks with context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, key: str, at: str, span: int = 4096) -> DataFrame:
    """rows with i, their number in the series of key by at (whole numbers, each once), and n, the series' length.

    Rows are numbered within spans of at, and spans told where they begin, so
    no task holds a series.
    """
    rows = rows.withColumn("span", F.floor(F.col(at) / span))
    sizes = rows.groupBy(key, "span").agg(F.count("*").alias("size"))  # a row per span
    before = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "span", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"), F.sum("size").over(Window.partitionBy(key)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(key, "span").orderBy(at)) - 1
    return rows.withColumn("inside", inside).join(sizes, [key, "span"]).withColumn("i", F.col("first") + F.col("inside")).drop("span", "first", "inside")


def _tree_sum(frame: Column, first: Column, fanout: int = 16) -> Column:
    """The sum of a frame whose first row has the number first in its series, added up as the SQL engine's tree over the series does.

    Rows up to the next multiple of fanout, then the sums of whole groups of
    fanout rows, then the rest. Other orders give other last bits, which show
    where a value lies exactly at a bound.
    """
    plus = lambda t, v: t + v
    size = F.size(frame)
    lead = F.pmod(-first, F.lit(fanout)).cast("int")
    groups = F.greatest(F.floor((size - lead) / fanout), F.lit(0)).cast("int")
    whole = lambda k: F.aggregate(F.slice(frame, lead + k * fanout + 1, F.lit(fanout)), F.lit(0.0), plus)
    left = F.aggregate(F.slice(frame, F.lit(1), lead), F.lit(0.0), plus)
    middle = F.when(groups > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(groups, F.lit(1)) - 1), left, lambda t, k: t + whole(k))).otherwise(left)
    return F.aggregate(F.slice(frame, lead + groups * fanout + 1, size), middle, plus)


def moving_average(rows: DataFrame, key: str, at: str, value: str, reach: int, block: int = 4096) -> DataFrame:
    """rows with mean: of the value over reach rows on either side in the series of key by at, which is mirrored at its ends.

    Blocks of rows get the context of their neighbours as copies; a mirrored
    place is a copy too, as often as a short series is mirrored over. Null
    values do not count.
    """
    rows = numbered(rows, key, at)
    n = F.col("n")
    turns = F.ceil(F.lit(reach) / (2 * n)).cast("int") + 1
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda t: F.array(F.col("i") + 2 * n * t, -1 - F.col("i") + 2 * n * t)))
    rows = rows.withColumn("p", F.explode(F.filter(places, lambda p: (p >= -reach) & (p < n + reach))))
    near = F.sequence(F.floor((F.col("p") - reach) / block), F.floor((F.col("p") + reach) / block))
    rows = rows.withColumn("block", F.explode(near))
    w = Window.partitionBy(key, "block").orderBy("p").rowsBetween(-reach, reach)
    own = (F.floor(F.col("p") / block) == F.col("block")) & (F.col("p") >= 0) & (F.col("p") < n)
    frame = F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w)
    rows = rows.withColumn("frame", frame).withColumn("held", F.count(value).over(w)).where(own)
    # The mirrored series begins reach rows before p = 0, so a frame begins at its row p.
    mean = F.when(F.col("held") > 0, _tree_sum(F.col("frame"), F.col("p")) / F.col("held"))
    return rows.withColumn("mean", mean).drop("i", "n", "p", "block", "frame", "held")
