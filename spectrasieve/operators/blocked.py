"""Noise and regions of spectra that span many rows: blocks of points, ranks from counts, runs stitched over blocks.

No step gathers a spectrum: ranks come from counts of values in bins, a block's runs from its own points, and what is ordered
within a spectrum are its runs and bins alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrasieve.operators import regions

KEY = "spectrum_id"


def blocks(points: DataFrame, size: int) -> DataFrame:
    """(spectrum_id, block, points array<struct<idx, mz, y>>): at most ``size`` consecutive points a row."""
    point = F.struct("idx", "mz", F.col("intensity").cast("double").alias("y"))
    return points.groupBy(KEY, F.floor(F.col("idx") / size).alias("block")).agg(F.array_sort(F.collect_list(point)).alias("points"))


def ranks(rows: DataFrame, fractions: list[tuple[int, int]]) -> DataFrame:
    """(spectrum_id, n, ranks): the values at floor(n a / b) of each spectrum's values in order (the least is 0), for fractions a / b.

    Equal values are counted before the shuffle. Their counts in bins (1/64 of an octave, alike for all spectra) tell which
    bin holds a rank, and only such bins' values are put in order.
    """
    width = F.floor(F.log2(F.abs("y") + 1) * 64)
    values = rows.groupBy(KEY, "y").agg(F.count("*").alias("c")).withColumn("bin", F.when(F.col("y") < 0, -width - 1).otherwise(width))
    whole = Window.partitionBy(KEY)
    bins = values.groupBy(KEY, "bin").agg(F.sum("c").alias("m"))
    bins = bins.withColumns({"n": F.sum("m").over(whole), "before": F.sum("m").over(whole.orderBy("bin")) - F.col("m")})
    each = F.array(*[F.struct(F.lit(k).alias("which"), F.least(F.floor(F.col("n") * a / b), F.col("n") - 1).alias("rank")) for k, (a, b) in enumerate(fractions)])
    aims = bins.withColumn("r", F.explode(each)).where((F.col("before") <= F.col("r.rank")) & (F.col("r.rank") < F.col("before") + F.col("m")))
    near = aims.select(KEY, "bin", "n", "r.which", (F.col("r.rank") - F.col("before")).alias("left")).join(values, [KEY, "bin"])
    upto = F.sum("c").over(Window.partitionBy(KEY, "which").orderBy("y"))
    hit = near.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("c") <= F.col("left")))
    return hit.groupBy(KEY, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "y"))), lambda r: r.y).alias("ranks"))


def noise_table(blocked: DataFrame) -> DataFrame:
    """(spectrum_id, n, baseline, noise_sigma), as regions.noise_table gives of whole arrays."""
    r = ranks(blocked.select(KEY, F.explode("points").alias("p")).select(KEY, "p.y"), [(1, 10), (1, 4), (3, 4)])
    p10 = F.greatest(F.get("ranks", F.lit(0)), F.lit(0.0))
    sigma = F.greatest((F.get("ranks", F.lit(2)) - F.get("ranks", F.lit(1))) / F.lit(1.349), p10 * 0.1, F.lit(1.0))
    return r.select(KEY, F.col("n").cast("int").alias("n"), p10.alias("baseline"), sigma.alias("noise_sigma"))


def islands(blocked: DataFrame, noise: DataFrame, k: float = 3.0, gap: int = 2) -> DataFrame:
    """(spectrum_id, n, start_idx, end_idx): runs above baseline + k sigma, merged over small gaps, also across blocks.

    A block gives the islands of its own points; an island whose begin is near the end of the one before goes on with it.
    """
    rows = blocked.join(noise, KEY)
    limit = F.col("baseline") + F.lit(k) * F.col("noise_sigma")
    up = F.transform(F.filter("points", lambda p: p.y > limit), lambda p: p.idx)
    rows = rows.select(KEY, "n", up.alias("up")).where(F.size("up") > 0)
    begins = F.filter("up", lambda x, i: F.coalesce(x - F.get("up", i - 1) > gap + 1, F.lit(True)))
    ends = F.filter("up", lambda x, i: F.coalesce(F.get("up", i + 1) - x > gap + 1, F.lit(True)))
    own = rows.select(KEY, "n", F.inline(F.arrays_zip(begins.alias("start_idx"), ends.alias("end_idx"))))
    return regions.merged(own, gap)


def detect(blocked: DataFrame, size: int, k: float = 3.0, gap: int = 2, extension: int = 3, least_width: int = 3) -> DataFrame:
    """The columns of regions.detect, of blocks of ``size`` points. A region meets the blocks that it spans by an equi-join."""
    found = regions.extended(islands(blocked, noise_table(blocked), k, gap), extension, least_width)
    number = F.row_number().over(Window.partitionBy(KEY).orderBy("start_idx", "end_idx")) - 1
    found = found.withColumn("region_idx", number)
    spans = found.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_idx") / size), F.floor(F.col("end_idx") / size))))
    inside = F.filter("points", lambda p: p.idx.between(F.col("start_idx"), F.col("end_idx")))
    parts = spans.join(blocked, [KEY, "block"]).withColumn("inside", inside)
    top = F.array_max(F.transform("inside", lambda p: F.struct(p.y.alias("y"), (-p.idx).alias("i"))))
    at = lambda e: F.get(F.filter("inside", lambda p: p.idx == F.col(e)), F.lit(0)).mz
    got = parts.groupBy(KEY, "region_idx", "start_idx", "end_idx").agg(F.max(at("start_idx")).alias("mz_start"), F.max(at("end_idx")).alias("mz_end"), F.max(top).alias("top"))
    return got.select(KEY, F.col("region_idx").cast("int").alias("region_idx"), "start_idx", "end_idx", "mz_start", "mz_end", F.col("top.y").alias("max_intensity"), (-F.col("top.i")).alias("apex_idx"))
