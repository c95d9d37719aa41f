"""Mixing sources to target weights (problem 8).

A time-varying curriculum: at training position t in [0, 1] a source has the
weight share * (1 + slope * (2t - 1)), so it has its target share over the
whole training. Its cumulative token demand is the integral of that weight;
the documents of a source, one after the other and over again as often as
allowed, meet the demand in turn, and each gets the position at which the
demand reaches its tokens. The mix is range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Hash buckets a source's documents are summed in, at least, and the rows of all sources for each: no task holds a whole source.
BUCKETS, BUCKET_ROWS = 256, 50_000
#: Documents of a source that may make up the last of its demand, and how many average ones that last is.
FILLERS, LAST = 200, 50
#: Target share that sources may miss, together, before the mix is made smaller to fit them: none, unless asked for.
SHORTFALL = 0.0
#: Greatest slope of a weight.
SLOPE = 0.5


def plan(sizes: DataFrame, targets: DataFrame, shortfall: float = SHORTFALL) -> DataFrame:
    """(source, target_share, max_repeats, size, demand, slope): tokens of the mix by source.

    A source can give at most ``max_repeats`` times its size. The mix is the
    largest of which at most ``shortfall`` of the target share has to go unmet;
    sources that cannot reach their part give all they can, and the rest of
    the mix keeps its proportions. Sources without documents give nothing, and
    their share is spread over the others in proportion. Sources often repeated
    rise towards the end of training, the others fall, so that the weights sum
    to one at every position. The tables here have one row per target.
    """
    rows = targets.select("source", "target_share", "max_repeats").distinct().join(sizes, "source", "left").na.fill(0, ["size"])
    rows = rows.withColumn("room", F.col("size") * F.greatest(F.col("max_repeats"), F.lit(0)))
    fed = F.when(F.col("room") > 0, F.col("target_share")).otherwise(0.0)
    all_ = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("share", F.try_divide(fed, F.sum(fed).over(all_))).withColumn("limit", F.when(F.col("share") > 0, F.col("room") / F.col("share")))
    # shares of the sources that a mix of this source's limit already exhausts
    lower = F.sum(F.coalesce("share", F.lit(0.0))).over(all_.orderBy(F.col("limit").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("unmet", F.coalesce(lower, F.lit(0.0)))
    total = F.max(F.when(F.col("limit").isNotNull() & (F.col("unmet") <= shortfall), F.col("limit"))).over(all_)
    rows = rows.withColumn("demand", F.coalesce(F.least(F.col("share") * total, F.col("room").cast("double")), F.lit(0.0)))
    rows = rows.withColumn("part", F.try_divide(F.col("demand"), F.sum("demand").over(all_)))
    rows = rows.withColumn("lean", F.when(F.col("demand") > 0, F.col("max_repeats") - F.sum(F.col("part") * F.col("max_repeats")).over(all_)))
    steep = F.max(F.abs("lean")).over(all_)
    rows = rows.withColumn("slope", F.coalesce(F.when(steep > 0, SLOPE * F.col("lean") / steep), F.lit(0.0)))
    return rows.select("source", "target_share", "max_repeats", "size", "demand", "slope")


def _position(offset: Column, demand: Column, slope: Column) -> Column:
    """The position at which a source's cumulative demand reaches ``offset`` tokens: (1 - slope) t + slope t^2 = offset / demand."""
    x = F.least(offset / demand, F.lit(1.0))
    root = F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * x, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, x).otherwise((root - (1 - slope)) / (2 * slope))


def nearest_sum(sizes: list[int], wanted: float) -> list[int]:
    """Places of the sizes whose sum is nearest to ``wanted``; of two equally near sums the smaller one's."""
    goal = max(0, round(wanted))
    top = (1 << 2 * goal + 1) - 1
    reach = [1]  # bit n is set where some of the sizes so far sum to n
    for n in sizes:
        reach.append((reach[-1] | reach[-1] << n) & top)
    below = (reach[-1] & (1 << goal + 1) - 1).bit_length() - 1
    above = reach[-1] >> goal + 1
    best = goal + (above & -above).bit_length() if above else below
    best = best if abs(best - wanted) < abs(below - wanted) else below
    places = []
    for k in range(len(sizes), 0, -1):
        if not reach[k - 1] >> best & 1:
            places.append(k - 1)
            best -= sizes[k - 1]
    return places


def _with_offset(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (doc_id, source, n_tokens, ...) with the tokens of their source before them, in order of a digest.

    Running sums are taken per hash bucket and joined with the sums of the
    buckets before, so no task holds a whole source.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    parts = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held"))
    # one row per source and bucket
    before = F.sum("held").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts, ["source", "bucket"])
    return rows.withColumn("offset", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def mix(docs: DataFrame, targets: DataFrame, shortfall: float = SHORTFALL) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens): the mix, sorted by position.

    ``docs`` has (doc_id, source, n_tokens). Documents of sources without a
    target, and those without tokens, are not mixed. Copies count from 1. The
    documents of a source are taken in order of a digest while they fit in
    its demand. What is left before the first that does not fit is filled from
    the others in the same way, but for the size of about ``LAST`` documents:
    for that the driver chooses among ``FILLERS`` documents of each source the
    set whose sum is nearest.
    """
    rows = stored(docs.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens"))
    buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    plans = stored(plan(rows.groupBy("source").agg(F.sum("n_tokens").alias("size")), targets, shortfall).where("demand > 0"))
    rows = _with_offset(rows.join(plans, "source"), buckets)
    # copy k of a document starts k - 1 sizes later; it is taken where its end is within the demand (sums of doubles may miss it by little)
    copies = F.floor((F.col("demand") + 1e-6 - F.col("offset") - F.col("n_tokens")) / F.col("size")) + 1
    rows = stored(rows.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("max_repeats"), copies)).cast("int")))
    left = rows.groupBy("source").agg((F.max("demand") - F.sum(F.col("copies") * F.col("n_tokens"))).alias("left"), F.min("copies").alias("least"))
    left = stored(left.where("left >= 1"))
    others = rows.join(left, "source").where("copies = least AND copies < max_repeats").select("source", "doc_id", "n_tokens", "copies", "left")
    fits = others.where("n_tokens <= left")
    last = fits.groupBy("source").agg((F.avg("n_tokens") * LAST).alias("last"))
    fits = stored(_with_offset(fits, buckets).join(last, "source").withColumn("end", F.col("offset") + F.col("n_tokens")))
    taken = fits.where("end <= left - last")
    used = taken.groupBy("source").agg(F.max("end").alias("used"))
    open_ = left.join(used, "source", "left").select("source", (F.col("left") - F.coalesce("used", F.lit(0))).alias("open"))
    # the first FILLERS of each source: at most so many rows for each row of the targets
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    cols = ["source", "doc_id", "n_tokens", "copies"]
    some = fits.where("end > left - last").select(cols).unionByName(others.where("n_tokens > left").select(cols))
    some = some.join(open_, "source").where("n_tokens <= 2 * open").withColumn("nth", nth).where(F.col("nth") <= FILLERS).select(*cols, "open").collect()
    chosen: list[tuple] = []
    for source in sorted({r.source for r in some}):
        rows_ = sorted((r for r in some if r.source == source), key=lambda r: (r.n_tokens, str(r.doc_id)))
        rest = rows_[0].open
        for k in nearest_sum([r.n_tokens for r in rows_], rest):
            chosen.append((source, rows_[k].doc_id, rows_[k].n_tokens, rows_[k].copies, float(rest)))
            rest -= rows_[k].n_tokens
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.schema["n_tokens"].dataType.simpleString()
    ends = rows.sparkSession.createDataFrame(chosen, f"source string, doc_id {kind}, n_tokens {size}, copies int, left double")
    filled = taken.select(*cols, (F.col("left") - F.col("offset")).alias("left")).unionByName(ends)
    more = filled.join(plans, "source")
    more = more.withColumn("copy", F.col("copies") + 1).withColumn("start", F.col("demand") - F.col("left"))
    whole = rows.withColumn("copy", F.explode(F.when(F.col("copies") >= 1, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))))
    whole = whole.withColumn("start", F.col("offset") + (F.col("copy") - 1) * F.col("size"))
    both = [d.select("start", "demand", "slope", "doc_id", "source", "copy", "n_tokens") for d in (whole, more)]
    position = _position(F.col("start") + F.col("n_tokens") / 2, F.col("demand"), F.col("slope"))
    mixed = both[0].unionByName(both[1]).select(position.alias("position"), "doc_id", "source", "copy", "n_tokens")
    return mixed.orderBy("position", "source", "doc_id", "copy")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, available_tokens, copies, max_repeats): what the mix holds of each target source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("copy").alias("copies"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    rows = targets.select("source", "target_share", "max_repeats").distinct().join(got, "source", "left").join(have, "source", "left")
    rows = rows.na.fill(0, ["tokens", "available_tokens", "copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    return rows.select(
        "source",
        "target_share",
        F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"),
        "tokens",
        "available_tokens",
        "copies",
        "max_repeats",
    )
