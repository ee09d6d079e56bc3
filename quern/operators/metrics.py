"""Metrics of scored rows and the learning of no-call thresholds.

Scored rows have a probability ``p`` and a target ``y`` (0 or 1); ``by`` are grouping columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import EDGES, probability_bin
from .similarity import checkpointed


def class_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count_if(F.col("y") == 0).alias("susceptible"), F.count_if(F.col("y") == 1).alias("resistant"))


def called_metrics(rows: DataFrame, by: list[str], signal: str = "model_signal") -> DataFrame:
    """Calls of a model on test rows: how many, their share and accuracy, and the share of
    the other class among the calls of each kind; null where there is no such call."""
    low, high, y = F.col(signal) == "susceptible_signal", F.col(signal) == "resistant_signal", F.col("y")
    called = low | high
    return rows.groupBy(*by).agg(
        F.count_if(called).alias("called_count"),
        F.avg(called.cast("int")).alias("coverage"),
        F.avg(F.when(called, (high == (y == 1)).cast("int"))).alias("accuracy"),
        F.count_if(low).alias("susceptible_calls"),
        F.count_if(high).alias("resistant_calls"),
        F.avg(F.when(low, y)).alias("resistant_fraction_in_susceptible_calls"),
        F.avg(F.when(high, 1 - y)).alias("susceptible_fraction_in_resistant_calls"),
    )


def report_metrics(rows: DataFrame, by: list[str], call: str = "call") -> DataFrame:
    """Calls of reports against laboratory labels. Recalls are of all rows of a class, so a row without a call is missed."""
    fail, work, y = F.col(call) == "likely_to_fail", F.col(call) == "likely_to_work", F.col("y")
    called = F.col(call) != "no_call"
    right = (fail & (y == 1)) | (work & (y == 0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(called).alias("called"),
        F.avg(called.cast("int")).alias("coverage"),
        F.avg((~called).cast("int")).alias("no_call_rate"),
        F.avg(F.when(called, right.cast("int"))).alias("called_accuracy"),
        F.avg(F.when(y == 1, fail.cast("int"))).alias("resistant_recall_including_no_calls"),
        F.avg(F.when(y == 0, work.cast("int"))).alias("susceptible_recall_including_no_calls"),
    )


def reliability(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ten bins of probability: rows, mean probability, observed share; rows outside 0 to 1 drop out."""
    binned = rows.withColumn("probability_bin", probability_bin(F.col("p"))).where("probability_bin IS NOT NULL")
    edge = F.array(*map(F.lit, EDGES))
    out = binned.groupBy(*by, "probability_bin").agg(F.count("*").alias("samples"), F.avg("p").alias("mean_probability"), F.avg(F.col("y")).alias("observed_fraction"))
    return out.withColumn("bin_lower", F.get(edge, F.col("probability_bin"))).withColumn("bin_upper", F.get(edge, F.col("probability_bin") + 1))


def _by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score; windows then run over scores, not rows."""
    return rows.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve with ties counted half; null for one class."""
    low = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    s = _by_score(rows, by).withColumn("below", F.coalesce(F.sum("neg").over(low), F.lit(0)))
    area = F.sum(F.col("pos") * (F.col("below") + F.lit(0.5).cast("double") * F.col("neg")))
    return s.groupBy(*by).agg(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def average_precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """The sum of precision over steps of recall, scores descending; null for one class."""
    down = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    s = _by_score(rows, by).withColumn("tp", F.sum("pos").over(down)).withColumn("n", F.sum(F.col("pos") + F.col("neg")).over(down))
    precision = F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos").cast("double"))
    return s.groupBy(*by).agg(F.when(F.sum("neg") > 0, precision).alias("average_precision"))


def evaluate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Recalls, balanced accuracy, F1 and Brier score at a probability of one half.

    Recalls and F1 are 0 where nothing is there to be found; balanced accuracy is null for one class.
    """
    call = (F.col("p") >= 0.5).cast("int")
    r = rows.withColumn("c", call).groupBy(*by).agg(
        F.count_if((F.col("y") == 1) & (F.col("c") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("c") == 0)).alias("tn"),
        F.count_if((F.col("y") == 0) & (F.col("c") == 1)).alias("fp"), F.count_if((F.col("y") == 1) & (F.col("c") == 0)).alias("fn"),
        F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"),
    )
    rr, sr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    f1 = F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return r.select(*by, zero(rr).alias("resistant_recall"), zero(sr).alias("susceptible_recall"), ((rr + sr) / 2).alias("balanced_accuracy"), zero(f1).alias("f1"), "brier")


def threshold_candidates(rows: DataFrame, by: list[str], worst: float, least: int, worst_high: float | None = None) -> DataFrame:
    """At each score: calls and errors below and above it, and whether it may bound a call region.

    ``worst`` bounds the share of errors below, and above, too, unless ``worst_high`` is given.
    """
    up = Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy("p").rowsBetween(0, Window.unboundedFollowing)
    n = F.col("pos") + F.col("neg")
    s = _by_score(rows, by).select(*by, "p", F.sum(n).over(up).alias("low_calls"), F.sum("pos").over(up).alias("low_errors"), F.sum(n).over(down).alias("high_calls"), F.sum("neg").over(down).alias("high_errors"))
    ok = lambda a, w: (F.col(f"{a}_calls") >= least) & (F.col(f"{a}_errors") / F.col(f"{a}_calls") <= w)
    return s.withColumn("low_ok", ok("low", worst)).withColumn("high_ok", ok("high", worst if worst_high is None else worst_high))


def best_thresholds(candidates: DataFrame) -> DataFrame:
    """One row (lower, upper, low_calls, high_calls, low_error, high_error): the pair of most calls,
    then of the larger smaller region, then of the larger lower region; one side alone if
    there is no pair, and nulls if there is none either.

    For each lower score the best upper one is that of most calls above it, which is the
    first valid one: calls above a score fall as the score rises. So no pairs are made.
    Scores are sorted by range; only the first valid one of each range reaches the driver, so no
    window runs over all scores.
    """
    spark = candidates.sparkSession
    parts = checkpointed(candidates.orderBy("p").withColumn("_part", F.spark_partition_id()))
    high = F.struct("p", "high_calls", "high_errors")
    firsts = {r["_part"]: r["f"] for r in parts.groupBy("_part").agg(F.min(F.when(F.col("high_ok"), high)).alias("f")).collect()}
    behind, rows = None, []
    for k in sorted(firsts, reverse=True):
        rows.append((k, behind))
        behind = firsts[k] or behind
    kinds = dict(candidates.dtypes)
    later = spark.createDataFrame(rows, f"_part int, _later struct<p: double, high_calls: {kinds['high_calls']}, high_errors: {kinds['high_errors']}>")
    order = Window.partitionBy("_part").orderBy("p").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("high_ok"), high), ignorenulls=True).over(order)
    low = parts.join(F.broadcast(later), "_part").withColumn("u", F.coalesce(nxt, "_later")).where("low_ok")
    pair = F.struct((F.col("low_calls") + F.col("u.high_calls")).alias("a"), F.least("low_calls", "u.high_calls").alias("b"), F.col("low_calls").alias("c"), F.col("low_errors").alias("e"), F.col("p").alias("lower"), F.col("u").alias("u"))
    best = low.where("u IS NOT NULL").agg(F.max(pair).alias("k")).first()["k"]
    one = parts.where("low_ok").agg(F.max(F.struct("low_calls", "p", "low_errors")).alias("k")).first()["k"]
    other = parts.where("high_ok").agg(F.max(F.struct("high_calls", "p", "high_errors")).alias("k")).first()["k"]
    if best:
        lower, upper = (best["lower"], best["c"], best["e"]), tuple(best["u"])
    elif one and (other is None or one["low_calls"] >= other["high_calls"]):
        lower, upper = (one["p"], one["low_calls"], one["low_errors"]), None
    else:
        lower, upper = None, (other["p"], other["high_calls"], other["high_errors"]) if other else None
    share = lambda x: float(x[2]) / x[1] if x else None
    row = (*((x[0] if x else None) for x in (lower, upper)), *((int(x[1]) if x else None) for x in (lower, upper)), share(lower), share(upper))
    return spark.createDataFrame([row], "lower double, upper double, low_calls long, high_calls long, low_error double, high_error double")
