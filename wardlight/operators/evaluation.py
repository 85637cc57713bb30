"""Detection quality: outcomes, rates, precision/recall, ranking quality, similarity statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.ranks import numbered_in_order


def outcome(label: Column, level: Column) -> Column:
    return (F.when(label == "scam", F.when(level != "safe", "ok").otherwise("MISSED"))
            .when(label == "safe", F.when(level == "safe", "ok").otherwise("FALSE ALARM"))
            .when(level == "suspicious", "ok").otherwise(F.concat(F.upper(level), F.lit(" (want suspicious)"))))


def headline_metrics(results: DataFrame) -> DataFrame:
    """One row: scams caught, false alarms on safe messages, questions answered with a question."""
    ok = F.col("outcome") == "ok"
    of = lambda label: F.col("label") == label
    return results.agg(
        F.count_if(of("scam") & ok).alias("scams_caught"), F.count_if(of("scam")).alias("scams"),
        F.count_if(of("safe") & ~ok).alias("false_alarms"), F.count_if(of("safe")).alias("safe"),
        F.count_if(of("needs_context") & ok).alias("context_ok"), F.count_if(of("needs_context")).alias("context"))


def by_intent(results: DataFrame, intent: str = "intent") -> DataFrame:
    return results.groupBy(intent).agg(F.count_if(F.col("outcome") == "ok").alias("ok"), F.count("*").alias("n"))


def pairs_fully_right(results: DataFrame, group: str = "group") -> DataFrame:
    """One row: groups whose every row is right, and all groups."""
    return results.groupBy(group).agg(F.bool_and(F.col("outcome") == "ok").alias("right")).agg(
        F.count_if("right").alias("fully_right"), F.count("*").alias("groups"))


def mistakes(results: DataFrame, split: str = "split") -> DataFrame:
    """Failing rows of the half one may study; those of the test half are never shown."""
    return results.filter((F.col(split) == "dev") & (F.col("outcome") != "ok"))


def golden_violations(results: DataFrame) -> DataFrame:
    """Rows that break a golden expectation: safe must be safe without reasons, flag must not be safe."""
    return results.filter(((F.col("expect") == "safe") & ((F.col("level") != "safe") | (F.size("reasons") > 0)))
                          | ((F.col("expect") == "flag") & (F.col("level") == "safe")))


def holdout_score(results: DataFrame) -> DataFrame:
    """One row: total, scams, caught, safe, false_alarms for rows with label 1/0 and a level."""
    flagged = F.col("level") != "safe"
    return results.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("scams"),
        F.count_if((F.col("label") == 1) & flagged).alias("caught"), F.count_if(F.col("label") == 0).alias("safe"),
        F.count_if((F.col("label") == 0) & flagged).alias("false_alarms"))


def prf(df: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """precision, recall, f1 (0 where undefined), optionally per key."""
    hit, said, real = F.count_if(truth & predicted), F.count_if(predicted), F.count_if(truth)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    counts = df.groupBy(*keys).agg(hit.alias("tp"), said.alias("flagged"), real.alias("positives"))
    return (counts.withColumn("precision", share(F.col("tp"), F.col("flagged")))
            .withColumn("recall", share(F.col("tp"), F.col("positives")))
            .withColumn("f1", share(2 * F.col("tp"), F.col("flagged") + F.col("positives"))))


def three_way_report(rows: DataFrame) -> DataFrame:
    """prf per system for rows (label, rules_level, proba, full_level): rules only, model only, everything."""
    systems = F.array(
        F.struct(F.lit("rules").alias("system"), (F.col("rules_level") != "safe").alias("flagged_it")),
        F.struct(F.lit("model").alias("system"), (F.col("proba") >= 0.5).alias("flagged_it")),
        F.struct(F.lit("full").alias("system"), (F.col("full_level") != "safe").alias("flagged_it")))
    long = rows.select("label", F.explode(systems).alias("s")).select("label", "s.*")
    return prf(long, F.col("label") == 1, F.col("flagged_it"), "system")


def listed_errors(rows: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """Missed scams and false alarms, numbered in `order`: the first n of each, as shown under a report, or all."""
    flagged = F.col("full_level") != "safe"
    kind = F.when((F.col("label") == 1) & ~flagged, "missed").when((F.col("label") == 0) & flagged, "false_alarm")
    wrong = rows.withColumn("error", kind).filter(F.col("error").isNotNull())
    ranked = numbered_in_order(wrong, ["error"], [F.col(order)])
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def stratified_folds(df: DataFrame, key: str, label: str = "label", k: int = V.FOLDS, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, balanced within each label.

    Rows are ranked by a seeded hash. Ranking all rows of a label in one window would be one task per label,
    so the hash is cut into ranges first: rank = rows in earlier ranges + rank inside the range.
    """
    ranges = 1024
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_range", F.pmod(F.col("_h"), F.lit(ranges)))
    sizes = hashed.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", key))
    ranked = hashed.withColumn("_inside", inside).join(before, [label, "_range"])
    return ranked.withColumn("fold", ((F.col("_before") + F.col("_inside") - 1) % k).cast("int")).drop(
        "_h", "_range", "_inside", "_before")


def ranked_scores(df: DataFrame, proba: str, label: str, ranges: int = 256) -> DataFrame:
    """One row per distinct score: _p, _pos and _neg (rows of either label with it), _below (normal rows with less).

    Counts per distinct score come first, so copies fold. The running count goes over ranges that hold about as many
    distinct scores each, wherever scores pile up, then inside each range: no window sorts the whole table.
    """
    per_score = df.groupBy(F.col(proba).cast("double").alias("_p")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")).filter("_p IS NOT NULL")
    bounds = sorted(set(per_score.approxQuantile("_p", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    place = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b <= F.col("_p"))) if bounds else F.lit(0)
    placed = per_score.withColumn("_range", place)
    sums = placed.groupBy("_range").agg(F.sum("_neg").alias("_n"))       # at most one row per range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_neg").over(Window.partitionBy("_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_inside", inside).join(sums.withColumn("_before", before).drop("_n"), "_range").select(
        "_p", "_pos", "_neg", (F.col("_before") + F.col("_inside")).alias("_below"))


def false_alarm_threshold(df: DataFrame, rate: float, proba: str, label: str) -> DataFrame:
    """One row: the score that `rate` of normal messages exceed, between two scores in proportion."""
    ranked = ranked_scores(df, proba, label).filter("_neg > 0")
    at = (F.col("_all") - 1) * F.lit(1 - rate)
    whole = ranked.agg(F.sum("_neg").alias("_all")).select("_all", at.alias("_at"))
    holds = lambda i: (F.col("_below") <= i) & (i < F.col("_below") + F.col("_neg"))
    ends = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(whole.withColumn("_one", F.lit(1))), "_one").agg(   # one row
        F.max(F.when(holds(F.floor("_at")), F.col("_p"))).alias("low"), F.max(F.when(holds(F.ceil("_at")), F.col("_p"))).alias("high"), F.max("_at").alias("_at"))
    return ends.select((F.col("low") + (F.col("high") - F.col("low")) * (F.col("_at") - F.floor("_at"))).alias("threshold"))


def caught_at_fpr(df: DataFrame, rate: float = V.FALSE_ALARM_RATE, proba: str = "proba", label: str = "label") -> DataFrame:
    """One row: the score that `rate` of normal messages exceed, and the share of scams strictly above it."""
    threshold = false_alarm_threshold(df, rate, proba, label).withColumn("_one", F.lit(1))
    scams = df.filter(F.col(label) == 1).select(F.col(proba).alias("_p"), F.lit(1).alias("_one"))
    return scams.join(F.broadcast(threshold), "_one").groupBy("threshold").agg(
        F.avg((F.col("_p") > F.col("threshold")).cast("double")).alias("caught"))


def caught_by_category(df: DataFrame, category: str, rate: float = V.FALSE_ALARM_RATE, proba: str = "proba",
                       label: str = "label") -> DataFrame:
    threshold = false_alarm_threshold(df, rate, proba, label).withColumn("_one", F.lit(1))
    scams = df.filter(F.col(label) == 1).select(category, F.col(proba).alias("_p"), F.lit(1).alias("_one"))
    return scams.join(F.broadcast(threshold), "_one").groupBy(category).agg(
        F.count("*").alias("n"), F.avg((F.col("_p") > F.col("threshold")).cast("double")).alias("caught"))


def auc(df: DataFrame, proba: str = "proba", label: str = "label") -> DataFrame:
    """One row: the chance that a scam scores above a normal message, ties counting half."""
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return ranked_scores(df, proba, label).agg(F.try_divide(wins, (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"))
