"""Explainable text rules. One projection tests every rule; nothing is joined or exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import noisy_or, one_of
from wardlight.functions.phrases import bit, found_in_either, screens, sure_pattern, unsure_pattern
from wardlight.functions.staging import stage
from wardlight.functions.text import normalize, to_latin


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(name, weight, amplifier, one_of(alternatives), i)
            for i, (name, weight, amplifier, alternatives) in enumerate(V.RULES)]
    return spark.createDataFrame(rows, "rule string, weight double, amplifier boolean, pattern string, ord int")


_NAMES = [name for name, *_ in V.RULES]


def rule_screens(norm: Column, latin: Column) -> Column:
    """What `rule_hits` needs to know beforehand; a column of its own, as it is computed in batches."""
    return screens(F.array(norm, F.when(latin != norm, latin)), [sure_pattern(n) for n in _NAMES] + [unsure_pattern(n) for n in _NAMES])


def rule_hits(norm: Column, latin: Column, screened: Column) -> Column:
    """array<struct<rule, weight, amplifier>> in rule order; a rule fires once per message."""
    seen = screened[0].bitwiseOR(screened[1])

    def fires(i: int, name: str) -> Column:
        if not unsure_pattern(name):
            return bit(seen, i)
        return bit(seen, i) | (bit(seen, len(_NAMES) + i) & found_in_either(norm, latin, name, unsure=True))

    return F.array_compact(F.array(*[
        F.when(fires(i, name), F.struct(
            F.lit(name).alias("rule"), F.lit(weight).alias("weight"), F.lit(amplifier).alias("amplifier")))
        for i, (name, weight, amplifier, _) in enumerate(V.RULES)
    ]))


def counted_hits(hits: Column, link_score: Column) -> Column:
    """Core rules, then amplifiers; amplifiers count only beside a core rule or a suspicious link."""
    core = F.filter(hits, lambda h: ~h["amplifier"])
    amplifiers = F.filter(hits, lambda h: h["amplifier"])
    return F.when((F.size(core) > 0) | (link_score > 0), F.concat(core, amplifiers)).otherwise(core)


def rule_score(counted: Column) -> Column:
    return noisy_or(F.transform(counted, lambda h: h["weight"]))


def match_rules(messages: DataFrame, text: str = "text") -> DataFrame:
    """Adds `hits` to a table of messages."""
    normed = stage(messages, {"_norm": normalize(F.col(text))})
    staged = stage(normed, {"_latin": to_latin(F.col("_norm"))})
    screened = staged.withColumn("_screens", rule_screens(F.col("_norm"), F.col("_latin")))
    return stage(screened, {"hits": rule_hits(F.col("_norm"), F.col("_latin"), F.col("_screens"))}).drop("_norm", "_latin", "_screens")
