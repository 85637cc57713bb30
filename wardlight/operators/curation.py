"""Curating labelled data: what is new, where it belongs, what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.text import (content_fingerprint, guess_lang, has_min_content, holdout_split, mask_for_dataset,
                                      strip)


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in `order`. An aggregate, so copies fold before they are shuffled."""
    columns = [c for c in df.columns if c not in order]
    packed = F.struct(*order, *columns)
    return df.groupBy(F.col(key).alias("_key")).agg(F.min(packed).alias("_first")).select("_first.*").select(*df.columns)


def new_only(df: DataFrame, known: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Rows whose content is in no known dataset, each content once. `known` has a text column."""
    keyed = first_of_each(df.withColumn("fp", content_fingerprint(F.col(text))), "fp", order)
    seen = known.filter(F.coalesce(F.col("text"), F.lit("")) != "").select(content_fingerprint(F.col("text")).alias("fp")).distinct()
    return keyed.join(seen, "fp", "left_anti")


def curate(df: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Mask, drop texts with too little content, drop what is known, guess the language, fix the split."""
    masked = df.withColumn("text", mask_for_dataset(F.col("text"))).filter(has_min_content(F.col("text")))
    return new_only(masked, known, order).withColumn("lang", guess_lang(F.col("text"))).withColumn(
        "split", holdout_split(F.col("fp")))


def validate_eval(rows: DataFrame) -> DataFrame:
    """(line, id, problem) for every fault in an evaluation set; empty when it is valid. Needs a line column."""
    earlier = Window.partitionBy("id").orderBy("line")
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    checks = [F.when(blank(c), f"'{c}' is empty") for c in V.EVAL_REQUIRED]
    checks.append(F.when(F.col("_nth") > 1, "duplicate id"))
    for column, allowed in V.EVAL_ALLOWED.items():
        listed = "[" + ", ".join(f"'{a}'" for a in allowed) + "]"
        checks.append(F.when(filled(column) & ~F.col(column).isin(allowed), F.concat(
            F.lit(f"{column}='"), F.col(column), F.lit(f"' - use one of {listed}"))))
    checks.append(F.when(filled("evidence") & ~F.coalesce(F.col("text"), F.lit("")).contains(F.col("evidence")),
                         "evidence must be copied exactly from the text"))
    checks.append(F.when(filled("group") & ~F.col("group").rlike(r"^g\p{Nd}+"),
                         "group must start with g and a number, e.g. g08-job-fee"))
    numbered = rows.withColumn("_nth", F.row_number().over(earlier))
    return numbered.select("line", "id", F.posexplode(F.array_compact(F.array(*checks))).alias("nth", "problem"))


def scheme_split(group: Column) -> Column:
    """dev or test by the number of the scheme group; NULL for a group without a number."""
    number = F.regexp_extract(group, r"^g(\d+)", 1).try_cast("long")
    return F.when((number <= 7) | (number % 2 == 1), "dev").when(number.isNotNull(), "test")


def review_progress(rows: DataFrame, draft: str = V.DRAFT_REVIEWER) -> DataFrame:
    """Rows and unreviewed rows per label."""
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("reviewer") == draft).alias("unreviewed"))


def relabel(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Applies reviews (id, reviewer, new_label, new_intent, reason, note); changes leave a trace in the note."""
    r = reviews.select("id", F.col("reviewer").alias("_who"), "new_label", "new_intent", "reason", F.col("note").alias("_note"))
    joined = rows.join(r, "id", "left")
    changed = F.col("new_label").isNotNull() & (F.col("new_label") != F.col("label"))
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    trace = F.when(changed, F.concat(
        F.col("_who"), F.lit(" changed label "), F.col("label"), F.lit("→"), F.col("new_label"),
        F.coalesce(F.concat(F.lit(": "), said("reason")), F.lit(""))))
    return (joined.withColumn("note", F.concat_ws("; ", said("note"), trace, said("_note")))
            .withColumn("label", F.coalesce("new_label", "label")).withColumn("intent", F.coalesce("new_intent", "intent"))
            .withColumn("reviewer", F.coalesce("_who", "reviewer")).drop("_who", "new_label", "new_intent", "reason", "_note"))


def category_alias(category: Column, label: Column) -> Column:
    """One name per kind of message; rows without a category go to the 'other' of their class."""
    named = category
    for other, name in V.SAME_CATEGORY.items():
        named = F.when(category == other, name).otherwise(named)
    return F.coalesce(named, F.when(label == 1, "other_scam").otherwise("other_safe"))
