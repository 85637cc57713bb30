"""From evidence to a three-level, explained verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.patterns import combined
from wardlight.functions.staging import stage
from wardlight.operators import intent, links, rules


def model_evidence(p: Column) -> Column:
    """0 below the confidence floor or without a model; then from 'suspicious' up to one half."""
    share = (p - V.MODEL_MIN) / F.lit(1 - V.MODEL_MIN)
    return F.when(p >= V.MODEL_MIN, F.lit(V.SUSPICIOUS_AT) + share * F.lit(V.MODEL_MAX_EVIDENCE - V.SUSPICIOUS_AT)
                  ).otherwise(0.0)


def level_for(score: Column) -> Column:
    return F.when(score >= V.DANGEROUS_AT, "dangerous").when(score >= V.SUSPICIOUS_AT, "suspicious").otherwise("safe")


def level_rank(level: Column) -> Column:
    return F.when(level == "dangerous", 2).when(level == "suspicious", 1).otherwise(0)


def worse_level(*levels: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in V.LEVELS]), F.greatest(*[level_rank(x) for x in levels]) + 1)


def is_mention(kind: Column) -> Column:
    """A warning or a story only mentions scam words; nothing in it asks for anything."""
    return kind.isin("warning", "report")


def by_weight(counted: Column) -> Column:
    """Rule names, heaviest first, ties in rule order."""
    keyed = F.transform(counted, lambda h, i: F.struct((-h["weight"]).alias("w"), i.alias("i"), h["rule"].alias("rule")))
    return F.transform(F.array_sort(keyed), lambda k: k["rule"])


def score_messages(messages: DataFrame, text: str = "text", proba: str | None = None) -> DataFrame:
    """The whole check as one narrow job: rules, links, intent, optional model probability, verdict.

    `proba` names a column with an injected probability (NULL means no model for that row).
    """
    kept = messages.columns
    p = F.col(proba).cast("double") if proba else F.lit(None).cast("double")
    body = F.coalesce(F.col(text), F.lit(""))
    judged = intent.judge_staged(intent.stage_forms(messages, text))
    plain = stage(judged, {
        "_plain": intent.unmarked(F.col("_norm")),
        "_plain_latin": F.when(F.col("_latin") == F.col("_norm"), intent.unmarked(F.col("_norm")))
        .otherwise(intent.unmarked(F.col("_latin"))),
        "links": links.message_links(body)})
    screened = plain.withColumn("_screens", rules.rule_screens(F.col("_plain"), F.col("_plain_latin")))
    found = stage(screened, {"_hits": rules.rule_hits(F.col("_plain"), F.col("_plain_latin"), F.col("_screens")),
                          "link_score": links.message_link_score(F.col("links"))})
    df = stage(found, {"counted": rules.counted_hits(F.col("_hits"), F.col("link_score")), "model_score": p})
    mention = is_mention(F.col("_kind"))
    df = stage(df, {
        "rule_score": rules.rule_score(F.col("counted")) * F.when(mention, V.MENTION_WEIGHT).otherwise(1.0),
        "_model": F.when(mention, 0.0).otherwise(model_evidence(F.col("model_score")))})
    df = stage(df, {"_all": combined(F.col("rule_score"), F.col("link_score"), F.col("_model")),
                    "_hard": combined(F.col("rule_score"), F.col("link_score"))})
    # A model reads the same text as the rules: alone it may raise a message to suspicious, not further.
    model_only = (F.col("_all") >= V.DANGEROUS_AT) & (F.col("_hard") < V.DANGEROUS_AT)
    capped = F.when(model_only, F.least(F.col("_all"), F.lit(V.DANGEROUS_AT - 0.01))).otherwise(F.col("_all"))
    asks = F.col("_asks_money") & F.col("_kind").isin("request", "quote")
    df = stage(df, {"_capped": capped,
                    "_level": F.when(model_only, "suspicious").otherwise(level_for(F.col("_all")))})
    df = stage(df, {"needs_context": (F.col("_level") == "safe") & asks})
    signals = F.concat(
        F.when(mention, F.array().cast("array<string>")).otherwise(by_weight(F.col("counted"))),
        F.flatten(F.transform(F.col("links"), lambda link: link["signals"])),
        F.array_compact(F.array(F.when(F.col("_model") > 0, "ai_model"), F.when(F.col("needs_context"), "needs_context"))),
    )
    done = stage(df, {
        "score": F.when(F.col("needs_context"), F.greatest(F.col("_capped"), F.lit(V.SUSPICIOUS_AT))).otherwise(F.col("_capped")),
        "level": F.when(F.col("needs_context"), "suspicious").otherwise(F.col("_level")),
        "signals": signals, "domains": links.scam_domains(F.col("links"))})
    return done.select(*kept, "score", "level", "signals", "rule_score", "link_score", "model_score",
                       F.col("_model").alias("model_evidence"), intent.intent_struct().alias("intent"), "links", "counted", "domains")


def verdict_document(verdicts: DataFrame, *keys: str) -> DataFrame:
    """keys, level, risk (percent, NULL when safe) and a JSON document with the distinct ordered signals."""
    shown = verdicts.withColumn("risk", F.when(F.col("level") != "safe", F.bround(F.col("score") * 100).cast("int")))
    return shown.select(*keys, "level", "risk", F.to_json(F.struct(
        "level", "risk", F.array_distinct("signals").alias("signals")), {"ignoreNullFields": "false"}).alias("document"))


def components_document(verdicts: DataFrame, *keys: str) -> DataFrame:
    """The verdict with its parts, for analysts."""
    three = lambda c: F.bround(F.col(c), 3).alias(c.removesuffix("_score") + "s")
    return verdicts.select(*keys, F.to_json(F.struct(
        F.bround("score", 3).alias("score"), "level", F.struct("intent.kind", "intent.evidence").alias("intent"),
        F.struct(three("rule_score"), three("link_score"), F.bround("model_score", 3).alias("model")).alias("components"),
    ), {"ignoreNullFields": "false"}).alias("document"))


def _merge(verdicts: DataFrame, weight: Column, extra_signals: Column) -> DataFrame:
    """Fold more evidence into a verdict: the score and the level can only rise."""
    raised = combined(F.col("score"), weight)
    return (
        verdicts.withColumn("_score", F.when(weight > 0, raised).otherwise(F.col("score")))
        .withColumn("level", F.when(weight > 0, worse_level(F.col("level"), level_for(F.col("_score"))))
                    .otherwise(F.col("level")))
        .withColumn("score", F.col("_score"))
        .withColumn("signals", F.when(weight > 0, F.concat("signals", extra_signals)).otherwise(F.col("signals")))
        .drop("_score")
    )


def apply_crowd(verdicts: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """`hits` is (key, crowd_weight): one row per message with crowd evidence, weights already combined."""
    joined = verdicts.join(hits.select(key, "crowd_weight"), key, "left")
    return _merge(joined, F.coalesce("crowd_weight", F.lit(0.0)), F.array(F.lit("community"))).drop("crowd_weight")


def apply_enrichment(verdicts: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """`findings` is (key, evidence, signals, confirmed): one row per message with online evidence."""
    found = findings.select(key, F.col("evidence").alias("_e"), F.col("signals").alias("_s"), F.col("confirmed").alias("_c"))
    empty = F.array().cast("array<string>")
    joined = verdicts.join(found, key, "left").withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    merged = _merge(joined, F.col("_e"), F.coalesce("_s", empty))
    positive = F.when(F.col("_e") > 0, F.coalesce("_c", empty)).otherwise(empty)
    return (merged.withColumn("confirmed", positive)
            .withColumn("domains", F.array_union("domains", "confirmed")).drop("_e", "_s", "_c"))


def apply_attachments(verdicts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """`files` is (key, file_level, app_signals): one row per message with a file."""
    f = files.select(key, "file_level", F.col("app_signals").alias("_app"))
    empty = F.array().cast("array<string>")
    floor = (F.when(F.col("file_level") == "dangerous", V.FILE_DANGEROUS_SCORE)
             .when(F.col("file_level") == "suspicious", V.FILE_SUSPICIOUS_SCORE).otherwise(0.0))
    program = F.when(F.col("file_level") == "dangerous", F.array(F.lit("file_program"))).otherwise(empty)
    return (
        verdicts.join(f, key, "left")
        .withColumn("score", F.greatest(F.col("score"), floor))
        .withColumn("level", worse_level(F.col("level"), F.coalesce("file_level", F.lit("safe"))))
        .withColumn("signals", F.concat(F.coalesce("_app", empty), program, F.col("signals")))
        .drop("_app")
    )
