"""Reasons and trust notes in the reader's language.

The reason table is a fixed handful of texts, so it sits in the plan as a literal map: explaining a verdict is
another row expression, with no explode, join and regroup per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.hosts import top_level, without_www
from wardlight.operators.verdict import by_weight, is_mention
from wardlight.texts import EVIDENCE, LANGUAGES, LOOKED_UP, REASONS


def reason_table(spark: SparkSession) -> DataFrame:
    rows = [(key, lang, text) for key, texts in REASONS.items() for lang, text in zip(LANGUAGES, texts)]
    return spark.createDataFrame(rows, "signal string, lang string, template string")


def _texts() -> Column:
    pairs = [F.lit(x) for key, texts in REASONS.items() for lang, text in zip(LANGUAGES, texts) for x in (f"{key}|{lang}", text)]
    return F.create_map(*pairs)


def template(key: Column, lang: Column) -> Column:
    """Russian and English where asked for, Uzbek for anyone else."""
    known = F.when(lang.isin("ru", "en"), lang).otherwise("uz")
    return F.element_at(_texts(), F.concat(key, F.lit("|"), known))


def evidence_reasons(signals: Column, lang: Column, looked_up: Column | None = None) -> Column:
    """One reason per signal of evidence from outside the text, in the signals' order; one for all lookups together."""
    known = F.create_map(*[F.lit(x) for key, texts in EVIDENCE.items() for name, text in zip(LANGUAGES, texts) for x in (f"{key}|{name}", text)])
    reader = F.when(lang.isin("ru", "en"), lang).otherwise("uz")
    told = F.array_compact(F.transform(F.array_distinct(signals), lambda s: F.try_element_at(known, F.concat(s, F.lit("|"), reader))))
    if looked_up is None:
        return told
    online = F.try_element_at(F.create_map(*[F.lit(x) for pair in zip(LANGUAGES, LOOKED_UP) for x in pair]), reader)
    return F.when(looked_up, F.concat(told, F.array(online))).otherwise(told)


def _fill(text: Column, **parts: Column) -> Column:
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text


def _brand_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _link_reasons(link: Column, lang: Column) -> Column:
    shown = F.filter(link["signals"], lambda s: ~s.startswith("brand:"))
    brand = F.coalesce(link["brand"], F.lit("click"))
    label = F.element_at(_brand_map({b: V.BRAND_LABELS.get(b, b.capitalize()) for b in V.OFFICIAL_DOMAINS}), brand)
    real = F.element_at(_brand_map({b: ", ".join(sorted(d)) for b, d in V.OFFICIAL_DOMAINS.items()}), brand)
    return F.transform(shown, lambda s: _fill(
        template(s, lang), host=link["host"], tld=top_level(link["host"]), brand=label, real=real))


def explain(verdicts: DataFrame, lang: Column) -> DataFrame:
    """Adds reasons (why it is risky) and trust (why it is not), empty where they do not apply.

    What the crowd, a file or an app's rights add to the verdict is said last, and one line for confirmed lookups.
    """
    none = F.array().cast("array<string>")
    kind, evidence = F.col("intent.kind"), F.col("intent.evidence")
    one = lambda condition, key, **parts: F.when(condition, F.array(_fill(template(F.lit(key), lang), **parts))).otherwise(none)
    pct = F.coalesce(F.bround(F.col("model_score") * 100).cast("int").cast("string"), F.lit(""))
    risky = F.concat(
        one(kind == "request", "asked", evidence=evidence),
        F.when(is_mention(kind), none).otherwise(F.transform(by_weight(F.col("counted")), lambda r: template(r, lang))),
        F.flatten(F.transform(F.col("links"), lambda link: _link_reasons(link, lang))),
        one(F.col("model_evidence") > 0, "ai_model", pct=pct))
    asks_context = F.array_contains("signals", "needs_context")
    official = F.array_sort(F.array_distinct(F.transform(
        F.filter("links", lambda link: link["official"]), lambda link: without_www(link["host"]))))
    sites = F.array_join(F.slice(official, 1, 3), ", ")
    counted = F.size("counted") > 0
    trusted = F.concat(
        one(F.size(official) > 0, "official_sites", sites=sites),
        one((kind == "warning") & counted, "is_warning", evidence=evidence),
        one((kind == "report") & counted, "is_story", evidence=evidence))
    looked_up = F.size("confirmed") > 0 if "confirmed" in verdicts.columns else None
    outside = evidence_reasons(F.col("signals"), lang, looked_up)
    own = F.when(asks_context, F.array(template(F.lit("needs_context"), lang))).when(F.col("level") != "safe", risky).otherwise(none)
    return (
        verdicts.withColumn("reasons", F.when(F.col("level") != "safe", F.concat(own, outside)).otherwise(own))
        .withColumn("trust", F.when(F.col("level") == "safe", trusted).otherwise(none))
    )


def shown_reasons(verdicts: DataFrame, n: int = V.REASONS_SHOWN) -> DataFrame:
    return verdicts.withColumn("reasons", F.slice("reasons", 1, n))
