"""Attachments, archives and app manifests, all given as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import values as V
from wardlight.functions.text import strip


def _name(file_name: Column) -> Column:
    return F.lower(strip(F.coalesce(file_name, F.lit(""))))


def extension(file_name: Column) -> Column:
    parts = F.split(_name(file_name), r"\.", -1)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def previous_extension(file_name: Column) -> Column:
    parts = F.split(_name(file_name), r"\.", -1)
    return F.when(F.size(parts) > 2, F.element_at(parts, -2)).otherwise("")


def file_kind(file_name: Column, mime: Column) -> Column:
    ext = extension(file_name)
    return (F.when(ext.isin(V.EXECUTABLE) | F.coalesce(mime == V.APP_MIME, F.lit(False)), "program")
            .when(ext.isin(V.MACRO), "macro").when(ext.isin(V.ARCHIVE), "archive").otherwise("document"))


def kind_level(kind: Column) -> Column:
    return F.when(kind == "program", "dangerous").when(kind.isin("macro", "archive"), "suspicious").otherwise("safe")


def classify_files(files: DataFrame, name: str = "file_name", mime: str = "mime") -> DataFrame:
    """Adds kind, level and double_extension (a harmless-looking extension right before a program's)."""
    with_kind = files.withColumn("kind", file_kind(F.col(name), F.col(mime)))
    return with_kind.withColumn("level", kind_level(F.col("kind"))).withColumn(
        "double_extension", (F.col("kind") == "program") & previous_extension(F.col(name)).isin(V.DECOY))


def needs_look_inside(file_name: Column, size: Column) -> Column:
    """Archives and files of unknown type, up to the size one can fetch."""
    ext = extension(file_name)
    known = ext.isin(V.DECOY + V.OTHER_KNOWN_TYPES + V.EXECUTABLE + V.MACRO)
    return (ext.isin(V.ARCHIVE) | ~known) & (F.coalesce(size, F.lit(0)) <= V.MAX_LOOK_BYTES)


def hidden_in_archive(entries: DataFrame, file: str = "file_id", shown: str = "file_name",
                      entry: str = "entry_name") -> DataFrame:
    """One row per archive that hides a program: a renamed app, or executables among its entries.

    Flags are partial aggregates; only the three listed names are ever gathered (`hidden_count` counts all).
    """
    base = F.element_at(F.split(F.col(entry), "/", -1), -1)
    is_program = base.contains(".") & extension(base).isin(V.EXECUTABLE)
    names = entries.select(file, shown, base.alias("base"), F.lower(base).alias("low"), is_program.alias("program"))
    # Distinct program names first: the number of copies of an entry no longer matters.
    per_name = names.groupBy(file, shown, F.when(F.col("program"), F.col("base")).alias("base")).agg(
        F.bool_or(F.col("low") == "androidmanifest.xml").alias("manifest"),
        F.bool_or(F.col("low").isin("classes.dex", "resources.arsc")).alias("code"))
    flags = per_name.groupBy(file, shown).agg(
        F.bool_or("manifest").alias("manifest"), F.bool_or("code").alias("code"), F.count("base").alias("hidden_count"))
    # The ranking filter is pushed below the shuffle, so at most three names per archive and task travel.
    ranked = per_name.filter(F.col("base").isNotNull()).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(file).orderBy("base"))).filter(F.col("_rank") <= V.NAMES_LISTED)
    listed = ranked.groupBy(file).agg(F.array_sort(F.collect_list("base")).alias("hidden_names"))
    found = flags.join(listed, file, "left")
    app_inside = F.col("manifest") & F.col("code")
    renamed = app_inside & ~extension(F.col(shown)).isin(V.APP_EXTENSIONS)
    hides = ~app_inside & (F.col("hidden_count") > 0)
    return found.filter(renamed | hides).select(
        file, F.when(renamed, "renamed_app").otherwise("hidden_program").alias("finding"),
        F.when(hides, F.col("hidden_count")).otherwise(F.lit(0)).alias("hidden_count"),
        F.when(hides, F.concat(F.array_join("hidden_names", ", "),
                               F.when(F.col("hidden_count") > V.NAMES_LISTED, "…").otherwise(""))).otherwise("")
        .alias("listed"))


def disguised_program(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """Windows programs under another name, from a table of (name, content) such as the binaryFile source."""
    magic = F.substring(F.col(content), 1, 2) == F.lit(b"MZ")
    return files.filter(magic & ~extension(F.col(name)).isin(V.WINDOWS_PROGRAM_NAMES))


def _has_any(column: str, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def app_capabilities(manifests: DataFrame) -> DataFrame:
    """Adds `app_signals`: what an app may do, most dangerous first, from its manifest arrays."""
    tests = {signal: reduce(lambda a, b: a | b, [_has_any(field, wanted) for field, wanted in needs.items()])
             for signal, needs in V.CAPABILITIES}
    reads_messages = reduce(lambda a, b: a | b, [tests[s] for s in V.NEEDS_ICON])
    hidden = reads_messages & ~_has_any("categories", [V.LAUNCHER_CATEGORY])
    return manifests.withColumn("app_signals", F.array_compact(F.array(
        *[F.when(test, signal) for signal, test in tests.items()],
        F.when(hidden, "apk_hidden_icon"),
        F.when(F.size(F.coalesce("tolerated", F.array())) > 0, "apk_evasion"),
    )))
