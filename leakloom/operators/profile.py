"""Project profiling: language, framework, package managers.

All markers are fixed lists, so one aggregate per application with a flag per
marker answers every question. Flags combine on the map side; an application
with a third of all files shuffles no more than one with ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakloom import catalog
from leakloom.functions import text as tx


def _walked(files: DataFrame) -> DataFrame:
    dirs = tx.parent_dirs(F.col("path"))
    skipped = F.array(*[F.lit(d) for d in catalog.PROFILE_SKIP_DIRS])
    return files.where(~F.arrays_overlap(dirs, skipped)).select(
        "app_name",
        F.lower(tx.file_name(F.col("path"))).alias("name"),
        F.lower(tx.suffix(F.col("path"))).alias("ext"),
    )


def _best(scores: dict[str, Column]) -> Column:
    """Name of the highest positive score, the first declared one on ties."""
    ranked = F.array(*[F.struct(score.alias("score"), F.lit(-n).alias("order"), F.lit(name).alias("name"))
                       for n, (name, score) in enumerate(scores.items())])
    top = F.array_max(ranked)
    return F.when(top["score"] > 0, top["name"]).otherwise("unknown")


def _number(flag: Column) -> Column:
    return flag.cast("int")


def language_and_framework(files: DataFrame) -> DataFrame:
    """Per application: best language and framework with their scores."""
    name, ext = F.col("name"), F.col("ext")
    flags = {}
    for language, markers in catalog.LANGUAGE_MARKERS.items():
        for n, marker in enumerate(markers):
            flags[f"l_{language}_{n}"] = ext == marker if marker.startswith(".") else name == marker.lower()
    for framework, markers in catalog.FRAMEWORK_MARKERS.items():
        for n, marker in enumerate(markers):
            flags[f"f_{framework}_{n}"] = (name == marker.lower()) | name.contains(marker)
    seen = _walked(files).groupBy("app_name").agg(*[F.bool_or(c).alias(k) for k, c in flags.items()])

    def total(prefix: str, owner: str, markers, weight) -> Column:
        return sum((_number(F.col(f"{prefix}_{owner}_{n}")) * weight(m) for n, m in enumerate(markers)), F.lit(0))

    languages = {k: total("l", k, v, lambda m: 1 if m.startswith(".") else 2)
                 for k, v in catalog.LANGUAGE_MARKERS.items()}
    frameworks = {k: total("f", k, v, lambda m: 1) for k, v in catalog.FRAMEWORK_MARKERS.items()}
    return seen.select(
        "app_name",
        _best(languages).alias("language"),
        F.greatest(*languages.values()).alias("language_score"),
        _best(frameworks).alias("framework"),
        F.greatest(*frameworks.values()).alias("framework_score"),
    )


def profile_applications(applications: DataFrame, files: DataFrame) -> DataFrame:
    """Applications with language and framework; one without files is 'unknown'."""
    profile = language_and_framework(files).withColumnRenamed("app_name", "name")
    return (
        applications.drop("language", "framework").join(profile, "name", "left")
        .drop("language_score", "framework_score")
        .withColumn("language", F.coalesce("language", F.lit("unknown")))
        .withColumn("framework", F.coalesce("framework", F.lit("unknown")))
    )


def _root_flags(files: DataFrame, names) -> DataFrame:
    """Per application, whether each named file lies in its root directory."""
    return files.groupBy("app_name").agg(*[F.bool_or(F.col("path") == n).alias(n.replace(".", "_")) for n in names])


def package_managers(files: DataFrame, only_scanned: bool = False) -> DataFrame:
    """One row per application and package manager found at its root."""
    managers = {m: f for m, f in catalog.MANAGER_FILES.items()
                if not only_scanned or m in catalog.SCANNED_MANAGERS}
    seen = _root_flags(files, sorted({n for f in managers.values() for n in f}))
    found = F.array(*[
        F.when(tx.any_of(F.col(n.replace(".", "_")) for n in names), F.lit(manager))
        for manager, names in managers.items()
    ])
    return seen.select("app_name", F.explode(F.array_compact(found)).alias("package_manager"))


def requirements_file(files: DataFrame) -> DataFrame:
    """The Python requirements file findings point to, first present wins."""
    names = catalog.MANAGER_FILES["pip"]
    seen = _root_flags(files, names)
    choice = F.coalesce(*[F.when(F.col(n.replace(".", "_")), F.lit(n)) for n in names], F.lit(names[0]))
    return seen.select("app_name", choice.alias("requirements_file"))
