"""User pattern files."""

from __future__ import annotations

import logging
import re

from pyspark.sql import SparkSession

from leakloom.catalog import Pattern
from leakloom.functions.text import java_regex

log = logging.getLogger(__name__)


def load_patterns(path: str, spark: SparkSession | None = None) -> list[Pattern]:
    """Patterns of a YAML file with a `patterns` list; any error gives none.

    With a session, Spark reads the file, from wherever it can, and each pattern must
    also compile as the JVM regex that the scan will use.
    """
    try:
        import yaml

        if spark is None:
            with open(path, encoding="utf-8") as handle:
                text = handle.read()
        else:
            text = spark.read.text(path, wholetext=True).first()[0]
        entries = (yaml.safe_load(text) or {}).get("patterns", [])
        loaded = [
            Pattern(
                name=entry["name"],
                pattern=entry["pattern"],
                severity=entry.get("severity", "medium"),
                confidence=float(entry.get("confidence", 0.8)),
                description=entry.get("description", ""),
                remediation=entry.get("remediation", ""),
                pattern_type=entry.get("type", "regex"),
            )
            for entry in entries
        ]
        for pattern in loaded:
            re.compile(pattern.pattern)
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(java_regex(pattern.pattern))
        return loaded
    except Exception as error:
        log.error("cannot load patterns from %s: %s", path, error)
        return []
