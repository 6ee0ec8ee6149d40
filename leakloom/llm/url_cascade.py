"""URL rules by a Bloom filter cascade.

A rule is a host and the start of a path; it fits its host and all subdomains.
Every url has a few keys: each parent domain of its host, of as many labels as some
rule's host at most, with each start of its path that is as long as some rule's path.
Keys over all urls are the universe.
The first filter encodes the listed keys, the second the unlisted keys that pass
the first, the third the listed keys that pass the second, and so on until
nothing passes wrongly. Since the universe is complete, asking the filters is
exact, and judging a url is one expression over its own row: no join, no shuffle.

The filters are literals of the plan, each of `most_bits` bits at most: what a level
has to encode is counted before it is built, and the first one is made large enough
that few keys of the universe pass it wrongly. Where a level would be larger, because
of a long list or of very many keys, a shuffled join on the same keys judges instead,
with the same result.

Defined results: a null url, or one without `://`, has an empty host and path and
fits no rule; where none fits, rule is null and the verdict is the default.
Repeated rows are judged alike; other columns are not looked at. Hosts and paths may
be of any length: only the last labels and the first characters that rules have count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from leakloom.llm.common import fold_ascii, stored

#: host, start of path, verdict
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
BITS_PER_KEY = 12
HASHES = 4
MOST_BITS = 1 << 22


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; empty if there is none."""
    return F.coalesce(fold_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, lengths: Sequence[int], most_labels: int) -> Column:
    """Every parent domain (the host itself included) of at most so many labels, with every start of the path of those lengths."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, most_labels), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
                         lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))


class Cascade:
    """Filters of alternating levels; `holds` asks them about a key of the universe."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            # Not in an odd level: not listed. Not in an even one: listed, as no level calls a member absent.
            answer = F.when(passes(key, self.levels[level], level), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _places(key: Column, bits: int, level: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(level * HASHES + i)).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


def passes(key: Column, words: np.ndarray, level: int) -> Column:
    filled = F.lit(words)
    found = F.lit(True)
    for place in _places(key, 64 * len(words), level):
        word = F.get(filled, F.shiftright(place, 6).cast("int"))
        found = found & (F.bit_get(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found


def _bits_for(n: int, others: int, most_bits: float) -> int:
    """Size of a filter of n keys: larger, within `most_bits`, while too many of the others would pass for the next level."""
    bits = 64
    while bits < n * BITS_PER_KEY:
        bits *= 2
    while bits * 2 <= most_bits and others * -np.expm1(-HASHES * n / bits) ** HASHES > max(n, most_bits / (4 * BITS_PER_KEY)):
        bits *= 2
    return bits


def _filled(keys: DataFrame, bits: int, level: int) -> np.ndarray:
    """Filter of the distinct `key`s: at most as many words as its size has."""
    rows = (keys.select(F.explode(F.array(*_places(F.col("key"), bits, level))).alias("place"))
            .groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int")))
                 .alias("bits"))
            .collect())
    words = np.zeros(bits // 64, np.int64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return words


def build_cascade(universe: DataFrame, most_bits: float = float("inf")) -> Cascade | None:
    """Cascade over the stored rows (key, listed) of a universe of distinct keys; None if a level needs more than `most_bits`."""
    levels: list[np.ndarray] = []
    sides = [universe.where("listed"), universe.where("NOT listed")]
    n = sides[0].count()
    others = sides[1].count() if most_bits < float("inf") else 0
    while n:
        level = len(levels)
        bits = _bits_for(n, others if level == 0 else 0, most_bits)
        if bits > most_bits:
            return None
        levels.append(_filled(sides[level % 2], bits, level))
        other = (level + 1) % 2
        sides[other] = sides[other].where(passes(F.col("key"), levels[level], level))
        n = sides[other].count()
    return Cascade(levels)


def _rule_rows(spark, rules) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules.select("host", "path", "verdict")
    fields = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*fields)))


def judge_urls(pages: DataFrame, rules=RULES, default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url).

    `rules` is a sequence or a frame of (host, path, verdict) with verdicts allow
    and block. The longest fitting rule wins, of equally long ones that with the
    longer host.
    """
    spark = pages.sparkSession
    listed = stored(_rule_rows(spark, rules).select(
        F.concat("host", "path").alias("key"), F.length("host").alias("host_length"), F.length("path").alias("start"),
        F.size(F.split("host", r"\.")).alias("labels"),
        (F.col("verdict") == "block").alias("blocks")).dropDuplicates(["key"]), "url-rules")
    lengths = sorted(r[0] for r in listed.select("start").distinct().collect())
    most_labels = listed.agg(F.max("labels")).first()[0]
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not lengths:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = url_keys(F.col("host"), F.col("path"), lengths, most_labels)
    if listed.count() * BITS_PER_KEY > most_bits:
        return _judge_by_join(urls, listed, keys, default)

    universe = stored(
        urls.select(F.explode(keys).alias("key")).distinct()
        .join(listed.select("key", "blocks"), "key", "left")
        .select("key", F.col("blocks").isNotNull().alias("listed"), "blocks"), "url-universe")
    members = build_cascade(universe.select("key", "listed"), most_bits)
    blocking = members and build_cascade(universe.where("listed").select("key", F.col("blocks").alias("listed")), most_bits)
    if blocking is None:
        return _judge_by_join(urls, listed, keys, default)
    fitting = F.filter(keys, members.holds)
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(
        F.length(k).alias("n"), F.length(F.substring_index(k, "/", 1)).alias("h"), k.alias("key"))))
    return (urls.withColumn("rule", longest["key"])
            .withColumn("verdict", F.when(F.col("rule").isNull(), F.lit(default))
                        .when(blocking.holds(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))))


def _judge_by_join(urls: DataFrame, listed: DataFrame, keys: Column, default: str) -> DataFrame:
    places = urls.select("host", "path").distinct()
    best = (places.select("host", "path", F.explode(keys).alias("key")).join(listed, "key")
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.length("key").alias("n"), "host_length", "key", "blocks")).alias("best")))
    return (urls.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.key").alias("rule"),
                    F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks"), F.lit("block"))
                    .otherwise(F.lit("allow")).alias("verdict")))


def op2_url_cascade(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP2_SQL = """
WITH urls AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT urls.*, (SELECT max_by(rhost || rpath || ' ' || rverdict, length(rhost || rpath)) FROM rules
                  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
  FROM urls)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
       CASE WHEN best IS NULL THEN 'allow' ELSE split_part(best, ' ', 2) END AS verdict
FROM judged
"""
