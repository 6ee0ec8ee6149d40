import random

from pyspark.sql import functions as F

from leakloom.operators import ordered


def hot_rows(n=3000, seed=3):
    """One group holds half of the rows, one is null, the rest are small."""
    rng = random.Random(seed)
    groups = ["hot"] * (n // 2) + [None] * (n // 10) + [f"g{rng.randint(0, 200)}" for _ in range(n - n // 2 - n // 10)]
    rng.shuffle(groups)
    return [(i, g, rng.randint(0, 50)) for i, g in enumerate(groups)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, t int").repartition(7)


def test_rank_across_slices(spark):
    rows = hot_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.seq for r in ordered.ranked(frame(spark, rows), ["g"], ["t", "id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, seen = {}, {}
    for i, g, t in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    assert got == expected


def test_last_before_across_slices(spark):
    rows = hot_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        value = F.when(F.col("t") < 5, F.col("id"))
        got = {r.id: r.prev for r in ordered.last_before(frame(spark, rows), ["g"], "id", value, "prev").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, last = {}, {}
    for i, g, t in rows:
        expected[i] = last.get(g)
        if t < 5:
            last[g] = i
    assert got == expected


def test_hot_group_is_cut_into_slices(spark):
    rows = [(i, "hot", i) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sliced = ordered._sliced(frame(spark, rows), ["g"], ["t"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in sliced.groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_numbering_of_all_rows_across_slices(spark):
    rows = hot_rows(1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r.seq, r.t, r.id) for r in ordered.ranked(frame(spark, rows), [], ["t", "id"]).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = sorted((t, i) for i, _, t in rows)
    assert sorted(got) == [(n + 1, t, i) for n, (t, i) in enumerate(expected)]
