"""Shards by balanced label propagation.

Documents with equal texts are linked. Each has a shard as its label; in every
round the members of a group move towards the shard where most of their
neighbours are: in exchange for as many members that want to go the other way, so
full shards are no hindrance, or as far as that shard's quota of rows has room. This
goes on until no member moves. Every move makes a group less even, so the rounds end.
Members of a group
are interchangeable, so the state of the iteration is how many members a group
has in each shard: at most one row per group and shard, however large the group,
and no pair of neighbours is ever listed. A group larger than a quota fills one
shard after another.

Documents without links then fill what is left of each quota, so the law `rows`
holds exactly: counts of any two shards differ by one at most.

Defined results: null texts have size 1, checksum 0 and no links; repeated rows
are documents of their own; null ids are like other ids; an empty table gives no
rows; with more shards than rows some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakloom.llm.common import before, blocked_total, on_keys, release, scratch, stored

SHARDS = 16
#: Rounds without a move after which the state counts as settled; ties are drawn anew in each.
QUIET = 4
#: Blocks that ranks within one group, shard or the whole table are cut into.
BLOCKS = 256


def _block(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BLOCKS))


def _pick(rank: Column, ends: Column) -> Column:
    """Shard of the first (end, shard) whose end is beyond the rank."""
    return F.get(F.filter(ends, lambda e: rank < e["end"]), F.lit(0))["shard"]


def _literal_ends(sizes: list[int]) -> Column:
    ends, total = [], 0
    for shard, size in enumerate(sizes):
        total += size
        ends.append(F.struct(F.lit(total).cast("long").alias("end"), F.lit(shard).alias("shard")))
    return F.array(*ends)


def _shard_literals(values: list[int], shard: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col(shard) + 1)


def _moved(state: DataFrame, room: list[int], quotas: list[int], turn: int) -> DataFrame:
    """Admitted moves (group, shard, target, moved) of one round.

    A target has more members of the group than the shard that is left, or as many
    and a tie drawn by the round. In every third round only shards with free room are
    targets, so that members whose first choice is full go elsewhere.
    """
    weight = F.struct(F.col("members"), F.xxhash64("group", "shard", F.lit(turn)).alias("tie"))
    open_ = F.col("members") < _shard_literals(quotas, "shard")  # one that the group fills by itself is settled
    if turn % 3 == 0 and any(r > 0 for r in room):
        open_ = open_ & (_shard_literals(room, "shard") > 0)
    goals = (state.where(open_).groupBy("group")
             .agg(F.max(weight).alias("best"), F.max_by("shard", weight).alias("target")))
    wishes = stored(on_keys(state, goals, ["group"]).where((F.col("shard") != F.col("target")) & (weight < F.col("best")))
                    .select("group", "shard", "target", "members", (-F.length(F.bin("total"))).alias("_class"),
                            _block("group").alias("_block")), "shard-wishes")
    # Between two shards as many go as come, larger groups first. There are at most SHARDS^2 pairs.
    asked = wishes.groupBy("shard", "target").agg(F.sum("members").alias("_asked"))
    back = asked.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("_asked").alias("_back"))
    swaps = on_keys(asked, back, ["shard", "target"]).select("shard", "target", F.least("_asked", "_back").alias("_swap"))
    queued = blocked_total(wishes, ["shard", "target"], ["_class", "_block"], ["group"], "members", "_before")
    swapped = F.greatest(F.lit(0), F.least("members", F.coalesce("_swap", F.lit(0)) - F.col("_before")))
    queued = stored(queued.join(F.broadcast(swaps), ["shard", "target"], "left").withColumn("_swapped", swapped)
                    .withColumn("_left", F.col("members") - F.col("_swapped")).drop("_before", "_swap"), "shard-swaps")
    # The others go where there is room; what a shard has room for is cut exactly at its quota.
    queued = blocked_total(queued, ["target"], ["_class", "_block"], ["group", "shard"], "_left", "_before")
    taken = F.greatest(F.lit(0), F.least("_left", _shard_literals(room, "target") - F.col("_before")))
    return (queued.withColumn("moved", F.col("_swapped") + taken).where("moved > 0")
            .select("group", "shard", "target", "moved"))


def _cut(state: DataFrame) -> int:
    """Members that are not in the shard that holds most of their group."""
    return (state.groupBy("group").agg((F.sum("members") - F.max("members")).alias("cut"))
            .agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0])


def propagate(state: DataFrame, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """Final stored state (group, total, shard, members): after `rounds`, or once nothing is cut or has moved for QUIET rounds."""
    spark = state.sparkSession
    quiet = turn = 0
    while quiet < QUIET and (rounds is None or turn < rounds) and _cut(state):
        earlier = list(scratch(spark))
        held = dict(state.groupBy("shard").agg(F.sum("members")).collect())
        moves = stored(_moved(state, [q - held.get(s, 0) for s, q in enumerate(quotas)], quotas, turn), "shard-moves")
        turn, quiet = turn + 1, quiet + 1
        if not moves.isEmpty():
            quiet = 0
            totals = state.select("group", "total").distinct()
            change = (moves.select("group", "shard", (-F.col("moved")).alias("members"))
                      .unionAll(moves.select("group", F.col("target").alias("shard"), F.col("moved").alias("members"))))
            after = (state.select("group", "shard", "members").unionByName(change)
                     .groupBy("group", "shard").agg(F.sum("members").alias("members")).where("members > 0"))
            state = stored(on_keys(after, totals, ["group"]).select("group", "total", "shard", "members"), "shard-state")
        release(spark, [p for p in scratch(spark) if p not in earlier and "shard-state" not in p])
    return state


def balanced_shards(documents: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, group, shard and slot (gapless in its shard) of each row (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text.cast("binary")).alias("text_crc32"), F.md5("text").alias("group"))
                  .withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    totals = rows.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("total")).where("total > 1")
    totals = stored(totals, "shard-groups")
    n, linked_n = rows.count(), totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    quotas = [n // shards + (s < n % shards) for s in range(shards)]

    # Rows with links: in blocks of their group, and dealt to shards in turn to begin with.
    linked = stored(on_keys(rows, totals, ["group"]).withColumn("_block", _block("row")).withColumn("one", F.lit(1).cast("long")),
                    "shard-linked")
    dealt = blocked_total(linked.select("row", "group", "total", "_block", "one"), [], ["_block"], ["row"], "one", "_rank")
    state = stored(dealt.groupBy("group", "total", (F.col("_rank") % shards).cast("int").alias("shard"))
                   .agg(F.count("*").alias("members")), "shard-state")
    state = propagate(state, quotas, rounds)

    # Members in order of rank take the shards of their group.
    ends = (state.withColumn("end", before(["group"], ["shard"], "members") + F.col("members"))
            .groupBy("group").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")))
    blocks = linked.groupBy("group", "_block").agg(F.count("*").alias("_n"))
    blocks = on_keys(blocks.withColumn("_start", before(["group"], ["_block"], "_n")).drop("_n"), ends, ["group"])
    inside = F.row_number().over(Window.partitionBy("group", "_block").orderBy("doc_id", "row")) - 1
    columns = ["doc_id", "size", "text_crc32", "group", "row", "shard"]
    placed = (on_keys(linked, blocks, ["group", "_block"])
              .withColumn("shard", _pick(F.col("_start") + inside, F.col("ends"))).select(*columns))

    held = dict(state.groupBy("shard").agg(F.sum("members")).collect())
    single = stored(rows.join(totals, "group", "left_anti").withColumn("_block", _block("row"))
                    .withColumn("one", F.lit(1).cast("long")), "shard-single")
    filled = (blocked_total(single, [], ["_block"], ["doc_id", "row"], "one", "_rank")
              .withColumn("shard", _pick(F.col("_rank"), _literal_ends([q - held.get(s, 0) for s, q in enumerate(quotas)])))
              .select(*columns))
    everything = stored(placed.unionByName(filled).withColumn("_block", _block("row")).withColumn("one", F.lit(1).cast("long")),
                        "shard-all")
    slots = blocked_total(everything, ["shard"], ["_block"], ["doc_id", "row"], "one", "slot")
    return slots.select("doc_id", "size", "text_crc32", "group", "shard", "slot")


def op4_shard_propagation(spark, sf_dir: str) -> DataFrame:
    placed = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
                         F.lit(None).cast("int").alias("grown_shard"))
