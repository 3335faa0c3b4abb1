"""Mixing sources to target weights by proportionate-fair scheduling of blocks.

A source's documents, in doc_id order, form blocks of equal size. A source with weight w gets a slot for its
i-th block (i from 1) no earlier than floor((i - 1) / w) and before ceil(i / w); of the blocks released, the one
with the earliest deadline takes the slot. Each source then has had its share of any number of first slots
to within less than one block. With weights that are whole shares of a period, the schedule repeats every
period, so it is worked out for one period and looked up for all blocks.

Slots of a source that has run out stay empty; what is left of the others goes on in its own slots, and no
document is dropped or repeated.

Defined results: a null source is a source of its own; sources without a target (or with a share below 1)
get one share; a null doc_id sorts first; repeated rows each get a place, in no set order among themselves;
empty input gives no rows; only doc_id and source are read for the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import let

#: Documents in a block.
BLOCK_DOCS = 32
#: doc_ids that are ranked together, so that no source is ranked in one task.
RANGE = 4096
#: Slots of a schedule that are listed together.
STRETCH = 1024


def _key(source: Column) -> Column:
    return F.coalesce(source, F.lit("\0"))


def root_targets(docs: DataFrame) -> DataFrame:
    """source, share: the whole square root of each source's number of documents."""
    return docs.groupBy("source").agg(F.floor(F.sqrt(F.count("*"))).cast("long").alias("share"))


def _shares(targets: DataFrame) -> DataFrame:
    """key, share, period: a row for each source; the period is the sum of all shares."""
    all_of = targets.groupBy(_key(F.col("source")).alias("key")).agg(F.greatest(F.max("share"), F.lit(1)).cast("long").alias("share"))
    return all_of.withColumn("period", all_of.agg(F.sum("share")).scalar())


def period_schedule(targets: DataFrame) -> DataFrame:
    """key, turn, slot, share, period: where in a period a source's turn-th block (from 0) goes.

    Earliest deadline first over one period. Sources with equal shares have the same releases and deadlines and
    take turns by key, so the fold over the slots has one state for each distinct share, fewer than sqrt(2 * period):
    as much work as slots times distinct shares. Its row holds one number for each source and slot.
    """
    ranked = _shares(targets).withColumn("rank", F.row_number().over(Window.orderBy("key")))
    classes = ranked.groupBy("share").agg(F.first("period").alias("period"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    one = classes.agg(F.sort_array(F.collect_list(F.struct("share", "ranks"))).alias("all"), F.first("period").alias("period")).filter("period > 0")

    def block(c: Column, turn: Column, member: Column) -> Column:
        # the next block of the c-th share; those with the earliest deadline, then the smallest key come first
        s = F.get("all", c)
        return F.struct(
            F.ceil((turn + 1) * F.col("period") / s["share"]).alias("deadline"),
            F.get(s["ranks"], member).alias("rank"),
            F.floor(turn * F.col("period") / s["share"]).alias("release"),
            c.alias("c"),
            turn.alias("turn"),
            member.alias("member"),
        )

    def after(x: Column) -> Column:
        last = x["member"] + 1 == F.size(F.get("all", x["c"])["ranks"])
        return block(x["c"], F.when(last, x["turn"] + 1).otherwise(x["turn"]), F.when(last, 0).otherwise(x["member"] + 1))

    def step(state: Column, t: Column) -> Column:
        first = F.array_min(F.filter(state["due"], lambda x: x["release"] <= t))
        taken = lambda f: F.struct(F.transform(state["due"], lambda x: F.when(x["c"] == f["c"], after(x)).otherwise(x)).alias("due"), F.concat(state["slots"], F.array(f["rank"])).alias("slots"))
        return let(first, taken)

    def stretch(state: Column, t: Column) -> Column:
        # STRETCH slots in a list of their own, as a list is copied for each slot
        own = F.struct(state["due"].alias("due"), F.array().cast("array<int>").alias("slots"))
        upto = F.least(t + STRETCH, F.col("period")) - 1
        return let(F.aggregate(F.sequence(t, upto), own, step), lambda s: F.struct(s["due"].alias("due"), F.concat(state["slots"], F.array(s["slots"])).alias("slots")))

    start = F.struct(F.transform("all", lambda s, c: block(c, F.lit(0).cast("long"), F.lit(0))).alias("due"), F.array().cast("array<array<int>>").alias("slots"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("period") - 1, F.lit(STRETCH).cast("long"))
    slots = one.select(F.posexplode(F.aggregate(starts, start, stretch, lambda s: F.flatten(s["slots"]))).alias("slot", "rank"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("slot")) - 1
    return slots.join(ranked, "rank").select("key", turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"), "share", "period")


#: What placing adds to a row.
RESULTS = ("block", "release", "deadline", "slot", "place")


def placed(docs: DataFrame, targets: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """docs with columns block, release, deadline, slot, place: its source's block number, and where it goes.

    Columns of docs may have any names; those named like a result give way to it.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "source")]
    own = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row")] if rest else []
    at = _placed(docs.select(*own, "doc_id", "source"), targets, block_docs)
    kept = [F.col(c) if c not in rest else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in RESULTS]
    return at.select(*kept, *RESULTS)


def _placed(docs: DataFrame, targets: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """placed() for docs with no columns but doc_id, source and _row."""
    keyed = docs.withColumn("_key", _key(F.col("source"))).withColumn("_range", F.expr(f"coalesce(doc_id div {RANGE}, -1152921504606846976)"))
    sizes = keyed.groupBy("_key", "_range").agg(F.count("*").alias("n"))
    targets = targets.select("source", "share").union(sizes.select("_key", F.lit(1).cast("long")).distinct())
    shares = _shares(targets).withColumnRenamed("key", "_key")
    turns = period_schedule(targets).select(F.col("key").alias("_key"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot"))
    before = sizes.select("_key", "_range", "n", (F.sum("n").over(Window.partitionBy("_key").orderBy("_range")) - F.col("n")).alias("_before")).join(shares, "_key")
    # a row for each block of a range, not for its documents; then the range's slots in the order of its blocks
    numbers = before.withColumn("_block", F.explode(F.expr(f"sequence(_before div {block_docs}, (_before + n - 1) div {block_docs})"))).withColumn("_turn", F.expr("_block % share"))
    slots = numbers.join(turns, ["_key", "_turn"]).groupBy("_key", "_range", "_before", "share", "period").agg(F.sort_array(F.collect_list(F.expr("_block div share * period + _slot"))).alias("_slots"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_range").orderBy("doc_id")) - 1).join(slots, ["_key", "_range"])
    met = ranked.withColumn("_at", F.col("_rank") + F.col("_before")).withColumn("block", F.expr(f"_at div {block_docs}")).withColumn("place", F.expr(f"_at % {block_docs}")).withColumn("_turn", F.expr("block % share"))
    round_ = F.expr("block div share") * F.col("period")
    return met.select(
        *docs.columns,
        "block",
        (round_ + F.floor(F.col("_turn") * F.col("period") / F.col("share"))).alias("release"),
        (round_ + F.ceil((F.col("_turn") + 1) * F.col("period") / F.col("share"))).alias("deadline"),
        F.expr(f"get(_slots, int(block - _before div {block_docs}))").alias("slot"),
        F.col("place").cast("long").alias("place"),
    )


def mixed(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The rows of docs in the order of the mix, by default to root_targets."""
    at = _placed(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source"), root_targets(docs) if targets is None else targets)
    return at.orderBy("slot", "place").select("_row.*")
