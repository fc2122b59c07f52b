"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each link group hangs on a hub (its members vote through it,
so no pairs are made); a group that would fill a large part of a shard is split by a hash of its
ids into chunks that vote for themselves. Documents begin in the shard of a hash of their id. In each round
every hub finds the shard where most of its members are, and the others propose to move there;
a shard accepts, by a hash of the hub, no more than its quota of linked documents leaves room for,
counting the room that those who leave it in this round make. The rounds end when a round moves
nothing, or less than ``LEAST_MOVED`` of the documents that are linked. Then rows beyond a shard's exact share, unlinked ones
first, go to the shards that lack rows. The law that holds is ``rows``: the counts of any two
shards differ by one at most.

Only tables of one row for each shard come to the driver. Ranks are counted in buckets
(see :func:`florilege.llm.scratch.ranked`), so that no task holds a shard.

Defined results: a null text has size 1 (no bytes plus 1), CRC 0 and no links. Repeated rows are
linked copies; each gets a slot. Equal votes are broken by a hash. Texts of any length count whole. With fewer rows than shards some shards are empty. An empty table
gives an empty result. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm.scratch import Scratch, ranked

SHARDS = 16
#: Part of the linked documents that a round has to move for another one to follow.
LEAST_MOVED = 0.001
#: A group that is larger than this part of a shard is split into chunks of about that size.
CHUNK_PART = 1
RANK_BUCKETS = 256


def _unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _per_shard(df: DataFrame, key: str, value: Column, shards: int) -> list[int]:
    found = {r[0]: int(r[1]) for r in df.groupBy(key).agg(value).collect()}  # a row for each shard
    return [found.get(i, 0) for i in range(shards)]


def _room(flow: dict[tuple[int, int], int], load: list[int], quota: int, shards: int) -> list[float]:
    """The part of the proposals to move to each shard that it can accept: the greatest parts at which
    no shard gets beyond its quota, or beyond its load if that is more, once the others have left."""
    part = [1.0] * shards
    incoming = [sum(n for (a, b), n in flow.items() if b == i != a) for i in range(shards)]
    while True:
        leaving = [sum(n * part[b] for (a, b), n in flow.items() if a == i != b) for i in range(shards)]
        most = [min(1.0, max(0.0, max(quota, load[i]) - load[i] + leaving[i]) / incoming[i]) if incoming[i] else 0.0 for i in range(shards)]
        if all(p - m < 1e-4 for p, m in zip(part, most, strict=True)):
            return most
        part = most


def _propagate(state: DataFrame, scratch: Scratch, shards: int, quota: int) -> DataFrame:
    """Move hubs' members together. ``state``: ``grp, chunk, init, cnt, cur``."""
    hub = ["grp", "chunk"]
    turn = 0
    while True:
        votes = state.groupBy(*hub, "cur").agg(F.sum("cnt").alias("v"))
        wish = votes.groupBy(*hub).agg(F.max(F.struct("v", F.xxhash64(*hub, "cur").alias("tie"), "cur"))["cur"].alias("wish"))
        asked = state.join(wish, hub)
        flow = {(r["cur"], r["wish"]): r["n"] for r in asked.groupBy("cur", "wish").agg(F.sum("cnt").alias("n")).collect()}  # shards x shards rows
        load = [sum(n for (a, _), n in flow.items() if a == i) for i in range(shards)]
        total = sum(load)
        room = _room(flow, load, quota, shards)
        if sum(n * room[b] for (a, b), n in flow.items() if a != b) < max(1, LEAST_MOVED * total):
            return state
        moves = (F.col("cur") != F.col("wish")) & (_unit(F.col("grp"), F.col("chunk"), F.lit(turn)) < _pick(room, F.col("wish")))
        state = scratch.write(asked.select(*hub, "init", "cnt", F.when(moves, F.col("wish")).otherwise(F.col("cur")).alias("cur")), f"state-{turn}")
        turn += 1


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(
        docs["doc_id"],
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"])).alias("grp"),
    )
    slim = scratch.write(slim.withColumn("init", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int")), "slim")
    total = slim.count()
    chunk_rows = max(1, total // (shards * CHUNK_PART))
    groups = scratch.write(slim.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    placed = slim.join(groups, "grp", "left").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("n") / chunk_rows)))
    nodes = scratch.write(placed, "nodes")
    state = scratch.write(nodes.where("n is not null").groupBy("grp", "chunk", "init").agg(F.count(F.lit(1)).alias("cnt")).withColumn("cur", F.col("init")), "state")
    state = _propagate(state, scratch, shards, -(-total // shards))
    labelled = nodes.join(state.drop("cnt"), ["grp", "chunk", "init"], "left").withColumn("cur", F.coalesce("cur", "init"))
    labelled = scratch.write(labelled.select("doc_id", "size", "text_crc32", "grp", "n", "chunk", "cur"), "labelled")

    have = _per_shard(labelled, "cur", F.count(F.lit(1)), shards)
    share = [total // shards + (i < total % shards) for i in range(shards)]
    over, starts, ends, lacks = 0, [], [], 0
    for i in range(shards):
        starts.append(over)
        over += max(0, have[i] - share[i])
        lacks += max(0, share[i] - have[i])
        ends.append(lacks)
    linked = F.col("n").isNotNull()
    spread = F.when(F.col("n") > max(1, total // 512), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(16))).otherwise(F.lit(0))
    bucket = F.struct(F.when(linked, 0).otherwise(1).alias("kind"), F.pmod(F.when(linked, F.xxhash64("grp", "chunk")).otherwise(F.xxhash64("doc_id")), F.lit(RANK_BUCKETS)).alias("b"), spread.alias("s"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    first = ranked(labelled, scratch, ["cur"], bucket, order, "_rank")
    extra = F.col("_rank") - _pick(share, F.col("cur"))
    at = _pick(starts, F.col("cur")) + extra
    to = F.lit(shards - 1)
    for i in reversed(range(shards)):
        to = F.when(at < ends[i], i).otherwise(to)
    final = first.withColumn("shard", F.when(extra >= 0, to).otherwise(F.col("cur")).cast("int"))
    final = scratch.write(final.select("doc_id", "size", "text_crc32", "shard"), "final")
    slots = ranked(final, scratch, ["shard"], F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(RANK_BUCKETS)), order, "slot")
    scratch.keep_only("final", "offsets-slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
