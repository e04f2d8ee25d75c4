"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ranked

#: Rounds of moves towards neighbours' shards.
ROUNDS = 4
#: A group of copies moves in pieces of at most this part of a shard, so that a hot group fits.
PIECES_PER_SHARD = 4
#: Hash buckets for each power of two of piece size, in which moves are admitted.
BUCKETS = 64


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: the row counts of any two shards differ by at most one. Rows are
    linked when their texts are equal; links that end in different shards are cut edges.

    Every row starts in the shard of its hash. In each round the members of a group (or of a
    piece of it, where the group is larger than a quarter of a shard) count the shards that
    they are in and ask for the commonest one with room; a shard admits requests, large
    pieces first, while its quota lasts. Groups of over a quarter of a shard are placed before
    that, in as few shards as hold them. After the rounds, pieces that full shards kept apart
    exchange places: all of them give theirs up and take what is free one after another, so
    that the end of a shard cuts one piece at most. Rows without links fill the rest to the
    exact counts; where linked rows overfill a shard, those of its smallest pieces leave.
    Ranks come from range partitions and their counts, never from one task.

    size is the text's UTF-8 bytes plus 16, and null counts as no bytes (its CRC is 0; it is
    linked with empty texts). slot numbers the rows of a shard from 0 without gaps.
    Ties, as of turns or of the commonest shard, go by hashes of pieces and rows. A very long
    text is read once, for its size, CRC and hash, and isn't moved.
    grown_shard belongs to another law and is null. Null doc_ids and repeated rows are dealt
    like any other. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    base = cut(
        rows.select(
            "doc_id",
            (F.octet_length("t") + 16).cast("long").alias("size"),
            F.crc32("t").alias("text_crc32"),
            F.substring(F.sha2("t", 256), 1, 32).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = base.count()
    room = total // shards
    linked, single = _linked(base, room, shards)
    hot, linked, held = _hot(linked, room, shards)
    for _ in range(rounds):
        linked = _round(linked, room, shards, held)
    spread = linked.groupBy("piece").agg((F.min("shard") != F.max("shard")).alias("spread"))
    linked = cut(linked.join(spread, "piece").unionByName(hot))
    apart, linked = linked.where("spread").drop("spread"), linked.where("NOT spread").drop("spread")

    load = {s: 0 for s in range(shards)} | {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    fullest = sorted(load, key=lambda s: (-load[s], s))
    want = {s: room + (k < total % shards) for k, s in enumerate(fullest)}
    columns = ["doc_id", "size", "text_crc32", "row", "n", "piece"]
    single = single.withColumn("n", F.lit(1.0)).withColumn("piece", F.xxhash64("row"))
    keep, pool = linked, single.unionByName(apart.select(*columns))
    if any(load[s] > want[s] for s in load):
        at = ranked(linked, [F.col("shard"), F.col("n").desc(), F.col("piece"), F.col("row")])
        place = F.col("rank") - _by_shard(_starts(load), "shard")
        at = at.withColumn("stays", place < _by_shard(want, "shard"))
        keep = at.where("stays").drop("rank", "stays")
        pool = pool.unionByName(at.where("not stays").select(*columns))
    free = {s: max(0, want[s] - load[s]) for s in load}
    ends = [end for end in _starts(free).values()][1:]
    pool = ranked(pool, [F.col("n").desc(), F.col("piece"), F.col("row")])  # pieces, one after another, before rows without links
    filled = pool.withColumn("shard", F.size(F.filter(F.array(*(F.lit(e) for e in ends)).cast("array<long>"), lambda e: e <= F.col("rank"))))
    columns = ["doc_id", "size", "text_crc32", "row", "shard"]
    dealt = ranked(keep.select(*columns).union(filled.select(*columns)), [F.col("shard"), F.xxhash64("row"), F.col("row")])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - _by_shard(_starts(want), "shard")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _linked(base: DataFrame, room: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The rows with copies, in pieces and in their first shards; the rows without."""
    # a table of its own, so that the join is between two exchanges and a hot text's rows can be split
    groups = cut(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    counted = cut(base.join(groups, "key", "left"))
    pieces = F.ceil(F.col("n") / max(1, room // PIECES_PER_SHARD))
    part = F.pmod(F.xxhash64("row", F.lit("piece")), pieces)
    start = F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).cast("int")
    own = ["doc_id", "size", "text_crc32", "row"]
    linked = counted.where("n IS NOT NULL").select(*own, "key", F.xxhash64("key", part).alias("piece"), (F.col("n") / pieces).alias("n"), start.alias("shard"))
    return linked, counted.where("n IS NULL").select(*own)


def _hot(linked: DataFrame, room: int, shards: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """The rows of groups of over a quarter of a shard, in as few shards as hold them (spread:
    without a place); the other linked rows; the rows of the former in each shard."""
    groups = linked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, room // PIECES_PER_SHARD))
    sizes = sorted(((r["n"], r["key"]) for r in groups.collect()), reverse=True)  # at most four a shard, by their sizes
    free, places = dict.fromkeys(range(shards), room), []
    start = 0
    for n, key in sizes:
        left = n
        while left and (most := max(free.values())) > 0:
            # the least room that holds all that is left, or else the most there is
            s = min((s for s in free if free[s] >= min(left, most)), key=lambda s: (free[s], s))
            take = min(left, free[s])
            places.append((key, start + n - left, start + n - left + take, s))
            free[s] -= take
            left -= take
        if left:
            places.append((key, start + n - left, start + n, None))
        start += n
    spark = linked.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k, -i) for i, (_, k) in enumerate(sizes)], "key string, turn int"))
    at = ranked(linked.join(keys, "key").withColumn("turn", -F.col("turn")), [F.col("turn"), F.col("row")])
    to = F.broadcast(spark.createDataFrame(places, "key string, first long, past long, target int"))
    placed = at.join(to, "key").where("rank >= first AND rank < past")
    # the rows of a group without a place keep together behind it
    hot = placed.select("doc_id", "size", "text_crc32", "row", F.xxhash64("key").alias("piece"), F.col("n"), F.coalesce("target", "shard").alias("shard"), F.col("target").isNull().alias("spread"))
    return hot, linked.join(keys, "key", "left_anti").drop("key"), {s: room - x for s, x in free.items()}


def _round(linked: DataFrame, room: int, shards: int, held: dict[int, int]) -> DataFrame:
    spark = linked.sparkSession
    load = linked.groupBy("shard").agg(F.count(F.lit(1)).alias("load"))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    spare = every.join(load, "shard", "left").select("shard", (F.lit(room) - _by_shard(held, "shard") - F.coalesce("load", F.lit(0))).alias("spare"))  # a row a shard
    tally = linked.groupBy("piece", "shard").agg(F.count(F.lit(1)).alias("c"))
    asked = tally.join(F.broadcast(spare), "shard").groupBy("piece").agg(
        F.sum("c").alias("size"),
        F.max(F.when(F.col("spare") > 0, F.struct("c", F.xxhash64("piece", "shard").alias("tie"), "shard"))).alias("best"),
    )
    asked = asked.where("best.c < size").select(
        "piece",
        F.col("best.shard").alias("target"),
        (F.col("size") - F.col("best.c")).alias("inflow"),
        (F.floor(F.log2("size")) * -BUCKETS + F.pmod(F.xxhash64("piece", F.lit("turn")), F.lit(BUCKETS))).alias("turn"),
    )
    asked = cut(asked)
    turns = asked.groupBy("target", "turn").agg(F.sum("inflow").alias("inflow"))  # at most 64 * 64 rows a shard
    so_far = turns.withColumn("so_far", F.sum("inflow").over(Window.partitionBy("target").orderBy("turn")))
    admitted = so_far.join(F.broadcast(spare.withColumnRenamed("shard", "target")), "target").where("so_far <= spare").select("target", "turn")
    moves = asked.join(F.broadcast(admitted), ["target", "turn"]).select("piece", "target")
    return cut(linked.join(moves, "piece", "left").withColumn("shard", F.coalesce("target", "shard")).drop("target"))


def _starts(sizes: dict[int, int]) -> dict[int, int]:
    found, total = {}, 0
    for s in sorted(sizes):
        found[s] = total
        total += sizes[s]
    return found


def _by_shard(values: dict[int, int], shard: str) -> Column:
    return F.element_at(F.array(*(F.lit(values[s]).cast("long") for s in sorted(values))), F.col(shard) + 1)
