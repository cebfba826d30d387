"""Sharding by balanced label propagation under capacity quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivertrace.llm.common import table
from rivertrace.session import write_once

SHARDS = 8
ROUNDS = 6
RANK_BUCKETS = 4096
PIECE_ROWS = 1000
SIZE_CLASSES = 32
LAW = "rows"


def _hash(*columns: Column | str, below: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(below))


def gapless(rows: DataFrame, group: Column, bucket: Column, order: list[str]) -> DataFrame:
    """Adds ``rank_``: 0, 1, 2 ... within ``group``. Rows are numbered inside buckets; buckets are placed by
    their counts, a table of at most groups x buckets rows, so no task orders a whole group."""
    keyed = rows.withColumns({"group_": group, "bucket_": bucket})
    counts = keyed.groupBy("group_", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("group_").orderBy("bucket_")) - F.col("n_")
    starts = counts.select("group_", "bucket_", before.alias("before_"))
    inside = F.row_number().over(Window.partitionBy("group_", "bucket_").orderBy(*order)) - 1
    placed = keyed.withColumn("inside_", inside).join(F.broadcast(starts), ["group_", "bucket_"])
    return placed.withColumn("rank_", F.col("before_") + F.col("inside_")).drop("bucket_", "before_", "inside_")


def _wishes(members: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """(row, shard, to, bucket) for rows with more linked rows elsewhere than in their own shard.

    Links run over hubs: each hub counts its rows per shard, at most one row per shard however many rows
    it has, and each row sums the counts of its hubs; it counts itself once. Ties are settled by a hash of the
    row's first hub and the shard, alike for all rows of a hub, so that two linked rows do not change
    places forever.
    """
    placed = members.join(labels, "row")
    votes = placed.groupBy("hub", F.col("shard").alias("to")).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    pieces = F.ceil(F.col("size") / PIECE_ROWS).cast("long")  # a large hub meets its votes in so many places
    votes = votes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("size")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("row"), pieces))
    sums = salted.join(votes, ["hub", "salt"]).groupBy("row", "shard", "to").agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("hubs"), F.min("anchor").alias("anchor"), F.max("size").alias("size")
    )
    sums = sums.withColumn("n", F.when(F.col("to") == F.col("shard"), F.col("all") - F.col("hubs") + 1).otherwise(F.col("all")))
    best = sums.groupBy("row", "shard").agg(
        F.max_by("to", F.struct("n", F.xxhash64("anchor", "to"), "to")).alias("to"), F.max("anchor").alias("anchor"), F.max("size").alias("size")
    )
    piece = F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / PIECE_ROWS).cast("long"))
    per_size = max(1, buckets // SIZE_CLASSES)
    size_class = F.least(F.floor(F.log2("size")), F.lit(SIZE_CLASSES - 1)).cast("long")
    bucket = size_class * per_size + _hash("anchor", piece, below=per_size)
    return best.filter(F.col("to") != F.col("shard")).select("row", "shard", "to", bucket.alias("bucket"))


def _accepted(wishes: dict[tuple[int, int], dict[int, int]], held: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, bucket): the buckets whose rows may move.

    As many rows may go from s to t as go from t to s; what is beyond shares the room left in t. Buckets of
    small hubs come first, and one that does not fit is passed over, so that a hub too large for a shard does
    not keep small ones apart.
    """
    flow = {pair: sum(counts.values()) for pair, counts in wishes.items()}
    over = {(s, t): n - min(n, flow.get((t, s), 0)) for (s, t), n in flow.items()}
    accepted = []
    for (s, t), counts in wishes.items():
        wanted = sum(n for (_, to), n in over.items() if to == t)
        room = max(0, capacity[t] - held[t])
        left = flow[s, t] - over[s, t] + (min(over[s, t], room * over[s, t] // wanted) if wanted else 0)
        for bucket in sorted(counts):
            if counts[bucket] <= left:
                left -= counts[bucket]
                accepted.append((s, t, bucket))
    return accepted


def propagate(members: DataFrame, labels: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(row, shard) after at most ``rounds`` rounds of moves; ``members(row, hub, anchor, size)``.

    Which rows may move is decided on counts per pair of shards and hash bucket: at most 2^16 numbers
    reach the driver in a round, whatever the data.
    """
    spark, shards = members.sparkSession, len(capacity)
    buckets = max(SIZE_CLASSES, min(1024, (1 << 16) // max(1, shards * shards)))
    for _ in range(rounds):
        wishes = write_once(_wishes(members, labels, buckets), "wishes")
        counts: dict[tuple[int, int], dict[int, int]] = {}
        for r in wishes.groupBy("shard", "to", "bucket").count().collect():
            counts.setdefault((r["shard"], r["to"]), {})[r["bucket"]] = r["count"]
        held = [0] * shards
        for r in labels.groupBy("shard").count().collect():
            held[r["shard"]] = r["count"]
        accepted = _accepted(counts, held, capacity)
        if not accepted:
            break
        allowed = spark.createDataFrame(accepted, "shard int, to int, bucket long")
        moves = wishes.join(F.broadcast(allowed), ["shard", "to", "bucket"]).select("row", "to")
        labels = write_once(labels.join(moves, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "labels")
    return labels


def assign(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``shard`` and ``slot`` (0, 1, 2 ... in each shard) to ``rows(row, ...)``; shards differ by one row
    at most. ``links(row, hub)`` links the rows of a hub; rows alone in their hubs count as unlinked.

    Linked rows start in a shard given by a hash and are moved by label propagation; the quota of a shard
    is an even share of all rows. Unlinked rows, and linked rows beyond a quota, then fill the shards. Hot
    hubs are no hot keys: they are only ever counted per shard.
    """
    sizes = links.groupBy("hub").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = links.join(sizes, "hub")
    anchor = shared.groupBy("row").agg(F.min("hub").alias("anchor"))
    members = write_once(shared.join(anchor, "row").select("row", "hub", "anchor", "size"), "members")
    total = rows.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    linked = members.select("row", "anchor").distinct()
    start = write_once(linked.select("row", _hash(F.lit("start"), "row", below=shards).cast("int").alias("shard")), "labels")
    labels = propagate(members, start, capacity, rounds).join(linked, "row")
    spread = _hash("row", below=RANK_BUCKETS)
    ranked = gapless(labels, F.col("shard"), _hash("anchor", F.pmod(F.xxhash64("row"), F.lit(16)), below=RANK_BUCKETS), ["anchor", "row"])
    kept = write_once(ranked.join(F.broadcast(_table(rows.sparkSession, capacity, "quota")), F.col("shard") == F.col("id_")).filter("rank_ < quota").select("row", "shard", F.col("rank_").alias("slot")), "kept")
    held = [0] * shards
    for r in kept.groupBy("shard").count().collect():
        held[r["shard"]] = r["count"]
    ends, done = [], 0
    for s in range(shards):
        done += capacity[s] - held[s]
        ends.append(done)
    rest = gapless(rows.select("row").join(kept, "row", "left_anti"), F.lit(0), spread, ["row"])
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("rank_")))
    begin = F.element_at(F.array(*[F.lit(h - (e - (c - h))) for h, e, c in zip(held, ends, capacity)]), shard + 1)
    filled = rest.select("row", shard.alias("shard"), (F.col("rank_") + begin).alias("slot"))
    return rows.join(kept.unionByName(filled), "row")


def _table(spark: SparkSession, values: list[int], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"id_ int, {name} long")


def cut_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """One row (links, cut): linked pairs in all, and those whose rows lie in different shards."""
    counts = links.join(rows, "row").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    hubs = counts.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"))
    pairs = F.coalesce(F.sum(F.expr("n * (n - 1) / 2")), F.lit(0)).cast("long")
    return hubs.agg(pairs.alias("links"), F.coalesce(F.sum(F.expr("(n * n - within) / 2")), F.lit(0)).cast("long").alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``docs`` with its size, checksum, shard and slot; equal texts are linked.

    Null texts count as empty for size and checksum and are linked to nothing. Repeated rows are rows of
    their own. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("hub"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = write_once(rows, "rows")  # fixes the row numbers
    links = rows.filter("hub is not null").select("row", "hub")
    return assign(rows.drop("hub"), links, shards, rounds)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_sharding": (query, None)}
