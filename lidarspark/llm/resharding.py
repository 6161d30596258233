"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes.

A flow over all bytes says how many of an old shard stay and how many go where. Documents above a
thousandth of a new shard are rounded to these targets one by one, largest first; a second flow
says the same of the light ones and the room that is left, and running sums over blocks of
documents cut their mass there. Only sizes by shard and block, and the heavy documents, of which
there are at most HEAVY times the shards, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Blocks of an old shard, and documents of a shard placed one by one, at most.
BLOCKS, HEAVY = 512, 1000


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each supply to each room at the least total cost, by successive shortest paths.

    The rooms must hold all supplies together. Costs are non-negative.
    """
    n, m = len(supply), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = supply[:], room[:]
    while any(left):
        # Bellman-Ford over supplies (0 .. n-1) and rooms (n .. n+m-1)
        dist: list[float] = [0.0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        prev: list[int | None] = [None] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], prev[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], prev[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        ends = [j for j in range(m) if free[j] and dist[n + j] < float("inf")]
        if not ends:
            raise ValueError("the rooms don't hold all supplies")
        at = n + min(ends, key=lambda j: (dist[n + j], j))
        path = [at]
        while prev[path[-1]] is not None:
            path.append(prev[path[-1]])  # type: ignore[arg-type]
        path.reverse()
        steps = list(zip(path, path[1:]))
        most = min([left[path[0]], free[at - n], *(flow[b][a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        left[path[0]] -= most
        free[at - n] -= most
    return flow


def plan(docs: DataFrame, shards: int = 24, old_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row of ``docs``.

    A document is as large as its text in UTF-8 plus 8 bytes (null: 8; its crc32 is null). The
    old layout is ``old_col``, or crc32(doc_id) mod ``old_shards``; a null or unknown old shard
    counts as shard 0. The new capacities are equal shares of all bytes. Slots count from 0
    without a gap. Repeated rows are documents of their own; an empty table gives an empty plan.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
        (F.coalesce(F.col(old_col).cast("int"), F.lit(0)) if old_col else F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % old_shards, F.lit(0)).cast("int")).alias("old_shard"),
    )
    source = source.withColumn("old_shard", F.when(F.col("old_shard").between(0, max(shards, old_shards) - 1), F.col("old_shard")).otherwise(0))
    # blocks are ranges of a hash, so that their sizes add up to places in the old shard
    rows = cut(source.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("block", F.pmod("h", F.lit(BLOCKS)).cast("int")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    limit = max(1, total // (shards * HEAVY))
    # at most shards * HEAVY documents can be larger than that
    heavy = [(r.size, r.old_shard, r.h, r.doc_id, r.n) for r in rows.where(F.col("size") > limit).groupBy("size", "old_shard", "h", "doc_id").agg(F.count("*").alias("n")).collect()]
    light = {(r.old_shard, r.block): (r.b, r.n) for r in rows.where(F.col("size") <= limit).groupBy("old_shard", "block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    olds = max(shards, old_shards)
    room = [total * (s + 1) // shards - total * s // shards for s in range(shards)]

    # targets for all bytes; the heavy ones are rounded to them, largest first
    whole = [sum(b for (o, _), (b, _) in light.items() if o == s) + sum(size * n for size, o, _, _, n in heavy if o == s) for s in range(olds)]
    cost = [[0 if i == j else 1 for j in range(shards)] for i in range(olds)]
    target = min_cost_flow(whole, room, cost)
    placed: dict[tuple, list[int]] = {}
    for size, old, h, doc, n in sorted(heavy, key=lambda x: (-x[0], x[1], x[2], x[3] is None, x[3] or 0)):
        for _ in range(n):
            own = target[old]
            if old < shards and room[old] >= size and 2 * own[old] >= size:
                to = old
            else:
                some = [s for s in range(shards) if own[s] > 0] or list(range(shards))
                to = max(some, key=lambda s: (min(room[s], own[s]) if own[s] > 0 else room[s], s == old, -s))
            room[to] -= size
            own[to] -= size
            placed.setdefault((size, old, h, doc), []).append(to)
    # rooms that a document has overfilled give up what the others must take
    over = -sum(r for r in room if r < 0)
    room = [max(0, r) for r in room]
    while over > 0:
        most = max(range(shards), key=lambda s: room[s])
        take = min(over, max(1, over // shards), room[most])
        room[most] -= take
        over -= take
    supply = [sum(b for (o, _), (b, _) in light.items() if o == s) for s in range(olds)]
    room[0] += max(0, sum(supply) - sum(room))
    flow = min_cost_flow(supply, room, cost)

    # places of the blocks in their old shard, and the cuts: first what stays
    spark = docs.sparkSession
    starts, seen = [], [0] * olds
    for (o, b), (size, _) in sorted(light.items()):
        starts.append((o, b, seen[o]))
        seen[o] += size
    cuts = []
    for o in range(olds):
        at, own = 0, []
        for s in sorted(range(shards), key=lambda s: (s != o, s)):
            if flow[o][s]:
                own.append((at, s))
                at += flow[o][s]
        cuts.append((o, own))
    at_block = spark.createDataFrame(starts, "old_shard int, block int, start long")
    at_cut = spark.createDataFrame(cuts, "old_shard int, cuts array<struct<at:long,to:int>>")
    w = Window.partitionBy("old_shard", "block").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("size") / 2
    # both tables are bounded by the numbers of shards and blocks
    moved = (
        rows.where(F.col("size") <= limit)
        .join(F.broadcast(at_block), ["old_shard", "block"])
        .withColumn("at", middle)
        .join(F.broadcast(at_cut), "old_shard")
        .withColumn("shard", F.expr("element_at(filter(cuts, c -> c.at <= at), -1).to"))
    )
    columns = ["doc_id", "size", "text_crc32", "old_shard", "shard", "h", "block"]
    spread = spark.createDataFrame([(*k, i + 1, s) for k, to in placed.items() for i, s in enumerate(to)], "size long, old_shard int, h long, doc_id long, k int, shard int")
    copies = Window.partitionBy("size", "old_shard", "h", "doc_id").orderBy("text_crc32")
    big = rows.where(F.col("size") > limit).withColumn("k", F.row_number().over(copies)).alias("r")
    same = (F.col("r.size") == F.col("p.size")) & (F.col("r.old_shard") == F.col("p.old_shard")) & (F.col("r.h") == F.col("p.h")) & F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.k") == F.col("p.k"))
    big = big.join(spread.alias("p"), same).select(*[F.col(f"p.{c}" if c == "shard" else f"r.{c}") for c in columns])
    laid = cut(moved.select(*columns).union(big))

    # gapless slots: places within (shard, block), after the counts of the blocks before
    sizes, before, last = [], 0, None
    for r in laid.groupBy("shard", "block").agg(F.count("*").alias("n")).orderBy("shard", "block").collect():
        before = 0 if r.shard != last else before
        sizes.append((r.shard, r.block, before))
        before, last = before + r.n, r.shard
    offsets = F.broadcast(spark.createDataFrame(sizes, "shard int, block int, before long"))
    order = Window.partitionBy("shard", "block").orderBy("h", "doc_id", "size", "text_crc32", "old_shard")
    slot = (F.col("before") + F.row_number().over(order) - 1).cast("long")
    return laid.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", slot.alias("slot"))


def rewrite(docs: DataFrame, planned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 1_000_000) -> DataFrame:
    """Write the affected shards of the layout at ``path``, a folder shard=N each; return (shard, moved_in, moved_out) of them.

    ``docs`` may be the layout itself. A shard that neither gains nor loses a document is left as
    it is, one that loses all is removed. A shard is written in files of ``file_rows`` rows, in
    the order of the slots. Rows are found again by id, size and checksum of the text; rows alike
    in these, nulls included, are interchangeable. Columns ``shard`` and ``slot`` of ``docs`` are
    replaced by the new ones, all others kept. An empty plan writes nothing.
    """
    spark = docs.sparkSession
    flows = planned.where("shard <> old_shard")
    gain = flows.groupBy("shard").agg(F.count("*").alias("moved_in"))
    lose = flows.groupBy(F.col("old_shard").alias("shard")).agg(F.count("*").alias("moved_out"))
    touched = cut(gain.join(lose, "shard", "full").select("shard", F.coalesce("moved_in", F.lit(0)).alias("moved_in"), F.coalesce("moved_out", F.lit(0)).alias("moved_out")))
    # a row for each shard
    own = planned.join(F.broadcast(touched.select("shard")), "shard", "left_semi")
    left = {r.shard for r in touched.select("shard").collect()} - {r.shard for r in own.select("shard").distinct().collect()}
    key = ["_doc", "_size", "_crc"]
    copies = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    own = own.select(F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    # every copy of a row is counted, those of shards left alone last
    others = planned.join(F.broadcast(touched.select("shard")), "shard", "left_anti").select(F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.lit(None).cast("int").alias("_shard"), F.lit(None).cast("long").alias("_slot"))
    own = own.union(others).withColumn("_k", copies(F.col("_shard").asc_nulls_last(), "_slot")).where("_shard is not null")
    # all columns under names of their own, so that none clashes
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    text, own_names = F.col(f"c{kept.index(text_col)}"), [f"c{i}" for i in range(len(kept))]
    rows = named.select(
        "*",
        F.col(f"c{kept.index(id_col)}").cast("long").alias("_doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    ).withColumn("_k", copies(F.xxhash64(*own_names)))
    alike = [rows[c].eqNullSafe(own[c]) for c in [*key, "_k"]]
    whole = rows.join(own, alike).select(*[F.col(c).alias(k) for c, k in zip(own_names, kept)], F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))
    dealt = whole.repartition("shard", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows).parquet(path)
    for shard in left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
