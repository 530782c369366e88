"""Sharding by balanced label propagation: linked documents meet, shards stay equal in rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import NULL_ID, any_names, materialize, ranked

#: Parts in which the rows of a group are numbered.
PARTS = 64


def _loads(cells: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _flows(demand: dict[tuple[int, int], int], room: list[int]) -> list[list[int]]:
    """Rows that may move between each two shards: what both directions ask for is exchanged, and what
    is left of a demand takes the room that the shard has."""
    n = len(room)
    room, out = room.copy(), [[0] * n for _ in range(n)]
    for s in range(n):
        for t in range(n):
            out[s][t] = min(demand.get((s, t), 0), demand.get((t, s), 0))
    for t in range(n):
        for s in sorted(range(n), key=lambda s: (room[s], s)):  # the fullest shard first
            more = max(0, min(demand.get((s, t), 0) - out[s][t], room[t]))
            out[s][t] += more
            room[t] -= more
    return out


def propagate(cells: DataFrame, quotas: list[int], rounds: int = 8) -> DataFrame:
    """Moves documents towards the shard where most of their neighbours are.

    ``cells``: g1, g2, shard, n (rows of the group in the shard). The neighbours of a document are all
    others of its group, so a group's cells are the labels around each of its documents, counted, and
    documents of one cell are alike: the state is a row for each cell instead of one for each document. In each round every cell away from
    its group's largest cell (ties by a hash) asks to move there; in every second round only shards
    with room count, so that groups whose best shard stays full find another. Demands between shards
    are summed (shards x shards numbers), exchanges and rooms give the rows that may move, and requests
    are admitted, largest first, up to that: the one at the edge in part, so a group larger than a
    shard fills it and leaves the rest behind. Loads change by the rooms only, hence quotas hold.

    A round is a join of cells with their group's best shard; the running sums that admit requests are
    taken over buckets first (size class, hash), then within a bucket.
    """
    shards = len(quotas)
    for turn in range(rounds):
        loads = _loads(cells, shards)
        room = [q - x for q, x in zip(quotas, loads, strict=True)]
        rooms = F.element_at(F.array(*[F.lit(int(r)) for r in room]), F.col("shard") + 1)
        open_ = (rooms > 0).cast("int") if turn % 2 else F.lit(1)
        rank = F.struct(open_, F.col("n"), F.xxhash64("g1", "g2", "shard"))
        best = cells.groupBy("g1", "g2").agg(F.max_by("shard", rank).alias("to"), F.max_by("n", rank).alias("to_n"), F.max(open_).alias("open"), F.count(F.lit(1)).alias("parts"))
        wanted = cells.join(best.where("open = 1 and parts > 1"), ["g1", "g2"]).where("shard != to and n <= to_n")
        wanted = wanted.withColumn("__c", (64 - F.log2(F.col("n")).cast("int")) * 64 + F.pmod(F.xxhash64("g1", "g2"), F.lit(64)).cast("int"))
        wanted = materialize(wanted.select("g1", "g2", "shard", "to", "n", "__c"), "wanted")
        demand = {(r["shard"], r["to"]): r["n"] for r in wanted.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        allowed = _flows(demand, room)
        if not any(map(any, allowed)):
            if turn % 2:
                break
            continue
        most = F.element_at(F.array(*[F.lit(x) for row in allowed for x in row]), F.col("shard") * shards + F.col("to") + 1)
        along = Window.partitionBy("shard", "to").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
        sums = wanted.groupBy("shard", "to", "__c").agg(F.sum("n").alias("__s"))
        sums = sums.select("shard", "to", "__c", F.coalesce(F.sum("__s").over(along), F.lit(0)).alias("__before"))
        inside = Window.partitionBy("shard", "to", "__c").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1)
        moved = (
            wanted.join(sums.where(F.col("__before") < most), ["shard", "to", "__c"])
            .withColumn("__at", F.col("__before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .withColumn("__m", F.least(F.col("n"), most - F.col("__at")))
            .where("__m > 0")
        )
        flows = moved.select("g1", "g2", F.explode(F.array(F.struct("shard", (-F.col("__m")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("__m").alias("n")))).alias("x"))
        both = cells.select("g1", "g2", "shard", "n").unionByName(flows.select("g1", "g2", "x.shard", "x.n"))
        cells = materialize(both.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
    return cells


def dealt(base: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """The start: each document in the shard that a hash of its id names, whatever its text; linked ones
    counted by group and shard."""
    first = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")
    return base.join(groups, ["g1", "g2"]).groupBy("g1", "g2", first.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def cut_links(cells: DataFrame) -> int:
    """Links between documents of different shards, of cells of linked groups."""
    each = cells.groupBy("g1", "g2").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return each.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0)).cast("long").alias("c")).first()["c"]


def shard(docs: DataFrame, shards: int = 8, rounds: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, __h``: a row for each row of ``docs``.

    Law ``rows``: counts of shards differ by one at most. Links: documents of equal text (nulls are
    equal to each other). Rows start where a hash of their id deals them, and linked ones move by
    :func:`propagate`; rows without links then fill the shards exactly, in ranges of a hashed order.
    ``slot`` numbers the rows of a shard from 0 without gaps. ``grown_shard`` is null (law ``key`` only).

    All state after the first scan is ids, hashes and counts. Groups of any size are split by
    counts, and numbered in buckets. Fewer rows than shards: some shards are empty. No rows: no rows.
    """
    as_bytes = F.col(text).cast("binary")
    base = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(as_bytes), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.col(text)).alias("g1"),
            F.xxhash64(F.lit("second"), F.col(text), F.octet_length(F.col(text))).alias("g2"),
        ),
        "shard",
    )
    groups = base.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    groups = materialize(groups, "groups")
    totals = base.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    quotas = [totals // shards + (s < totals % shards) for s in range(shards)]
    cells = propagate(materialize(dealt(base, groups, shards), "cells"), quotas, rounds)
    return _placed(base, groups, cells, quotas)


def _placed(base: DataFrame, groups: DataFrame, cells: DataFrame, quotas: list[int]) -> DataFrame:
    """Gives the rows of each group to its cells, fills the gaps, and numbers the rows of each shard."""
    shards = len(quotas)
    loads = _loads(cells, shards)
    linked = base.join(groups, ["g1", "g2"])
    linked = linked.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    along = Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = cells.withColumn("__end", F.sum("n").over(along)).select(
        "g1", "g2", F.struct(F.col("__end").alias("e"), F.col("shard").alias("s")).alias("__x")
    )
    # a group has at most one range for each shard
    ranges = ranges.groupBy("g1", "g2").agg(F.array_sort(F.collect_list("__x")).alias("__ranges"))
    salts = linked.groupBy("g1", "g2", "__salt").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy("g1", "g2").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salts.select("g1", "g2", "__salt", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("g1", "g2", "__salt").orderBy("doc_id")
    placed = (
        linked.withColumn("__r", F.row_number().over(inside) - 1)
        .join(starts.join(ranges, ["g1", "g2"]), ["g1", "g2", "__salt"])
        .withColumn("__at", F.col("__start") + F.col("__r"))
        .withColumn("shard", F.element_at(F.filter("__ranges", lambda x: x["e"] > F.col("__at")), 1)["s"])
    )
    columns = ["doc_id", "size", "text_crc32", "g1", "shard"]
    placed = placed.select(*columns)
    single = base.join(groups, ["g1", "g2"], "left_anti")
    if any(x > q for x, q in zip(loads, quotas, strict=True)):
        # the start can exceed a quota where nearly all rows are linked: what is over is dealt anew
        over = materialize(ranked(placed, ["shard"], ["doc_id", "g1"], "__at", buckets=256), "over")
        limit = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("shard") + 1)
        placed = over.where(F.col("__at") < limit).select(*columns)
        single = single.select(*columns[:-1]).unionByName(over.where(F.col("__at") >= limit).select(*columns[:-1]))
    single = ranked(single, [], ["doc_id", "g1"], "__at", buckets=1024)
    ends, edges = 0, []
    for s, gap in enumerate(max(0, q - x) for q, x in zip(quotas, loads, strict=True)):
        ends += gap
        edges.append(F.when(F.col("__at") < ends, s))
    single = single.withColumn("shard", F.coalesce(*edges, F.lit(shards - 1)))
    both = materialize(placed.unionByName(single.select(*columns)), "placed")
    numbered = ranked(both, ["shard"], ["doc_id", "g1"], "slot", buckets=256)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("g1").alias("__h"),
    )


@any_names("doc_id", "text", replaces=("shard", "slot"))
def sharded_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (a column of that name is replaced)."""
    each = Window.partitionBy("__id", "__h")
    placed = shard(docs, doc_id=doc_id, text=text, **options).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__id"), "__h", F.col("shard").alias("__shard"), F.col("slot").alias("__slot")
    )
    placed = placed.withColumn("__n", F.row_number().over(each.orderBy("__shard", "__slot")))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__h": F.xxhash64(F.col(text))})
    keyed = keyed.withColumn("__n", F.row_number().over(each.orderBy(F.lit(0))))
    return keyed.join(placed, ["__id", "__h", "__n"]).select(*docs.columns, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
