"""Shards of even size that keep linked documents together: balanced label propagation.

Documents with equal texts are linked.  Each starts with a shard by hash as its label.
In every round each group of linked documents that has no shard yet asks for the shard
most of its bytes are labelled with, among those still open to it; the requests are
added up in Spark, granted within the room that is left, largest first, and joined to
the groups, which take the shard as their label.  What a group leaves is free for
others, so a shard's load is what it was granted.  Refused groups ask again, until a
round grants nothing.

1.  Groups over 1 / ``WHOLE`` of the mean shard ask one by one, larger ones (by powers
    of two) before smaller ones, and only where they fit, first where they fill at
    least half of the room.  Of those that no shard has room for, a group of up to
    1 / ``SPLIT`` of the mean goes whole to the emptiest; a larger one is split over
    the room that is left.
2.  Smaller groups are never split.  They ask in cells, by wish and hash.  A shard that
    refuses a cell is closed, and cells refused everywhere go to the emptiest shard.
3.  Documents without links cut no edge wherever they go: they fill what is missing
    in each shard, largest pieces first.

Law: `bytes`.  Defined results: a null text has no bytes and size 1, and equals an
empty text; null ids and repeated rows are placed like any other row; a document
larger than the mean shard makes its shard that much larger; an empty table gives
no rows.  Other columns are not used.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.settings import cut_lineage

PIECES = 1 << 14  # hash ranges of unlinked documents
CELLS = 1 << 10  # hash ranges of small groups with one wish
WHOLE = 256  # groups above this part of the mean are placed one by one: at most WHOLE a shard
SPLIT = 64  # groups above this part of the mean may be split
SLOT_RANGES = 4096
UNITS = 64  # hash ranges of one text's rows within a shard


def _pieces(*columns: str, n: int = PIECES):
    return F.pmod(F.xxhash64(*columns, F.lit("piece")), F.lit(n)).cast("int")


def _emptiest(room: list[float]) -> int:
    return max(range(len(room)), key=room.__getitem__)


def _parts(keys: list[tuple[int, int]], room: list[float]) -> dict[int, list[list]]:
    """[shard, bytes] for each group (text_key, size) that no shard has room for; lowers ``room``."""
    split = {}
    for key, size in sorted(keys, key=lambda k: (-k[1], k[0])):
        parts = split[key] = []
        for s in sorted(range(len(room)), key=lambda s: (-room[s], (key >> s) % 8191, s)):
            part = max(min(size, room[s]), 0)
            parts.append([s, part])
            room[s] -= part
            size -= part
    return split


def _place_units(units: list, split: dict[int, list[list]], room: list[float]) -> list[tuple[int, int, int, int]]:
    """(text_key, first, unit, home) of each of ``units`` (text_key, first, unit, size): parts are filled in turn.

    Corrects ``room`` by what units do not divide as the parts ask.
    """
    for parts in split.values():
        for s, part in parts:
            room[s] += part
    out = []
    for key, first, unit, size in sorted(units, key=lambda u: (-u[3], u[0], u[1], u[2])):
        parts = split[key]
        at = next((p for p in parts if p[1] >= size), None) or max(parts, key=lambda p: p[1])
        at[1] -= size
        room[at[0]] -= size
        out.append((key, first, unit, at[0]))
    return out


def _granted(requests: list, room: list[float]) -> tuple[list[tuple[int, int]], set[int]]:
    """(to, cell) of the ``requests`` (to, cell, b) that fit, largest first, and the shards that refused one.

    Lowers ``room``.
    """
    yes, full = [], set()
    for to, cell, b in sorted(requests, key=lambda r: (-r[2], r[1], r[0])):
        if b <= room[to]:
            room[to] -= b
            yes.append((to, cell))
        else:
            full.add(to)
    return yes, full


def _wish(room: list[float], need):
    """The shard a group asks for: most of its bytes, of the shards with room for ``need``; null if there is none."""
    rooms = F.array(*[F.lit(float(r)) for r in room])

    def offer(s):
        left = F.element_at(rooms, s + 1)
        held = F.coalesce(F.element_at("held", s), F.lit(0))
        return F.struct(
            (left >= need).alias("fits"), (left < 2 * need).alias("tight"), held, F.xxhash64("text_key", s), s.alias("s")
        )

    offers = F.transform(F.sequence(F.lit(0), F.lit(len(room) - 1)), offer)
    return F.array_max(F.filter(offers, lambda o: o["fits"]))["s"]


def _rounds(groups: DataFrame, room: list[float], one_by_one: bool) -> tuple[list[DataFrame], DataFrame]:
    """Tables (text_key, shard) of the groups that were granted a shard, one a round, and the groups refused everywhere.

    ``groups`` has text_key, cell, size, held; groups of one cell and wish are granted together.
    """
    spark = groups.sparkSession
    settled, shown = [], room
    while True:
        asking = groups.withColumn("to", _wish(shown, F.col("size") if one_by_one else F.lit(0.0)))
        requests = asking.where("to is not null").groupBy("to", "cell").agg(F.sum("size").alias("b")).collect()
        yes, full = _granted([tuple(r) for r in requests], room)
        if not yes:
            return settled, groups
        grants = F.broadcast(spark.createDataFrame([(*r, True) for r in yes], "to int, cell long, granted boolean"))
        labelled = cut_lineage(asking.join(grants, ["to", "cell"], "left"))
        settled.append(labelled.where("granted").select("text_key", F.col("to").alias("shard")))
        groups = labelled.where("granted is null").select("text_key", "cell", "size", "held")
        if not full and len(yes) == len(requests) and not groups.limit(1).count():
            return settled, groups
        # One by one, groups see the room that is left; cells only whether a shard has refused one.
        shown = room if one_by_one else [-1.0 if s in full or x < 0 else 0.0 for s, x in enumerate(shown)]


def _forced(groups: DataFrame, room: list[float]) -> DataFrame:
    """(text_key, shard) of ``groups``, cell by cell to the emptiest shard; lowers ``room``."""
    homes = []
    cells = groups.groupBy("cell").agg(F.sum("size").alias("b")).collect()
    for cell, b in sorted((tuple(r) for r in cells), key=lambda c: (-c[1], c[0])):
        homes.append((cell, _emptiest(room)))
        room[homes[-1][1]] -= b
    homes = groups.sparkSession.createDataFrame(homes, "cell long, shard int")
    return groups.join(F.broadcast(homes), "cell").select("text_key", "shard")


def propagate(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard): every row with its shard.

    The driver sees tables of fixed size: requests by shard and cell, where a cell is
    one of at most ``WHOLE`` * ``shards`` large groups or one of ``CELLS`` ranges, and
    the units of groups to split.  A unit is the rows of one text, first shard and hash
    range; a text has at most ``shards`` * ``UNITS`` of them however many copies it
    has, and rows meet their unit, not their text, so no join has a hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    first = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int")
    rows = cut_lineage(rows.withColumns({"first": first, "unit": _pieces("text_key", "doc_id", n=UNITS)}))
    spark = rows.sparkSession
    unit = ["text_key", "first", "unit"]
    units = cut_lineage(rows.groupBy(*unit).agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    held = units.groupBy("text_key", "first").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    groups = held.groupBy("text_key").agg(
        F.sum("n").alias("n"),
        F.sum("size").alias("size"),
        F.map_from_entries(F.collect_list(F.struct("first", "size"))).alias("held"),
    )
    groups = cut_lineage(groups)
    total = groups.agg(F.sum("size")).first()[0]
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.col("first").alias("shard"))
    cap = total / shards
    room = [cap] * shards
    # Class k: the k-th halving of the mean; groups of the last large class may not be split.
    level = F.greatest(F.ceil(F.log2(F.lit(cap) / F.col("size"))), F.lit(0)).cast("int")
    last = (SPLIT - 1).bit_length() + 1
    kind = F.when(F.col("size") * WHOLE <= F.lit(cap), -1).when(F.col("size") * SPLIT <= F.lit(cap), last)
    linked = groups.where("n > 1").withColumn("class", kind.otherwise(F.least(level, F.lit(last - 1))))
    found = {r["class"] for r in linked.select("class").distinct().collect()}
    large = cut_lineage(linked.where("class >= 0").withColumn("cell", F.col("text_key")).drop("n"))
    labels, split = [], {}
    for k in sorted(found - {-1}):
        settled, refused = _rounds(large.where(F.col("class") == k).drop("class"), room, True)
        labels += settled
        if k == last:
            labels.append(_forced(refused, room))
        else:
            split |= {r["text_key"]: r["size"] for r in refused.select("text_key", "size").collect()}
    parts = _parts(list(split.items()), room)
    torn = []
    if split:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in split], "text_key long"))
        torn = units.join(keys, "text_key").select(*unit, "size").collect()
        torn = _place_units([tuple(r) for r in torn], parts, room)
    if -1 in found:
        small = linked.where("class = -1").withColumn("cell", _pieces("text_key", n=CELLS).cast("long"))
        settled, refused = _rounds(small.drop("n", "class"), room, False)
        labels += [*settled, _forced(refused, room)]
    alone = groups.where("n = 1").groupBy(_pieces("text_key").alias("piece"))
    sums = alone.agg(F.sum("size").alias("b")).collect()
    heap = [(-room[s], s) for s in range(shards)]
    heapq.heapify(heap)
    home = np.zeros(PIECES, int)
    for r in sorted(sums, key=lambda r: (-r["b"], r["piece"])):
        load, s = heapq.heappop(heap)
        home[r["piece"]] = s
        heapq.heappush(heap, (load + r["b"], s))
    homes = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(home)], "piece int, home int"))
    moved = spark.createDataFrame(torn, "text_key long, first int, unit int, shard int")
    if labels:
        label = functools.reduce(DataFrame.unionByName, labels)
        moved = moved.unionByName(units.join(label, "text_key").select(*unit, "shard"))
    placed = rows.join(moved, unit, "left").withColumn("piece", _pieces("text_key")).join(homes, "piece")
    return placed.select("doc_id", "size", "text_crc32", F.coalesce("shard", "home").alias("shard"))


def slots(placed: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard.

    Rows are numbered inside ranges of a shard by hash; counts per range, a table
    of fixed size, give each range its first slot.
    """
    ranged = cut_lineage(placed.withColumn("r", _pieces("doc_id", "text_crc32", "size", n=SLOT_RANGES)))
    counts = ranged.groupBy("shard", "r").agg(F.count("*").alias("n"))
    upto = W.partitionBy("shard").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "r", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "r").orderBy("doc_id", "text_crc32", "size")
    numbered = ranged.withColumn("k", F.row_number().over(inside)).join(starts, ["shard", "r"])
    return numbered.withColumn("slot", (F.col("first") + F.col("k") - 1).cast("long")).drop("r", "k", "first")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: size, text_crc32, law, shard, slot, grown_shard."""
    return slots(propagate(docs, shards)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
