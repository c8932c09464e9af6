"""Sharding by longest-processing-time scheduling under the law of equal bytes.

Rows whose texts are equal form a group, and a group stays in one shard. The scheduler takes the groups by falling size
and gives each to the least-loaded shard, which a heap yields. It sees the number of groups of each size, not the groups:
once the loads of some shards lie within one size of each other, and below those of the rest, the heap yields them in
turn, so that whole turns are taken at once. The result is the schedule of all groups one by one, group for group. The
driver holds a row for each distinct size, of which a table of B bytes has fewer than sqrt(2 B), and some 20 more numbers
for each at most.

The groups of a size are numbered in parts of bounded size, in which each looks up its number's shard.

Defined results: a null text has no bytes and groups with the empty text; every row has size >= 1; ties in size go by
the text's hash, so that the schedule is the same in every run; repeated rows are rows of their own in the same shard;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldtext.llm.common import empty_if_null, materialize

#: Groups, or rows, that are numbered in one part.
PART = 10_000


def schedule(sizes: list[tuple[int, int]], n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest processing time first, for (size, number of groups of that size).

    Groups are numbered by falling size from 0. Gives stretches of numbers: the first of each, where its turn begins
    among the shards, with the end of the last one behind; and the shards of all turns.
    """
    heap = [(0, shard) for shard in range(n_shards)]
    firsts, turns, shards, number = [], [0], [], 0
    for size, left in sorted(sizes, reverse=True):
        while left:
            # The shards that come in turn: those within one size of the least-loaded one.
            low, turn = heap[0][0], []
            while heap and heap[0][0] - low < size:
                turn.append(heapq.heappop(heap))
            rounds = left // len(turn)
            if heap and rounds:
                rounds = min(rounds, (heap[0][0] - turn[-1][0] - 1) // size + 1)
            if not rounds:  # fewer groups than shards in the turn
                firsts.append(number)
                shards += [shard for _, shard in turn[:left]]
                turn = [(load + size, shard) if k < left else (load, shard) for k, (load, shard) in enumerate(turn)]
                number, left = number + left, 0
            else:
                firsts.append(number)
                shards += [shard for _, shard in turn]
                turn = [(load + size * rounds, shard) for load, shard in turn]
                number, left = number + rounds * len(turn), left - rounds * len(turn)
            turns.append(len(shards))
            for item in turn:
                heapq.heappush(heap, item)
    return np.array(firsts, np.int64), np.array(turns, np.int64), np.array(shards, np.int32)


def shard_of(plan: tuple[np.ndarray, np.ndarray, np.ndarray], number: np.ndarray) -> np.ndarray:
    """The shard of each group's number."""
    firsts, turns, shards = plan
    stretch = np.searchsorted(firsts, number, side="right") - 1
    return shards[turns[stretch] + (number - firsts[stretch]) % (turns[stretch + 1] - turns[stretch])]


def placed_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """(grp, shard) for groups (grp, bytes)."""
    sizes = [(r.bytes, r["count"]) for r in groups.groupBy("bytes").count().collect()]  # a row for each distinct size
    plan = schedule(sizes, n_shards)
    size, count = (np.array(x, np.int64) for x in zip(*sorted(sizes, reverse=True), strict=True)) if sizes else (np.empty(0, np.int64),) * 2
    first = np.cumsum(count) - count
    # Sizes of few groups share a part with their neighbours, those of many have several parts of their own.
    many = np.maximum(1, -(-count // PART))
    part = np.where(many > 1, 0, first // PART)
    common = groups.sparkSession.sparkContext.broadcast((-size, first, part, many, plan))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        falling, _, part, many, _ = common.value
        for batch in batches:
            own = batch.column("bytes").to_numpy()
            at = np.searchsorted(falling, -own)
            spread = np.frombuffer(b"".join(g[:4] for g in batch.column("grp").to_pylist()), ">u4").astype(np.int64)
            run = spread % many[at]
            alone = np.where(many[at] > 1, own, 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(alone), pa.array(np.where(many[at] > 1, run, part[at]))], names=["grp", "bytes", "alone", "part"]
            )

    tagged = groups.select("grp", "bytes").mapInArrow(tag, "grp binary, bytes long, alone long, part long")
    before, total = {}, {}
    for r in sorted(tagged.where("alone > 0").groupBy("alone", "part").count().collect()):  # a row for each PART groups
        before[r.alone, r.part] = total.get(r.alone, 0)
        total[r.alone] = before[r.alone, r.part] + r["count"]
    starts = groups.sparkSession.sparkContext.broadcast(before)

    def place(key: tuple, group: pa.Table) -> pa.Table:
        falling, first, _, _, plan = common.value
        group = group.sort_by([("bytes", "descending"), ("grp", "ascending")])
        own = group.column("bytes").to_numpy()
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        inside = np.arange(len(own)) - np.repeat(cuts, np.diff(np.r_[cuts, len(own)]))
        number = first[np.searchsorted(falling, -own)] + inside + starts.value.get((key[0].as_py(), key[1].as_py()), 0)
        return pa.table({"grp": group.column("grp"), "shard": pa.array(shard_of(plan, number), pa.int32())})

    return tagged.groupBy("alone", "part").applyInArrow(place, "grp binary, shard int")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = empty_if_null(F.col(text_col))
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("grp"),
        )
    )
    groups = materialize(rows.groupBy("grp").agg(F.sum("size").alias("bytes")))
    runs = rows.count() // (n_shards * PART) + 1
    put = materialize(
        rows.join(placed_groups(groups, n_shards), "grp")
        .withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(runs)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "run")
    )
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        put.groupBy("shard", "run")
        .count()
        .select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"))
    )  # a row for each PART rows, and n_shards more
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        put.withColumn("at", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "run"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("at")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
