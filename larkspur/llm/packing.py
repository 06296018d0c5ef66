"""Best-fit packing of documents into training sequences, by hierarchical residual packing.

Round 0 deals the pieces at random to groups of bounded size, and each group is packed best fit, longest
first. Bins that are nearly full are done, and so are those in which not even the emptiest bin would fit. The others are the
items of the next round, whose groups hold the bins of several groups before: a tree of rounds, whose root packs
all that is left as one group. Where that is too much for one task, the root packs by the number of bins of each length,
which are no more than the capacity, and the bins are then told their places by their rank among those of
their length. Only lengths take part; ids stay where they were made.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import bounded, cut, trimmed
from larkspur.llm.tokens import encoded
from larkspur.operators.ordering import with_position

#: Items of a group, about. Every group of a round is one task's work at most.
GROUP_ITEMS = 25_000
#: How many groups of a round meet in one of the next.
FAN_IN = 8
_PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(name: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for some, ids, first in encoded(batch, 1, name, end):
                sizes = np.diff(first)
                parts = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                # the first piece is what whole pieces leave over
                head = sizes - (parts - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                ids = ids.astype("<u4")
                at = first[doc] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at, length)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key + np.arange(len(doc))), some.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["key", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                key += len(doc)

    return run


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: key (a number of its own), doc_id, piece (from 0), start, length, ids_crc32.

    A document's ids and the end id stay together up to `capacity`; a longer one is cut into pieces of that
    many ids, the first of which has what is left over.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return bounded(rows).mapInArrow(trimmed(_pieces(tokenizer, capacity, end)), _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin), longest first into the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room left
    some, fill = 0, []  # bit r of some: a bin has room r
    bins, offsets = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for i in order:
        n = size[i]
        fitting = some >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                some ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            with_room[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _packed(round_: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        bins, offsets, fill = best_fit(table.column("length").to_numpy(), capacity)
        base = (round_ << 58) | (group << 24)
        return pa.table({"key": table.column("key").combine_chunks(), "bin": base + bins, "offset": offsets, "fill": fill[bins]})

    return run


def best_fit_by_length(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, in their order there, number of such bins), longest first into the fullest bins that have room.

    counts: how many items of each length there are. Bins that were filled alike are one entry, so the work depends
    on the lengths, not on the items.
    """
    with_room: dict[int, list[tuple[list[int], int]]] = {}

    def add(lengths: list[int], bins: int, room: int) -> None:
        if bins and lengths:
            with_room.setdefault(room, []).append((lengths, bins))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in with_room if r >= size), default=capacity)
            lengths, bins = with_room[room].pop() if room in with_room else ([], left)
            if room in with_room and not with_room[room]:
                del with_room[room]
            # the fullest bin that has room is the one that the item before went into, as long as it has room
            each = room // size
            filled = min(bins, left // each)
            add([*lengths, *[size] * each], filled, room - each * size)
            left -= filled * each
            rest = left if filled < bins and left < each else 0
            add([*lengths, *[size] * rest], 1 if rest else 0, room - rest * size)
            left -= rest
            add(lengths, bins - filled - (1 if rest else 0), room)
    return [(lengths, n) for some in with_room.values() for lengths, n in some]


def _slots(bins: list[tuple[list[int], int]], base: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of places, the number of the run's first bin, and the offset in its bins; a run is one place in bins filled alike."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for lengths, n in bins:
        at = 0
        for size in lengths:
            runs.setdefault(size, []).append((n, base, at))
            at += size
        base += n
    out = {}
    for size, some in runs.items():
        n, first, at = (np.array(x, np.int64) for x in zip(*some))
        out[size] = (np.cumsum(n) - n, first, at)
    return out


def _placed_by_rank(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, length, rank = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                starts, first, at = slots.value[int(size)]
                those = np.flatnonzero(length == size)
                run_ = np.searchsorted(starts, rank[those], side="right") - 1
                bins[those], offsets[those] = first[run_] + rank[those] - starts[run_], at[run_]
            yield pa.RecordBatch.from_arrays([key, pa.array(bins), pa.array(offsets)], names=["key", "bin", "offset"])

    return run


def _root(loose: DataFrame, round_: int, capacity: int) -> DataFrame:
    """All of loose packed as one group, by the number of bins of each length: key, bin, offset."""
    counts = {r["length"]: r["count"] for r in loose.groupBy("length").count().collect()}  # as many rows as there are lengths
    base = round_ << 58
    slots = loose.sparkSession.sparkContext.broadcast(_slots(best_fit_by_length(counts, capacity), base))
    # places in one order of all, from a distributed sort; a length's first place is how many are shorter
    before, total = {}, 0
    for size in sorted(counts):
        before[size], total = total, total + counts[size]
    firsts = loose.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "length long, before long")
    placed = with_position(loose, F.col("length").asc(), F.col("key").asc(), name="place").join(F.broadcast(firsts), "length")
    ranked = placed.select("key", "length", (F.col("place") - 1 - F.col("before")).alias("rank"))
    return ranked.mapInArrow(trimmed(_placed_by_rank(slots)), "key long, bin long, offset long")


def pack_items(items: DataFrame, capacity: int = 2048, slack: int = 8) -> DataFrame:
    """Packs items (key, length: long; 1 <= length <= capacity, keys unique): key, sequence_id, offset.

    slack: bins with no more room than this are done. The offsets of a sequence leave no gap. An empty table gives an empty result.
    """
    count = items.count()
    groups = max(1, -(-count // GROUP_ITEMS))
    placed, loose, round_ = None, items.select("key", "length"), 0
    while True:
        if round_ and groups == 1 and count > GROUP_ITEMS:
            made = _root(loose, round_, capacity)
        else:
            dealt = loose.withColumn("group", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(groups)))
            # all of a group's keys are one task's work, and no group has more than about GROUP_ITEMS of them in the first round,
            # or later of its bins that are left
            made = dealt.groupBy("group").applyInArrow(_packed(round_, capacity), "key long, bin long, offset long, fill long")
        made = cut(made, f"packed-{round_}")
        if placed is None:
            placed = made.select("key", F.col("bin").alias("sequence_id"), "offset")
        else:
            moved = made.select(F.col("key").alias("sequence_id"), F.col("bin").alias("to"), F.col("offset").alias("by"))
            placed = placed.join(moved, "sequence_id", "left").select("key", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
        if groups == 1:
            return placed
        bins = made.groupBy(F.col("bin").alias("key")).agg(F.first("fill").alias("length"))
        loose = cut(bins.where(F.col("length") < capacity - slack), f"loose-{round_}")
        least = loose.agg(F.min("length")).first()[0]
        loose = loose.where(F.col("length") <= capacity - (least or 0))
        count, round_ = loose.count(), round_ + 1
        # groups of a round merge FAN_IN in one, as long as what is left of them is one task's work; the last round is one group
        fewer = -(-groups // FAN_IN)
        groups = fewer if count <= fewer * GROUP_ITEMS else 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A null id keeps its pieces; rows that share an id, also repeated rows, are packed
    each on its own. A very long text is encoded whole and cut into pieces. Other columns of docs are not used. An empty
    table gives an empty result.
    """
    pieces = cut(document_pieces(docs, tokenizer, capacity, end, id_column, text_column), "pieces")
    return pieces.join(pack_items(pieces, capacity), "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
