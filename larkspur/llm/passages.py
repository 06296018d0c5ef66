"""Passages that repeat, across documents or within one: suffix trees of groups that share a prefix.

Every word of the corpus begins a suffix, and two suffixes that agree in `window` words meet in a node of that depth of the
suffix tree of all. The tree is never built whole:

1. Texts are dealt to chunks of some megabytes and written once, bucketed by chunk, so that no later step shuffles texts.
2. A chunk builds the tree of its own suffixes. Below each deep node the earliest suffix stays; the others are settled, and don't leave the chunk.
3. What stays goes by its prefix: of its first `window` words, the least run of GRAM words, by hash. Only prefixes of several chunks are
   looked at again; one that very many suffixes have is lengthened to all `window` words.
4. Neighbouring suffixes of one prefix travel as one stretch of text to a group of prefixes, of a size that fits a task's
   memory, which builds their subtree; below its deep nodes all suffixes but the earliest are settled, too.
5. The words that settled suffixes begin with are cut out, chunk by chunk.

A suffix of a prefix has at most one row in a group for each chunk, however often a passage is repeated. Words are compared by
64-bit hashes; texts made to collide could fool it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shingles import folded
from larkspur.llm.storage import bounded, cut, give_back, new_path, tasks, trimmed
from larkspur.llm.textkit import WHITESPACE, chunks, find_words, mix, ranges

#: Bytes of text of a chunk, about.
CHUNK_BYTES = 8 << 20
#: Words of the shortest prefix.
GRAM = 8
#: Suffixes of one prefix beyond which it is lengthened, and suffixes of a group, about.
HEAVY, GROUP = 20_000, 200_000
#: Rows (a prefix of a chunk) that meet in one task to find those of several chunks, and bytes of text for each such row, about.
PAIRS, PAIR_BYTES = 1_000_000, 45
#: Most buckets that a table may have.
MOST_BUCKETS = 100_000


class Words:
    """The words of some texts: hashes, where each text's begin, and the words' bytes, each with a space after it."""

    def __init__(self, column: pa.Array, with_bytes: bool = True):
        hashes, counts, data, lengths = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for _, _, raw, offsets in chunks(column):
            found = find_words(raw, offsets, WHITESPACE, lower=False)
            hashes.append(found.hashes())
            counts.append(np.diff(found.first))
            if with_bytes:
                size = found.end - found.start + 1
                at = np.repeat(found.start, size) + ranges(size)
                spaced = np.append(raw, np.uint8(0x20))[at]
                spaced[np.cumsum(size) - 1] = 0x20
                data.append(spaced)
                lengths.append(size)
        self.hashes, self.data, self.lengths = np.concatenate(hashes), np.concatenate(data), np.concatenate(lengths)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64)))).astype(np.int64)

    def starts(self, size: int) -> np.ndarray:
        """The words that begin a run of that many words of one text."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))
        return np.flatnonzero(left >= size)


def deep_nodes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers into `at`, node of each): the suffixes that meet others in a node of depth `size` of the tree of the suffixes from `at` on.

    The tree is gone down by edges of up to GRAM words; a suffix that is alone on its edge drops out. Suffixes come
    node by node, and those of a node in their order in `at`.
    """
    live, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while depth < size:
        width = min(GRAM, size - depth)
        edge = folded(words, at[live] + depth, width)
        order = np.lexsort((edge, node)) if depth else np.argsort(edge, kind="stable")
        live, node, edge = live[order], node[order], edge[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (edge[1:] != edge[:-1])
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1 if len(live) else new
        live, node = live[shared], number[shared]
        depth += width
    return live, node


def _later(node: np.ndarray) -> np.ndarray:
    """Of rows in order within their nodes, which are not the first of theirs."""
    later = np.zeros(len(node), dtype=bool)
    later[1:] = node[1:] == node[:-1]
    return later


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows by id, those without one last; rows of one id by a hash of their texts."""
    ids = rows.column("doc_id")
    return rows.take(pa.array(np.lexsort((rows.column("row").to_numpy(), rows.column("tie").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))))


def _own(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(all starts of a chunk, which of them begin what begins earlier in the chunk)."""
    at = words.starts(size)
    live, node = deep_nodes(words.hashes, at, size)
    settled = np.zeros(len(at), dtype=bool)
    settled[live[_later(node)]] = True
    return at, settled


def _prefixes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least run of GRAM words, by hash, among the first `size` words from each start on; where it begins)."""
    gram = min(GRAM, size)
    runs = np.full(len(words), np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(words) >= gram:
        runs[: len(words) - gram + 1] = folded(words, np.arange(len(words) - gram + 1), gram)
    best, place = runs[at], at.copy()
    for k in range(1, size - gram + 1):
        other = runs[at + k]
        less = other < best
        best[less], place[less] = other[less], at[less] + k
    return best, place


def _prefixes_of_chunk(size: int):
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0]
        words = Words(_in_order(rows).column("text"), with_bytes=False)
        at, settled = _own(words, size)
        best, _ = _prefixes(words.hashes, at[~settled], size)
        found, count = np.unique(best, return_counts=True)
        return pa.table({"chunk": pa.array([chunk.as_py()] * len(found), pa.int64()), "prefix": pa.array(found.view(np.int64)), "n": pa.array(count, pa.int64())})

    return run


def _of_several_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows, each a prefix of a chunk, those whose prefix several chunks have."""
    rows = pa.Table.from_batches(list(batches), schema=pa.schema([("chunk", pa.int64()), ("prefix", pa.int64()), ("n", pa.int64())]))
    prefix, count = rows.column("prefix").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(prefix, kind="stable")
    prefix = prefix[order]
    new = np.ones(len(prefix), dtype=bool)
    new[1:] = prefix[1:] != prefix[:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1 if len(number) else new
    load = np.bincount(number, weights=count[order])[number] if len(number) else count
    kept = order[several]
    for low in range(0, len(kept), 100_000):
        some, part = kept[low : low + 100_000], slice(low, low + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(rows.column("chunk").to_numpy()[some]), pa.array(prefix[several][part]), pa.array(count[some]), pa.array(load[several][part] > HEAVY)], names=["chunk", "prefix", "n", "heavy"])


def _slices(length: np.ndarray) -> Iterator[slice]:
    """Consecutive slices of some 4 MB each, of things of these lengths; a longer one is alone."""
    total, low = np.cumsum(length), 0
    while low < len(length):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + (4 << 20), side="right")))
        yield slice(low, high)
        low = high


_STRETCH = pa.schema([("group", pa.int32()), ("chunk", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("text", pa.string())])


def _stretches(size: int, groups: int):
    """The stretches of a chunk's text that go to groups, for the prefixes given with it."""

    def run(rows: pa.Table, prefixes: pa.Table) -> pa.Table:
        if not rows.num_rows or not prefixes.num_rows:
            return _STRETCH.empty_table()
        rows = _in_order(rows)
        words = Words(rows.column("text"))
        at, settled = _own(words, size)
        at = at[~settled]
        best, place = _prefixes(words.hashes, at, size)
        known = prefixes.column("prefix").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, heavy = known[order], prefixes.column("heavy").to_numpy(zero_copy_only=False)[order]
        where = np.minimum(np.searchsorted(known, best), len(known) - 1)
        met = known[where] == best
        at, best, place, heavy = at[met], best[met], place[met], heavy[where[met]]
        if heavy.any():
            best[heavy] = mix(folded(words.hashes, at[heavy], size))
        goes_on = np.zeros(len(at), dtype=bool)
        goes_on[1:] = (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1]) & ~heavy[1:] & ~heavy[:-1]
        first = np.flatnonzero(~goes_on)
        count = np.diff(np.append(first, len(at)))
        begin, end = at[first], at[first] + count + size - 1  # words
        row = np.searchsorted(words.first, begin, side="right") - 1
        edge = np.concatenate(([0], np.cumsum(words.lengths)))
        texts = []
        for part in _slices(edge[end] - edge[begin] - 1):
            length = edge[end[part]] - edge[begin[part]] - 1
            data = words.data[np.repeat(edge[begin[part]], length) + ranges(length)]
            texts.append(pa.StringArray.from_buffers(len(length), pa.py_buffer(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.py_buffer(data)))
        of = lambda name: rows.column(name).combine_chunks().take(pa.array(row))
        start = (begin - words.first[row]).astype(np.int32)
        group = (best[first] % np.uint64(groups)).astype(np.int32)
        out = pa.Table.from_arrays([pa.array(group), of("chunk"), of("row"), of("doc_id"), of("tie"), pa.array(start), pa.chunked_array(texts, pa.string())], schema=_STRETCH)
        give_back()
        return out

    return run


def _subtree(size: int):
    """The suffixes of a group that begin what begins earlier, as runs of starts."""

    def run(rows: pa.Table) -> pa.Table:
        words = Words(rows.column("text"), with_bytes=False)
        at = words.starts(size)
        live, node = deep_nodes(words.hashes, at, size)
        stretch = np.searchsorted(words.first, at[live], side="right") - 1
        ids = rows.column("doc_id")
        row, start = rows.column("row").to_numpy()[stretch], rows.column("start").to_numpy()[stretch].astype(np.int64) + at[live] - words.first[stretch]
        order = np.lexsort((start, row, rows.column("tie").to_numpy()[stretch], ids.fill_null(0).to_numpy()[stretch], ids.is_null().to_numpy()[stretch], node))
        gone = order[_later(node[order])]
        gone = gone[np.lexsort((start[gone], row[gone]))]
        row, start, chunk = row[gone], start[gone], rows.column("chunk").to_numpy()[stretch[gone]]
        new = np.ones(len(gone), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        return pa.table({"chunk": pa.array(chunk[first], pa.int64()), "row": pa.array(row[first], pa.int64()), "low": pa.array(start[first].astype(np.int32)), "high": pa.array((start[first] + np.diff(np.append(first, len(gone)))).astype(np.int32))})

    return run


_SPAN = pa.struct([("low", pa.int32()), ("high", pa.int32())])


def _cut_out(size: int):
    """A chunk's documents without the words that settled suffixes begin with; given: runs of starts that groups have settled."""

    def run(rows: pa.Table, given: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        words = Words(rows.column("text"))
        at, settled = _own(words, size)
        gone = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(gone, at[settled], 1)
        np.add.at(gone, at[settled] + size, -1)
        if given.num_rows:
            number = rows.column("row").to_numpy()
            order = np.argsort(number)
            base = words.first[order[np.searchsorted(number[order], given.column("row").to_numpy())]]
            np.add.at(gone, base + given.column("low").to_numpy(), 1)
            np.add.at(gone, base + given.column("high").to_numpy() + size - 1, -1)
        out = np.cumsum(gone[:-1]) > 0
        count = np.diff(words.first)
        doc = np.repeat(np.arange(len(count)), count)
        # what is kept, each word with its space but the last of a text
        kept = np.flatnonzero(~out)
        length = words.lengths[kept]
        last = np.ones(len(kept), dtype=bool)
        last[:-1] = doc[kept][1:] != doc[kept][:-1]
        length = length - last
        edge = np.cumsum(words.lengths) - words.lengths
        total = np.bincount(doc[kept], weights=length, minlength=len(count)).astype(np.int64)
        pieces = []
        for part in _slices(length):
            pieces.append(words.data[np.repeat(edge[kept[part]], length[part]) + ranges(length[part])])
        data = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        text = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(np.concatenate(([0], np.cumsum(total))).astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        opens, closes = out.copy(), out.copy()
        same = doc[1:] == doc[:-1]
        opens[1:] &= ~(out[:-1] & same)
        closes[:-1] &= ~(out[1:] & same)
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes)
        spans = pa.StructArray.from_arrays([pa.array((opens - words.first[doc[opens]]).astype(np.int32)), pa.array((closes - words.first[doc[opens]] + 1).astype(np.int32))], fields=list(_SPAN))
        per = np.concatenate(([0], np.cumsum(np.bincount(doc[opens], minlength=len(count))))).astype(np.int32)
        made = pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(count, pa.int64()), "removed": pa.ListArray.from_arrays(pa.array(per), spans), "text": text})
        give_back()
        return made

    return run


def _chunked(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """(row, doc_id, tie, text and chunk of all rows, written once and bucketed by chunk; bytes of all texts)."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    part = F.shiftrightunsigned("row", 33)
    # a row for each partition of the input
    parts = cut(texts.groupBy(part.alias("part")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")), "partitions")
    parts = parts.orderBy("part").withColumn("chunks", F.ceil((F.col("bytes") + 1) / CHUNK_BYTES))
    size = parts.agg(F.sum("bytes"), F.sum("chunks")).first()
    # parts are numbered by 2**20 chunks each; one of more takes chunks that are larger
    chunk = F.shiftleft(part, 20) + F.pmod(F.col("row"), F.least(F.coalesce("chunks", F.lit(1)), F.lit(1 << 20)))
    rows = texts.join(F.broadcast(parts.select("part", "chunks")), part == F.col("part"), "left").select("row", "doc_id", F.xxhash64("text").alias("tie"), "text", chunk.alias("chunk"))
    name = f"larkspur_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(1, size[1] or 0))
    rows.write.format("parquet").option("path", new_path(spark, "chunks")).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name), size[0] or 0


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20) -> DataFrame:
    """doc_id, n_words, removed (array of word ranges low..high) and text (the words that are left, joined by spaces), for each row of docs.

    Words are runs of [^\\x20\\x09-\\x0D]. A word goes if it is in a run of `window` words of its document that also begins
    earlier: in a document of a smaller id, or further ahead in its own. Runs are judged on the texts as they come, not on what is left.

    A null text has no words. Rows without an id come after all others; rows that share an id are documents of their own, in the
    order of a hash of their texts, and of rows alike one counts as the first. Texts of fewer words than `window` stay whole. A very long
    text is handled whole, in one task. Other columns are not used. An empty table gives an empty result.
    """
    texts, size = _chunked(docs, id_column, text_column)
    pairs = bounded(texts).groupBy("chunk").applyInArrow(_prefixes_of_chunk(window), "chunk long, prefix long, n long")
    pairs = pairs.repartition(tasks(size // PAIR_BYTES, PAIRS), "prefix")
    shared = cut(pairs.mapInArrow(trimmed(_of_several_chunks), "chunk long, prefix long, n long, heavy boolean"), "prefixes")
    groups = tasks(shared.agg(F.sum("n")).first()[0] or 0, GROUP)
    stretches = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_stretches(window, groups), "group int, chunk long, row long, doc_id long, tie long, start int, text string")
    settled = cut(stretches.groupBy("group").applyInArrow(_subtree(window), "chunk long, row long, low int, high int"), "settled")
    return texts.groupBy("chunk").cogroup(settled.groupBy("chunk")).applyInArrow(_cut_out(window), "doc_id long, n_words long, removed array<struct<low:int,high:int>>, text string")


#: DuckDB SQL for the query of windows of 20 words; ids must differ.
ORACLE = r"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
runs AS (SELECT doc_id, pos, sha256(array_to_string(words[pos : pos + 19], ' ')) AS run FROM (SELECT *, unnest(range(1, len(words) - 18)) AS pos FROM d)),
later AS (SELECT doc_id, pos FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest(range(20)) AS k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)"""
