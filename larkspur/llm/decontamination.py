"""Benchmark decontamination: test n-grams as a broadcast hash set, token windows scanned, hits verified.

The benchmark's windows are dealt into blocks of bounded size. A block is broadcast, and one pass over the
documents looks all their windows up in it. Usually there is one block. For more, the documents are written once, each
block leaves a narrow table of the rows that it hits, and these are merged at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import shingles as sh
from larkspur.llm.storage import bounded, cut, named, own_names, plain_names, trimmed
from larkspur.llm.textkit import NON_ALPHANUMERIC, chunks, find_words

#: Most (item, window) pairs of a block, about. A pair takes its window's text, if no other pair of the block has it, and some 30 bytes.
BLOCK_WINDOWS = 500_000
#: Most bytes of the windows' texts of a block, about.
BLOCK_BYTES = 64 << 20


def _benchmark_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0)
            for low, high, data, offsets in chunks(batch.column(1)):
                words = find_words(data, offsets, NON_ALPHANUMERIC, lower=True)
                count = np.diff(words.first)
                for n in range(1, size + 1):
                    chosen = count >= size if n == size else count == n
                    docs, hashes = sh.windows(words, n, short=False)
                    keep = chosen[docs]
                    if not keep.any():
                        continue
                    docs, hashes = docs[keep], hashes[keep]
                    begin = np.concatenate([np.arange(words.first[d], words.first[d + 1] - n + 1) for d in np.flatnonzero(chosen)])
                    text = [b" ".join(words.data[words.start[a + k] : words.end[a + k]].tobytes() for k in range(n)).decode() for a in begin]
                    yield pa.RecordBatch.from_arrays([items.take(pa.array(low + docs)), pa.array(np.full(len(docs), n, np.int32)), pa.array(hashes.view(np.int64)), pa.array(text)], names=["item", "size", "hash", "window"])

    return run


class _Windows:
    """Distinct windows of one size, in ascending order of their hashes, and the items of each; all in flat arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows, [("hash", "ascending"), ("window", "ascending")])).combine_chunks()
        hashes, text = rows.column("hash").to_numpy(), rows.column("window").combine_chunks()
        new = np.ones(len(hashes), dtype=bool)
        if len(hashes) > 1:
            same = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            new[1:] = ~same | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        items = rows.column("item").combine_chunks().dictionary_encode()
        self.names, self.items = items.dictionary, items.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        self.first = np.append(at, len(hashes))  # of each window's items, and the total last
        self.hashes = hashes[at].view(np.uint64)
        order = np.argsort(self.hashes, kind="stable")  # signed order isn't unsigned order
        self.hashes, self.number = self.hashes[order], order.astype(np.int32)
        self.text = text.take(pa.array(at))

    def items_of(self, place: int, window: bytes) -> np.ndarray | None:
        """Numbers of the items that have that window, if it is one of those that share the hash at that place."""
        at = place
        while at < len(self.hashes) and self.hashes[at] == self.hashes[place]:
            k = self.number[at]
            if self.text[k].as_buffer() == window:
                return self.items[self.first[k] : self.first[k + 1]]
            at += 1
        return None


class _Block:
    """A block's windows by size."""

    def __init__(self, rows: pa.Table):
        sizes = rows.column("size").to_numpy()
        self.sizes = {int(n): _Windows(rows.filter(pa.array(sizes == n)).select(["item", "hash", "window"])) for n in np.unique(sizes)}


_KIND = pa.struct([("low", pa.int32()), ("high", pa.int32())])


def _scan(block, with_text: bool):
    """Batches with three columns more, what the block finds in each text; the text goes unless with_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        for batch in batches:
            places = batch.schema.get_field_index("larkspur_text")
            n_words, spans_out, items_out = [], [], []
            for low, high, data, offsets in chunks(batch.column(places)):
                words = find_words(data, offsets, NON_ALPHANUMERIC, lower=True)
                count = np.diff(words.first)
                n_words.append(count)
                found: dict[int, tuple[list, set]] = {}
                for n, table in known.sizes.items():
                    docs, got = sh.windows(words, n, short=False)
                    at = np.searchsorted(table.hashes, got)
                    at[at == len(table.hashes)] = 0
                    hits = np.flatnonzero(table.hashes[at] == got)
                    if not len(hits):
                        continue
                    # windows stand in order of documents; a document's first is at its first word
                    per = np.maximum(count - n + 1, 0)
                    before = np.cumsum(per) - per
                    for h in hits.tolist():
                        d = int(docs[h])
                        a = h - int(before[d])
                        w = int(words.first[d]) + a
                        window = b" ".join(words.data[words.start[w + k] : words.end[w + k]].tobytes() for k in range(n))
                        items = table.items_of(int(at[h]), window)
                        if items is not None:
                            spans, names = found.setdefault(d, ([], {}))
                            spans.append((a, a + n))
                            names.setdefault(n, []).append(items)
                for i in range(high - low):
                    spans, names = found.get(i, ((), {}))
                    spans_out.append([{"low": a, "high": b} for a, b in spans])
                    met: set[str] = set()
                    for n, items in names.items():
                        some = np.unique(np.concatenate(items))
                        met.update(known.sizes[n].names.take(pa.array(some[some >= 0])).to_pylist())
                    items_out.append(list(met))
            spans_out = [_merged(s) for s in spans_out]
            keep = [i for i in range(batch.num_columns) if with_text or i != places]
            columns = [batch.column(i) for i in keep] + [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(spans_out, pa.list_(_KIND)), pa.array(items_out, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + ["larkspur_n", "larkspur_spans", "larkspur_items"])

    return run


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["low"], s["high"])):
        if out and s["low"] <= out[-1]["high"]:
            out[-1]["high"] = max(out[-1]["high"], s["high"])
        else:
            out.append(dict(s))
    return out


_MARKS = [
    T.StructField("larkspur_n", T.LongType()),
    T.StructField("larkspur_spans", T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))),
    T.StructField("larkspur_items", T.ArrayType(T.StringType())),
]


def _marked(docs: DataFrame, benchmark: DataFrame, text_column: str, item_column: str, item_text_column: str, window: int, columns: list[str]) -> DataFrame:
    """The given columns of docs, its texts as larkspur_text, and what was found as larkspur_n, larkspur_spans, larkspur_items."""
    spark = docs.sparkSession
    given = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text_column).cast("string").alias("text"))
    windows = cut(bounded(given).mapInArrow(trimmed(_benchmark_windows(window)), "item string, size int, hash long, window string").distinct(), "benchmark-windows")
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    # pairs are dealt, so a block is bounded however large the benchmark is and however many items share a window
    blocks = max(1, -(-count // BLOCK_WINDOWS), -(-size // BLOCK_BYTES))
    of_block = lambda k: spark.sparkContext.broadcast(_Block(windows.where(F.pmod(F.xxhash64("hash", "item"), F.lit(blocks)) == k).toArrow()))
    rows = docs.select(*named(columns), F.col(f"`{text_column}`").cast("string").alias("larkspur_text"))
    if blocks == 1:
        return bounded(rows).mapInArrow(trimmed(_scan(of_block(0), True)), T.StructType([*rows.schema.fields, *_MARKS]))
    rows = cut(rows.withColumn("larkspur_row", F.monotonically_increasing_id()), "documents")
    found, schema = None, T.StructType([T.StructField("larkspur_row", T.LongType()), *_MARKS])
    for k in range(blocks):
        block = of_block(k)
        marks = bounded(rows.select("larkspur_row", "larkspur_text")).mapInArrow(trimmed(_scan(block, False)), schema)
        marks = cut(marks.where("size(larkspur_spans) > 0") if k else marks, f"contamination-{k}")
        found = marks if found is None else found.unionAll(marks)
        block.destroy()
    # a row has one mark of each block at most
    marks = found.groupBy("larkspur_row").agg(F.max("larkspur_n").alias("larkspur_n"), F.flatten(F.collect_list("larkspur_spans")).alias("larkspur_spans"), F.array_distinct(F.flatten(F.collect_list("larkspur_items"))).alias("larkspur_items"))
    return rows.join(marks.mapInArrow(_with_merged_spans, schema), "larkspur_row").drop("larkspur_row")


def _with_merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("larkspur_spans")
        yield batch.set_column(at, "larkspur_spans", pa.array([_merged(s) for s in batch.column(at).to_pylist()], pa.list_(_KIND)))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 10, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (all by default), each row once, with n_words (long), spans (array of word ranges
    low..high, merged, that benchmark windows cover) and items (array of the ids, as text, of the items found).

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], with A-Z lower-cased. An item's windows are its runs of
    `window` consecutive words; an item of fewer words, but not none, is one window. Every hash that is met is
    compared word by word. Null texts have no words; items without an id count for spans, but are left out of items; repeated
    rows come back as often as they are there, and repeated items count once. A very long text is scanned whole, in one
    task. Columns of docs that are named as the three results are left out for these. An empty benchmark contaminates
    nothing, and an empty table gives an empty result.
    """
    names = {"larkspur_n": "n_words", "larkspur_spans": "spans", "larkspur_items": "items"}
    columns = [c for c in columns or docs.columns if c.lower() not in names.values()]
    plain, of = plain_names(docs)
    marked = _marked(plain, benchmark, of[text_column], item_column, item_text_column, window, [of[c] for c in columns])
    return own_names(marked.withColumnsRenamed(names), {c: of[c] for c in columns}, *names.values())


def hit_words(spans: str = "spans"):
    """The number of words that spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["high"] - s["low"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 10) -> DataFrame:
    """The rows of docs that no benchmark window occurs in, with all columns of docs, whatever their names.

    Rows of null or empty texts stay; repeated rows stay or go alike; a very long text is scanned whole, in one task. Items without an id
    count. An empty benchmark drops nothing, and an empty table gives an empty result.
    """
    plain, of = plain_names(docs)
    marked = _marked(plain, benchmark, of[text_column], item_column, item_text_column, window, list(of.values()))
    return own_names(marked.where(F.size("larkspur_spans") == 0), of)


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, spans = batch.schema.get_field_index("larkspur_text"), batch.column("larkspur_spans").to_pylist()
        out = batch.column(at).to_pylist()
        for low, high, data, offsets in chunks(batch.column(at)):
            words = None
            for i in range(low, high):
                if spans[i]:
                    words = words or find_words(data, offsets, NON_ALPHANUMERIC, lower=True)
                    text, base, first = data[offsets[i - low] : offsets[i - low + 1]].tobytes(), int(offsets[i - low]), int(words.first[i - low])
                    parts, last = [], 0
                    for s in spans[i]:
                        parts.append(text[last : int(words.start[first + s["low"]]) - base])
                        last = int(words.end[first + s["high"] - 1]) - base
                    out[i] = b"".join([*parts, text[last:]]).decode()
        columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 10) -> DataFrame:
    """All rows of docs, with the words that benchmark windows cover, and what stands between them, cut out.

    The columns are those of docs, whatever their names, with the text as a string. Null texts stay null, and repeated rows are all
    treated alike; a very long text is treated whole, in one task. What is left may by chance form a window again that wasn't there before. An
    empty benchmark changes nothing, and an empty table gives an empty result.
    """
    plain, of = plain_names(docs)
    others = [n for c, n in of.items() if c != text_column]
    rows = _marked(plain, benchmark, of[text_column], item_column, item_text_column, window, others).select(*others, "larkspur_text", "larkspur_spans")
    cleaned = bounded(rows).mapInArrow(trimmed(_without_spans), rows.schema)
    return own_names(cleaned, of | {text_column: "larkspur_text"})


def contamination_by_hand(text: str | None, items: dict[str, str | None], window: int = 10) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) by plain Python, for tests."""
    import re

    def words(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    mine, hit, found = words(text), set(), []
    for item, t in items.items():
        w = words(t)
        n = min(window, len(w))
        parts = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        at = [i for i in range(len(mine) - n + 1) if tuple(mine[i : i + n]) in parts] if n else []
        if at:
            found.append(item)
            hit |= {i + k for i in at for k in range(n)}
    return len(mine), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
