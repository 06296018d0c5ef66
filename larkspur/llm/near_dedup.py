"""Near-duplicate documents by MinHash: fast similarity sketching, banding, exact verification.

The plan, none of whose steps gathers a group:

1. One scan turns each text into its set of word shingles, a digest of the set, and band keys of the
   set's sketch. Equal sets form a class; from here on only its least document stands for it.
2. Documents of a band bucket are compared with at most three leaders (stars, not all pairs) on full
   sets, and the links' components found.
3. Buckets that still hold several components are settled exactly: their members meet in blocks of
   bounded size, all pairs of a block are counted by one matrix product, and the block gives back
   only a forest of its links. A large bucket is dealt out as blocks of its largest component, each
   with all other members, or if these are many, as pairs of blocks.

A link is lost only if its two sets share no band: with 50 bands of 6 coordinates, once in four million
pairs at a similarity of exactly 0.8, and ever less above. Shingles are compared by 64-bit hashes (polynomials of the words'
bytes modulo 2**64, scrambled), and equal sets known by 128 bits; texts made to collide could fool both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import shingles as sh
from larkspur.llm.components import connected_components
from larkspur.llm.storage import bounded, broadcast_if_small, cut, join_with_hot, own_names, plain_names, trimmed
from larkspur.llm.textkit import WHITESPACE, chunks, find_words, lists

#: Sets of fewer elements are sketched together, as they need many rounds of few elements.
_TINY = 64
#: Most members and most shingles, about, of a block in step 3.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
#: Most document ids that are broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, elements, where each row's begin) by chunk."""
    for low, high, data, offsets in chunks(column):
        docs, hashes = sh.windows(find_words(data, offsets, WHITESPACE, lower=True), size)
        yield low, *sh.distinct_sets(docs, hashes, high - low)


def _fingerprint(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n = batch.num_rows
            count, keys = np.zeros(n, np.int64), np.zeros((n, bands), np.uint64)
            d = np.zeros((2, n), np.uint64)
            tiny: list[tuple[int, np.ndarray]] = []
            for low, values, first in _sets(batch.column(1), size):
                sizes = np.diff(first)
                at = slice(low, low + len(sizes))
                count[at] = sizes
                d[0, at], d[1, at] = sh.digests(values, first)
                large = sizes >= _TINY
                some = values[np.repeat(large, sizes)]
                keys[low + np.flatnonzero(large)] = sh.band_keys(sh.sketches(some, np.concatenate(([0], np.cumsum(sizes[large]))), bands * rows), bands, rows)
                tiny += [(low + i, values[first[i] : first[i + 1]]) for i in np.flatnonzero((sizes > 0) & ~large)]
            for k in range(0, len(tiny), 2048):
                some = tiny[k : k + 2048]
                first = np.concatenate(([0], np.cumsum([len(v) for _, v in some])))
                keys[[i for i, _ in some]] = sh.band_keys(sh.sketches(np.concatenate([v for _, v in some]), first, bands * rows), bands, rows)
            per = np.where(count > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(n)), batch.column(0), pa.array(count), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists(keys[count > 0].reshape(-1).view(np.int64), np.concatenate(([0], np.cumsum(per))), pa.int64())],
                names=["row", "doc_id", "n_shingles", "d1", "d2", "bands"],
            )
            row += n

    return run


def _shingle_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values, first in _sets(batch.column(0), size):
                d1, d2 = sh.digests(values, first)
                some = np.flatnonzero(np.diff(first))
                columns = [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(values.view(np.int64), first, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(some)) for c in columns], names=["d1", "d2", "shingles"])

    return run


def _with_digests(size: int, text: int):
    """Batches with three columns more: the number of shingles and the digests of column number `text`, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.uint64)
            for low, values, first in _sets(batch.column(text), size):
                at = slice(low, low + len(first) - 1)
                n[at] = np.diff(first)
                d[0, at], d[1, at] = sh.digests(values, first)
            columns = [c for k, c in enumerate(batch.columns) if k != text]
            names = [c for k, c in enumerate(batch.schema.names) if k != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64))], names=[*names, "larkspur_n", "larkspur_d1", "larkspur_d2"])

    return run


def _forest(group: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs (of positions) that join groups not joined before."""
    root = list(range(max(group) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        x, y = find(group[i]), find(group[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _links_of_block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc").to_numpy()
        n = len(docs)
        column = table.column("shingles").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(n), sizes)
        _, code, seen = np.unique(values, return_inverse=True, return_counts=True)
        shared = seen > 1
        number = np.cumsum(shared) - 1
        keep = shared[code]
        owner, code = owner[keep], number[code[keep]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        both, width = np.zeros((n, n), dtype=np.float32), 4096
        for low in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(code, (low, low + width))
            m = np.zeros((n, width), dtype=np.float32)
            m[owner[a:b], code[a:b] - low] = 1
            both += m @ m.T
        linked = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
        _, group = np.unique(table.column("component").to_numpy(), return_inverse=True)
        linked &= group[:, None] < group[None, :]
        pairs = _forest(group.tolist(), np.argwhere(linked))
        a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        return pa.table({"a": pa.array(docs[a], pa.int64()), "b": pa.array(docs[b], pa.int64())})

    return run


def near_duplicate_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 50, rows: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, d1, d2 (the digest of its set), component_id, keeper.

    keeper: true for one row of each component, that of the least id, or if none has an id, any one; and for every row without
    shingles. near_duplicates() says what the others are.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    made = cut(bounded(texts).mapInArrow(trimmed(_fingerprint(shingle_words, bands, rows)), "row long, doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "fingerprints")
    narrow = made.select("row", "doc_id", "n_shingles", "d1", "d2")
    # a class is known by the number of one of its rows; its best row is that of the least id, and of equal ones the first
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    classes = cut(narrow.where("n_shingles > 0").groupBy("d1", "d2").agg(best.alias("best"), F.min("row").alias("node"), F.count("*").alias("copies")), "classes")

    # 1: the members of band buckets, one for each class; a bucket's leaders are its least in each of three orders
    member = made.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.explode("bands").alias("key"), F.col("row").alias("doc"), F.col("n_shingles").alias("n"))
    orders = [F.min(F.struct(x.alias("by"), F.col("doc"), F.col("n"))) for x in (F.col("doc"), F.xxhash64("doc"), F.xxhash64("doc", F.lit(1)))]
    buckets = cut(member.groupBy("key").agg(F.count("*").alias("members"), F.array(*orders).alias("leaders")).where("members > 1"), "buckets")
    total = buckets.agg(F.sum("members")).first()[0] or 0
    member = cut(join_with_hot(member, buckets.withColumn("of", F.col("members")), ["key"], "of", total), "members")
    compared = cut(classes.join(member.select(F.col("doc").alias("node")).distinct(), "node").select("d1", "d2", "node", "best.doc_id"), "compared")
    ids = broadcast_if_small(compared.where("doc_id is not null").select("doc_id").distinct(), BROADCAST_IDS)
    again = texts.join(ids, "doc_id", "left_semi")
    if not compared.where("doc_id is null").isEmpty():
        again = again.unionAll(texts.where("doc_id is null"))
    sets = bounded(again.select("text")).mapInArrow(trimmed(_shingle_sets(shingle_words)), "d1 long, d2 long, shingles array<long>")
    sets = cut(sets.dropDuplicates(["d1", "d2"]).join(compared.select("d1", "d2", F.col("node").alias("doc")), ["d1", "d2"]).select("doc", "shingles"), "sets")

    # 2: each member against the leaders of its bucket
    pairs = member.select("doc", "n", F.explode("leaders").alias("leader"))
    pairs = pairs.where((F.col("doc") != F.col("leader.doc")) & (100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")))
    pairs = pairs.select(F.least("doc", "leader.doc").alias("a"), F.greatest("doc", "leader.doc").alias("b")).distinct()
    pairs = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("theirs")), "a").join(sets.withColumnRenamed("doc", "b"), "b")
    common = F.size(F.array_intersect("shingles", "theirs"))
    pairs = pairs.select("a", "b", common.alias("common"), (F.size("shingles") + F.size("theirs")).alias("sum"))
    links = cut(pairs.where(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b"), "links")
    found = connected_components(links)

    # 3: what is left of buckets with several components
    open_ = member.join(found, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", "members", F.coalesce("component", "doc").alias("component")).where("members > 2")
    open_ = cut(open_, "open")
    # a list of members is known by two sums of 64-bit hashes, as decimals, which don't overflow
    who = [F.sum(F.xxhash64("doc", F.lit(salt)).cast("decimal(20,0)")).alias(f"who{salt}") for salt in (0, 1)]
    parts = open_.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), *who)
    todo = parts.groupBy("key").agg(F.count("*").alias("components"), F.sum("members").alias("members"), F.sum("weight").alias("weight"), F.sum("who0").alias("who0"), F.sum("who1").alias("who1"), F.max(F.struct("members", "weight", "component")).alias("main")).where("components > 1")
    todo = todo.groupBy("who0", "who1", "members", "weight").agg(F.min(F.struct("key", "main")).alias("x"))  # equal member lists need it once
    rest, rest_weight = F.col("members") - F.col("x.main.members"), F.col("weight") - F.col("x.main.weight")
    # the largest component needs no pairs of its own: if the others are few, they meet each block of it
    few = (2 * rest <= BLOCK_SETS) & (2 * rest_weight <= BLOCK_SHINGLES)
    blocks = F.when(few, F.greatest(F.ceil(2 * F.col("x.main.members") / BLOCK_SETS), F.ceil(2 * F.col("x.main.weight") / BLOCK_SHINGLES)))
    blocks = F.coalesce(blocks, F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_SHINGLES)))
    todo = cut(todo.select(F.col("x.key").alias("key"), F.col("x.main.component").alias("main"), few.alias("few"), blocks.cast("int").alias("blocks"), F.col("members").alias("of")), "todo")
    if not todo.isEmpty():
        dealt = join_with_hot(open_, todo, ["key"], "of", total).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        once = F.col("few") & (F.col("component") == F.col("main"))
        dealt = dealt.withColumn("other", F.explode(F.when(once, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        i, j = F.when(F.col("few"), F.col("other")).otherwise(F.least("own", "other")), F.when(F.col("few"), F.col("other")).otherwise(F.greatest("own", "other"))
        dealt = dealt.select("key", i.alias("i"), j.alias("j"), "doc", "component").join(sets, "doc")
        more = dealt.groupBy("key", "i", "j").applyInArrow(_links_of_block(percent), "a long, b long")
        found = connected_components(found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    # what a class's component comes to, for its rows
    placed = cut(classes.join(found, "node", "left").select("d1", "d2", "best", "copies", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("best").alias("keeper"), F.count("*").alias("of"))
    placed = join_with_hot(placed, least, ["component"], "of", classes.count()).select("d1", "d2", "copies", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.row").alias("keeper_row"))
    some = narrow.where("n_shingles > 0")
    some = join_with_hot(some, cut(placed, "components-of-sets"), ["d1", "d2"], "copies", some.count())
    some = some.select("doc_id", "n_shingles", "d1", "d2", "component_id", (F.col("row") == F.col("keeper_row")).alias("keeper"))
    return some.unionAll(narrow.where("n_shingles = 0").select("doc_id", "n_shingles", "d1", "d2", "doc_id", F.lit(True)))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 50, rows: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs of [^\\x20\\x09-\\x0D], with A-Z lower-cased; a text's set are its distinct runs of
    shingle_words words, or with fewer words all of them as one. Two texts are linked if
    100 * |intersection| >= percent * |union|. component_id is the least id that links lead to, itself
    included; kept says that a row has it.

    Null and empty texts, and texts of white space, have no shingles and no link. A row without an id is linked as any other;
    its component_id is null, and kept true, only if no row of its component has an id. Repeated rows, and
    rows that share an id but not a text, all come back; copies of the kept row under its id are kept too
    (drop_near_duplicates() leaves one). A very long text is one set as any other, and is handled whole. Columns of docs
    other than these two are not used. An empty table gives an empty result.
    """
    found = near_duplicate_rows(docs, id_column, text_column, shingle_words, percent, bands, rows)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, **more) -> DataFrame:
    """docs, of each component of near duplicates one row only: that of the least id, or of no id if none has one.

    Rows without shingles (null, empty or white texts) all stay, as nothing links them. Ids that are null or that several rows
    share are told apart by the texts' sets; of rows alike in id and set one stays. All columns of docs come
    back, whatever their names. An empty table gives an empty result.
    """
    docs, names = plain_names(docs)
    id_column, text_column, key = names[id_column], names[text_column], "larkspur_id"
    found = cut(near_duplicate_rows(docs, id_column, text_column, shingle_words, **more), "near-duplicate-rows")
    per_id = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n"), F.count_if("keeper").alias("kept"))
    settled = cut(per_id.where("n > 1 or kept = 0"), "settled-ids")
    of = docs[id_column].cast("long")
    plain = docs.where(of.isNotNull()).join(broadcast_if_small(settled.select(key), BROADCAST_IDS), of == F.col(key), "left_anti")
    shared = settled.where("n > 1").select(key)
    without = found.where("doc_id is null").isEmpty()
    if without and shared.isEmpty():
        return own_names(plain, names)
    # rows that their id doesn't tell apart
    odd = docs.where(of.isNull()).unionByName(docs.join(broadcast_if_small(shared, BROADCAST_IDS), of == F.col(key), "left_semi"))
    rows = odd.select("*", odd[text_column].cast("string").alias("larkspur_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in ("larkspur_n", "larkspur_d1", "larkspur_d2")]])
    rows = bounded(rows).mapInArrow(trimmed(_with_digests(shingle_words, len(docs.columns))), schema)
    some = rows.where("larkspur_n > 0").withColumn(key, F.col(id_column).cast("long")).dropDuplicates([key, "larkspur_d1", "larkspur_d2"])
    keepers = found.where("keeper and n_shingles > 0").select(F.col("doc_id").alias("larkspur_k"), F.col("d1").alias("larkspur_k1"), F.col("d2").alias("larkspur_k2"))
    some = some.join(keepers, F.col(key).eqNullSafe(F.col("larkspur_k")) & (F.col("larkspur_d1") == F.col("larkspur_k1")) & (F.col("larkspur_d2") == F.col("larkspur_k2")), "left_semi")
    return own_names(plain.unionByName(rows.where("larkspur_n = 0").select(*docs.columns)).unionByName(some.select(*docs.columns)), names)
