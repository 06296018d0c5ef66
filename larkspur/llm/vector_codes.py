"""Vectors as short codes: a codebook for each part of the vectors, by filtering Lloyd rounds over kd-trees.

Every task cuts its vectors into blocks, and builds one kd-tree a block and part, whose nodes cache the sum, the count and the
bounding box of what is below. The trees are written once. A round walks them from their roots with all entries of the
codebook as candidates: an entry that is farther than another from every point of a node's box is out, and where one is left, the
whole subtree is assigned at once by its cached sum. Only a leaf that several entries could have compares its points.
All of it is in integers, and so exact.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import bounded, broadcast_if_small, cut, join_with_hot, trimmed
from larkspur.llm.vectors import integer_vectors, matrix

#: Vectors of a block, and points of a leaf, at most.
BLOCK, LEAF = 8192, 32
#: Most sums of labels that are broadcast; beyond it they are joined by a shuffle, but for those of hot labels.
BROADCAST_LABELS = 100_000


class Tree:
    """A balanced kd-tree, level by level: at depth d, node k holds the points order[cuts[d][k]:cuts[d][k + 1]]."""

    def __init__(self, points: np.ndarray):
        order, cuts = np.arange(len(points), dtype=np.int32), np.array([0, len(points)])
        self.cuts = [cuts]
        while np.diff(cuts).max() > LEAF:
            halves = [0]
            for low, high in zip(cuts[:-1], cuts[1:]):
                some = order[low:high]
                middle = len(some) // 2
                values = points[some]
                widest = int(np.argmax(values.max(axis=0) - values.min(axis=0))) if len(some) else 0
                order[low:high] = some[np.argpartition(values[:, widest], middle)] if len(some) > 1 else some
                halves += [low + middle, high]
            cuts = np.array(halves)
            self.cuts.append(cuts)
        self.order, self.points = order, points[order]
        self.sums, self.low, self.high = [], [], []
        total = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points.astype(np.int64), axis=0)))
        for cuts in self.cuts:
            self.sums.append(total[cuts[1:]] - total[cuts[:-1]])
            self.low.append(np.minimum.reduceat(self.points, cuts[:-1], axis=0))
            self.high.append(np.maximum.reduceat(self.points, cuts[:-1], axis=0))

    def filtered(self, entries: np.ndarray):
        """(what is settled at each depth, and at last the leaves' points): (kind, numbers of nodes or points, entry of each)."""
        nodes = np.arange(1)
        open_ = np.ones((1, len(entries)), dtype=bool)
        for depth in range(len(self.cuts)):
            low, high = self.low[depth][nodes].astype(np.int64), self.high[depth][nodes].astype(np.int64)
            # the candidate next to the middle of the box, in doubled coordinates
            away = ((low + high)[:, None, :] - 2 * entries[None]) ** 2
            away = np.where(open_, away.sum(axis=2), np.iinfo(np.int64).max)
            best = np.argmin(away, axis=1)
            chosen = entries[best]
            # the corner of the box that is best for an entry against the chosen one; if the chosen one is nearer even there, the entry is out
            corner = np.where(entries[None] > chosen[:, None, :], high[:, None, :], low[:, None, :])
            lead = ((corner - entries[None]) ** 2).sum(axis=2) - ((corner - chosen[:, None, :]) ** 2).sum(axis=2)
            numbers = np.arange(len(entries))[None]
            open_ &= (lead < 0) | ((lead == 0) & (numbers <= best[:, None]))
            settled = open_.sum(axis=1) == 1
            if settled.any():
                yield depth, nodes[settled], best[settled]
            nodes, open_ = nodes[~settled], open_[~settled]
            if not len(nodes):
                return
            if depth + 1 < len(self.cuts):
                nodes = np.stack((2 * nodes, 2 * nodes + 1), axis=1).reshape(-1)
                open_ = np.repeat(open_, 2, axis=0)
        cuts = self.cuts[-1]
        counts = cuts[nodes + 1] - cuts[nodes]
        at = np.repeat(cuts[nodes], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        away = np.where(np.repeat(open_, counts, axis=0), distances(self.points[at], entries), np.iinfo(np.int64).max)
        yield None, at, np.argmin(away, axis=1)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts) of the points that each entry gets."""
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        for depth, at, entry in self.filtered(entries):
            cuts = self.cuts[0] if depth is None else self.cuts[depth]
            np.add.at(sums, entry, self.points[at] if depth is None else self.sums[depth][at])
            np.add.at(counts, entry, 1 if depth is None else cuts[at + 1] - cuts[at])
        return sums, counts

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance to it) of each point, in the points' own order."""
        place = np.empty(len(self.order), dtype=np.int64)
        for depth, at, entry in self.filtered(entries):
            if depth is None:
                place[at] = entry
            else:
                for k, e in zip(at, entry):
                    place[self.cuts[depth][k] : self.cuts[depth][k + 1]] = e
        away = ((self.points - entries[place]) ** 2).sum(axis=1)
        code, error = np.empty_like(place), np.empty_like(place)
        code[self.order], error[self.order] = place, away
        return code, error


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1) if len(points) else np.zeros((0, len(entries)), np.int64)


def _blocks(parts: int, width: int):
    def block(rows: pa.Table) -> pa.RecordBatch:
        x = matrix(rows.column("x").combine_chunks(), width)
        if np.abs(x).max(initial=0) < 1 << 31:
            x = x.astype(np.int32)
        trees = []
        for p in range(parts):
            tree = Tree(x[:, p * (width // parts) : (p + 1) * (width // parts)])
            trees.append(pickle.dumps(tree, protocol=5))
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, rows.drop_columns("x").schema) as writer:
                writer.write_table(rows.drop_columns("x"))
            kept = sink.getvalue().to_pybytes()
        return pa.RecordBatch.from_arrays([pa.array([rows.num_rows]), pa.array([kept], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["n", "rows", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held, count = table.slice(BLOCK).to_batches(), count - BLOCK
        if count:
            yield block(pa.Table.from_batches(held))

    return run


def _tree(packed: pa.Scalar) -> Tree:
    tree = pickle.loads(packed.as_buffer())
    tree.points = tree.points.astype(np.int64)
    return tree


def _round(books: list[np.ndarray]):
    """Sums and counts by part and entry of all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[[0] * b.shape[1] for _ in b] for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for trees in batch.column(0):
                for p, packed in enumerate(trees):
                    some, n = _tree(packed).totals(books[p])
                    counts[p] += n
                    sums[p] = [[a + int(b) for a, b in zip(*both)] for both in zip(sums[p], some)]
        rows = [{"part": p, "entry": e, "at": d, "sum": str(s), "count": int(counts[p][e])} for p in range(len(books)) for e in np.flatnonzero(counts[p]) for d, s in enumerate(sums[p][e])]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("sum", pa.string()), ("count", pa.int64())]))

    return run


def _coded(books: list[np.ndarray], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, trees in zip(batch.column(0), batch.column(1)):
                rows = pa.ipc.open_stream(kept.as_buffer()).read_all().combine_chunks()
                found = [_tree(packed).assigned(books[p]) for p, packed in enumerate(trees)]
                digits = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
                text = digits.tobytes().hex()
                codes = [text[k : k + 2 * len(books)] for k in range(0, len(text), 2 * len(books))]
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([*[rows.column(n).combine_chunks() for n in rows.column_names], pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=[*rows.column_names, "code", "error"])

    return run


def vector_codes(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, code, error and label_error of each row, the codebook of each part).

    Vectors are the floors of the scaled components; those that are null or empty, or hold nulls or numbers that aren't finite, are left
    out. They are cut into equal parts. A part's codebook starts as that part of the vectors of the smallest ids, and each
    round replaces every entry by the floors of the means of the parts nearest to it, of equal distances to that of the lower number; an entry that gets none stays.
    code has two hex digits a part, error is the sum of the squared distances, label_error that of all rows of a label, those without one being one.

    Rows that repeat, share an id or have none all come back; of the rows of an id the least vector counts as a start, and
    rows without an id start last, as one. With fewer ids the codebooks are shorter. Vectors of different lengths, of a length that the parts don't
    divide, or with a component beyond 65536 are refused with an error. Other columns are not used. An empty table gives an empty result and no codebooks.
    """
    if entries > 256:
        raise ValueError("a code of two hex digits has no more than 256 entries")
    column = lambda name: F.col(f"`{name}`")
    rows = integer_vectors(df, vector_column, scale, vec_id=column(id_column), label=column(label_column))
    ids = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    starts = rows.join(F.broadcast(ids.withColumnRenamed("vec_id", "start")), F.col("vec_id").eqNullSafe(F.col("start"))).groupBy("vec_id").agg(F.min("x").alias("x"))
    first = starts.orderBy(F.col("vec_id").asc_nulls_last()).collect()  # at most `entries` rows
    schema = rows.drop("x").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    if not first:
        return df.sparkSession.createDataFrame([], schema).select("vec_id", "code", "error", F.col("error").alias("label_error")), []
    seeds = matrix(pa.array([r.x for r in first], pa.list_(pa.int64())))
    width = seeds.shape[1]
    if width % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {width}")
    books = [seeds[:, p * (width // parts) : (p + 1) * (width // parts)].copy() for p in range(parts)]
    blocks = cut(bounded(rows).mapInArrow(trimmed(_blocks(parts, width)), "n long, rows binary, trees array<binary>"), "kd-trees")
    for _ in range(rounds):
        found = bounded(blocks.select("trees")).mapInArrow(trimmed(_round(books)), "part int, entry int, at int, sum string, count long")
        for r in found.groupBy("part", "entry", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("count").alias("count")).collect():  # parts * entries * width / parts
            books[r["part"]][r["entry"], r["at"]] = int(r["sum"]) // r["count"]
    coded = cut(bounded(blocks.select("rows", "trees")).mapInArrow(trimmed(_coded(books, None)), schema), "vector-codes")
    keyed = coded.withColumns({"larkspur_label": F.coalesce(F.col("label").cast("string"), F.lit("")), "larkspur_none": F.col("label").isNull()})
    keys = ["larkspur_label", "larkspur_none"]
    sums = cut(keyed.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("larkspur_rows")), "label-errors")
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        out = keyed.join(broadcast_if_small(sums, BROADCAST_LABELS), keys)
    else:
        out = join_with_hot(keyed, sums, keys, "larkspur_rows", coded.count())
    return out.select("vec_id", "code", "error", "label_error"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """The sha256 of all components of all entries, part by part, as decimal texts joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for the rows of the query."""
    near = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT n, p, any_value(v) AS v, min({{'d': CAST({near} AS BIGINT), 'e': e}}) AS best FROM parts JOIN (SELECT p AS q, e, w FROM book{k}) ON p = q GROUP BY n, p)")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT p, e, list(CAST(CASE WHEN s >= 0 THEN s // c ELSE -((c - 1 - s) // c) END AS BIGINT) ORDER BY i) AS m
  FROM (SELECT p, best.e AS e, i, sum(v[i]) AS s, count(*) AS c FROM near{k}, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM parts))) AS i) GROUP BY ALL) GROUP BY p, e)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m, w) AS w FROM book{k} b LEFT JOIN mean{k} USING (p, e))")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (SELECT n, vec_id, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
firsts AS (SELECT vec_id, min(x) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM kept GROUP BY vec_id),
book0 AS MATERIALIZED (SELECT p, e, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS w FROM firsts, (SELECT unnest(range({parts})) AS p) WHERE e < {entries}),
{", ".join(steps)},
coded AS (SELECT n, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM kept JOIN coded USING (n)"""
