"""Vector codes and whitening against plain Python, on vectors with the odd cases."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import queries, vector_codes, whitening

KIND = "vec_id long, embedding array<float>, label int, x string, error string, code string, component string, `a.b` long"


def odd_vectors(width=16, n=400):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, width))
    rows = [(k, (centres[k % 9] + rng.normal(size=width) * (0.02 if k % 3 else 1)).astype(np.float32).tolist(), k % 4 if k % 7 else None) for k in range(n)]
    same = [0.25] * width
    rows += [(1000 + k, same, 1) for k in range(150)]  # a hot vector
    rows += [(5, same, 2), (5, rows[5][1], 1), (None, same, None), (None, [1.0] * width, 3), (7, rows[7][1], rows[7][2])]
    rows += [(-9, None, 1), (-8, [], 1), (-7, [None] + same[1:], 1), (-6, [math.nan] + same[1:], 1), (-5, same[1:] + [math.inf], 1), (-4, same[1:] + [-math.inf], None)]
    return [(i, v, label, "x", "e", "c", "k", 5) for i, v, label in rows]


def good(rows):
    return [(i, v, label) for i, v, label, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * c) for c in v], label) for i, v, label in good(rows)]
    width = len(kept[0][1]) // parts
    firsts = {}
    for i, x, _ in kept:
        firsts[i] = min(firsts.get(i, x), x)
    seeds = [firsts[i] for i in sorted(firsts, key=lambda i: (i is None, i or 0))[:entries]]
    away = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b))
    out, books = [["", 0] for _ in kept], []
    for p in range(parts):
        points, book = [x[p * width : (p + 1) * width] for _, x, _ in kept], [s[p * width : (p + 1) * width] for s in seeds]
        for k in range(rounds + 1):
            near = [min(range(len(book)), key=lambda e: (away(v, book[e]), e)) for v in points]
            if k < rounds:
                for e in set(near):
                    mine = [v for v, n in zip(points, near) if n == e]
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for o, v, e in zip(out, points, near):
            o[0] += f"{e:02x}"
            o[1] += away(v, book[e])
        books.append(book)
    by_label = defaultdict(int)
    for (_, _, label), (_, error) in zip(kept, out):
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, code, error, by_label[label]) for (i, _, label), (code, error) in zip(kept, out)], digest


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("leaf", [4, 32])
def test_vector_codes(spark, leaf, monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rows = odd_vectors()
    want, digest = codes_by_hand(rows)
    got, books = vector_codes.vector_codes(spark.createDataFrame(rows, KIND).repartition(3))
    assert ordered(got.collect()) == ordered(want)
    assert vector_codes.codebooks_digest(books) == digest


def test_vector_codes_with_few_ids_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 2)
    rows = [r for r in odd_vectors() if r[0] is None or r[0] in (1, 2, 3, 5)]
    want, digest = codes_by_hand(rows)
    got, books = vector_codes.vector_codes(spark.createDataFrame(rows, KIND))
    assert ordered(got.collect()) == ordered(want) and len(books[0]) == 5
    assert vector_codes.codebooks_digest(books) == digest


def test_vector_codes_of_nothing_and_of_vectors_that_do_not_fit(spark):
    got, books = vector_codes.vector_codes(spark.createDataFrame([], KIND))
    assert got.columns == ["vec_id", "code", "error", "label_error"] and got.collect() == [] and books == []
    some = spark.createDataFrame([r for r in odd_vectors() if r[0] in (-9, -8)], KIND)
    assert vector_codes.vector_codes(some)[0].collect() == []
    for vectors in ([[0.0] * 12], [[0.0] * 16, [0.0] * 8], [[1e9] * 16]):
        with pytest.raises(Exception, match="don't divide|differ in length|beyond"):
            vector_codes.vector_codes(spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int"))[0].collect()


def test_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-50, 50, (500, 4)) + c for c in ([0, 0, 0, 0], [9000, 0, 0, 0], [0, 9000, 9000, 0])])
    entries = np.array([[0, 0, 0, 0], [9000, 0, 0, 0], [0, 9000, 9000, 0], [9000, 0, 0, 0]])
    tree = vector_codes.Tree(points)
    kinds = list(tree.filtered(entries))
    # only leaves across two heaps compare their points
    assert sum(len(at) for depth, at, _ in kinds if depth is None) < 150 and sum(len(at) for depth, at, _ in kinds if depth is not None) < 100
    code, error = tree.assigned(entries)
    away = vector_codes.distances(points, entries)
    assert (code == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    sums, counts = tree.totals(entries)
    assert counts.tolist() == [500, 500, 500, 0] and sums.tolist() == [points[code == e].sum(axis=0).tolist() for e in range(4)]


def whitened_by_hand(rows, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v, _ in good(rows)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    v = np.cov(fit.T, bias=True).reshape(fit.shape[1], -1)
    values, vectors = np.linalg.eigh(v)
    return kept, n, total, values[::-1], vectors[:, ::-1], v


def test_whitening(spark):
    rows = odd_vectors()
    kept, n, total, values, vectors, v = whitened_by_hand(rows)
    got = whitening.whiten(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    assert len(got) == 4 * len(kept)
    model = [(r.vec_id, r.component, r.n, int(r.deviation)) for r in got]
    want = [(i, c, n, sum((n * a - s) ** 2 for a, s in zip(x, total))) for i, x in kept for c in (1, 2, 3, 4)]
    assert ordered(model) == ordered(want)
    assert all(abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9 for r in got)
    by_id = defaultdict(list)
    for i, x in kept:
        by_id[i].append(x)
    for c in (1, 2, 3, 4):
        of = lambda x: (np.array(x) - np.array(total) / n) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        mine = [(r.whitened, of(by_id[r.vec_id][0])) for r in got if r.component == c and len(by_id[r.vec_id]) == 1]
        sign = np.sign(sum(a * b for a, b in mine))
        assert max(abs(a - sign * b) for a, b in mine) < 1e-9


def test_moments_are_merged_exactly():
    x = np.random.default_rng(1).integers(-1 << 40, 1 << 40, (300, 3))
    merged = None
    for part in np.array_split(x, [1, 7, 100]):
        m = whitening.Moments.of(part)
        merged = merged.merged(m) if merged else m
    assert merged.n == 300 and merged.sums == [int(s) for s in x.astype(object).sum(axis=0)]
    assert np.allclose(merged.covariance(), np.cov(x.T.astype(float), bias=True), rtol=1e-12)


def test_whitening_without_variance_and_of_nothing(spark):
    frame = lambda vectors: spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).collect() == [] == whitening.whiten(frame([None, []])).collect()
    got = whitening.whiten(frame([[1.0, 2.0]] * 3)).collect()
    assert len(got) == 6 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = whitening.whiten(frame([[1.0, 2.0, 0.0], [3.0, 6.0, 0.0], [2.0, 4.0, 0.0]])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-12 for r in line)
    far = whitening.whiten(frame([[9e5, -9e5], [1.0, 2.0], [0.5, 9e5]])).collect()
    x = [[math.floor(256 * c) for c in v] for v in ([9e5, -9e5], [1.0, 2.0], [0.5, 9e5])]
    total = [sum(c) for c in zip(*x)]
    assert {(r.vec_id, int(r.deviation)) for r in far} == {(k, sum((3 * a - s) ** 2 for a, s in zip(v, total))) for k, v in enumerate(x)}
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(frame([[1.0], [1.0, 2.0]])).collect()


def test_op11_matches_its_sql_where_rows_are_odd(spark, tmp_path):
    rows = [r for r in odd_vectors() if r[0] is not None]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op11_vector_codes"])
    got = queries.op11_vector_codes(spark, str(tmp_path))
    assert ordered(got.select(*want.columns).collect()) == ordered(want.fetchall())
    assert got.select(F.count_distinct("codebooks_sha256")).first()[0] == 1
