"""Repeated passages against plain Python, on documents with the odd cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import passages
from tests.llm.test_corpus import odd_documents, prose_of, words_of

KIND = "doc_id long, text string, `a.b` string, row long, chunk string, tie string, n_words string, removed string"


def repeating_documents():
    shared, refrain = words_of(60, 500), words_of(25, 501)
    rows = [(k, t) for k, t, *_ in odd_documents()]
    rows += [(100 + k, f"{prose_of(30 + k, k)} {shared}\n{words_of(30, 600 + k)}") for k in range(40)]  # in all chunks, after different words
    rows += [(200 + k, f"{refrain}  {words_of(5, 700 + k)}\t{refrain} {shared[: 30 * (k + 1)]}") for k in range(10)]
    rows += [(300, "la " * 500), (301, "LA " * 50), (302, "la " * 45), (303, "ab cd " * 40), (304, " ".join(words_of(19, 9).split()[:19])), (305, words_of(19, 9) + " end")]
    rows += [(None, shared), (None, shared), (None, refrain + " " + shared), (400, shared), (400, shared), (400, "x " + shared + " y"), (-5, shared[:200]), (401, None), (401, "")]
    return [(k, t, "b", 1, "c", "t", "n", "r") for k, t in rows]


def by_hand(rows, size=20):
    """{(doc_id, text): [(n_words, removed ranges, text)]} for rows (doc_id, hash of the text, text)."""
    seen, out = set(), []
    for doc_id, _, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            run = tuple(words[i : i + size])
            if run in seen:
                gone |= set(range(i, i + size))
            seen.add(run)
        ranges = [i for i in sorted(gone) if i - 1 not in gone], [i + 1 for i in sorted(gone) if i + 1 not in gone]
        out.append((doc_id, len(words), tuple(zip(*ranges)), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize(("chunk", "heavy", "group", "size"), [(8 << 20, 20_000, 200_000, 20), (3000, 5, 50, 20), (3000, 20_000, 400, 20), (20_000, 10, 100, 3)])
def test_repeated_passages(spark, monkeypatch, chunk, heavy, group, size):
    for name, value in (("CHUNK_BYTES", chunk), ("HEAVY", heavy), ("GROUP", group), ("PAIRS", 500)):
        monkeypatch.setattr(passages, name, value)
    docs = spark.createDataFrame(repeating_documents(), KIND).repartition(4)
    want = by_hand([tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()], size)
    got = [(r.doc_id, r.n_words, tuple((s.low, s.high) for s in r.removed), r.text) for r in passages.without_repeats(docs, window=size).collect()]
    assert ordered(got) == ordered(want)


def test_nothing_repeats_in_an_empty_table(spark):
    got = passages.without_repeats(spark.createDataFrame([], KIND))
    assert got.columns == ["doc_id", "n_words", "removed", "text"] and got.collect() == []
    got = passages.without_repeats(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(None, 0, [], "")]


def test_chunks_are_read_without_a_shuffle_of_texts(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK_BYTES", 3000)
    rows = passages.without_repeats(spark.createDataFrame(repeating_documents(), KIND))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroups") :].split("Exchange")[0]
    assert "Bucketed: true" in left and "text#" in left


def test_deep_nodes_are_those_of_equal_runs():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 400).astype(np.uint64)
    for size in (1, 5, 8, 9, 17):
        at = np.arange(len(words) - size + 1)
        live, node = passages.deep_nodes(words, at, size)
        groups = {}
        for i in at:
            groups.setdefault(tuple(words[i : i + size]), []).append(i)
        found = {}
        for i, k in zip(live.tolist(), node.tolist()):
            found.setdefault(k, []).append(i)
        assert sorted(found.values()) == sorted(g for g in groups.values() if len(g) > 1)


def test_slices_hold_all_and_stay_small():
    for length in ([], [0, 0], [5 << 20], [1, 9 << 20, 3, 3, (4 << 20) - 6, 1], [1 << 20] * 9):
        parts = list(passages._slices(np.array(length, dtype=np.int64)))
        assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(length)))
        assert all(p.stop - p.start == 1 or sum(length[p]) <= 4 << 20 for p in parts)
