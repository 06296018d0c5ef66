"""Registered queries and the pipeline against plain Python, on tables that hold the odd cases."""

import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontamination, labelled, near_dedup, quality_model, queries, shingles, tokens, toxicity
from larkspur.llm.textkit import NON_ALPHANUMERIC, find_words
from tests.llm.test_corpus import PROSE, lines_by_hand, lowered, odd_documents, prose_of, words_of

M = (1 << 64) - 1
CLASHING = "score double, spans string, items string, n_words string, lines_before long, lines_dropped long, larkspur_score double, component_id long, `a.b` string, larkspur_text string, larkspur_spans long, larkspur_n string, larkspur_hit long, larkspur_host string, larkspur_boilerplate string, in0 string, in1 long"


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def raw(data):
    return sum((b + 1) * pow(0x9E3779B97F4A7C15 | 1, i, 1 << 64) for i, b in enumerate(data)) & M


def quality_by_hand(model, text):
    """The score of a text, by plain Python."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    kinds = {**{b: 4 + 1 for b in range(128)}, **{b: 1 for b in range(97, 123)}, **{b: 2 for b in range(65, 91)}, **{b: 3 for b in range(48, 58)}, **{ord(c): 4 for c in ".,;:!?'\"()-"}, **{b: 6 for b in range(128, 256)}}
    hashes, shapes = [], []
    for w in words:
        low = bytes(b + 32 if 65 <= b < 91 else b for b in w)
        hashes.append(mixed(raw(low)))
        has = 0
        for kind in (2, 3, 4, 5):
            has = has * 3 + min(sum(kinds[b] == kind for b in w), 2)
        shape = ((kinds[w[0]] * 8 + kinds[w[-1]]) * 81 + has) * 6 + min(int(math.log2(len(w) + 1)), 5)
        shapes.append(mixed(1 << 20 if len(hashes) > 1 and hashes[-1] == hashes[-2] else shape))
    found = set()
    for base, sizes, salt in ((hashes, (1, 2), 11), (shapes, (1, 2, 3), 23)):
        for n in sizes:
            for i in range(len(words) - n + 1):
                total = salt + n
                for j in range(n):
                    total = mixed(total ^ base[i + j])
                found.add(total >> 64 - quality_model.BITS)
    margin = sum(model.weights[f] for f in found) / math.sqrt(max(1, len(found))) + model.bias
    return 1 / (1 + math.exp(-min(40, max(-40, model.slope * margin + model.shift))))


def toxicity_by_hand(net, text):
    """The score of a text, by plain Python: every window, one step at a time."""
    p, size = net.p, toxicity.STATE
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))]
    inputs = []
    for w in words:
        x = p["word"][mixed((raw(w) + 1) & M) % toxicity.WORD_ROWS].astype(float)
        grams = [p["char"][mixed((raw(w[i : i + n]) + 100 + n) & M) % toxicity.CHAR_ROWS] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
        inputs.append(x + (np.mean(grams, axis=0) if grams else 0))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    worst, start = -30.0, 0
    while words:
        window = inputs[start : start + toxicity.WINDOW]
        states = {}
        for d in "fb":
            h, states[d] = np.zeros(size), []
            for x in window if d == "f" else window[::-1]:
                a, u = x @ p[f"x{d}"] + p[f"b{d}"], h @ p[f"h{d}"]
                z, r = sigmoid(a[:size] + u[:size]), sigmoid(a[size : 2 * size] + u[size : 2 * size])
                h = h + z * (np.tanh(a[2 * size :] + r * u[2 * size :]) - h)
                states[d].append(h)
        both = [np.concatenate(x) for x in zip(states["f"], states["b"][::-1])]
        e = np.array([np.tanh(s @ p["attend"]) @ p["query"] for s in both])
        weight = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        worst = max(worst, sum(w * s for w, s in zip(weight, both)) @ p["out"] + p["bias"][0])
        start += toxicity.STRIDE
        if start + toxicity.WINDOW - toxicity.STRIDE >= len(words):
            break
    return 1 / (1 + math.exp(-min(40, max(-40, net.slope * worst + net.shift))))


def components_by_hand(rows, size, percent=80):
    """For (id, text) rows: the number of each row's component, or None without shingles, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder of tables: documents with odd rows and clashing columns, and small other tables."""
    folder = str(tmp_path_factory.mktemp("tiny"))
    rows = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in odd_documents()]
    rows += [(1000 + k, prose_of(40 + k, k), "en", f"h{k % 4}", 1) for k in range(60)]
    rows += [(2000 + k, " ".join(f"{w.upper()}!! {w}" for w in prose_of(30, 70 + k).split()) + (" scumbag" if k % 2 else ""), "en", "h1", 1) for k in range(40)]
    near = prose_of(90, 999)
    rows += [(None, near, "en", "h0", 1), (None, near, "en", "h0", 1), (None, near + " more", None, None, 1), (3000, near + " again", "en", "h0", 1), (3000, near + " again", "en", "h0", 1), (3001, "", "en", "h0", 0), (3001, "", "en", "h0", 0)]
    rows += [(4000 + k, f"menu of {k}\nhome and away\n{prose_of(60, 300 + k)}", "en", "h9", 1) for k in range(6)]
    frame = spark.createDataFrame([(*r, 0.5, "a", "b", "c", 1, 2, 0.25, 9, "d", "e", 3, "f", 4, "g", "h", "i", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(7, PROSE, 1), (10, "Two  WORDS!", 1), (9, "", 1), (8, None, 1), (11, prose_of(40, 5), 1), (None, prose_of(41, 6), 1), (7, PROSE, 1)]
    spark.createDataFrame(items, "item_id long, text string, n_words int").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(1000 + k, 1, 0) for k in range(60)] + [(2000 + k, 0, k % 2) for k in range(40)] + [(1000, 1, 0), (1001, 0, 1), (None, 1, 1), (9999, 1, 1), (3, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(1, "http://a/1", "x" * 1200), (2, "http://a/2", "x" * 1200), (3, None, None), (None, "u", "small")]
    spark.createDataFrame([(*p, "no") for p in pages], "page_id long, url string, html string, first string").write.parquet(f"{folder}/pages.parquet")
    return folder, rows, {("" if k is None else str(k)): t for k, t, _ in items}


TYPES = {
    "op1_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, text_md5 string",
    "op5_license_scan": "doc_id bigint, digest string, license_id string, notices string",
    "op6_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def results(spark, tiny):
    got = {name: queries.QUERIES[name](spark, tiny[0]) for name in TYPES}
    assert {n: ", ".join(f"{c} {t}" for c, t in df.dtypes) for n, df in got.items()} == TYPES
    return {n: df.collect() for n, df in got.items()}


def test_every_row_has_its_result(tiny, results):
    for name, rows in results.items():
        assert len(rows) == (4 if name == "op7_warc" else len(tiny[1])) or name == "op9_best_fit_packing"


def test_decontamination_query(tiny, results):
    _, rows, items = tiny
    texts = {r[0]: r[1] for r in rows if r[0] not in (None, 3)}
    for r in results["op3_decontamination"]:
        if r.doc_id in texts:
            n_words, n_hit, _, _ = decontamination.contamination_by_hand(texts[r.doc_id], items)
            *_, n_items, sha = decontamination.contamination_by_hand(texts[r.doc_id], {k: t for k, t in items.items() if k})
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n_words, n_hit, n_items, sha, n_hit > 0)


def test_token_queries(tiny, results):
    fresh = __import__("tokenizers").Tokenizer.from_file(tokens.tokenizer_path(queries.TOKENIZER))
    texts, at = {r[0]: r[1] for r in tiny[1] if r[0] not in (None, 3)}, 0
    for r in sorted(results["op8_token_files"], key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        if r.doc_id in texts:
            ids = [*fresh.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4")))
    assert sum(r.length for r in results["op9_best_fit_packing"]) == at


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("name, label, train, by_hand", [("op6_quality_classifier", "quality", quality_model.train, quality_by_hand), ("op10_toxicity", "toxic", toxicity.train, toxicity_by_hand)])
def test_scores_are_those_of_plain_python(spark, tiny, results, name, label, train, by_hand):
    docs, marks = (spark.read.parquet(f"{tiny[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs.where(~quality_model.held_out()), marks.where(~quality_model.held_out()), label_column=label)
    texts = {r[0]: r[1] for r in tiny[1] if r[0] not in (None, 3)}
    bound = 0.7 if label == "quality" else 0.3
    for r in results[name]:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bound)
        if r.doc_id in texts and len(texts[r.doc_id] or "") < 2000:
            assert r.score == pytest.approx(by_hand(model, texts[r.doc_id]), abs=2e-4), r.doc_id


def test_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "two"), (3, "three"), (4, None), (None, "none"), (5, "five"), (6, "six")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 1), (None, 1), (5, 7), (6, None), (77, 1)], "doc_id long, y int")
    found, share = labelled.labelled_texts(docs, marks, "doc_id", "text", "y", 10)
    read = lambda texts, y: (texts.to_pylist(), y.tolist())
    texts, y = labelled.learnt_in_one_task(found, read)
    assert sorted(zip(texts, y)) == [("a", 1), ("two", 0)] and share == pytest.approx(4 / 6)
    found, _ = labelled.labelled_texts(docs.limit(0), marks.limit(0), "doc_id", "text", "y", 10)
    assert labelled.learnt_in_one_task(found, read) == ([], [])


def test_the_sample_is_bounded_by_rows_and_by_bytes(spark):
    docs = spark.createDataFrame([(k, f"{k:03d} " + "x" * 96) for k in range(200)] + [(200, "y" * 5000)], "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    for rows, size, least in ((10, 1 << 20, 10), (100, 1000, 4), (100, 1, 1)):
        found = labelled.labelled_texts(docs, marks, "doc_id", "text", "y", rows, size)[0].collect()
        for label in (0, 1):
            mine = sorted((r.by, r.id, r.text) for r in found if r.label == label)
            assert least <= len(mine) <= rows and (len(mine) == 1 or sum(len(t) for *_, t in mine) <= size // 2)
        assert all(r.text == f"{r.id:03d} " + "x" * 96 or r.id == 200 and len(r.text) == 5000 for r in found)


def test_long_texts_are_learnt_from_whole(spark, monkeypatch):
    rows = [(1, words_of(30_000, 1)), (2, words_of(9_000, 2) + " end"), (3, "short")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    found, _ = labelled.labelled_texts(frame, marks, "doc_id", "text", "quality", 10)
    texts, y = labelled.learnt_in_one_task(found, lambda texts, y: (texts, y))
    assert sorted(texts.to_pylist()) == sorted(t for _, t in rows)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda lex, number, first, *_: seen.update(words=np.diff(first)))
    monkeypatch.setattr(quality_model, "fit", lambda features, label: seen.update(features=list(map(len, features))))
    toxicity.learn(texts, y)
    quality_model.learn(texts, y)
    assert sorted(seen["words"].tolist()) == [1, 9_001, 30_000]
    whole = [quality_model.ngram_features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1] for _, t in rows]
    assert sorted(seen["features"]) == sorted(map(len, whole))


def test_sketches_fill_and_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    for size, want in ((1, 1.0), (3, 1.0), (400, 0.5), (400, 0.8), (3000, 0.8)):
        shared = int(size * 2 * want / (1 + want)) if size > 3 else size
        agree = []
        for _ in range(8):
            a = rng.integers(0, 1 << 63, 2 * size - shared).astype(np.uint64)
            sets = [np.sort(a[:size]), np.sort(np.concatenate((a[:shared], a[size:])))]
            s = shingles.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 300)
            assert (s != shingles._EMPTY).all()
            agree.append((s[0] == s[1]).mean())
        assert np.mean(agree) == pytest.approx(shared / (2 * size - shared), abs=0.04)


def test_all_pairs_at_the_bound_are_found(spark):
    """Recall against what was planted: 300 pairs at similarities of 0.82 and 0.85."""
    rows = []
    for k in range(300):
        words = words_of(101, 5000 + k).split()
        other = list(words)
        for at in range(4, 4 + 20 * (5 if k % 2 else 4), 20)[: 5]:
            other[at] = f"new{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, shingle_words=2).collect()}
    assert got == {k: k - k % 2 for k in range(600)}


def test_dropping_near_duplicates_leaves_one_of_each_group(spark, tiny):
    docs = spark.read.parquet(f"{tiny[0]}/documents.parquet")
    rows = [(r[0], r[1]) for r in tiny[1]]
    root = components_by_hand(rows, 5)
    groups = {}
    for (doc_id, text), g in zip(rows, root):
        groups.setdefault(g, []).append((doc_id is None, doc_id or 0))
    got = near_dedup.drop_near_duplicates(docs)
    assert got.schema == docs.schema
    kept = [(r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect()]
    with_words = sorted(k[:2] for k in kept if re.search(r"[^\x20\x09-\x0D]", k[2] or ""))
    assert with_words == sorted(min(v) for g, v in groups.items() if g is not None)
    assert len(kept) - len(with_words) == len(groups[None])
    assert near_dedup.drop_near_duplicates(docs.where("n_chars < 0")).collect() == []


def test_pipeline_is_what_plain_python_makes_of_it(spark, tiny):
    folder, rows, items = tiny
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_model.train(docs.where(~quality_model.held_out()), spark.read.parquet(f"{folder}/labels.parquet").where(~quality_model.held_out()))
    left = [list(r) for r in rows if quality_model.np.round(one_score(model, r[1]), 9) >= 0.7]
    for r, (text, _, gone) in zip(left, lines_by_hand([(r[1], r[3]) for r in left], 0.05)):
        r[1], r[4] = text, len(text) if gone else r[4]
    root, best = components_by_hand([(r[0], r[1]) for r in left], 5), {}
    for k, g in enumerate(root):
        best.setdefault(k + 1e6 if g is None else g, []).append(((left[k][0] is None, left[k][0] or 0), k))
    left = [left[min(v)[1]] for v in best.values()]
    left = [r for r in left if not decontamination.contamination_by_hand(r[1], items)[1]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.schema == docs.schema, name
    assert sorted([tuple(r)[:5] for r in at.collect()], key=key) == sorted(map(tuple, left), key=key)
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    fresh = __import__("tokenizers").Tokenizer.from_file(tokens.tokenizer_path(queries.TOKENIZER))
    want = sum(len(fresh.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in left)
    got = packed.agg(F.sum("length").alias("n"), F.count_if(F.col("piece") == 0).alias("docs")).first()
    assert (got.n, got.docs) == (want, len(left))


def one_score(model, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return model.scores(data, np.array([0, len(data)]))[0]


def test_stages_on_empty_tables(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny[0]}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny[0]).collect() == [], name
    for table in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{tiny[0]}/{table}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_words_of_lexicon_are_all_there():
    data = np.frombuffer("ab cd ab ef cd ab".encode(), np.uint8)
    words = find_words(data, np.array([0, 9, len(data)]), NON_ALPHANUMERIC, True)
    lex, number = toxicity.lexicon(words)
    assert len(lex.word) == 3 and number[0] == number[2] == number[5] and number[1] == number[4] != number[3]


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op3_decontamination", "op2_quality_rules"])
def test_sql_of_larger_tables(spark, name):
    path = "/root/testdata/sf0.001" if name == "op2_quality_rules" else "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.register(table, pq.read_table(f"{path}/{table}.parquet"))
    want = con.sql(queries.ORACLES[name])
    got = [tuple(r[c] for c in want.columns) for r in queries.QUERIES[name](spark, path).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
