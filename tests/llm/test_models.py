"""Trained operators, vectors and the pipeline: held-out accuracy, plain versions, odd rows."""

import html as entities
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import odd
from tests.llm.test_text_operators import components_of
from twinarm.llm import decontaminate, html_text, language, near_text, near_vectors, quality
from twinarm.llm.storage import read_table

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def need_tables():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")


def fold(doc, folds):
    return zlib.crc32(str(doc).encode()) % folds


LANGS = {"en": ["the cat and the dog went there", "then the other thing was this"], "fr": ["le chat et la souris où été", "une très belle forêt là-bas"]}


def ppm_bits(text, training, order=language.ORDER):
    """Code length byte by byte, from counts kept in dictionaries."""
    def fold_bytes(t):
        return bytes(b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in t.encode())

    seen = defaultdict(lambda: defaultdict(int))
    for t in training:
        data = b" " * order + fold_bytes(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen[data[i - k : i]][data[i]] += 1
    data, bits = b" " * order + fold_bytes(text), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            after = seen.get(data[i - k : i])
            if after is None:
                continue
            total = sum(after.values()) + len(after)
            if data[i] in after:
                bits -= np.log2(after[data[i]] / total)
                break
            bits -= np.log2(len(after) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_plain_prediction():
    counts = {}
    for lang, texts in LANGS.items():
        codes = np.concatenate([language.grams(d, p) for _, _, d, p in language.words.slices(pa.array(texts))])
        counts[lang] = np.unique(codes, return_counts=True)
    model = language.fit_counts(counts)
    texts = ["The cat was there", "où est le chat", "zzz qqq 123", "a", "", "été été", "中文 mixed the"]
    bits, size, letters = language.score(model, pa.array(texts))
    assert letters.tolist() == [True, True, True, True, False, True, True]
    for row, text in enumerate(texts):
        assert size[row] == len(text.encode())
        for k, lang in enumerate(model.languages):
            assert bits[row, k] == pytest.approx(ppm_bits(text, LANGS[lang]), rel=1e-5, abs=1e-4)


def test_languages_of_odd_rows(spark):
    train = odd.docs(spark, [(i, t) for i, t in enumerate(LANGS["en"] * 3)])
    model = language.train(train)
    found = {str(r.id): r for r in language.predict(odd.docs(spark), model).collect()}
    assert [found[k].lang_pred for k in ("1", "2", "3", "8")] == ["und"] * 4
    assert found["4"].lang_pred == found["None"].lang_pred == "en" and found["4"].score == 1.0
    kept = {str(r.doc_id) for r in language.known_rows(odd.docs(spark), model).collect()}
    assert {"4", "5", "6", "None", "11"} <= kept and not kept & {"1", "2", "3", "8", "9"}
    assert language.known_rows(odd.docs(spark), model).columns == odd.docs(spark).columns
    none = language.train(odd.docs(spark, []))
    assert {r.lang_pred for r in language.predict(odd.docs(spark), none).collect()} == {"und"}
    assert language.predict(odd.docs(spark, []), model).count() == 0


def test_text_unlike_any_language_goes(spark):
    model = language.train(odd.docs(spark, [(i, t) for i, t in enumerate(LANGS["en"] * 3)]))
    strange = "".join(chr(0x4E00 + i * 37 % 8000) for i in range(400))
    assert language.known_rows(odd.docs(spark, [(1, strange), (2, "the dog was there " * 40)]), model).first().doc_id == 2


def test_held_out_languages(spark):
    need_tables()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF_MORE}/documents.parquet'").fetchall())
    found = entry.queries()["op5_language_id"](spark, SF_MORE).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in found) and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_features_of_a_text():
    x = quality.features(pa.array(["Aa bb bb, cc!\nAa bb bb, cc!\n", None, "", "x***"], pa.string()))
    named = dict(zip(quality.FEATURES, x[0]))
    assert named["log_words"] == pytest.approx(np.log1p(8)) and named["repeated_lines"] == pytest.approx(0.5)
    assert named["distinct"] == pytest.approx(4 / 8) and named["lines"] == pytest.approx(2 / 28)
    assert named["capitals"] == pytest.approx(2 / 28) and named["top_word"] == pytest.approx(2 / 8)
    assert not x[1].any() and not x[2].any() and dict(zip(quality.FEATURES, x[3]))["marked_words"] == 1


def test_additive_model_finds_main_effects_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    logit = 3 * np.sin(6 * x[:, 0]) + 4 * ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) - 2
    y = (rng.random(6000) < 1 / (1 + np.exp(-logit))).astype(float)
    model = quality.fit(x[:4000], y[:4000], rounds=120)
    assert (1, 2) in model.pairs
    p = quality.scores(model, x[4000:])
    truth = 1 / (1 + np.exp(-logit[4000:]))
    assert np.corrcoef(p, truth)[0, 1] > 0.9
    by_hand = model.base + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, x[0]))
    for (i, j), t in zip(model.pairs, model.pair_tables):
        by_hand += t[np.searchsorted(model.edges[i], x[0, i], "right"), np.searchsorted(model.edges[j], x[0, j], "right")]
    assert quality.scores(model, x[:1])[0] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_quality_of_odd_rows(spark):
    labelled = odd.docs(spark, [(i, t) for i, t in enumerate(["good words in a line."] * 30 + ["bad*** bad*** bad***"] * 30)])
    labelled = labelled.withColumn("quality", (F.col("doc_id") < 30).cast("int"))
    model = quality.train(labelled)
    found = quality.predict(odd.docs(spark), model).collect()
    assert len(found) == len(odd.TEXTS) and all(0 <= r.score <= 1 for r in found)
    good = quality.good_rows(odd.docs(spark, [(1, "good words in a line."), (2, "bad*** bad*** bad***")]), model)
    assert [r.doc_id for r in good.collect()] == [1]
    blank = quality.train(labelled.limit(0))
    assert {r.score for r in quality.predict(odd.docs(spark), blank).collect()} == {0.5}
    assert quality.predict(odd.docs(spark, []), model).count() == 0


def test_held_out_quality(spark):
    need_tables()
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_MORE}/labels.parquet'").fetchall())
    found = entry.queries()["op7_quality_classifier"](spark, SF_MORE).collect()
    assert len(found) == duckdb.sql(f"SELECT count(*) FROM '{SF_MORE}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|div|article)>", inner)
    return "\n\n".join(filter(None, (" ".join(entities.unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", "")).split()) for p in parts)))


def test_pages_give_their_articles(spark):
    need_tables()
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF_MORE}/pages.parquet'").fetchall()
    found = {r.page_id: r for r in entry.queries()["op10_html_extraction"](spark, SF_MORE).collect()}
    assert len(found) == len(pages)
    right = sum(found[i].text == article(h) and found[i].url == u and found[i].n_chars == len(found[i].text) for i, u, h in pages)
    assert right >= 0.99 * len(pages)


def test_blocks_of_broken_markup():
    assert [b.text for b in html_text.blocks("<p>a  b\n c<p>d &amp; &lt;e&gt;&nbsp;f<br>g<div>h<ul><li>i<li>j</ul>k")] == ["a b c", "d & <e> f g", "h", "i", "j", "k"]
    assert [b.text for b in html_text.blocks("x<script>var t='</p>';</script>y<!-- <p>no --><style>p{}</style>z<textarea>q")] == ["xyz"]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<head><title>t</title></head><nav></nav>") == []
    assert [b.text for b in html_text.blocks("1 < 2 and 3 > 2 <")] == ["1 < 2 and 3 > 2 <"]
    (block,) = html_text.blocks('<div class="Side-Bar" id=main><p><a href="x>y">link</a> text</p></div>')
    assert block.path == ("div", ".side", ".bar", ".main", "p", "a") and block.linked == 4


def test_lstm_gradient_equals_differences():
    rng = np.random.default_rng(0)
    d = html_text.PATH_DIMS + html_text.WORD_DIMS + html_text.NUMBERS
    x = rng.normal(size=(4, 2, d)).astype(np.float32)
    on = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    w = rng.normal(0, 0.2, (d + html_text.HIDDEN, 4 * html_text.HIDDEN)).astype(np.float32)
    side = rng.normal(size=(4, 2, html_text.HIDDEN)).astype(np.float32)
    side[~on] = 0
    keep = []
    html_text._run(x, on, w, keep)
    grad = html_text._back(x, on, w, keep, side)
    for row, col in ((0, 0), (5, 20), (d - 1, 40), (d + 3, 60), (d + 1, 10)):
        up, down = w.copy(), w.copy()
        up[row, col] += 1e-2
        down[row, col] -= 1e-2
        slope = ((html_text._run(x, on, up) - html_text._run(x, on, down)) * side).sum() / 2e-2
        assert grad[row, col] == pytest.approx(slope, rel=0.05, abs=2e-3)


def test_pages_in_odd_shapes(spark):
    schema = "page_id long, url string, html string, id string, text string, n_chars string"
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>text of a page</p>"), (3, "u", "no markup at all"), (4, "u", "<p>" * 3000 + "deep"), (3, "u", "no markup at all")]
    pages = spark.createDataFrame([(*r, "i", "t", "n") for r in rows], schema)
    found = html_text.main_text(pages, None).collect()
    assert sorted((str(r.id), r.text) for r in found) == sorted(
        [("1", ""), ("2", ""), ("None", "text of a page"), ("3", "no markup at all"), ("3", "no markup at all"), ("4", "deep")])
    assert html_text.main_text(pages.limit(0), html_text.train(pages.limit(0))).count() == 0


def links_by_hand(rows, threshold=0.9):
    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    pairs = []
    for i, (_, v) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if good(v) and good(w) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    pairs.append((i, j))
    root = components_of(range(len(rows)), pairs)
    out = []
    for i, (vec, v) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        low = min(ids, default=None) if good(v) else vec
        out.append((vec, sum(i in p for p in pairs), low, low == vec))
    return sorted(out, key=str)


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, n int, cid string, size string, home string"
    return spark.createDataFrame([(i, v, 1, 1, "c", "s", "h") for i, v in rows], schema)


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 40)
    monkeypatch.setattr(near_vectors, "VISITORS", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[rng.integers(30)] * rng.uniform(0.5, 2) + rng.normal(0, rng.choice([0.05, 0.3]), 16)).astype("f4").tolist()) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(5)] + [(301, rows[0][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None, 1.0]), (405, [float("inf")] + [1.0] * 15)]
    rows += [(410, [1.0, 2.0]), (411, [2.0, 4.0]), (412, [-1.0, 2.0]), (None, rows[3][1]), (413, [5.0])]
    found = sorted(map(tuple, near_vectors.near_vectors(vectors(spark, rows)).collect()), key=str)
    assert found == links_by_hand(rows)


def test_no_vectors(spark):
    assert near_vectors.near_vectors(vectors(spark, [])).count() == 0
    assert near_vectors.near_vectors(vectors(spark, [(1, None)])).first().n_links == 0


def test_multi_sequence_stop_is_the_kth_nearest_cell():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((50, 9)), rng.random((50, 7))
    for visits in (1, 5, 30, 63, 500):
        want = np.sort((d1[:, :, None] + d2[:, None]).reshape(50, -1), axis=1)[:, min(visits, 63) - 1]
        assert np.allclose(near_vectors.stops(d1, d2, visits), want)


def test_pipeline_stages_follow_one_another(spark):
    need_tables()
    docs = read_table(spark, SF_MORE, "documents")
    names = docs.columns
    (_, langs), (_, good), (_, once), (_, clean), (_, packed) = corpus_pipeline.STAGES
    first = langs(spark, docs, SF_MORE).cache()
    assert first.columns == names
    second = good(spark, first, SF_MORE).cache()
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_MORE}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in second.select("doc_id").collect()}
    assert sum(truth[d] == 1 for d in truth) * 0.98 <= sum(truth[d] == 1 and d in kept for d in truth)
    assert sum(truth[d] == 0 and d in kept for d in truth) <= 0.1 * sum(truth[d] == 0 for d in truth)
    third = once(spark, second, SF_MORE).cache()
    want = {r.id for r in near_text.near_classes(second, similarity=corpus_pipeline.NEAR).where("kept").collect()}
    assert {r.doc_id for r in third.collect()} == want
    fourth = clean(spark, third, SF_MORE).cache()
    marks = decontaminate.contamination(third, read_table(spark, SF_MORE, "benchmark")).collect()
    assert {r.doc_id for r in fourth.collect()} == {r.id for r in marks if not (r.n_hit and 20 * r.n_hit >= r.n_words)}
    assert fourth.columns == names
    pieces = packed(spark, fourth, SF_MORE)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in fourth.collect()}
    run = corpus_pipeline.run(spark, SF_MORE).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, pieces.select(*run.columns).collect()))
