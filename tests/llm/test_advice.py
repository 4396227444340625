"""Cases that a review has found missing: each failed before its change."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import odd
from tests.llm.test_text_operators import ALNUM, SPACED, components_of, lower
from twinarm.llm import attribution, decontaminate, html_text, near_text, packing, tokens


def near_copies():
    """Texts with one to three changed words, and longer and shorter versions of them, around 0.8."""
    rng = random.Random(5)
    rows = []
    for size in (30, 50, 56, 60, 75, 90, 110, 130, 300, 900):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        rows.append(base)
        for changes in (1, 2, 3):
            w = list(base)
            for at in rng.sample(range(size), changes):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append(w)
        for share in (0.78, 0.8, 0.81, 0.84):
            rows.append(base[: round(size * share)])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_pipeline_drops_near_copies_from_four_fifths(spark):
    rows = near_copies()
    sets = []
    for _, text in rows:
        w = SPACED.findall(lower(text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    links = {whole: [(i, j) for i in range(len(rows)) for j in range(i)
                     if 100 * len(sets[i] & sets[j]) >= whole * len(sets[i] | sets[j])] for whole in (80, 85)}
    assert len(links[80]) > len(links[85]) + 10
    root = components_of(range(len(rows)), links[80])
    kept = corpus_pipeline.one_of_each_group(spark, odd.docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("part", [80, 85])
def test_needed_share_leaves_room_below_a_subset(part):
    k, j = near_text.K, part / 100
    needed = int(k * near_text.needed_share((part, 100)))
    assert (k * j - needed) / (k * j * (1 - j)) ** 0.5 > 5


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "é<|endoftext|><|endoftext|>\n\n  it's", " x  <|endoftext|>\n<|endoftext|", "<|ENDOFTEXT|>", "plain text"]


def test_added_tokens_get_their_own_id(spark):
    """Against a tokenizer that nothing has changed."""
    fresh = Tokenizer.from_file(tokens.default_path())
    known = tokens.Encoder(tokens.default_path())
    want = {i: fresh.encode(t, add_special_tokens=False) for i, t in enumerate(ADDED)}
    assert want[0].ids == [50256]
    for i, text in enumerate(ADDED):
        assert known.ids(text) == want[i].ids
        assert known.byte_lengths[known.ids(text)].sum() == len(text.encode())
    docs = odd.docs(spark, list(enumerate(ADDED)))
    packed = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    assert packed == {i: (len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for i, e in want.items()}
    counts = {i: 0 for i in want}
    for r in attribution.section_tokens(docs, rule="majority").collect():
        counts[r.id] += r.n_tokens
    assert counts == {i: len(e.ids) for i, e in want.items()}


@pytest.mark.parametrize("text", [" " * 5_000_000 + "x", "a" + "\n" * 5_000_000, "b" * 5_000_000, "$" * 5_000_000,
                                  "x" + " \n" * 60_000 + "\t y " + " " * 200_000])
def test_long_runs_of_one_character_are_encoded(text):
    known = tokens.Encoder(tokens.default_path())
    found = known.ids(text)
    assert known.tokenizer.decode(found) == text
    if len(text) < 1_000_000:
        assert found == known.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_white_space_passes_through_jobs(spark):
    docs = odd.docs(spark, [(1, "one" + " " * 1_200_000 + "two"), (2, "\n" * 1_200_000)])
    lengths = {}
    for r in packing.pack(docs).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    counts = {i: 0 for i in lengths}
    for r in attribution.section_tokens(docs, separator="\x00", rule="majority").collect():
        counts[r.id] += r.n_tokens
    assert {i: n - 1 for i, n in lengths.items()} == counts
    assert min(counts.values()) >= 600_000


@pytest.mark.parametrize("page,want", [
    ('<p>one<svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
    ("<p>one <math/>two</p><p>three</p>", ["one two", "three"]),
    ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let x=1 be"]),
    ("<div><button>Menu</div><p>one</p><p>two</p>", ["Menu", "one", "two"]),
    ("<button>Menu<article><p>one</p></article>", ["Menu", "one"]),
    ("<p>text <button>Share</p><p>two</p>", ["text", "Share", "two"]),
    ("<p>text <button>Share</button> goes on</p>", ["text goes on", "Share"]),
    ("<form><select><option>A<option>B</form><p>one</p>", ["A", "B", "one"]),
    ("<object><object>in</object>out</object><p>one</p>", ["in", "out", "one"]),
    ("<object data=x><p>one</p><p>two</p>", ["one", "two"]),
    ("<noscript>Turn it on<p>one</p>", ["Turn it on", "one"]),
    ("<template><p>t</p></template><p>one</p>", ["t", "one"]),
    ("<svg><svg><path d='m'/></svg><text>label</text></svg><p>one</p>", ["label", "one"]),
    ("<svg><title>icon</svg><p>one</p>", ["one"]),
    ("<p>a<svg><title/><style/><path/></svg>b</p><p>one</p>", ["ab", "one"]),
    ("<p>a <svg><path d='m'><p>one</p>", ["a", "one"]),
    ("<svg-icon>x</svg-icon><p>one</p>", ["x", "one"]),
    ("<script>a</b></script ><p>one</p><iframe><p>in", ["one"]),
    ("<style/>p{}</style>one", ["one"]),
])
def test_unclosed_and_self_closed_elements_swallow_nothing(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_training_pages_do_not_depend_on_copies(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(html_text, "fit", lambda pages: taken.append(pages))
    pages = [f"<article><p>page {i}</p></article>" for i in range(200)]
    once = spark.createDataFrame([(p,) for p in pages], "html string")
    html_text.train(once, sample=10)
    assert 0 < len(taken[0]) <= 40 and len(set(taken[0])) == len(taken[0])
    for hot in (taken[0][0], next(p for p in pages if p not in taken[0])):
        html_text.train(once.unionByName(spark.createDataFrame([(hot,)] * 100, "html string")).repartition(7), sample=10)
    assert taken[1] == taken[2] == taken[0]


@pytest.mark.parametrize("limit", [40, 150, 1000])
def test_stretches_of_long_texts_find_what_whole_texts_do(limit):
    rng = random.Random(limit)
    words = [rng.choice(["a", "bb", "é", "naïve", "x" * 90, "Word9"]) for _ in range(60)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", " …", "\n"]) for _ in range(n)) for n in (0, 1, 7, 30, 400)]
    texts += [None, "x" * 3000, " " * 3000, texts[-1]]
    items = [(str(i), " ".join(texts[4].split()[i * 9 : i * 9 + 20])) for i in range(20)] + [("short", "bb é")]
    phrases = decontaminate.Phrases(items, 4)
    whole, stretched = (decontaminate.find(pa.array(texts, pa.string()), phrases, n) for n in (10**6, limit))
    assert whole[0].tolist() == stretched[0].tolist()
    assert whole[1] == stretched[1] and len(whole[1]) > 2
    for row, (spans, _) in whole[1].items():
        for a, b, c, d in spans:
            assert len(ALNUM.findall(lower(texts[row])[c:d])) == b - a
            assert len(ALNUM.findall(lower(texts[row])[:c])) == a


def test_repeated_items_are_spread_over_parts(spark):
    text = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(i % 300, text) for i in range(900)] + [(None, text)], "item_id long, text string")
    parts, part = decontaminate.phrase_parts(bench, part_bytes=2000)
    names = [{x for found in part(k).items for x in found} for k in range(parts)]
    assert parts > 5 and max(map(len, names)) < 150 and set().union(*names) == {str(i) for i in range(300)}
    found = decontaminate.contamination(odd.docs(spark, [(1, "a " + text), (2, None), (None, text), (None, text)]), bench, part_bytes=2000)
    assert sorted((str(r.id), r.n_words, r.n_hit, len(r["items"])) for r in found.collect()) == [
        ("1", 21, 20, 300), ("2", 0, 0, 0), ("None", 20, 20, 300), ("None", 20, 20, 300)]
