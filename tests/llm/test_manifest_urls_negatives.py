"""Merkle manifest, URL reputation and hard negatives against brute force."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import open_tables, rows as sorted_rows
from tests.llm import odd
from twinarm.llm import hard_negatives as hard
from twinarm.llm import manifest, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_url_reputation", "op13_hard_negatives"])
def test_queries_equal_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    want = open_tables(SF).sql(queries.ORACLES[name])
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(want.columns, want.fetchall())


# --- manifest -------------------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes):
    """All levels of a tree, from the leaves to the root."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return levels


def proof(levels, pos):
    out = []
    for level in levels[:-1]:
        out.append((pos & 1, level[pos ^ 1] if pos ^ 1 < len(level) else None))
        pos >>= 1
    return out


def manifest_by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in names:
        groups[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[lang] = climb([leaf_of(r) for r in groups[lang]])
    top = climb([trees[lang][-1][0] for lang in names])
    out = []
    for t, lang in enumerate(names):
        for pos, r in enumerate(groups[lang]):
            path = proof(trees[lang], pos) + proof(top, t)
            hit = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = leaf_of(r, 1 if hit else 0)
            for bit, other in path:
                h = sha(h if other is None else other + h if bit else h + other)
            root = top[-1][0]
            out.append((r.doc_id, leaf_of(r), trees[lang][-1][0], root, sha("".join(o or "" for _, o in path)), h, h == root))
    return sorted(out, key=str)


def documents(spark, sizes, seed=3):
    rng = random.Random(seed)
    rows = [(n, rng.choice(["text é", "", None, "中文 " * 5]), lang, rng.choice(["a", None]), rng.choice([5, None, 2**63 - 1]), "x", 1, "tree", "seg")
            for lang, size in sizes for n in rng.sample(range(10**6), size)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, pos int, tree string, seg string"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("levels,small", [(12, 10**6), (2, 0), (3, 300)])
def test_manifest_equals_plain_tree(spark, monkeypatch, levels, small):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(manifest, "SMALL_BYTES", small)
    monkeypatch.setattr(manifest, "SMALL_GROUPS", 10_000 if small else 0)
    sizes = [("fr", 1), ("", 2), (None, 3), ("é", 7), ("Zz", 8), ("en", 65), ("de", 33)]
    docs = documents(spark, sizes)
    real = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda *a: real(*a, levels=levels, small_bytes=small))
    found = sorted(map(tuple, manifest.document_manifest(docs).collect()), key=str)
    assert found == manifest_by_hand(docs.collect())
    assert {v for *_, v in found} == {True, False}


def test_manifest_of_odd_rows(spark):
    docs = odd.docs(spark, odd.TEXTS + odd.TEXTS[:6])
    assert sorted(map(tuple, manifest.document_manifest(docs).collect()), key=str) == manifest_by_hand(docs.collect())
    assert manifest.document_manifest(odd.docs(spark, [])).count() == 0
    one = manifest.document_manifest(odd.docs(spark, [(1, "alone")])).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_many_equal_rows_share_a_partition_of_no_task(spark):
    """Rows equal in every column are dealt over the sorted partitions, not kept together."""
    rows = spark.range(20_000).select(F.lit(7).alias("o"), F.lit("x").alias("leaf"), F.lit("g").alias("tree"))
    found = manifest.placed(rows, "tree", ["o", "leaf"])
    assert found.agg(F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.min("size")).first()[:] == (20_000, 0, 19_999, 20_000)
    held = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 1


# --- urls -----------------------------------------------------------------------------------------

URLS = [
    ("https://WWW.Example.net/en/1?x#y", "www.example.net", "/en/1"), ("http://a.example.com/de/", "a.example.com", "/de/"),
    ("http://a.example.com", "a.example.com", ""), ("http://a.net?q=://b/c", "a.net", ""), ("no scheme.net/en/", "", ""), (None, "", ""), ("", "", ""),
    ("://", "", ""), ("x://h#f/p", "h", ""), ("ftp://u:p@H.co.uk:8080/p;a?b", "u:p@h.co.uk:8080", "/p;a"), ("http://ÉA.org/fr/É", "Éa.org", "/fr/É"),
    ("http://h\n.net/a\nb?c", "h\n.net", "/a\nb"), ("http://net/", "net", "/"), ("http://xnet/", "xnet", "/"), ("http:///en/", "", "/en/"),
]


def test_host_path_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, host string, low string")
    none = spark.createDataFrame([], "key long, bad int")
    rules = [url_filter.Rule(*r) for r in queries.URL_RULES]
    found = {r.id: r for r in url_filter.verdicts(pages, none, rules).collect()}
    assert [(found[i].host, found[i].path) for i in range(len(URLS))] == [(h, p) for _, h, p in URLS]
    for r in found.values():
        fits = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert (r.rule, r.verdict) == ((best.text, best.action) if best else (None, "allow"))
    assert found[0].rule == "example.net/en/" and found[1].verdict == "block" and found[2].rule is None
    assert url_filter.verdicts(pages.limit(0), none, rules).count() == 0


def test_families(spark):
    hosts = ["a.b.example.com", "example.com", "com", "", "x.y.co.uk", "co.uk", "u@a.b.org:80", "10.0.0.1", "10.0.0.1:8080", "[::1]:80", "a.org."]
    domain, suffix = url_filter.families(F.col("h"))
    got = [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(domain, suffix).collect()]
    assert got == [("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", ""), ("y.co.uk", "co.uk"), ("co.uk", "co.uk"),
                   ("b.org", "org"), ("10.0.0.1", ""), ("10.0.0.1", ""), ("[::1]", ""), ("a.org", "org")]


def reputation_by_hand(hosts):
    """hosts: name -> (n, bad, domain, suffix)."""
    def fit(groups):
        """groups: name -> (n, bad, prior a, prior b)."""
        means = {k: (pa - b) / (pa + pb - n) for k, (n, b, pa, pb) in groups.items()}
        extra = sum((b - n * means[k]) ** 2 - n * means[k] * (1 - means[k]) for k, (n, b, _, _) in groups.items())
        room = sum(n * (n - 1) * means[k] * (1 - means[k]) for k, (n, *_) in groups.items())
        spread = min(max(extra / room if room > 0 else 1e-4, 1e-4), 1 / 3)
        out = {}
        for k, (n, b, pa, pb) in groups.items():
            w = min(1 / spread - 1, pa + pb - n)
            out[k] = w * means[k] + b, w * (1 - means[k]) + n - b
        return out

    def sums(key):
        out = {}
        for n, b, *rest in hosts.values():
            x = out.setdefault(key(rest), [0, 0])
            x[0] += n
            x[1] += b
        return out

    total, bad = sum(h[0] for h in hosts.values()), sum(h[1] for h in hosts.values())
    level = fit({k: (n, b, bad + 1, total - bad + 1) for k, (n, b) in sums(lambda r: r[1]).items()})
    level2 = fit({k: (n, b, *level[k[1]]) for k, (n, b) in sums(tuple).items()})
    return fit({h: (n, b, *level2[d, s]) for h, (n, b, d, s) in hosts.items()})


def test_reputation_blocks_bad_hosts_and_borrows_from_domains(spark):
    rng = random.Random(4)
    rates = {"spam.bad.com": 0.95, "more.bad.com": 0.9, "third.bad.com": 0.92, **{f"h{i}.site{i % 9}.org": 0.1 for i in range(40)}, "mixed.com": 0.5}
    pages, labels, n = [], [], 0
    for host, rate in rates.items():
        for _ in range(rng.randrange(20, 60)):
            pages.append((n, f"https://{host}/{n}"))
            if rng.random() < 0.7:
                labels.append((n, int(rng.random() < rate)))
            n += 1
    pages += [(n, "http://new.bad.com/"), (n + 1, "http://new.site3.org/"), (n + 2, "http://one.info/"), (None, "http://mixed.com/")]
    labels += [(n + 2, 1), (10**9, 1)]
    page_rows = spark.createDataFrame(pages, "page_id long, url string")
    label_rows = spark.createDataFrame(labels, "key long, bad int")
    got = {(r.id, r.host): r for r in url_filter.verdicts(page_rows, label_rows, []).collect()}
    assert len(got) == len(pages)
    counts = {}
    known = dict(labels)
    for i, url in pages:
        host = url.split("/")[2]
        c = counts.setdefault(host, [0, 0, ".".join(host.split(".")[-2:]), host.split(".")[-1]])
        if i in known:
            c[0] += 1
            c[1] += known[i]
    posterior = reputation_by_hand(counts)
    for (_, host), r in got.items():
        a, b = posterior[host]
        low = a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert r.low == pytest.approx(low, abs=1e-9) and r.verdict == ("block" if low > 0.5 else "allow")
    blocked = {h for (_, h), r in got.items() if r.verdict == "block"}
    assert {"spam.bad.com", "more.bad.com", "third.bad.com", "new.bad.com"} <= blocked
    assert not any(h.endswith(".org") or h in ("mixed.com", "one.info") for h in blocked)
    # The same by a shuffle of hosts instead of a broadcast.
    again = url_filter.verdicts(page_rows, label_rows, [], small_hosts=3).collect()
    assert {(r.id, r.host): r.verdict for r in again} == {k: r.verdict for k, r in got.items()}


def test_outcomes_leave_out_unclear_labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 0), (None, 0, 0), (6, None, 1), (7, 3, 0), (2, 0, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_filter.outcomes(labels).collect())) == [(1, 0), (2, 1), (3, 1), (6, 1)]


# --- hard negatives -------------------------------------------------------------------------------


def negatives_by_hand(rows, every=50):
    known = set()
    for i, v, label in rows:
        if i is None or v is None or not v or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        if sum(x * x for x in q) < 2**62:
            known.add((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a in (x for x in known if x[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in known if b[0] != a[0] and len(b[2]) == len(a[2]))
        for ps, positive, _ in [x for x in scored if x[2] == a[1]][:5]:
            fits = [x for x in scored if x[2] != a[1] and -50 * ps <= -100 * x[0] <= -95 * ps]
            out += [(a[0], positive, k + 1, negative, -ps, -ns) for k, (ns, negative, _) in enumerate(fits[:3])]
    return sorted(out)


def embeddings(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, id long, x string, size string, mark string, family string"
    return spark.createDataFrame([(i, v, label, 1, "x", "s", "m", "f") for i, v, label in rows], schema)


def clustered(n, dims, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (labels, dims))
    out = []
    for i in range(n):
        c = int(rng.integers(labels))
        out.append((i, (centres[c] * rng.uniform(0.2, 1) + rng.normal(0, 0.15, dims) + centres[(c + 1) % labels] * rng.uniform(0, 1)).astype("f4").tolist(), c))
    return out


@pytest.mark.parametrize("block,visitors", [(30, 4), (1000, 1000)])
def test_hard_negatives_equal_all_pairs(spark, block, visitors):
    rows = clustered(420, 8, 6, 1)
    rows += [(1000 + i, rows[100][1], rows[100][2]) for i in range(12)] + [(1100 + i, rows[100][1], (rows[100][2] + 1) % 6) for i in range(12)]
    rows += [rows[50], rows[51], (2000, [0.0] * 8, 1), (2050, [0.25] * 8, 77), (2100, [-x for x in rows[3][1]], rows[3][2])]
    rows += [(3000, None, 1), (3050, [], 1), (3100, [float("nan")] * 8, 1), (3150, [None] + [1.0] * 7, 1), (3200, [1.0] * 8, None),
             (None, [1.0] * 8, 1), (3250, [float("inf")] * 8, 2), (3300, [0.5, 1.0], 1), (3301, [0.5, 0.75], 1), (3302, [0.5, 0.5], 2), (3303, [1e30] * 8, 1)]
    found = sorted(map(tuple, hard.hard_negatives(embeddings(spark, rows), block=block, visitors=visitors).collect()))
    want = negatives_by_hand(rows)
    assert len({r[0] for r in want}) >= 8
    assert found == want


def test_no_rows_no_negatives(spark):
    assert hard.hard_negatives(embeddings(spark, [])).count() == 0
    assert hard.hard_negatives(embeddings(spark, [(50, [1.0], 1), (51, None, 2)])).count() == 0


def test_threshold_stops_early_and_loses_nothing():
    """Where few components carry the score, a small part of the rows is scored."""
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(-300, 300, (5000, 2)), rng.integers(-3, 3, (5000, 6))], axis=1).astype(np.int64)
    ids = rng.permutation(5000).astype(np.int64)
    found = hard.lists(ids, rows)
    for a in range(20):
        scores = rows @ rows[a]
        order = [i for i in np.lexsort((ids, -scores)) if i != a]
        ((got, got_scores),), scored = hard.best(found, rows[a], int(ids[a]), None, [(-np.inf, np.inf)], 5)
        assert got.tolist() == ids[order[:5]].tolist() and got_scores.tolist() == scores[order[:5]].tolist()
        assert scored < 2500
        window = (50 * int(scores[order[0]]), 95 * int(scores[order[0]]))
        fits = [i for i in order if window[0] <= 100 * scores[i] <= window[1]]
        assert hard.best(found, rows[a], int(ids[a]), None, [window], 3)[0][0][0].tolist() == ids[fits[:3]].tolist()


def test_large_scores_are_exact():
    big = 1 << 29
    rows = np.array([[big, big], [big, big - 1], [big, big - 2], [1, 0]], np.int64)
    found = hard.lists(np.arange(4), rows)
    score = 2 * big * big
    ((ids, scores),), _ = hard.best(found, rows[0], 0, None, [(50 * score, 100 * (score - big))], 3)
    assert ids.tolist() == [1, 2] and scores.tolist() == [score - big, score - 2 * big]


def test_quantised_rows():
    got = list(hard.quantised(pa.array([[0.5, -0.001], None, [], [None], [float("nan")], [1e9]], pa.list_(pa.float64()))))
    assert got[0].tolist() == [128, -1] and all(x is None for x in got[1:])
