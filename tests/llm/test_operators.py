"""Each operator against a brute-force version on a small fixture of awkward rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import ann, components, exact_dedup, html_text, langid, lm, mixing, packing, quality, simhash, simhash_wide, suffix_dedup

LONG = " ".join(f"word{i % 997} of{i % 13}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest where nobody has ever been before " * 4
ROWS = [
    (1, "alpha beta gamma delta epsilon", "en", "a"),
    (2, "alpha beta gamma delta epsilon", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, "   \t\n", "fr", "b"),
    (6, BASE, "en", "b"),
    (7, BASE + " tail", "en", "c"),
    (8, "x" + BASE, "en", "c"),
    (9, "ALPHA beta gamma delta epsilon", "en", "a"),
    (10, "é è à ü ß 漢字 привет", "fr", "a"),
    (10, "é è à ü ß 漢字 привет", "fr", "a"),
    (11, LONG, "en", "d"),
    (12, LONG[:-3] + "zzz", "en", "d"),
    (None, "no id here at all", "en", "a"),
    (14, "no id here at all", "en", "a"),
    (15, "one", "en", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # clashing names of inner columns, which operators must not trip over
    rows = [(*r, "x", 5, b"y", 0.5, "z") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, h int, digest binary, score double, keep_id string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts():
    return [t or "" for _, t, _, _ in ROWS]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, empty, keep, weak):
    from pyspark.sql import functions as F

    digest = (lambda t: F.substring(exact_dedup.sha256_digest(t), 1, 0)) if weak else exact_dedup.sha256_digest
    got = exact_dedup.exact_duplicates(docs, keep=keep, digest=digest).collect()
    groups = collections.defaultdict(list)
    for i, t, _, _ in ROWS:
        groups[t or ""].append(i)
    best = {t: (min if keep == "min" else max)([i for i in ids if i is not None]) for t, ids in groups.items()}
    want = sorted((str(i), best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t, _, _ in ROWS)
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert exact_dedup.exact_duplicates(empty, keep=keep).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("filing", [(2, 2), (4, 2), (3, 3), (4, 4)])
def test_every_near_pair_shares_a_file(filing):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 64, 4000, np.uint64, endpoint=False)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in a], np.uint64)
    masks, starts = simhash.file_masks(4, *filing)
    shared = (flips[None, :] & masks[:, None]) == 0
    passed = [simhash.near(a, a ^ flips, np.full(len(a), s), 4) for s in starts]
    assert (shared & np.array(passed)).any(0).all()


def slow_components(prints, distance=4):
    forest = components.Forest()
    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= distance:
                forest.union(a, b)
    return {a: forest.find(a) for a, _ in prints}


def test_simhash_components(docs, empty):
    got = simhash.simhash_components(docs).collect()
    prints = [(i, slow_fingerprint(t or "")) for i, t, _, _ in ROWS if i is not None]
    want = slow_components(prints)
    assert {(r["doc_id"], r["fp"] % (1 << 64)) for r in got if r["doc_id"] is not None} == set(prints)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert len(got) == len(ROWS) and simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize(("block", "filing"), [(8, (2, 2)), (4096, None), (8, (4, 2)), (4096, (3, 3)), (8, (4, 4))])
def test_links_connect_all_near_fingerprints(spark, block, filing):
    rng = np.random.default_rng(1)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = sorted({s ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(30)})
    rows = list(enumerate(prints))
    want = slow_components([(i, p) for i, p in rows])
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in rows], "fp long, node long")
    found = {r["node"]: r["component"] for r in components.connected_components(simhash.links(frame, 4, block, filing)).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == want


def slow_similar(rows, similarity=0.8):
    """Components of (id, text) by the share of their five-word shingles, over all pairs."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, forest = [(i, shingles(t)) for i, t in rows], components.Forest()
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if len(x & y) >= similarity * len(x | y):
                forest.union(a, b)
    return {i: forest.find(i) for i, _ in rows}


@pytest.mark.parametrize("block", [16, 1024])
def test_similar_texts_against_brute_force(spark, block):
    rng = np.random.default_rng(14)
    words = [f"W{k}" for k in range(800)]
    made = lambda n: [words[int(k)] for k in rng.integers(0, 800, n)]
    texts = [None, "", " \t", "one", "ONE", "two words"]
    passage = made(60)
    for n in (40, 90, 200, 400):
        base = made(n)
        for _ in range(18):
            copy = list(base)
            for k in rng.integers(0, n, int(rng.integers(0, 1 + n // 25))):
                copy[k] = f"other{rng.integers(10**6)}"
            texts.append(" ".join(copy[int(rng.integers(0, 3)) :]))
    texts += [" ".join(made(80) + passage + made(80)) for _ in range(20)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: simhash_wide.F.lit("clash") for c in ("id", "n", "sig", "node", "key")}).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash_wide.near_components(frame, "doc_id", block=block).collect()}
    want = slow_similar(rows)
    assert got == want and len(set(want.values())) > 25 and max(collections.Counter(want.values()).values()) > 8
    assert simhash_wide.near_components(frame.limit(0), "doc_id").count() == 0


def test_chains_never_lose_a_near_fingerprint():
    rng = np.random.default_rng(15)
    flips = np.array([rng.random(256) < p for p in rng.uniform(0.05, 0.4, 5000)])
    differ = np.packbits(flips, axis=1).view(np.uint64)
    assert simhash_wide.within(differ[:0], 51).tolist() == []
    apart = simhash_wide.shortest_forest(differ[:2], np.array([10, 100]), np.zeros(2, int), np.zeros(2, int), 256, 0.8)
    assert [x.tolist() for x in apart] == [[], []]
    for most in (20, 51, 80):
        assert simhash_wide.within(differ, most).tolist() == np.flatnonzero(flips.sum(1) <= most).tolist()


@pytest.mark.parametrize("task_edges", [40, 200_000])
def test_connected_components_of_a_long_path(spark, task_edges):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "src long, dst long").repartition(7)
    found = {r["node"]: r["component"] for r in components.connected_components(edges, task_edges).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 220, (150, 2))] + [(903, 901), (903, 902)]
    forest = components.Forest()
    for a, b in links:
        forest.union(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    edges = spark.createDataFrame(links, "src long, dst long").repartition(9)
    found = components.connected_components(edges, 40).collect()
    assert sorted((r["node"], r["component"]) for r in found) == sorted((x, forest.find(x)) for x in nodes)


def test_connected_components_of_two_edges_in_two_tasks(spark):
    edges = spark.createDataFrame([(3, 1)], "src long, dst long").union(spark.createDataFrame([(3, 2)], "src long, dst long"))
    found = components.connected_components(edges, 1).collect()
    assert sorted((r["node"], r["component"]) for r in found) == [(1, 1), (2, 1), (3, 1)]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(8)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] + [1.0] * 15), (504, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, x = np.array([i for i, _ in rows[:408]]), np.array([v for _, v in rows[:408]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 408, 10):
        s = u @ u[q]
        want = [int(ids[j]) for j in sorted((j for j in range(408) if j != q), key=lambda j: (-round(s[j], 12), ids[j]))[:5]]
        assert len(got[q]) == 5 and all(abs(score - s[vec]) < 1e-12 for vec, score in got[q])
        hit += len(set(want) & {vec for vec, _ in got[q]})
    assert hit >= 0.9 * 5 * len(range(0, 408, 10))
    assert not {500, 501, 502, 503} & set(got) and ann.nearest(table.limit(0), table.limit(0)).count() == 0
    alone = table.where("vec_id < 3")
    assert ann.nearest(alone, alone).count() == 6


def test_probes_are_the_likeliest_buckets():
    import itertools

    rng = np.random.default_rng(16)
    units = rng.standard_normal((5, 20))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for prefix, success, most in ((2, 2.0, 300), (0, 0.4, 300), (5, 0.3, 2187)):
        table = ann.Table(1, 20, 7, prefix, 1.05)
        at = table.project(units)
        for q, (first, codes) in enumerate(table.probes(units, success, most)):
            home = np.floor(at[q])
            gains = np.diff(ann._normal((home[:, None] + np.arange(-1, 3) - at[q][:, None]) * table.width / table.reach), axis=1)
            code = lambda cell, n: int(((home[:n].astype(np.int64) + np.array(cell[:n], np.int64) - 1) * table.factors[:n]).sum()) if n else 0  # noqa: B023, E731
            cells = sorted(itertools.product(range(3), repeat=7), key=lambda c: -np.prod(gains[range(7), c]))[:most]  # noqa: B023
            done = np.cumsum([np.prod(gains[range(7), c]) for c in cells])
            cells = cells[: int(np.searchsorted(done, success)) + 1]
            assert sorted(zip(first.tolist(), codes.tolist(), strict=True)) == sorted((code(c, prefix), code(c, 7)) for c in cells)


def test_nearest_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    huge = [float(x) * 1e155 for x in rng.standard_normal(8)]
    tiny = [x * 1e-300 for x in huge]
    rows = [(1, huge), (2, tiny), (3, [-x for x in huge]), (4, [1.0] * 8), (4, [1.0] * 8), (5, [2.0] * 8), (6, []), (None, [1.0] * 8), (7, [float("inf")] + [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "dim", "row", "tab", "prefix", "score", "rank")})
    ask = table.where("vec_id IN (1, 4, 5)")
    got = collections.defaultdict(list)
    for r in ann.nearest(table, ask.union(ask)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 12)))
    assert got[1][0] == (1, 2, 1.0) and got[1][-1] == (5, 3, -1.0) and [i for _, i, _ in got[1]][1:4] in ([4, 4, 5], [5, 4, 4])
    assert got[5][:2] == [(1, 4, 1.0), (2, 4, 1.0)] and len(got[5]) == 5 and got[4][0] == (1, 5, 1.0) and len(got[4]) == 4 and set(got) == {1, 4, 5}


def test_equal_vectors_cost_no_neighbours(spark):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(60)] + [(100 + i, [0.5, 1.0, float(i)]) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = collections.defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id < 30")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert all(got[q] == [i for i in range(6) if i != q][:5] for q in range(30))


@pytest.mark.parametrize("shard", [64, 8192])
def test_recall_on_the_given_table(spark, shard):
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.where("embedding IS NOT NULL").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = table.where("vec_id % 10 = 0")
    found = collections.defaultdict(set)
    for r in ann.nearest(table, ask, shard=shard).collect():
        found[r["query_id"]].add(r["vec_id"])
    hit = sum(len(found[q] & set(ids[np.lexsort((ids, np.where(ids == q, 9, -(u @ u[np.flatnonzero(ids == q)[0]]))))[:5]].tolist())) for q in found)
    assert hit >= 0.9 * 5 * len(found) and len(found) == 50
    assert 0 < ann.nearest(table, ask, with_visited=True).agg(F.avg("visited")).first()[0] < 0.9 * len(ids)


@pytest.mark.parametrize("shard", [64, 8192])
def test_blocks_of_queries_change_nothing(spark, shard):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    ask = table.where("vec_id % 10 = 0")
    rows = lambda found: sorted(map(tuple, found.collect()))
    whole = rows(ann.nearest(table, ask, shard=shard))
    assert whole == rows(ann.nearest(table.repartition(7), ask, shard=shard, query_block=6)) and len(whole) == 250


def test_main_text(spark):
    from pyspark.sql import functions as F

    nav = "<nav><a href='/x'>Home</a></nav><div id=strip><p>Site wide strip</p></div>"
    page = lambda i: f"<!DOCTYPE html><html><head><title>T{i}</title><script>var a='<p>no</p>';</script></head><body>{nav}<!-- c --><h2>Head {i}</h2><p>Text &amp; more {i}<p>open {i} <b>bo</b>ld\n end<br>line<form><input>go</form><div class='comments'><p>first!</p></div><footer>&copy; us</footer></body>"
    rows = [(i, "https://a.example/p", page(i)) for i in range(6)]
    rows += [(7, None, None), (8, "https://b.example/", "<article><h1>A</h1><p>b<aside>c</aside></article><p>outside"), (9, "https://b.example/", "plain &lt;text&gt; only")]
    rows += [(9, "https://b.example/", "plain &lt;text&gt; only")]
    rows += [(10, "https://c.example/", "<body><div class=header>Site</div><article><div class=entry-header><h1>T</h1></div><p>x</p><ul class='share-links'><li>tweet</li></ul></article></body>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract_main_text(table, F.col("page_id")).collect())
    assert got[:6] == [(i, f"Head {i} Text & more {i} open {i} bold end line") for i in range(6)]
    assert got[6:] == [(7, ""), (8, "A b"), (9, "plain <text> only"), (9, "plain <text> only"), (10, "T x")]
    assert html_text.extract_main_text(table.limit(0), F.col("page_id")).count() == 0


def extracted(spark, pages):
    from pyspark.sql import functions as F

    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://h.example/x"))
    return [r["text"] for r in html_text.extract_main_text(table, F.col("page_id")).orderBy("page_id").collect()]


def test_templates_alone_remove_what_no_name_tells(spark):
    strip = "<div class=x1><b>Read</b> our daily letter</div>"
    page = lambda i: f"<body>{strip if i < 5 else ''}<article><p>story {i}</p><p>quoted by three</p>{strip if i < 5 else ''}<p>never miss a story</p></article></body>"
    got = extracted(spark, [page(i).replace("quoted by three", "quoted by three" if i < 3 else f"own {i}") for i in range(10)])
    assert got == [f"story {i} " + ("quoted by three" if i < 3 else f"own {i}") for i in range(10)]
    # copies of one article are no template, and neither is what few pages of a host share
    assert extracted(spark, ["<article><div>same</div><p>text of one article</p></article>"] * 9) == ["same text of one article"] * 9
    assert extracted(spark, [page(0), page(1)]) == [f"story {i} quoted by three Read our daily letter never miss a story" for i in range(2)]


def test_names_are_judged_as_a_whole_inside_an_article(spark):
    page = "<article><h1>T</h1><div class='share-price'>a</div><section class='social-history'>b</section><p class='notice-of-motion'>c</p><div class='comment-list'>d</div><div class='Ad'>e</div><div id=cookie-banner>f</div></article>"
    assert extracted(spark, [page]) == ["T a b c"]
    assert extracted(spark, ["<body><div class='share-price'>a</div><p>b</p><div class=site-header>c</div></body>"]) == ["b"]


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "<b>", "<p><button><ul>", "<", "=", "<!--", "<p>a", "<b><i></b>", "</i>", "<li><dl><dt>", "<a b='"])
def test_long_broken_pages_take_linear_time(unit):
    import time

    spent = []
    for size in (60_000, 480_000):
        start = time.process_time()
        html_text.subtrees(unit * (size // len(unit)) + '"')
        spent.append(time.process_time() - start)
    assert spent[1] < 24 * max(spent[0], 0.02)


def slow_main_text(pages):
    """Text of pages of one host made of <div> and <p> in a body, by recurrence over different pages."""
    blocks = [[(m[1], " ".join(re.sub("<[^>]*>", "", m[2]).split())) for m in re.finditer(r"<(div|p)>(.*?)</\1>", p)] for p in pages]
    whole = [tuple(own) for own in blocks]
    seen = collections.defaultdict(set)
    for own, article in zip(blocks, whole, strict=True):
        for block in own:
            seen[block].add(article)
    n = len(set(whole))
    is_template = lambda b: len(seen[b]) >= (4 if b[0] == "div" else max(8, 0.8 * n))
    return [" ".join(t for tag, t in own if not is_template((tag, t))) for own in blocks]


def test_main_text_against_brute_force(spark):
    rng = np.random.default_rng(12)
    common = [f"<div>strip {k}</div>" for k in range(4)] + ["<p>on every page</p>", "<p>often quoted</p>"]
    pages = ["".join(x for x, share in zip(common, (0.1, 0.3, 0.5, 0.9, 0.95, 0.5), strict=True) if rng.random() < share) + f"<p>the long story number {i // 2} and its end</p><div>by {i}</div>" for i in range(40)]
    assert extracted(spark, [f"<body>{p}</body>" for p in pages]) == slow_main_text(pages)


def slow_removed(raw, length):
    seen = collections.Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    for b in raw:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        yield bytes(c for c, m in zip(b, mask, strict=True) if not m), sum(m and (j == 0 or not mask[j - 1]) for j, m in enumerate(mask))


@pytest.mark.parametrize("length", [40, 200])
def test_remove_repeats(docs, empty, length):
    got = sorted((str(r["doc_id"]), r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(docs, length=length).collect())
    raw = [t.encode() for t in texts()]
    want = sorted((str(i), len(b), n, hashlib.sha256(kept).hexdigest()) for (i, *_), b, (kept, n) in zip(ROWS, raw, slow_removed(raw, length), strict=True))
    assert got == want and suffix_dedup.remove_repeats(empty, length=length).count() == 0


def test_multikey_order_sorts_by_all_tokens():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 500):
        tokens = [rng.integers(0, k, n) for k in (3, 4, 50)]
        rows = list(zip(*tokens, strict=True))
        assert [rows[i] for i in suffix_dedup.multikey_order(tokens)] == sorted(rows)


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("values", [1, 3, 1 << 40])
def test_multikey_order_keeps_the_order_of_equal_rows(ordered, values):
    draw = np.random.default_rng(7)
    for n in (0, 1, 2, 400):
        tokens = [draw.integers(-values, values, n) for _ in range(3)]
        if ordered:
            tokens[0] = np.sort(tokens[0])
        want = sorted(range(n), key=lambda i: (*[t[i] for t in tokens], i))
        assert suffix_dedup.multikey_order(tokens).tolist() == want


def test_remove_repeats_with_one_hot_string(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    hot, rows = noise(90), []
    for i in range(150):
        rows.append((i, noise(int(rng.integers(0, 60))) + hot[: int(rng.integers(50, 90))] + noise(int(rng.integers(0, 60)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.remove_repeats(frame, length=40).collect())
    raw = [t.encode() for _, t in rows]
    assert got == [(i, kept, n) for i, (kept, n) in enumerate(slow_removed(raw, 40))]


def test_mix_to_weights(docs, empty):
    got = mixing.mix_to_weights(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(ROWS) and all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in order)
    again = mixing.mix_to_weights(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and mixing.mix_to_weights(empty).count() == 0


def test_interpolated_scores(docs, empty):
    from pyspark.sql import functions as F

    got = lm.interpolated_scores(docs, F.col("doc_id") % 2 == 0).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]
    counts = collections.Counter(w for i, t, _, _ in ROWS if i is not None and i % 2 == 0 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t, _, _ in ROWS)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.interpolated_scores(empty, F.lit(True)).count() == 0


def test_interpolation_beats_unigrams_on_held_out_text(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = lm.interpolated_scores(docs, F.col("doc_id") % 10 != 0).where("doc_id % 10 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_parts_of_the_keys_hold_each_key_once():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 52, 500, np.uint64))
    for cut in (0, 3, 20):
        part, ends = lm._split(keys, 52, cut)
        assert ends[0] == 0 and ends[-1] == len(keys) and len(np.unique(part)) == len(part) == len(ends) - 1
        assert all((keys[b:e] >> np.uint64(52 - cut) == p).all() for p, b, e in zip(part, ends[:-1], ends[1:], strict=True))


def test_packed_numbers_round_trip():
    for values in ([], [0], [5, 0, 1 << 40], [(1 << 64) - 1, 3], [*range(0, 9000, 9), 1 << 63]):
        x = np.array(values, np.uint64)
        assert (lm._unpack(lm._pack(x)) == x).all() and (lm._unpack_sorted(lm._pack_sorted(np.sort(x))) == np.sort(x)).all()


def test_identify_languages(spark, docs):
    rows = [(i, t, lang, None) for i, (t, lang) in enumerate([("the cat sat on the mat with the hat", "en"), ("le chat est sur la table avec les autres", "fr"), ("привет как дела сегодня", "ru")] * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit_languages(train)
    from pyspark.sql import functions as F

    mixed = "the cat sat on the mat. le chat est sur la table avec les autres. привет как дела"
    ask = spark.createDataFrame([(1, mixed), (2, "123 ..."), (3, None), (4, ""), (5, "дела"), (5, "дела")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify_languages(ask, model, "text", F.col("doc_id")).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "fr", "ru"] and got[1]["lang_pred"] == "fr" and 0 < got[1]["score"] < 1
    assert [mixed[s["start"] : s["end"]][:3] for s in got[1]["spans"]] == ["the", "le ", "при"]
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["spans"] == [] for k in (2, 3, 4)) and got[5]["lang_pred"] == "ru"
    none = langid.fit_languages(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify_languages(docs, none, "text").collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    counts = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    labels, at = langid.viterbi(scores, counts, 0.7), 0
    import itertools

    for n in counts:
        value = lambda p: sum(scores[at + i, l] for i, l in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731, E741
        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert value(labels[at : at + n]) == pytest.approx(best, abs=1e-4)
        at += n


@pytest.mark.parametrize("stretch", [1, 3, 64])
def test_stretches_of_a_long_text_keep_its_path(stretch):
    rng = np.random.default_rng(6)
    counts = np.array([500, 0, 7, 64, 65, 1])
    for scores in (rng.normal(size=(637, 4)), np.zeros((637, 4)), rng.integers(0, 2, (637, 4)) * 0.25, rng.normal(size=(637, 4)) * 1e-3):
        scores = scores.astype(np.float32)
        assert (langid.viterbi(scores, counts, 0.7, stretch) == langid.viterbi(scores, counts, 0.7, 1000)).all()


def test_a_very_long_text_takes_few_steps():
    scores = np.random.default_rng(7).normal(size=(2_000_000, 4)).astype(np.float32)
    start = time.time()
    labels = langid.viterbi(scores, np.array([len(scores)]), 2.0)
    assert time.time() - start < 30 and len(np.unique(labels)) == 4


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(5)
    for capacity in (1, 7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 200)
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        room: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in room if r >= n]
            room.remove(min(fits)) if fits else None
            room.append((min(fits) if fits else capacity) - n)
        assert bins.max() + 1 == len(room)
        for b in range(len(room)):
            own = sorted((o, n) for o, n, x in zip(offsets, lengths, bins, strict=True) if x == b)
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity


def test_pack_best_fit(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_best_fit(docs, path, 4096, 1, group_bins=2).collect()
    want = []
    for i, t, _, _ in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert packing.pack_best_fit(empty, path).count() == 0


def test_quality(spark, docs, empty, sf_dir):
    from pyspark.sql import functions as F

    d, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(d, labels.where("doc_id % 2 = 0"))
    held = quality.score_quality(d, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert held.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.9
    scores = quality.score_quality(docs, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0


def slow_trees(x, y, trees):
    """Boosted trees by plain loops over every row and threshold; scores of the rows of ``x``."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    rate = min(max(sum(y) / len(y), 0.01), 0.99)
    raw = [math.log(rate / (1 - rate))] * len(y)

    def grow(rows, g, h, depth):
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best = (1e-6, None, None)
        if depth < quality.DEPTH and len(rows) >= 2 * quality.LEAST_LEAF:
            for j, own in enumerate(edges):
                for cut in own:
                    left = [i for i in rows if x[i, j] <= cut]
                    if min(len(left), len(rows) - len(left)) < quality.LEAST_LEAF:
                        continue
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = gl**2 / (hl + quality.RIDGE) + (gs - gl) ** 2 / (hs - hl + quality.RIDGE) - gs**2 / (hs + quality.RIDGE)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, j, cut)
        if best[1] is None:
            return quality.RATE * gs / (hs + quality.RIDGE)
        _, j, cut = best
        return (j, cut, grow([i for i in rows if x[i, j] <= cut], g, h, depth + 1), grow([i for i in rows if x[i, j] > cut], g, h, depth + 1))

    def walk(tree, row):
        while isinstance(tree, tuple):
            j, cut, left, right = tree
            tree = left if row[j] <= cut else right
        return tree

    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        tree = grow(list(range(len(y))), [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p], 0)
        raw = [r + walk(tree, row) for r, row in zip(raw, x, strict=True)]
    return [1 / (1 + math.exp(-r)) for r in raw]


def test_boosted_trees_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(90, 4)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.3, 90)) > 0).astype(float)
    for n in (1, 5):
        monkeypatch.setattr(quality, "TREES", n)
        assert quality.fit_trees(x, y).score(x) == pytest.approx(slow_trees(x, y, n), abs=1e-9)
    model = quality.fit_trees(x, y)

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            total += model.value[at]
        return 1 / (1 + math.exp(-total))

    fresh = rng.normal(size=(50, 4))
    assert model.score(fresh) == pytest.approx([walk(r) for r in fresh])
    assert quality.fit_trees(np.zeros((0, 4)), np.zeros(0)).score(fresh).tolist() == [0.5] * 50


def test_statistics_of_a_text():
    got = dict(zip(quality.FEATURES, quality.statistics("Ab abc abc ABC 12! | é\nhttp://x.y"), strict=True))
    n = len("Ab abc abc ABC 12! | é\nhttp://x.y".encode())
    assert got["log_chars"] == pytest.approx(math.log1p(n)) and got["log_words"] == pytest.approx(math.log1p(8))
    assert got["upper_share"] == pytest.approx(4 / n) and got["digit_share"] == pytest.approx(2 / n) and got["wide_share"] == pytest.approx(2 / n)
    assert got["distinct_share"] == 7 / 8 and got["same_as_last_share"] == 1 / 8 and got["upper_words"] == 1 / 8 and got["hash_like_share"] == 1 / 8
    assert got["exclaim_share"] == pytest.approx(1 / n) and got["pipe_share"] == pytest.approx(1 / n) and got["newline_share"] == pytest.approx(1 / n)


@pytest.mark.parametrize("part_rows, part_keys", [(lm.PART_ROWS, lm.PART_KEYS), (3, 8), (3, 1_000_000), (1, 1)])
def test_interpolated_score_against_brute_force(spark, monkeypatch, part_rows, part_keys):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "PART_ROWS", part_rows)
    monkeypatch.setattr(lm, "PART_KEYS", part_keys)
    monkeypatch.setattr(lm, "FAN", 2)
    rng = np.random.default_rng(10)
    word = lambda: f"W{int(rng.zipf(1.6)) % 50}"
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 14))))) for i in range(60)] + [(61, None), (62, "W1 w2 new")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r["doc_id"]: r["score"] for r in lm.interpolated_scores(frame, F.col("doc_id") % 3 != 0).collect()}
    deleted = {r[0] for r in frame.where(F.pmod(F.xxhash64("doc_id", F.lit("deleted")), F.lit(lm.DELETED)) == 0).select("doc_id").collect()}
    tokens = {i: (t or "").lower().split() + ["</s>"] for i, t in rows}
    train = [i for i in tokens if i % 3 != 0]

    def counts(ids):
        one, two = collections.Counter(), collections.Counter()
        for i in ids:
            one.update(tokens[i])
            two.update(zip(["<s>", *tokens[i]], tokens[i], strict=False))
        return one, two, len(ids)

    def terms(i, held):
        one, two, docs = held
        n = sum(one.values())
        for before, word in zip(["<s>", *tokens[i]], tokens[i], strict=False):
            context = docs if before == "<s>" else one[before]
            yield context, (two[before, word] / context if context else 0.0), one[word] / n, 1 / (len(one) + 1)

    bucket = lambda c: 0 if c == 0 else 1 + int(math.log2(c))
    rest = counts([i for i in train if i not in deleted])
    cells = collections.defaultdict(collections.Counter)
    for i in train:
        if i in deleted:
            for context, two, one, uniform in terms(i, rest):
                level = lambda p: math.exp(round(lm.STEPS * math.log(p / uniform)) / lm.STEPS) if p > 0 else 0.0  # noqa: B023, E731
                cells[bucket(context)][level(two), level(one), 1.0] += 1
    weights = collections.defaultdict(lambda: [0.3, 0.6, 0.1], {0: [0.0, 0.85, 0.15]})
    for b, own in cells.items():
        lam = weights[b]
        for _ in range(lm.ROUNDS):
            total = [0.0] * 3
            for p, n in own.items():
                parts = [x * y for x, y in zip(p, lam, strict=True)]
                total = [t + n * x / sum(parts) for t, x in zip(total, parts, strict=True)]
            lam = [t / sum(own.values()) for t in total]
        lam = [lam[0], max(lam[1], 1e-6), max(lam[2], 1e-6)]
        weights[b] = [x / sum(lam) for x in lam]
    whole = counts(train)
    assert deleted & set(train) and len(cells) > 1
    for i in tokens:
        want = sum(math.log10(sum(w * p for w, p in zip(weights[bucket(c)], ps, strict=True))) for c, *ps in terms(i, whole))
        assert got[i] == pytest.approx(want, rel=1e-9), i


def test_word_scores_against_brute_force(spark):
    texts = [("the cat sat on the mat", "en"), ("le chat est assis là", "fr"), ("the hat", "en"), ("кот сидит", "ru")] * 3
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit_languages(train)
    assert model.languages == ["en", "fr", "ru"]
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    cells = collections.defaultdict(collections.Counter)

    def letters(word):
        pair, triple, first, *_ = langid.words_of([word])
        assert len(first) == 1 and len(pair) == len(word)
        return list(zip(pair.tolist(), triple.tolist(), strict=True))

    for t, x in texts:
        for w in words(t):
            for a, b in letters(w):
                cells[x, 2][a] += 1
                cells[x, 3][b] += 1
    log = lambda x, size, cell: math.log((cells[x, size][cell] + langid.SMOOTH) / (sum(cells[x, size].values()) + langid.SMOOTH * langid.CELLS))
    for word in ("the", "chat", "zebra", "là"):
        pair, triple, first, _, script, *_ = langid.words_of([word])
        got = langid.word_scores(model, pair, triple, first, script)[0]
        want = [sum(log(x, 2, a) + log(x, 3, b) for a, b in letters(word)) for x in ("en", "fr")]
        assert got[:2] == pytest.approx(want, rel=1e-4) and got[2] == -1e4
    pair, triple, first, _, script, *_ = langid.words_of(["кот"])
    assert langid.word_scores(model, pair, triple, first, script)[0].tolist()[:2] == [-1e4, -1e4]


def test_remove_repeats_across_the_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 12)
    rng = np.random.default_rng(11)
    noise = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    a, b, c = noise(260), noise(5000), noise(200)
    rows = [(1, noise(3900) + a + noise(4000) + c + noise(50)), (2, noise(100) + a + b), (3, b[:2500] + noise(7000) + b[2500:]), (None, noise(30) + c), (None, c[:199]), (5, a + a), (5, "é" * 150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame, length=200).collect())
    raw = [t.encode() for _, t in rows]
    assert got == sorted((str(i), len(t), n, kept) for (i, _), t, (kept, n) in zip(rows, raw, slow_removed(raw, 200), strict=True))


def test_repeated_rows_take_linear_time(spark):
    """A text that most rows repeat, with an identifier and without."""
    text = " ".join(f"w{i * 7919 % 10007}" for i in range(110))
    rows = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    began = time.monotonic()
    got = suffix_dedup.remove_repeats(rows.repartition(8)).groupBy("doc_id", "n_bytes", F.octet_length("kept").alias("left"), F.size("spans").alias("n")).count().collect()
    assert sorted(map(tuple, got), key=str) == [(7, len(text), 0, 1, 25_000), (None, len(text), 0, 1, 25_000)]
    assert time.monotonic() - began < 120


def test_labelled_rows_that_repeat_reach_the_driver_once(spark, monkeypatch):
    docs = spark.range(100_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some text number "), (F.col("id") % 3).cast("string")).alias("text"))
    seen, fit = [], quality.fit_trees
    monkeypatch.setattr(quality, "fit_trees", lambda x, y: seen.append(len(x)) or fit(x, y))
    model = quality.fit_quality(docs, spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, 1)], "doc_id long, quality int"))
    assert seen == [2] and quality.score_quality(docs.limit(3), model).count() == 3


def test_filters_asked_without_moving_texts(spark):
    """Packed words are broadcast up to a bound in bytes, and answer as the joined ones do."""
    rows = spark.range(4000).select("id", F.concat(F.lit("text "), (F.col("id") % 3000).cast("string")).alias("body")).withColumn("digest", exact_dedup.sha256_digest(F.col("body")))
    held = rows.where("id >= 3000").select("digest")
    words = 500
    made = exact_dedup.bloom_filter(held, words)
    packed, joined = exact_dedup.may_hold(rows, made, words), exact_dedup.may_hold(rows, made, words, most_bytes=0)
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    assert ids(packed) == ids(joined) and set(range(1000)) <= set(ids(packed)) and len(ids(packed)) < 2600
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.replace("SinglePartition", "") and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("words", [8, 12, 16, 24, 50, 500])
@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_wide_fingerprints_lose_no_similar_texts(words, similarity):
    """Pairs at or just above a similarity, by number of shingles: that they share a band, and pass what prunes pairs of a file."""
    rng, found, n = np.random.default_rng(words), 0, 400
    gone = int(words * (1 - similarity))
    for _ in range(n):
        a = np.sort(rng.integers(0, 1 << 64, words, np.uint64, endpoint=False))
        b = np.sort(rng.permutation(a)[: words - gone])
        (f, x), (g, y) = simhash_wide.sketch(a), simhash_wide.sketch(b)
        near = simhash_wide.near_pairs((f ^ g)[None], np.array([min(len(a), len(b))]), simhash_wide.MOST_BITS)
        found += len(near) == 1 and bool((x == y).any())
    assert found >= 0.98 * n
