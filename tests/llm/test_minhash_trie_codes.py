"""MinHash near-duplicates, the conversation trie and vector codes against brute-force versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from test_operators import ROWS, docs, empty  # noqa: F401  fixtures of awkward rows
from tidewater.llm import codes, minhash, trie
from tidewater.llm.components import Forest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text, shingle=3):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in (text or "").translate(LOWER)).split(" ") if w]
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def slow_minhash(rows, percent=85):
    """[(id, n, component, kept)] over all pairs of rows."""
    sets, forest = [slow_set(t) for _, t in rows], Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                forest.union(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[forest.find(i)] = min(doc, least.get(forest.find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        c = least.get(forest.find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), c, doc == c))
    return sorted(out, key=str)


def found(frame, id_col="doc_id"):
    return sorted(((r[id_col], r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()), key=str)


def test_minhash_of_awkward_rows(docs, empty):  # noqa: F811
    assert found(minhash.minhash_components(docs)) == slow_minhash([(i, t) for i, t, *_ in ROWS])
    assert minhash.minhash_components(empty).count() == 0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("block", "exact_block"), [(4096, 512), (8, 5)])
def test_minhash_links_against_all_pairs(spark, block, exact_block):
    """Groups of copies with few to many edits, from 3 to 400 words; chains of links; an identifier twice or missing."""
    rng, rows = random.Random(5), []
    for n, copies in ((3, 4), (8, 12), (20, 20), (60, 30), (400, 25)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(len(rows) + 7 * k, edited(rng, base, rng.randrange(1 + n // 12))) for k in range(copies)]
        rows += [(len(rows), " ".join(base[: n - k])) for k in range(min(n, 12))]
    rows += [(None, rows[30][1]), (None, "only this row has no identifier"), (rows[0][0], "another text of an identifier")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(minhash.minhash_components(frame, block=block, exact_block=exact_block)) == slow_minhash(rows)


def test_a_row_without_identifier_connects_others(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(9, " ".join(words)), (None, " ".join(words[:36])), (4, " ".join(words[:32]))]
    assert found(minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_minhash(rows)
    assert slow_minhash(rows)[0][2] == 4


@pytest.mark.parametrize("words", [8, 16, 50, 500])
def test_tensored_tables_miss_few(words):
    """Pairs at the least similarity share a table as often as the docstring says, short or long."""
    rng, missed, pairs = np.random.default_rng(words), 0, 3000
    gone = max(1, int(words * 0.13))
    for _ in range(pairs):
        a = rng.integers(0, 1 << 64, words, np.uint64, endpoint=False)
        b = a[: words - gone]
        (x, y), (v, w) = minhash.half_keys(minhash.minima(a)), minhash.half_keys(minhash.minima(b))
        missed += not ((x == v).any() and (y == w).any())
    assert missed <= 6


def test_walk_reaches_what_links_reach():
    rng = random.Random(3)
    edges = {frozenset((rng.randrange(80), rng.randrange(80))) for _ in range(60)}
    one, two = minhash.walk(80, lambda x, others: np.array([frozenset((x, int(o))) in edges for o in others], bool))
    forest, want = Forest(), Forest()
    for a, b in zip(one, two, strict=True):
        forest.union(a, b)
    for e in edges:
        want.union(min(e), max(e))
    assert [forest.find(i) for i in range(80)] == [want.find(i) for i in range(80)] and all(frozenset(e) in edges for e in zip(one, two, strict=True))


@pytest.fixture
def spread(spark):
    """Small tables stay in as many partitions as large ones would."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


TURNS = [
    (0, 2, "user", "hello  there"), (0, None, "system", "be brief"), (0, 1, None, "x"), (0, 1, "a", None), (1, 1, "user", "one two"), (1, 2, "bot", "three"),
    (3, 1, "user", "one two"), (3, 2, "bot", "three"), (5, 1, "user", "alone"), (None, 1, "user", "nobody's"), (21, 1, "user", "no base"), (21, 2, "user", "no base"), (21, 3, "b", "c\td e"),
    (21, 4, "b", "tail"), (-3, 1, "user", "below zero"), (-3, 1, "user", "below zero"), (40, 1, "s", "lead"), (45, 1, "s", "lead"), (45, 9, "s", "after"), (7, 5, "é", "漢字 \x0b ü"),
]


def slow_trie(turns, every=20, most=3):
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        rebuilt[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        words = len([w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in p[-1][1].decode()).split(" ") if w]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * words
            leaves[p[:d]] += not children[p]
    sha = lambda p, cs: hashlib.sha256(",".join(str(c) for c in sorted(cs) if rebuilt[c] == list(p)).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], sha(p, cs)) for p, cs in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("shards", "in_memory"), [(1000, 1 << 18), (10, 2), (1, 1)])
def test_trie_against_brute_force(spark, spread, shards, in_memory):
    """Awkward turns, many equal conversations, and one much longer than the others, with shards of many sizes and queues that spill."""
    rng = random.Random(1)
    rows = [*TURNS, *((100 + c, k, "u", "same text") for c in range(60) for k in range(1, 5)), *((77, k, "u", f"turn {k}") for k in range(150))]
    rows += [(200 + c, k, rng.choice("ab"), rng.choice(["x y", "z"])) for c in range(50) for k in range(rng.randrange(1, 6))]
    rng.shuffle(rows)
    clash = ["part", "place", "x1", "words"]
    frame = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} long" for c in clash)).repartition(4)
    got = trie.prefix_trie(frame, shards=shards, in_memory=in_memory)
    assert got.columns == TRIE
    assert sorted(tuple(r) for r in got.collect()) == slow_trie(rows)


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(alone, 1, "a", "b")]
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()]
    assert got == slow_trie(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_turns_are_numbered_across_partitions(spark, spread):
    rows = [(5, k, "u", f"text {k}") for k in range(1000)] + [(6, 1, "u", "x")]
    turns = trie.sorted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), "conv_id", "turn", "role", "text")
    got = turns.collect()
    assert sorted((r["conv_id"], r["place"]) for r in got) == sorted((c, k if c == 5 else 0) for c, k, *_ in rows)
    assert len({r["part"] for r in got if r["conv_id"] == 5}) > 1


def test_spilling_queue_keeps_order():
    rng, queue, want, got = random.Random(2), trie.SpillingQueue(5), [], []
    for _ in range(400):
        if want and rng.random() < 0.4:
            got.append(queue.pop())
            assert got[-1] == min(want)
            want.remove(got[-1])
        else:
            want.append((rng.randrange(30), rng.randrange(30)))
            queue.push(want[-1])
    assert [queue.pop() for _ in range(len(want))] == sorted(want) and queue.first() is None


def slow_codes(rows, rounds=6):
    """Lloyd rounds in whole numbers of any size, all entries looked at by every part: ({id: (code, error)}, codebooks)."""
    kept = sorted(((i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(x * 4096) if abs(x) < 1e300 else int(x) * 4096 for x in v]) for i, v in kept if len(v) == len(kept[0][1])]
    cut = [(len(kept[0][1]) * p // 8, len(kept[0][1]) * (p + 1) // 8) for p in range(8)]
    books = [[v[a:b] for _, v in kept[:16]] for a, b in cut]

    def assigned():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), j) for j, e in enumerate(books[p])) for p, (a, b) in enumerate(cut)] for _, v in kept]

    for _ in range(rounds):
        now = assigned()
        for p, (a, b) in enumerate(cut):
            for j in range(len(books[p])):
                own = [v[a:b] for (_, v), c in zip(kept, now, strict=True) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    most = (1 << 63) - 1
    return sorted(((i, "".join(f"{j:02x}" for _, j in c), min(most, sum(d for d, _ in c))) for (i, _), c in zip(kept, assigned(), strict=True)), key=str), books


def vectors(n, size, seed=0, big=None):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(size)]) for i in range(n)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (n + 1, None), (n + 2, [None] * size), (n + 3, [float("nan"), *rows[0][1][1:]]), (n + 4, [float("-inf"), *rows[0][1][1:]]), (n + 5, [1.0]), (n + 6, [])]
    return rows + [(n + 7 + k, [x, *rows[1][1][1:]]) for k, x in enumerate(big or [])]


@pytest.mark.parametrize(("n", "size", "big"), [(150, 64, None), (120, 16, [1e30, -1e30, 5000.0, 1.7e308, -1.7e308]), (60, 19, None), (9, 8, None), (40, 5, None)])
def test_codes_against_brute_force(spark, n, size, big):
    """Repeated and null identifiers, vectors that take no part, few vectors, odd lengths, components beyond 64 bits."""
    rows = vectors(n, size, big=big)
    labels = [None if i is None or i % 3 == 0 else i % 3 for i, _ in rows]
    frame = spark.createDataFrame([(i, v, x, "clash", 1) for (i, v), x in zip(rows, labels, strict=True)], "vec_id long, embedding array<double>, label int, code string, part int").repartition(4)
    got, books = codes.vector_codes(frame)
    want, want_books = slow_codes(rows)
    held = got.collect()
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in held), key=str) == want
    assert [b.tolist() for b in books] == want_books
    sums = collections.Counter()
    for r in held:
        sums[r["label"]] += r["error"]
    assert all(r["label_error"] == min((1 << 63) - 1, sums[r["label"]]) for r in held)
    flat = ",".join(str(x) for b in want_books for e in b for x in e)
    assert codes.codebooks_sha256(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_codes_of_nothing(spark):
    got, books = codes.vector_codes(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int"))
    assert got.count() == 0 and books == []


def test_resting_parts_compare_moved_entries_only(monkeypatch):
    rng = np.random.default_rng(4)
    rows, book = rng.integers(-50, 50, (500, 4)), rng.integers(-50, 50, (16, 4))
    code, dist = codes.assign(rows, book, np.ones(16, bool))
    later, moved = book.copy(), np.zeros(16, bool)
    later[[2, 9]] += rng.integers(-9, 9, (2, 4))
    moved[[2, 9]] = True
    compared, scan = [], codes._scan
    monkeypatch.setattr(codes, "_scan", lambda r, e: compared.append(len(r) * len(e)) or scan(r, e))
    got = codes.assign(rows, later, moved, code, dist)
    again = np.isin(code, [2, 9]).sum()
    assert sum(compared) == again * 16 + (500 - again) * 2
    want = scan(rows, later)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
