"""Lexical search, hard negatives and MinHash groups against brute force, and on hard rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import hard_negatives as hn
from tillwise.llm import lexical_search as ls
from tillwise.llm import minhash as mh

from .conftest import HARD
from .test_operators import _shingles

# -- lexical search -------------------------------------------------------------------

def _terms(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute_search(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    words = sum(sum(c.values()) for _, c in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(_terms(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, tf in held:
            score = 0
            for t in terms:
                if tf[t]:
                    df = sum(t in c for _, c in held)
                    m = 100 - 75 + (75 * sum(tf.values()) * n_docs) // words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


def _items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_lexical_search(spark, documents, monkeypatch):
    monkeypatch.setattr(ls, "PIECE_BYTES", 64)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdé9", k=draw.randint(1, 4))) for _ in range(120)]
    docs = [(i, draw.choice([" ", "--", "\n_"]).join(draw.choices(words, k=draw.randint(0, 90)))) for i in range(80)]
    docs += [(100 + i, docs[5][1]) for i in range(14)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 30))).upper()) for i in range(9)]
    want = _brute_search(docs, items)
    for postings in (1 << 20, 40):  # in one pass, and in several
        monkeypatch.setattr(ls, "POSTINGS_PER_PASS", postings)
        got = ls.search(documents(*docs).repartition(5), _items(spark, *items)).collect()
        assert Counter(map(tuple, got)) == want


def test_lexical_search_whole_terms_only():
    queries = ls.build_queries([(1, "a", 1), (1, "ab", 1), (2, "a", 2)])
    column = __import__("pyarrow").array(["a ab abc a-a", "xa", None, ""])
    found = [(n, dict(zip([queries.terms[i] for i in t], c.tolist()))) for n, t, c in ls._scanned(queries, column)]
    assert found == [(5, {"a": 3, "ab": 1}), (1, {}), (0, {}), (0, {})]


def test_lexical_search_hard_rows(spark, documents):
    items = [(1, "Same TEXT"), (2, None), (3, ""), (None, "id"), (4, "word"), (4, "word same"), (5, "nowhere")]
    got = ls.search(documents(*HARD), _items(spark, *items)).collect()
    assert Counter(map(tuple, got)) == _brute_search([r[:2] for r in HARD], items)
    assert ls.search(documents(), _items(spark, *items)).count() == 0
    assert ls.search(documents(*HARD), _items(spark)).count() == 0
    assert ls.search(documents((1, None)), _items(spark, (1, "a"))).count() == 0


def test_lexical_search_clashing_names(spark, documents):
    docs = documents((1, "a b"), (2, "b")).withColumns({n: F.lit(7) for n in ("score", "rank", "item_id", "term", "n")})
    items = _items(spark, (1, "b a")).withColumns({n: F.lit(7) for n in ("doc_id", "times", "score", "rank")})
    assert [r[:3] for r in sorted(ls.search(docs, items).collect())] == [(1, 1, 1), (1, 2, 2)]


# -- hard negatives -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def _brute_negatives(rows, positives=5, negatives=10):
    valid = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
             if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for a, u, y in valid:
        if a is None or a % 100:
            continue
        scored = [(i, sum(p * q for p, q in zip(u, v)), z) for i, v, z in valid if i != a]
        for p, s, _ in sorted((r for r in scored if r[2] == y), key=order)[:positives]:
            window = sorted((r for r in scored if r[2] != y and 30 * s <= 100 * r[1] <= 90 * s), key=order)[:negatives]
            out += [(a, p, rank, n, s, t) for rank, (n, t, _) in enumerate(window, 1)]
    return Counter(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_hard_negatives(spark, monkeypatch, clustered):
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(hn, "PART_ROWS", 100)
    monkeypatch.setattr(hn, "CHUNK_ROWS", 32)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    vectors = centres[draw.integers(6, size=400)] + draw.normal(size=(400, 8)) * (0.05 if clustered else 2)
    rows = [(i * 10, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(draw.integers(3)) if i % 3 else 0)
            for i, v in enumerate(vectors)]
    rows += [(r[0] + 3, r[1], r[2]) for r in rows[:60:5]]  # equal scores
    got = hn.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(map(tuple, got)) == _brute_negatives(rows)


def test_hard_negatives_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, [0.25, 1.0, 4.0], 2),
            (4, None, 1), (5, [None, 1.0], 1), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [1.0, 1.0], None), (9, [], 2),
            (100, [], 2), (200, [-1.0, -1.0], 1), (None, [0.6, 0.6], 2), (None, [0.9, 0.4], 1), (300, [0.5, 0.1], 3),
            (-100, [0.4, 0.4], 2), (11, [0.55, 0.5], 2), (11, [0.55, 0.5], 2)]
    got = hn.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(map(tuple, got)) == _brute_negatives(rows)
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [1e30, 0.0], 2), (3, [6e5, 1.0], 2)]
    assert len(hn.hard_negatives(spark.createDataFrame(huge, VECTORS)).collect()) == 0  # all scores equal at the limit
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    clash = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in ("id", "vector", "anchor", "score", "rank", "block", "parts")})
    assert Counter(map(tuple, hn.hard_negatives(clash).collect())) == _brute_negatives(rows)


def test_products_beyond_doubles():
    rows = np.array([[2.0 ** 27 - 1, 2.0 ** 27, 3.0]])
    norms = np.linalg.norm(rows, axis=1)
    assert hn._products(rows, norms, rows[0], norms[0])[0] == sum(int(x) ** 2 for x in rows[0])


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(1).normal(size=(40, 3))
    visits = hn.spanning_tree(points)
    assert sorted(v[0] for v in visits) == list(range(40))
    seen, open_, most = set(), set(), 0
    for node, parent, length, last in visits:
        assert parent == -1 and node == 0 or parent in open_ and length == pytest.approx(np.linalg.norm(points[node] - points[parent]))
        if last:
            open_.discard(parent)
        open_.add(node)
        seen.add(node)
        most = max(most, len(open_ & {v[1] for v in visits}))
    edges = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for length, i, j in edges:  # Kruskal
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i], total = j, total + length
    assert sum(v[2] for v in visits) == pytest.approx(total)


def test_bounds_spare_work():
    """In clusters few rows are scored at an anchor; what is left out is outside the window."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16)) * 200
    anchors = np.floor(np.repeat(centres, 3, 0) + draw.normal(size=(60, 16)))
    rows = np.floor(np.repeat(centres, 50, 0) + draw.normal(size=(1000, 16)) * 5)
    norm = lambda x: np.linalg.norm(x, axis=1)
    exact = anchors @ rows.T
    low = np.quantile(exact, 0.95, axis=1)
    scored = 0
    for i, some, scores in hn._descend(hn.spanning_tree(anchors), anchors, norm(anchors), rows, norm(rows),
                                       lambda i, lo, hi: hi >= low[i]):
        assert (scores == exact[i][some]).all() and set(np.flatnonzero(exact[i] >= low[i])) <= set(some)
        scored += len(some)
    assert scored < exact.size / 2


# -- MinHash ----------------------------------------------------------------------------

def _brute_groups(rows, percent=85):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("block", [3, 1024])
def test_minhash(documents, monkeypatch, block):
    monkeypatch.setattr(mh, "BLOCK_SETS", block)
    monkeypatch.setattr(mh, "_STEP", 50)
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(400)]
    common = " ".join(draw.choices(words, k=60))
    rows = []
    for group in range(14):
        base = draw.choices(words, k=draw.randint(3, 160))
        for _ in range(draw.randint(1, 25)):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text) + (" " + common if group % 3 == 0 else ""))
    rows += [None, "", "one", "ONE", "a b c d", "A B c D", rows[0].upper()]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in mh.minhash_groups(documents(*rows)).collect()}
    want = _brute_groups(rows)
    assert got == want
    assert len({c for _, c, _ in got.values()}) < len(rows)


def test_minhash_chain(documents):
    """A document far from the first is reached through others."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 7:i * 7 + 150])) for i in range(9)]
    got = {r.doc_id: r.component_id for r in mh.minhash_groups(documents(*rows)).collect()}
    assert got == {i: c for i, (_, c, _) in _brute_groups(rows).items()} and set(got.values()) == {0}


def test_minhash_hard_rows(documents):
    docs = documents(*HARD)
    got = mh.minhash_groups(docs)
    assert got.count() == len(HARD)
    assert {(r.component_id, r.kept) for r in got.filter("doc_id in (3, 4)").collect()} == {(3, True), (3, False)}
    assert [(r.component_id, r.kept) for r in got.filter("doc_id is null").collect()] == [(None, True)]
    joined = mh.minhash_groups(documents((None, "no id here"), (8, "no id here"))).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in joined} == {(None, 8, False), (8, 8, True)}
    assert mh.minhash_groups(documents()).count() == 0
    clash = docs.withColumns({n: F.lit(1) for n in ("n", "fp", "node", "bucket", "cluster", "component", "k", "a", "b", "block")})
    assert mh.minhash_groups(clash).count() == len(HARD)


def test_minima_are_those_of_each_function():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 200_000, 3)]
    got = mh.minima(sets)
    for row, tokens in zip(got, sets):
        assert [int(x) for x in row[:5]] == [int((tokens * a + b).min()) for a, b in zip(mh._FACTORS[:5], mh._SHIFTS[:5])]


def test_bands_and_agreement_lose_no_link():
    """The chances in the docstring, by the binomial sum."""
    n, p, least = mh.BANDS * mh.MINIMA, 0.85, mh.least_agreement(85)
    assert (1 - p ** mh.MINIMA) ** mh.BANDS < 1e-10
    assert sum(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(least)) < 1e-7
