"""Treaps, their simultaneous traversal and the ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from kgloom.llm import lexical

DOCS = "doc_id long, text string, item_id string, term string, score string"
ITEMS = "item_id long, text string, doc_id string, term string"


def _treaps(lists, docs):
    trees = [lexical.treap(i, d) for d, i in lists]
    return lexical.Treaps(np.arange(docs), [d for d, _ in lists], [i for _, i in lists], *([np.array(t[k]) for t in trees] for k in (0, 1)))


def test_treaps_keep_both_orders():
    rng = np.random.default_rng(2)
    for impact in (rng.integers(1, 9, 500), np.full(500, 3), np.arange(500)):
        doc = np.sort(rng.choice(5000, 500, replace=False))
        left, right, root = lexical.treap(impact, doc)

        def walk(node, left=left, right=right, impact=impact):
            order, way = [], []
            while node >= 0 or way:
                while node >= 0:
                    assert all(c < 0 or impact[c] <= impact[node] for c in (left[node], right[node]))
                    way.append(node)
                    node = left[node]
                node = way.pop()
                order.append(node)
                node = right[node]
            return order

        assert walk(root) == list(range(500))


@pytest.mark.parametrize("seed", range(25))
def test_traversal_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    docs, terms, k = int(rng.integers(1, 400)), int(rng.integers(1, 12)), int(rng.integers(1, 12))
    lists = []
    for _ in range(terms):
        d = np.sort(rng.choice(docs, int(rng.integers(1, docs + 1)), replace=False))
        lists.append((d, [rng.integers(1, 50, len(d)), np.full(len(d), 7), np.arange(1, len(d) + 1)][int(rng.integers(3))]))
    rows = [(i, int(t), int(rng.integers(1, 9))) for i in range(5) for t in sorted(rng.choice(terms, int(rng.integers(1, terms + 1)), replace=False))]
    found = lexical.traverse(_treaps(lists, docs), *np.array(rows).T, 5, k, leaf=int(rng.integers(1, 20)), cursors=int(rng.choice([1, 10, 10**6])))
    expected = []
    for i in range(5):
        scores = np.zeros(docs, np.int64)
        for _, t, w in (r for r in rows if r[0] == i):
            scores[lists[t][0]] += w * lists[t][1]
        expected += [(i, int(scores[d]), int(d)) for d in np.lexsort((np.arange(docs), -scores))[:k] if scores[d] > 0]
    assert sorted(zip(*(a.tolist() for a in found), strict=True)) == sorted(expected)


def test_ranges_that_cannot_enter_are_passed_over(monkeypatch):
    docs = 20_000
    lists = [(np.arange(docs), np.where(np.arange(docs) % 5000 == 7, 900, 1)) for _ in range(3)]
    t, met = _treaps(lists, docs), []
    within = lexical.Treaps.within
    monkeypatch.setattr(lexical.Treaps, "within", lambda self, node, low, high: met.append(len(node)) or within(self, node, low, high))
    found = lexical.traverse(t, np.zeros(3, int), np.arange(3), np.ones(3, int), 1, 4)
    assert found[2].tolist() == [7, 5007, 10007, 15007] and sum(met) < 200


def _terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _expected(docs, items, k=10):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in counts if c]
    n_all, l_all = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    for i, ts in asked.items():
        scores = []
        for d, c, n in own:
            m = 10 + 90 * n * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(i, r + 1, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def _corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "été", "日本語", "a-b", "x_1", "ABC"]
    text = lambda size: " ".join(words[min(int(rng.zipf(1.3)), len(words)) - 1] for _ in range(size))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)] + [(3, docs[3][1]), (None, docs[7][1]), (n + 50, None), (n + 51, " -_- "), (n + 52, "w1 " * 20_000)]
    return docs, [(i, text(int(rng.integers(1, 25)))) for i in range(12)] + [(12, docs[5][1]), (12, "w59 Ünï"), (13, None), (14, "nowhere"), (None, "w3 w4")]


@pytest.mark.parametrize(("vocabulary", "pairs", "shard"), [(500_000, 100_000, 3_000_000), (0, 100_000, 200), (500_000, 10, 50)])
def test_search_equals_brute_force(spark, vocabulary, pairs, shard):
    docs, items = _corpus()
    d = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, "clash", "clash") for r in items], ITEMS)
    found = lexical.ranked(d, i, vocabulary=vocabulary, block_pairs=pairs, shard_postings=shard)
    assert sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == _expected(docs, items)


def test_index_of_all_terms_is_the_same_whatever_is_forgotten(spark):
    docs, _ = _corpus()
    d = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in docs], DOCS).coalesce(1)
    kept, forgotten = (lexical.indexed(d, (400, 9000), shard_postings=500, kept_terms=n).where("term is not null") for n in (10**6, 5))
    rows = [sorted((r.shard, r.term, tuple(r.doc), tuple(r.impact), tuple(r.left)) for r in x.collect()) for x in (kept, forgotten)]
    assert rows[0] == rows[1] and {r[1] for r in rows[0]} == {t for _, text in docs for t in _terms(text)}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "w1", "", "", "")], DOCS), spark.createDataFrame([(1, "w1", "", "")], ITEMS)
    assert lexical.ranked(d.limit(0), i).count() == 0 and lexical.ranked(d, i.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.ranked(d, i).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
