"""The source divergence audit against a brute force of its definition."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kgloom.llm import divergence, terms

SCHEMA = "doc_id long, text string, lang string, source string, item string, rank string, g string"


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _expected(rows, least, top=10):
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", _lower(t or "")), lang or "", s or "") for t, lang, s in rows]
    found, out = Counter((lang, t) for ts, lang, _ in docs for t in set(ts)), []
    counts = defaultdict(Counter)
    for ts, lang, s in docs:
        counts[lang, s].update(t for t in ts if found[lang, t] >= least)
    for lang in {k[0] for k in counts}:
        kept = [t for (x, t), n in found.items() if x == lang and n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def p(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole, own = p(sum(groups.values(), Counter())), {s: p(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            best = [(-f(own[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] and own[s][t] > whole[t]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(values)]
    return sorted(out)


def _rows(n=300, seed=3):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "été", "Été", "a1b", "x_y", "日本", "zß", "...", "12"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(10)]
    rows = []
    for i in range(n):
        source = int(rng.zipf(1.5)) % 7
        own = rng.choice(len(words), int(rng.integers(0, 30)))
        rows.append((" ".join(words[k] if k < 10 or (k + source) % 3 else "q" * (1 + source) for k in own), ["en", "de"][int(rng.integers(2))], f"s{source}"))
    odd = [(None, None, None), ("", "en", None), (None, "fr", "é"), (None, "fr", "z"), ("only here", "xx", "one"), ("the " * 5000, "en", "s1"), ("THE\x00the\tthe-the", "en", "s1")]
    return rows + odd + rows[:40]


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, *r, "clash", "clash", "clash") for i, r in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("least", "heavy", "slab_cells"), [(10, 4, 1 << 22), (1, 1, 1 << 22), (3, 100, 1 << 22), (2, 3, 5), (1, 2, 20)])
def test_audit_equals_brute_force(spark, least, heavy, slab_cells):
    rows = _rows()
    found = divergence.audited(_frame(spark, rows), least_docs=least, heavy=heavy, slab_cells=slab_cells)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == _expected(rows, least)


def test_small_pieces_and_flushes_change_nothing(spark, monkeypatch):
    rows = _rows(120, 5)
    monkeypatch.setattr(terms, "PIECE", 7)
    counts = divergence._Counts()
    for text, _, _ in rows:
        counts.add((text or "").encode(), 0)
        counts.count()
    assert not counts.full()
    text = "ab cd " * 50 + "é" * 40 + " x"
    assert [t for part in terms.term_pieces(text.encode(), terms.LETTERS, 7) for t in part] == text.encode().split()


def test_no_kept_terms_and_empty_table(spark):
    found = divergence.audited(_frame(spark, [("one", "en", "a"), ("two", "en", "b")])).collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in found) == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]
    assert divergence.audited(_frame(spark, [])).count() == 0


def test_probabilities_leave_64_bits(spark):
    n = np.array([0, 10**6, 10**13])
    assert divergence.probability(n, np.array([10**13] * 3), 7).tolist() == [1 + 10**9 * (int(x) + 2) // (10**13 + 14) for x in n]
