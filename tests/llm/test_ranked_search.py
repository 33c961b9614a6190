"""Ranked search against a plain search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftrow.llm import lexical
from siftrow.llm.lexical import Items, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, best=50):
    held = [(k, Counter(terms(t))) for k, t in docs]
    held = [(k, c, sum(c.values())) for k, c in held if c]
    total, n_docs = sum(n for _, _, n in held), len(held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, counts, n in held:
            m = 50 + (50 * n * n_docs) // total
            score = 0
            for t in set(terms(text)) & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is not None, key or 0))
        out += [(item, i + 1, k if known else None, -s) for i, (s, known, k) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"wort{i}" for i in range(60)] + ["Ünder", "ünder", "ÉTÉ", "été", "x1", "A", "a", "漢字"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, rng.choice([" ", "\n", "-", "_"]).join(rng.choices(vocab, weights, k=rng.choice([1, 4, 20, 120])))) for i in range(n)]
    docs += [(n, ""), (n + 1, None), (n + 2, "?!"), (None, docs[0][1])] + [(n + 10 + i, docs[3][1]) for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12, 40])))) for i in range(9)]
    return docs, [*items, (90, None), (91, "..."), (92, "unknown"), (None, "wort1 wort1")]


@pytest.mark.parametrize(("best", "blocks", "first"), [(50, 1 << 20, 0.02), (5, 1 << 20, 0.02), (7, 20, 0.5)])
def test_search_equals_plain_search(spark, monkeypatch, best, blocks, first):
    monkeypatch.setattr(lexical, "FIRST", first)
    docs, items = corpus(best, 400)
    d = spark.createDataFrame([(k, t, "x", 3, 0.5) for k, t in docs], "doc_id long, text string, hits string, uid int, norm double").repartition(4)
    q = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, terms int")
    got = ranked_search(d, q, best, blocks)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_search(docs, items, best)


def test_repeated_rows_are_documents_and_items_of_their_own(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id long, text string")
    q = spark.createDataFrame([("i", "a"), ("i", "a")], "item_id string, text string")
    got = [(r.item_id, r["rank"], r.doc_id) for r in ranked_search(d, q).collect()]
    assert sorted(got) == [("i", 1, 1), ("i", 1, 1), ("i", 2, 1), ("i", 2, 1)]


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(d.where("false"), q).count() == 0
    assert ranked_search(d, q.where("false")).count() == 0


def test_buckets_are_passed_over_and_bounds_lose_nothing():
    rng = np.random.default_rng(5)
    weights = np.array([9000, 7000, 4000, 1000, 700, 300] + [200] * 14)
    items = Items([np.arange(20)], weights, np.zeros(1, np.int64), 3)
    plain, searched = [], 0
    for bucket in range(6):
        rows = [np.sort(rng.choice(20, rng.integers(1, 6), False)) for _ in range(50)]
        term, edges = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        tf, m = rng.integers(1, 4, len(term)), np.full(50, 100 + 4000 * bucket)
        p = weights[term] * lexical.impacts(tf, np.repeat(m, np.diff(edges)))
        norm = np.sqrt(np.add.reduceat(p.astype(float) ** 2, edges[:-1]))
        order = np.arange(50)
        plain += [(-s, bucket * 50 + i) for i, s in enumerate(np.add.reduceat(p, edges[:-1]).tolist())]
        before = items.found[0].copy()
        items.search(np.stack([np.ones(50, np.int64), bucket * 50 + order, order]), m, norm, term, tf, edges)
        searched += not np.array_equal(before, items.found[0])
    assert [(-s, d) for s, _, d, _ in items.found[0].T.tolist()] == sorted(plain)[:3]
    assert searched < 6
