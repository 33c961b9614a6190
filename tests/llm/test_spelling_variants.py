"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftrow.llm.queries.vocabulary import op13_spelling_variants
from siftrow.llm.variants import crc_of_spans, edits, hashes, latin, spelling_variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, drop_every=31, ratio=10, min_length=7):
    counts = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop_every and h % drop_every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 2}
    # Words one apart share what is left when a letter of each is taken out.
    holes: dict[str, set] = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        holes.setdefault(w, set()).add(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_apart(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeéÿàz", k=rng.choice([6, 7, 8, 9, 12]))) for _ in range(30)] + ["x" * 70, "ß" * 66 + "a"]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = base[min(int(rng.paretovariate(0.7)) - 1, len(base) - 1)]
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abßé") + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((i, rng.choice([" ", "\n", "-", "1"]).join(words)))
    return [*docs, (n, None), (n + 1, ""), (None, docs[0][1]), (0, docs[1][1]), (n + 2, "Łódźabcdefg ×÷abcdefg×÷ " * 3)]


@pytest.mark.parametrize(("drop", "filter_bytes"), [(31, 32 << 20), (3, 64), (None, 1 << 10)])
def test_variants_equal_a_plain_comparison(spark, drop, filter_bytes):
    docs = corpus(drop or 1, 120)
    table = spark.createDataFrame([(k, t, "w", 1) for k, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling_variants(table, drop_every=drop, filter_bytes=filter_bytes)
    columns = ("word", "n", "n_near", "form", "form_n", "root")
    want = plain_variants(docs, drop)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want
    assert len(want) > 100 and sum(x[3] is not None for x in want) > 20


def test_forms_are_followed_to_the_last(spark):
    chain = [("abcdefghijkl", 5000), ("abcdefghijk", 400), ("abcdefghij", 30), ("abcdefghi", 3), ("abcdefghx", 2), ("zzabcdefg", 2)]
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    got = {r.word: (r.form, r.root) for r in spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), drop_every=None).collect()}
    assert got == {
        "abcdefghijkl": (None, "abcdefghijkl"),
        "abcdefghijk": ("abcdefghijkl", "abcdefghijkl"),
        "abcdefghij": ("abcdefghijk", "abcdefghijkl"),
        "abcdefghi": ("abcdefghij", "abcdefghijkl"),
        "abcdefghx": (None, "abcdefghx"),
        "zzabcdefg": (None, "zzabcdefg"),
    }


def test_empty_and_wordless_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(empty).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "12 34"), (2, None)], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(empty, ratio=1)


def test_query_equals_a_plain_comparison_on_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op13_spelling_variants(spark, folder)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = [(w, f, r, n, near, fn) for w, n, near, f, fn, r in plain_variants(docs)]
    assert sorted(map(tuple, got.collect())) == want


def test_edits_have_the_hash_of_the_edited_word():
    words = ["abcdefg", "aaaaaaa", "éÿzabcd", "zzzzzzz"]
    letters, edges = latin(pa.array(words))
    got = {}
    for _, row, h in edits(letters.reshape(4, 7)):
        for r, x in zip(row.tolist(), h.tolist()):
            got.setdefault(r, []).append(x)
    alphabet = [chr(x) for x in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
    for r, w in enumerate(words):
        made = [w[:i] + w[i + 1 :] for i in range(7) if not i or w[i] != w[i - 1]] + [w[:i] + c + w[i + 1 :] for i in range(7) for c in alphabet if c > w[i]]
        assert sorted(got[r]) == sorted(hashes(*latin(pa.array(made))).tolist())


def test_crc_of_spans():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(5000), np.uint8)
    starts = np.array([rng.randrange(4000) for _ in range(200)])
    ends = starts + np.array([rng.choice([0, 1, 5, 40, 128, 129, 700]) for _ in range(200)])
    seeds = np.array([zlib.crc32(str(i).encode()) for i in range(200)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(starts, ends, seeds)]
    assert crc_of_spans(data, starts, ends, seeds).tolist() == want
