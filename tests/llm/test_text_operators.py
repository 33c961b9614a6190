"""Line dedup, quality rules, classifier, language identification, HTML and fingerprints on small and odd inputs."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftrow.llm.bytes import prefix_hashes, slices, span_hashes, word_spans
from siftrow.llm.classifier import fit_quality, quality_scores, score_quality
from siftrow.llm.common import words
from siftrow.llm.fingerprints import compare_with_next, equal_pairs, fingerprint_documents, likeness, rarity
from siftrow.llm.html import content_blocks, extract_main_text, matching, merge, parse, tree_of
from siftrow.llm.language import fit_model, identify_languages
from siftrow.llm.line_dedup import LineIndex, dedup_lines, line_hashes
from siftrow.llm.quality_rules import BUCKETS, quality_rules

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, n_lines string"
ODD = [
    (1, "A common line here\nown one of the first\n\nshort", "x"),
    (2, "  a COMMON line here \nÉcole commune longue\nA common line here", None),
    (3, None, None),
    (4, "", ""),
    (None, "a common line here\nonly in the one without id", ""),
    (5, "école commune longue\nshort\nlast line of all", ""),
    (5, "école commune longue\nshort\nlast line of all", ""),
    (6, "\n\n\t", ""),
    (7, "z" * 200_000 + "\na common line here", ""),
]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows):
    first = {}
    held = Counter()
    keys = lambda t: [lower(x.strip(BLANK)) for x in (t or "").split("\n")]
    for doc in {r[0] for r in rows}:
        for k in {k for r in rows if r[0] == doc for k in keys(r[1]) if len(k) >= 10}:
            held[k] += 1
            if doc is not None:
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(k) >= 10 and held[k] > 1 and first.get(k) != doc for k in keys(text)]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fan_in", [(1, 3), (4, 2), (5, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fan_in):
    got = dedup_lines(spark.createDataFrame(ODD, DOCS), batches, fan_in)
    rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr)
    assert rows == brute_lines(ODD)


def test_runs_are_merged_by_level_and_hold_each_hash_once(spark):
    index = LineIndex(spark, fan_in=2, buckets=2)
    for i in range(5):
        docs = spark.createDataFrame([(i, f"line number {j} of them" if j else f"own line {i} for sure") for j in range(3)], "doc_id long, text string")
        index.add(line_hashes(docs))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    firsts = index.firsts()
    assert firsts.count() == firsts.select("h1", "h2").distinct().count() == 7
    index.drop()


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert dedup_lines(empty).count() == 0
    assert quality_rules(empty, labels).count() == 0
    assert quality_scores(empty, labels).count() == 0
    assert identify_languages(empty).count() == 0
    assert compare_with_next(empty, rarity(empty)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_main_text(pages).count() == 0


TEXTS = ["one two three four five six one two three four five", "a\nb\na\n \na", "tab\tand\x0bfeed\x0cword\r\nend  of", None, "", "x " * 300, "é É ünï # $5 *", "p q r s t p q r s t p q r s t u v w x y z a b c d e f g h i j k l m"]


def test_words_split_at_the_contract_s_blanks(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r.w for r in df.select(words(df.text).alias("w")).collect()]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]


def brute_rules(rows, trusted):
    bags = {}
    for i, (doc, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        alone = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        pairs = [xxhash.xxh64_intdigest(y.encode(), h) for h, y in zip(alone, w[1:])] + alone[-1:]
        bags[i] = alone + pairs
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for i, (doc, _) in enumerate(rows):
        for h in bags[i]:
            raw[signed(h) % BUCKETS] += 1
            target[signed(h) % BUCKETS] += doc in trusted
    ratio = [round(1e6 * (math.log(t / sum(target)) - math.log(r / sum(raw)))) for t, r in zip(target, raw, strict=True)]
    out = []
    for i, (doc, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        llr = sum(ratio[signed(h) % BUCKETS] for h in bags[i]) // (2 * len(w)) if w else None
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= -100_000))
    return sorted(out)


def test_quality_rules_equal_brute_force(spark):
    rows = list(enumerate([*TEXTS, TEXTS[-1], "good text with more than ten words in it, all of them different from others"]))
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(9,), (7,), (7,), (None,)], "doc_id long")
    out = quality_rules(docs, trusted)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == brute_rules(rows, {7, 9})


def test_the_order_of_words_counts(spark):
    rng = np.random.default_rng(5)
    clean = [f"the {a} house stands on the {b} hill and looks over the {a} river" for a in ("old", "red", "tall") for b in ("green", "steep", "wide")]
    mixed = [" ".join(rng.permutation(t.split())) for t in clean]
    docs = spark.createDataFrame(list(enumerate(clean * 5 + mixed)), "doc_id long, text string")
    out = quality_rules(docs, docs.where("doc_id < 30").select("doc_id"))
    llr = {r.doc_id: r.llr for r in out.collect()}
    assert all(llr[i] > llr[45 + i] for i in range(9))


CLASHES = "_f f row _row _gone gone _lines lines _own own id _id _t t _copy copy _of of _share share _each tie rows n".split()


@pytest.mark.parametrize("operator", ["dedup_lines", "quality_rules", "mixed_documents"])
def test_columns_of_any_name_come_back_as_they_were(spark, operator):
    from siftrow.llm.mixing import mixed_documents

    rows = [(i, f"a common line of words here\nown words of document number {i} so that it is long enough", "s", *([f"{i}"] * len(CLASHES))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    out = {
        "dedup_lines": lambda: dedup_lines(docs),
        "quality_rules": lambda: quality_rules(docs, docs.select("doc_id")),
        "mixed_documents": lambda: mixed_documents(docs),
    }[operator]()
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert {r.doc_id for r in got} == set(range(4))
    assert all(r[c] == str(r.doc_id) for r in got for c in CLASHES)


def test_word_spans_and_hashes():
    texts = ["ab cd", "", None, "ab", "cdab\n ab", "é ab"]
    for data, offsets, _ in slices(pa.array(texts, pa.string())):
        starts, ends, bounds = word_spans(data, offsets)
        found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
        assert found == ["ab", "cd", "ab", "cdab", "ab", "é", "ab"]
        assert bounds.tolist() == [0, 2, 2, 2, 3, 5, 7]
        h = span_hashes(prefix_hashes(data), starts, ends)
        assert len({h[0], h[2], h[4], h[6]}) == 1 and len(set(h.tolist())) == 4


def test_classifier_is_learned_without_held_out_rows(spark):
    good = "the quiet river runs past old stone houses and green fields number "
    rows = [(i, good + str(i) if i % 2 else f"WIN!! CASH!! NOW!! CLICK!! {i}") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x"), (902, "word " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i, _ in rows], (None, 1), (900, None), (901, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == 204
    for i, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == i % 2
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score
    # The labels of held-out rows make no difference.
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    w, b = fit_quality(docs, labels)
    w2, b2 = fit_quality(docs, turned)
    assert b == b2 and np.array_equal(w, w2)
    clash = score_quality(docs.withColumn("score", docs.text), w, b)
    assert dict(clash.dtypes)["score"] == "double"


def plain_kneser_ney(texts, order, alphabet):
    """p(gram) of one language by the textbook recursion; texts are lists of symbols, padded in front."""
    grams = Counter(tuple(t[i : i + order]) for t in texts for i in range(len(t) - order + 1))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(gram):
        if not gram:
            return 1 / alphabet
        counts = levels[len(gram)]
        ones, twos = (sum(n == x for n in counts.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        after = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(counts[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p


def coded(gram):
    code = 0
    for c in gram:
        code = code << 16 | c
    return code


def test_kneser_ney_is_the_plain_recursion_with_unseen_grams_and_sums_to_one():
    rng = np.random.default_rng(1)
    order, symbols, unseen = 3, range(2, 9), 99
    # The second language lacks two symbols and most contexts.
    texts = {"a": [rng.integers(2, 9, 150).tolist()], "b": [(rng.integers(1, 4, 60) * 2).tolist()]}
    rows = []
    for lang, held in texts.items():
        counts = Counter(tuple(t[i : i + order]) for t in held for i in range(len(t) - order + 1))
        codes = sorted(counts, key=coded)
        rows.append((lang, np.array([coded(g) for g in codes], np.uint64), np.array([counts[g] for g in codes])))
    model = fit_model(rows, order)
    seen = {c for _, codes, _ in rows for c in (codes & np.uint64(0xFFFF)).tolist()}
    plain = {lang: plain_kneser_ney(held, order, len(seen) + 1) for lang, held in texts.items()}
    contexts = [(a, b) for a in [*symbols, unseen] for b in [*symbols, unseen]]
    missing = 0
    for context in contexts:
        grams = [(*context, c) for c in [*sorted(seen), unseen]]
        got = np.exp2(model.lookup(np.array([coded(g) for g in grams], np.uint64)).astype(float))
        want = np.array([[plain[lang](g) for lang in model.langs] for g in grams])
        np.testing.assert_allclose(got, want, rtol=1e-4)
        np.testing.assert_allclose(got.sum(0), 1, rtol=1e-4)
        missing += sum(coded(g) not in model.codes[-1] for g in grams)
    assert missing > 100


def test_languages(spark):
    samples = {"xx": "kala kuku tolo mipa kolo tapi lomu", "yy": "strzk brzgw krtch plskt drzwm grbst"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(samples[k].split())), k) for i in range(60) for k in [["xx", "yy"][i % 2]]]
    extra = [(100, None, "xx"), (101, "", None), (102, "12 34 !!", "yy"), (103, "kala tolo mipa", None), (104, "漢字仮名交文漢字仮名" * 20, None), (None, "krtch plskt", "yy")]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert all(got[i].lang_pred == k and got[i].accepted for i, _, k in rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and not got[102].accepted
    assert got[103].lang_pred == "xx" and got[None].lang_pred == "yy" and not got[104].accepted
    assert all(0 <= r.score <= 1 for r in got.values())


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="#">{n}</a></nav><div class="ad">buy {n}</div><article><h1>H &amp; {n}</h1><p>One <b>{n}<br><p>two&nbsp;\n x</article><div class="comments"><p>me too {n}</p></div><form><p>in</p></form><footer>f</footer>'


def test_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(4)]
    rows += [(10, "http://solo.example/", "<body><p>alone</p><footer>x</footer></body>"), (11, None, None), (12, "bad", ""), (13, "http://h.example/0", PAGE.format(n=0))]
    rows += [(20 + i, "http://plain.example/", f'<div><div class="top">Same head</div><div><p>story {i}</p></div></div>') for i in range(3)]
    # Neighbours alike are one slot: where nothing tells them apart, a constant one among varying ones is kept.
    rows += [(30 + i, "http://alike.example/", f"<div><div>Same head</div><div><p>story {i}</p></div></div>") for i in range(3)]
    got = {r.page_id: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in (0, 1, 2, 3):
        assert got[i].text == f"H & {i}\nOne {i}\ntwo x"
    assert got[13].text == got[0].text and got[10].text == "alone" and got[11].text == got[12].text == ""
    assert [got[20 + i].text for i in range(3)] == [f"story {i}" for i in range(3)]
    assert [got[30 + i].text for i in range(3)] == [f"Same head\nstory {i}" for i in range(3)]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_tree_matching_maps_the_most_nodes():
    a = [["p", 1, None, []], ["div", 1, None, [["p", 1, None, []]]], ["ul", 1, None, []]]
    b = [["div", 1, None, [["p", 1, None, []]]], ["p", 1, None, []]]
    assert matching(a, b) == (2, [(1, 0)])
    merged = merge(tree_of(parse("<p>a</p><div>x</div>")), tree_of(parse("<p>a</p><ul><li>y</ul><div>z</div>")))
    assert [(n[0], n[1], n[2] is not None) for n in merged[3]] == [("p", 2, True), ("ul", 1, True), ("div", 2, False)]


def test_character_references_and_white_space():
    assert content_blocks(parse("<p>a&lt;b &#233;&#x1F600;  c\n\td</p>"), None) == [html.unescape("a&lt;b &#233;&#x1F600; c d")]


def test_fingerprints(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))
    long = [text(300) for _ in range(6)]
    rows = [(i * 3, t) for i, t in enumerate(long)] + [(100, long[0]), (101, None), (102, ""), (103, "ab"), (104, "a" * 5000), (104, "a" * 5000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = rarity(docs)
    got = compare_with_next(docs, ranks, rows_per_range=2)
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for (doc, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        want.append((doc, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r[:3] for r in found), key=repr) == sorted(want, key=repr)
    prints = {r.doc_id: r.fingerprint for r in fingerprint_documents(docs, ranks).collect()}
    assert prints[0] == prints[100] and prints[101] == prints[102] == "" and prints[3] != prints[0]
    assert all(prints[r[0]] == r[3] for r in found)
    near = {r.doc_id: r for r in got.collect()}
    assert all(near[d].near_edited > 0.25 > near[d].near_next for d in (0, 3, 6, 9, 12))
    assert likeness(bytes.fromhex(prints[0]), bytes.fromhex(prints[0])) == 1.0


def test_equal_pairs_counts_every_window():
    data = np.random.default_rng(0).integers(97, 101, 200).astype(np.uint8)
    want = [sum(n * (n - 1) // 2 for n in Counter(data[i : i + 24].tolist()).values()) for i in range(len(data) - 23)]
    assert equal_pairs(data).tolist() == want
