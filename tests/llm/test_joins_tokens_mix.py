"""The similarity join, token files, packing, mixing and the pipeline on small and odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftrow.llm import jaccard, mixing
from siftrow.llm.common import work_folder
from siftrow.llm.components import connected_components
from siftrow.llm.jaccard import jaccard_components, keep_one_of_each
from siftrow.llm.mixing import mix_sources, mixed_documents, schedule, taken_words, targets
from siftrow.llm.packing import pack, pack_documents
from siftrow.llm.queries.token_files import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary
from siftrow.llm.tokens import Encoder, read_tokens, token_digests, write_tokens


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def near_copies(seed):
    """Texts around a few originals, with one passage that most of them share, and odd ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([8, 30, 60]))]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append(" ".join(text + (passage if rng.random() < 0.6 else [])))
    rows += [rows[3].upper(), rows[5], None, "", " \n\t", "one two", "One  Two", "one two three four five", " ".join(passage)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, rows[0]), (4, rows[4]), (None, "nothing like it at all here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == brute_components(rows)


def test_a_crowd_of_near_copies_costs_about_one_comparison_each(spark, monkeypatch):
    """Each lacks other words of one text; many are linked with nothing, none is compared with the whole crowd."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(260):
        words = list(base)
        for k in range(rng.choice([0, 1, 2, 3, 4, 5, 7])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 2])] = [f"own{i}x{k}"]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:12] + [f"u{i}y{k}" for k in range(60)])) for i in range(60)]
    compared = []
    verify = jaccard.verify

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(jaccard, "verify", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=repr)
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) > 20 and sum(compared) < 3 * len(rows)


def test_a_passage_of_many_unlike_texts_is_met_once_and_compares_none(spark, monkeypatch):
    """The passage is in no list of frequent tokens. Links between its texts are found all the same."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(40)] + passage + [f"z{i}x{k}" for k in range(rng.randint(40, 60))])) for i in range(30)]
    rows += [(100 + i, rows[i][1].replace(f"z{i}x3 ", "other ")) for i in range(5)]
    compared, joined = [], []
    verify, together = jaccard.verify, jaccard.together

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    def holding(pairs, values, columns, *rest):
        if columns == ["held", "weights"]:
            joined.append((pairs.count(), {r.cls: len(r.held) // 8 for r in values.collect()}))
        return together(pairs, values, columns, *rest)

    monkeypatch.setattr(jaccard, "frequent_tokens", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(jaccard, "verify", counting)
    monkeypatch.setattr(jaccard, "together", holding)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)
    assert sum(compared) < 2 * len(rows)
    # Of the passage's tokens few are left, as most are held by the same texts.
    assert joined and max(joined[0][1].values()) < 12


def test_filters_of_further_orders_keep_every_linked_pair():
    from siftrow.llm.bytes import slices
    from siftrow.llm.jaccard import further_prefixes, share_prefixes, shingles

    rng = random.Random(5)
    texts = [t for _, t in near_copies(3)] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 30))) for _ in range(40)]
    (data, offsets, _), = slices(pa.array(texts))
    token, bounds = shingles(data, offsets)
    columns = further_prefixes(token, bounds, 75)
    held = [[c[i].as_buffer() for c in columns] for i in range(len(texts))]
    sets = [set(token[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    passed = dropped = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = both and 100 * both >= 75 * len(sets[i] | sets[j])
            together = share_prefixes(held[i], held[j]) == 1
            assert together or not linked
            passed, dropped = passed + together, dropped + (not together)
    assert passed and dropped > passed


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "x"), (1, text + " end", "y"), (2, "other words " + text[:60], None), (5, None, "z"), (6, "", "z")]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 5, 6] and got.columns == ["doc_id", "text", "n"]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), work_folder(spark, "test"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in root}
    assert got.count() == len(root)


TEXTS = ["It's  a test. It's", " two  spaces ", "line\nbreak\tand\r\nmore", "é à ü ñ 漢字 😀", "<|endoftext|> inside <|startoftext|> x", "", None, "a b  c", "'s 't 123 4567 #$%", "x" * 3000, "\x1c \x85y", "A B C " * 700, "é ́x"]


@pytest.mark.parametrize("name", [WORD_VOCABULARY, BYTE_VOCABULARY])
def test_encoding_by_words_equals_encoding_whole_texts(name):
    encoder, rng = Encoder(vocabulary(name)), random.Random(7)
    signs = [*"aBé. \n\t'*1", "'s", "\u0301", "\xa0", "\u2003", "\x1d", "漢", " foo", "bar,", "<|endoftext|>", "<|"]
    texts = [t or "" for t in TEXTS] * 2 + ["".join(rng.choices(signs[: rng.choice([9, 13, 22])], k=rng.randint(1, 12))) for _ in range(4000)]
    got = [ids[a:b].tolist() for _, ids, edges in encoder.encode(pa.array(texts)) for a, b in zip(edges[:-1], edges[1:])]
    assert got == [x.tolist() for x in encoder.whole(texts)]
    ended = [ids[a:b].tolist() for _, ids, edges in encoder.encode(pa.array([None, *texts]), 3) for a, b in zip(edges[:-1], edges[1:])]
    assert ended == [[3], *[[*x, 3] for x in got]]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i * 7 % 13, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (50, "same"), (50, "same")]
    folder = work_folder(spark, "test")
    shards = write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, vocabulary(WORD_VOCABULARY), 1, rows_per_shard=3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    tokenizer = Tokenizer.from_file(vocabulary(WORD_VOCABULARY))
    want, start = [], 0
    for doc, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc, start, len(ids), ids))
        start += len(ids)
    got = sorted((tuple(r) for r in read_tokens(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    digests = {r.start: r.ids_crc32 for r in token_digests(spark, folder, shards).collect()}
    assert digests == {s: zlib.crc32(np.array(ids, "<u4").tobytes()) for _, s, _, ids in want}
    empty = work_folder(spark, "test")
    assert write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, vocabulary(WORD_VOCABULARY), 1).count() == 0
    assert token_digests(spark, empty).count() == 0


def check_packing(rows, length):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append((r.offset, r.size))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


@pytest.mark.parametrize("seed,kind", [(1, "any"), (2, "small"), (3, "thirds"), (4, "equal"), (5, "one")])
def test_packing_is_valid_and_tight(spark, seed, kind):
    rng = random.Random(seed)
    sizes = {"any": [rng.randint(1, 100) for _ in range(300)], "small": [rng.randint(1, 5) for _ in range(400)], "thirds": [34] * 50 + [33] * 50, "equal": [51] * 40, "one": [100]}[kind]
    rows = pack(spark.createDataFrame(list(enumerate(sizes)), "uid long, size long"), length=100).collect()
    assert Counter(r.size for r in rows) == Counter(sizes) and len({r.uid for r in rows}) == len(sizes)
    used = check_packing(rows, 100)
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(100 - s)
    assert used <= len(gaps) * 1.05 + 1


def test_documents_are_cut_from_the_front_and_packed(spark):
    rows = [(1, "word " * 50), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "b c d")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary(BYTE_VOCABULARY), 2, length=16)
    rows = got.collect()
    check_packing(rows, 16)
    one = sorted((r.piece, r.start, r.size) for r in rows if r.doc_id == 1)
    total = sum(s for *_, s in one)
    assert [s for *_, s in one] == [total % 16 or 16] + [16] * (len(one) - 1)
    assert sorted(r.size for r in rows if r.doc_id in (2, 3)) == [1, 1] and sum(r.doc_id == 4 for r in rows) == 2
    assert got.columns == ["doc_id", "piece", "start", "size", "ids_crc32", "bin", "offset"]
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary(BYTE_VOCABULARY), 2).count() == 0


def mix_rows():
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "c", "é", None])) for i in range(120)]
    return [*rows, (200, None, "tiny"), (201, "one two", "tiny"), (7, rows[7][1], rows[7][2]), (None, "x y z", "a"), (202, "", "void")]


def test_mix_meets_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = mix_sources(docs, block=8)
    got = taken_words(spans).collect()
    sizes = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").split())) for r in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sizes
    assert all(r.taken <= 3 * r.size for r in got)
    # Filled up by hand.
    total = Counter()
    for _, text, source in rows:
        total[source] += len((text or "").split())
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, goal = set(), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        open_ = [s for s in names if s not in full]
        goal = {s: 3 * total[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = [s for s in open_ if goal[s] > 3 * total[s]]
        if not over:
            break
        full |= set(over)
    for s in names:
        mine = [r for r in spans.collect() if r.source == s]
        assert abs(sum(r.n_words for r in mine if r.slot is not None) - goal[s]) <= 4 * 8 and sum(r.n_words for r in mine if r.slot is None) == 0
        assert all(abs(r.target - goal[s]) < 1e-6 for r in mine)
    # A block of a source is one slot's, and slots of a source take its blocks in order, from the first on.
    slots = sorted({(r.source or "~", r.slot, r.block) for r in spans.collect() if r.slot is not None})
    assert all(b[2] == (a[2] + 1 if a[0] == b[0] else 0) for a, b in zip(slots, slots[1:], strict=False))
    # Small blocks come as near as a few words.
    fine = Counter()
    for r in mix_sources(docs).collect():
        fine[r.source] += r.n_words
    assert all(abs(fine[s] - goal[s]) <= 4 for s in names)
    assert sorted(map(tuple, taken_words(mix_sources(docs, block=8)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert taken_words(mix_sources(docs.where("false"))).count() == 0


def test_the_mix_is_what_the_schedule_reaches(spark, monkeypatch):
    """Fewer slots, fewer words: an empty schedule leaves an empty mix."""
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    whole = {(r.doc_id, r.size, r.taken) for r in taken_words(mix_sources(docs, block=8)).collect()}
    plain = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda goals, block: plain(goals, block).where("slot < 40"))
    spans = mix_sources(docs, block=8)
    some = taken_words(spans).collect()
    assert sum(r.taken for r in some) <= 40 * 8 and {(r.doc_id, r.size, r.taken) for r in some} != whole
    assert {r.slot for r in spans.collect() if r.slot is not None} == set(range(40))
    monkeypatch.setattr(mixing, "schedule", lambda goals, block: plain(goals, block).where("false"))
    none = taken_words(mix_sources(docs, block=8)).collect()
    assert len(none) == len(mix_rows()) and sum(r.taken for r in none) == 0 and all(r.first_slot is None for r in none)
    assert mixed_documents(docs, block=8).count() == 0


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([(1, 6000), (2, 3000), (3, 1000), (4, 0)], "source_no int, quota long")
    rows = schedule(goals, block=10).orderBy("slot").collect()
    for n in (50, 200, 1000):
        seen = Counter(r.source_no for r in rows[:n])
        assert all(abs(seen[s] - share * n) <= 4 for s, share in ((1, 0.6), (2, 0.3), (3, 0.1)))
    assert len(rows) == 1000 and {r.source_no: max(x.k for x in rows if x.source_no == r.source_no) + 1 for r in rows} == dict(Counter(r.source_no for r in rows))


def test_mixed_documents_repeat_as_taken(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = mixed_documents(docs, block=8)
    texts = {(r[0], r[1]) for r in rows}
    taken = Counter()
    for r in got.collect():
        assert (r.doc_id, r.text) in texts and r.n_chars == len(r.text)
        taken[r.doc_id, r.text] += 1
    # Whole documents: as often as the mix holds at least half of one.
    want = Counter()
    for r in taken_words(mix_sources(docs, block=8)).collect():
        passes = (r.taken + r.size // 2) // r.size if r.size else 0
        want[r.doc_id, r.size] += passes
    sized = Counter()
    for (doc, text), n in taken.items():
        sized[doc, len(text.split())] += n
    assert +sized == +want and got.columns == docs.columns


def test_pipeline_stages_do_what_their_operators_do(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["kala", "kuku", "tolo", "mipa", "kolo", "tapi", "lomu", "sano"]
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice("aeiou") for _ in range(rng.randint(5, 80))), "xx", f"s{i % 3}", 0) for i in range(60)]
    rows += [(60, rows[0][1], "xx", "s0", 0), (61, rows[1][1] + " tail", "xx", "s1", 0), (62, None, "xx", "s1", 0), (63, "123", "xx", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
    current, after = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = current
    kept = {r.doc_id for r in after["language_id"].collect()}
    assert kept == set(range(62))
    lines = {r.doc_id: r.text for r in after["line_dedup"].collect()}
    assert lines[60] == "" and lines[61] == rows[61][1] and lines[0] == rows[0][1]
    joined = {r.doc_id for r in after["jaccard_join"].collect()}
    assert joined == {d for d, _, c in brute_components(sorted(lines.items())) if d == c}
    mixed = Counter(r.doc_id for r in after["mixing"].collect())
    expected = taken_words(mix_sources(after["jaccard_join"])).collect()
    assert +mixed == +Counter({r.doc_id: (r.taken + r.size // 2) // r.size if r.size else 0 for r in expected})
    assert {(r.doc_id, r.text) for r in after["mixing"].collect()} <= {(r.doc_id, r.text) for r in after["jaccard_join"].collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, after["packing"].select(*key).collect()))
