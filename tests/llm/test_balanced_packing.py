"""Cost-balanced packing against a plain greedy and against whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from siftrow.llm.balanced import balance, pack_balanced, piece_cost
from siftrow.llm.queries.token_files import BYTE_VOCABULARY, op11_cost_balanced_packing, vocabulary

SCHEMA = "doc_id long, text string, shard int, ids string, size long, uid string"


def plain_balance(sizes, length, width):
    """The same rule with a scan over all sequences instead of a tree; whole pieces only."""
    sequences = [[0.0, i, length] for i in range(sum(sizes) // length)]
    out = {}
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = min((s for s in sequences if s[2] >= sizes[piece]), default=None)
        if fit:
            out[piece] = (fit[1], length - fit[2])
            fit[0] += piece_cost(sizes[piece], width)
            fit[2] -= sizes[piece]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_balance_is_the_plain_greedy_and_loses_no_token(seed):
    rng = random.Random(seed)
    length, width = 64, 32
    sizes = [rng.choice([rng.randint(1, 63), rng.randint(1, 6)]) for _ in range(rng.choice([0, 1, 3, 40, 300]))]
    parts = balance(sizes, length, width)
    plain = plain_balance(sizes, length, width)
    assert {p: (s, o) for p, at, n, s, o in parts if n == sizes[p] and s < sum(sizes) // length and p in plain} == plain
    per_piece, per_sequence = defaultdict(list), defaultdict(list)
    for piece, at, n, sequence, offset in parts:
        assert n > 0
        per_piece[piece].append((at, n))
        per_sequence[sequence].append((offset, n))
    for spans, total in [(sorted(v), sizes[k]) for k, v in per_piece.items()] + [(sorted(v), None) for v in per_sequence.values()]:
        ends = [a + n for a, n in spans]
        assert [a for a, _ in spans] == [0, *ends[:-1]]
        assert total is None or ends[-1] == total
    assert len(per_piece) == len(sizes)
    filled = [sum(n for _, n in v) for v in per_sequence.values()]
    assert all(x == length or x & (x - 1) == 0 for x in filled) and max(filled, default=0) <= length
    assert sum(x == length for x in filled) == sum(sizes) // length


def test_costs_are_nearer_than_by_room_alone():
    """Against the fullest sequence that has room, for the same pieces in the same order."""
    rng = random.Random(3)
    sizes = [min(2047, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(4000)]
    full = sum(sizes) // 2048
    costs, room, plain = np.zeros(full), [2048] * full, np.zeros(full)
    for _, _, n, sequence, _ in balance(sizes):
        if sequence < full:
            costs[sequence] += piece_cost(n)
    for n in sorted(sizes, reverse=True):
        best = min((r, i) for i, r in enumerate([*room, 4096]) if r >= n)[1]
        if best < full:
            room[best] -= n
            plain[best] += piece_cost(n)
    assert np.std(costs) < 0.95 * np.std(plain) and costs.min() > 1.1 * plain.min()
    # What no long piece dominates is level.
    assert np.median(costs) < 1.05 * costs.min()


def check_rows(rows, docs, length):
    """rows: (doc key, start, size, ids crc, doc tokens, sequence, offset); docs: key to ids."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for key, start, size, crc, total, sequence, offset in rows:
        assert total == len(docs[key]) and crc == zlib.crc32(np.array(docs[key][start : start + size], "<u4").tobytes())
        spans[key].append((start, size))
        sequences[sequence].append((offset, size))
    for key, held in spans.items():
        assert sum(n for _, n in held) == len(docs[key])
        assert [a for a, _ in sorted(held)] == [0, *np.cumsum([n for _, n in sorted(held)])[:-1]]
    assert spans.keys() == docs.keys()
    for held in sequences.values():
        assert [a for a, _ in sorted(held)] == [0, *np.cumsum([n for _, n in sorted(held)])[:-1]]
        total = sum(n for _, n in held)
        assert total == length or (total < length and total & (total - 1) == 0)
    return sequences


def test_odd_documents_repeats_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))
    texts = {1: "a b c", 2: "", 3: None, 4: "word " * 900, 5: "one two", None: "no id", 7: "x" * 5000}
    rows = [(k, t, 1, "ids", 5, "uid") for k, t in texts.items()]
    out = pack_balanced(spark.createDataFrame(rows, SCHEMA).repartition(3), vocabulary(BYTE_VOCABULARY), 1, length=128, shard_tokens=300)
    docs = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    got = [(r.doc_id, r.start, r.size, zlib.crc32(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in out.collect()]
    check_rows(got, docs, 128)
    twice = pack_balanced(spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string"), vocabulary(BYTE_VOCABULARY), 1)
    assert sorted((r.start, r.size) for r in twice.collect()) and sum(r["size"] for r in twice.collect()) == 9
    assert pack_balanced(spark.createDataFrame([], "doc_id long, text string"), vocabulary(BYTE_VOCABULARY), 1).count() == 0


def test_query_packs_every_token_of_whole_texts(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))
    docs = {
        r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for r in spark.read.parquet(f"{folder}/documents.parquet").collect()
    }
    sequences = check_rows([tuple(r) for r in op11_cost_balanced_packing(spark, folder).collect()], docs, 2048)
    # No more sequences than full ones and the powers of two of a shard's rest.
    assert len(sequences) <= sum(map(len, docs.values())) // 2048 + 11
