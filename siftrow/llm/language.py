"""Language identification with interpolated Kneser-Ney character models.

For each language the n-grams of characters (four by default) of all its learning texts are counted. Lower orders use
continuation counts (how many different characters come before), each order is discounted and interpolated with the next
lower one, and the lowest with a uniform spread over the characters. The models of all languages share sorted arrays of
n-gram codes with one column of log probabilities per language; a lookup is a binary search, and an n-gram that no
language has seen falls back to the next shorter one with the context's weight. A text's language is the one of least
cross-entropy per character.

Rejection is calibrated on the counts themselves: they give the mean and the variance of the code length per character
that each model spends on its own language. A text is rejected if its best code length lies more than `Z` standard
deviations (which shrink with the text's length) and a `SLACK` above that mean, or if it has no letter.

Counting covers every learning text: tasks send one row per language and different n-gram. The table that comes of it
grows with the variety of character sequences, which a script bounds, not with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrow.llm.bytes import U, slices, worker_memory
from siftrow.llm.classifier import held_out

ORDER = 4
UNKNOWN = "und"
Z, SLACK = 8.0, 2.0
#: The score weighs likelihoods as over so many characters at most, so that long texts do not all score 1.
SURE_AFTER = 16
#: Characters held as such in a code; beyond, they share codes by remainder.
CODE_BITS = 16
EDGE = 1


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts and their offsets: lower case, every run of other than letters one blank."""
    text = data.tobytes().decode("utf-8")
    wide = np.frombuffer(text.encode("utf-32-le"), "<u4")
    lead = (data & 0xC0) != 0x80
    bounds = np.concatenate([[0], np.cumsum(lead)])[offsets]
    known = _folded(wide)
    blank = known == EDGE
    drop = np.zeros(len(wide), bool)
    if len(wide):
        drop[1:] = blank[1:] & blank[:-1]
        inner = bounds[1:-1]
        drop[inner[inner < len(wide)]] = False
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return known[~drop], kept[bounds]


def _fold_table() -> np.ndarray:
    table = np.full(0x110000, EDGE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = max(ord(low) if len(low) == 1 else i, 2) % ((1 << CODE_BITS) - 2) + 2
    return table


def _folded(wide: np.ndarray) -> np.ndarray:
    """Letters in lower case, folded to CODE_BITS; EDGE for everything else."""
    return worker_memory("fold", _fold_table)[wide]


def grams(chars: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each character, and the text it lies in. Texts are padded in front by EDGE."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = np.zeros(len(chars), U)
    place = np.arange(len(chars)) - bounds[:-1][text]
    for back in range(order - 1, -1, -1):
        shifted = np.full(len(chars), EDGE, U)
        if back < len(chars):
            shifted[back:] = chars[: len(chars) - back]
        shifted[place < back] = EDGE
        code = (code << U(CODE_BITS)) | shifted
    return code, text


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, code, n over all texts of docs (text, lang); rows without a language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for data, offsets, first in slices(batch.column("text")):
                code, text = grams(*characters(data, offsets), order)
                names, which = np.unique(langs[first : first + len(offsets) - 1].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    codes, n = np.unique(code[which[text] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())],
                        names=["lang", "code", "n"],
                    )

    rows = docs.where("lang is not null").select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages; per order a sorted array of codes with a matrix of log2 probabilities, and one of contexts with a matrix of
    log2 back-off weights; the calibration."""

    def __init__(
        self,
        langs: list[str],
        codes: list[np.ndarray],
        log_p: list[np.ndarray],
        contexts: list[np.ndarray],
        log_back: list[np.ndarray],
        base: float,
        mean: np.ndarray,
        var: np.ndarray,
    ):
        self.langs, self.codes, self.log_p, self.contexts, self.log_back = langs, codes, log_p, contexts, log_back
        self.base, self.mean, self.var = base, mean, var

    def lookup(self, code: np.ndarray) -> np.ndarray:
        """log2 probabilities (n-grams by languages).

        Of an n-gram that no language has seen, the shorter one's, times the weight that each language gives to what its
        context leaves open; a context that a language has not seen leaves all open.
        """
        order = len(self.codes)
        out = np.zeros((len(code), len(self.langs)), np.float32)
        left = np.arange(len(code))
        for k in range(order, 0, -1):
            wanted = code[left] & (U((1 << (CODE_BITS * k)) - 1) if CODE_BITS * k < 64 else U(0xFFFFFFFFFFFFFFFF))
            at, hit = _find(self.codes[k - 1], wanted)
            out[left[hit]] += self.log_p[k - 1][at[hit]]
            left, wanted = left[~hit], wanted[~hit]
            if not len(left):
                return out
            at, known = _find(self.contexts[k - 1], wanted >> U(CODE_BITS))
            out[left[known]] += self.log_back[k - 1][at[known]]
        out[left] += np.float32(self.base)
        return out

    def cross_entropy(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits per character of each text under each language; 0 for texts without characters."""
        uniq, inverse = np.unique(code, return_inverse=True)
        bits = -self.lookup(uniq)
        size = np.diff(bounds)
        text = np.repeat(np.arange(len(size)), size)
        sums = np.stack([np.bincount(text, bits[:, i][inverse], minlength=len(size)) for i in range(len(self.langs))], 1)
        return sums / np.maximum(size, 1)[:, None]


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the wanted number stands there."""
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, table[at] == wanted if len(table) else np.zeros(len(wanted), bool)


def fit_model(rows: list[tuple[str, np.ndarray, np.ndarray]], order: int = ORDER) -> LanguageModel:
    """rows: (language, codes, counts) of the highest order, each language once."""
    rows = sorted(rows, key=lambda r: r[0])
    shift = U(CODE_BITS)
    per_lang = []
    for _, codes, n in rows:
        sort = np.argsort(codes)
        codes, n = codes[sort], n[sort].astype(float)
        levels = [(codes, n)]
        for k in range(order - 1, 0, -1):
            # Continuation counts: different n-grams one longer that end in this one.
            low, types = np.unique(levels[0][0] & U((1 << (CODE_BITS * k)) - 1), return_counts=True)
            levels.insert(0, (low, types.astype(float)))
        per_lang.append(levels)
    union = [np.unique(np.concatenate([lv[k][0] for lv in per_lang])) for k in range(order)]
    alphabet = len(union[0]) + 1
    log_p = [np.zeros((len(union[k]), len(rows)), np.float32) for k in range(order)]
    contexts = [np.unique(codes >> shift) for codes in union]
    log_back = [np.zeros((len(c), len(rows)), np.float32) for c in contexts]
    mean, var = np.zeros(len(rows)), np.zeros(len(rows))
    for i, levels in enumerate(per_lang):
        lower: np.ndarray | None = None
        for k in range(order):
            codes, n = levels[k]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            context = codes >> shift
            ctx, first = np.unique(context, return_index=True)
            total = np.add.reduceat(n, first)
            types = np.diff(np.append(first, len(codes)))
            wanted = union[k]
            own = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            count = np.where(codes[own] == wanted, np.maximum(n[own] - d, 0), 0)
            at = np.minimum(np.searchsorted(ctx, wanted >> shift), len(ctx) - 1)
            seen = ctx[at] == wanted >> shift
            back = 1 / alphabet if k == 0 else lower[np.searchsorted(union[k - 1], wanted & U((1 << (CODE_BITS * k)) - 1))]
            p = np.where(seen, count / total[at] + d * types[at] / total[at] * back, back)
            log_p[k][:, i] = np.log2(p)
            log_back[k][np.searchsorted(contexts[k], ctx), i] = np.log2(d * types / total)
            lower = p
        codes, n = levels[-1]
        bits = -log_p[-1][np.searchsorted(union[-1], codes), i]
        mean[i] = (n * bits).sum() / n.sum()
        var[i] = (n * (bits - mean[i]) ** 2).sum() / n.sum()
    return LanguageModel([r[0] for r in rows], union, log_p, contexts, log_back, -float(np.log2(alphabet)), mean, var)


def learn_languages(docs: DataFrame, order: int = ORDER) -> LanguageModel | None:
    """The model of all of docs (text, lang) that are not held out by their doc_id. None without a learning text."""
    counts = count_grams(docs.where(~held_out(F.col("doc_id"))), order).toArrow()
    if not counts.num_rows:
        return None
    langs = np.array(counts.column("lang").to_pylist(), object)
    codes = counts.column("code").to_numpy().view(U)
    n = counts.column("n").to_numpy()
    return fit_model([(name, codes[langs == name], n[langs == name]) for name in sorted(set(langs))], order)


def _judge(m: LanguageModel, column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text."""
    lang = np.full(len(column), UNKNOWN, object)
    score, accepted = np.zeros(len(column)), np.zeros(len(column), bool)
    for data, offsets, first in slices(column) if m is not None else ():
        chars, bounds = characters(data, offsets)
        letters = np.concatenate([[0], np.cumsum(chars != EDGE)])
        has = np.diff(letters[bounds]) > 0
        if not has.any():
            continue
        code, _ = grams(chars, bounds, order)
        h = m.cross_entropy(code, bounds)
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        sure = np.minimum(np.diff(bounds), SURE_AFTER)[:, None]
        share = 1 / np.exp2((least[:, None] - h) * sure).sum(1)
        limit = m.mean[best] + SLACK + Z * np.sqrt(m.var[best] / np.maximum(np.diff(bounds), 1))
        rows = slice(first, first + len(h))
        lang[rows] = np.where(has, np.array(m.langs, object)[best], UNKNOWN)
        score[rows] = np.where(has, share, 0.0)
        accepted[rows] = has & (least <= limit)
    return lang, score, accepted


def _shared(docs: DataFrame, model: LanguageModel | None):
    # Arrays and names alone: one row per n-gram of the languages, whatever the length of the texts.
    return docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)


def predict_language(docs: DataFrame, model: LanguageModel | None, order: int = ORDER) -> DataFrame:
    """docs with lang_pred, score (share of the best language
    in the likelihoods of all, over 16 characters at most; 0 to 1) and accepted.

    `und`, score 0 and not accepted: a null text, a text without a letter, or no model. Ties: the first language by code
    point. Rejected texts keep their best language as lang_pred. Repeated rows are judged alike, whole texts are read in
    bounded slices, columns named like the result's are replaced. No documents: no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    schema = docs.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema
    shared = _shared(docs, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(**shared.value) if shared.value else None
        for batch in batches:
            lang, score, accepted = _judge(m, batch.column("text"), order)
            extra = [pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + extra, names=schema.names)

    return docs.select(*kept).mapInArrow(judge, schema)


def identify_languages(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs with held_out, lang_pred, score and accepted, learned from docs' own lang and predicted in one go."""
    model = learn_languages(docs.select("doc_id", "text", "lang"), order)
    return predict_language(docs, model, order).withColumn("held_out", held_out(F.col("doc_id")))


def keep_identified(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs (doc_id, text, lang and others) without the rejected ones; columns as they are.

    A row goes to Python once, whole, and those that stay come back.
    """
    shared = _shared(docs, learn_languages(docs.select("doc_id", "text", "lang"), order))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(**shared.value) if shared.value else None
        for batch in batches:
            yield batch.filter(pa.array(_judge(m, batch.column("text"), order)[2]))

    return docs.mapInArrow(keep, docs.schema)
