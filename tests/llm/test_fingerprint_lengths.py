"""Likeness of texts on both sides of the length from which windows decide, and of uniform texts."""

import numpy as np
import pyarrow as pa
import pytest

from siftrow.llm.fingerprints import edited, fingerprints, likeness, rarity


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    return [" ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(600)) for _ in range(12)]


@pytest.fixture(scope="module")
def like(spark, texts):
    ranks = rarity(spark.createDataFrame([(t,) for t in texts], "text string"))
    return lambda a, b: likeness(*fingerprints(pa.array([a, b], pa.large_string()), ranks))


def test_near_copies_across_the_border(like, texts):
    for t, other in zip(texts, texts[1:], strict=False):
        assert like(t[:505], t[:520]) > 0.8
        assert like(t[:511], t[:512]) > 0.8
        assert like(t[:505], other[:520]) < 0.1


def test_edits_across_the_border(like, texts):
    for t, other in zip(texts, texts[1:], strict=False):
        for size, after in ((600, 180), (1000, 3), (1022, 0)):
            new = edited(t[:size], other[:after])
            assert len(new) < 512 <= size and like(t[:size], new) > 0.3
        wide = edited(t[:510], "\U0001f600" * 600)
        assert len(wide.encode()) == 1275 and like(t[:510], wide) > 0.1
        assert like(wide, edited(wide, "")) > 0.1


def test_brief_texts_share_windows_with_long_ones(like, texts):
    assert sum(like(t[:500], t[:2800]) > 0.05 for t in texts) >= 10


def test_uniform_texts_with_and_without_windows(like, texts):
    assert like("a" * 5000, "a" * 5000 + texts[0][:60]) > 0
    assert like("a" * 5000 + texts[0][:100], "a" * 5000 + texts[0][:110]) > 0.8
