"""The pipeline's near-duplicate stage where hot groups are full of texts that miss 0.8 by little."""

import random

import numpy as np
import pytest

from lumetric.llm import near_text
from lumetric.llm.components import components, extended

from .test_near_text import stay, survivors


def copy(rng, words, times):
    """Words replaced from a small stock, taken out or put in: edits that other copies share too."""
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        words[at : at + rng.choice((0, 1, 1, 1, 2))] = rng.choice(([], ["x"], ["y"], ["z"], ["u", "v"]))
    return " ".join(words)


def group(rng, name, length, size, edits):
    words = [f"{name}{i}" for i in range(length)]
    return [copy(rng, words, rng.choice(edits)) for _ in range(size)]


def as_rows(texts):
    return [(i, t, "en", "a", 3) for i, t in enumerate(texts)]


@pytest.mark.parametrize("kin", [(0, 1), (1, 2), (4, 5)])
def test_families_lose_no_pair_and_add_none(spark, monkeypatch, kin):
    """Whatever proposals make a family, of one group, of several or of none with a centre."""
    monkeypatch.setattr("lumetric.llm.near_text.KIN_OVER", kin[0])
    monkeypatch.setattr("lumetric.llm.near_text.KIN_UNDER", kin[1])
    rng = random.Random(11)
    texts = group(rng, "a", 120, 70, (1, 2, 3, 4, 5, 6)) + group(rng, "b", 60, 40, (1, 2, 3)) + group(rng, "c", 250, 30, (5, 8, 9, 10, 12))
    half = [f"a{i}" for i in range(60)] + [f"d{i}" for i in range(60)]  # half of it is of the first group
    texts += [copy(rng, half, rng.choice((1, 3, 5))) for _ in range(30)]
    chain = [f"e{i}" for i in range(260)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 150, 13)]  # neighbours miss by little
    rng.shuffle(texts)
    want = sorted(survivors(as_rows(texts)))
    assert 40 < len(want) < len(texts) - 40
    assert sorted(stay(spark, as_rows(texts))["doc_id"]) == want


def test_pairs_of_a_group_that_misses_by_little_grow_with_its_size(spark, monkeypatch):
    """Near copies of one text, many of them alike to few or none: what is compared at last is no square."""
    rng, last = random.Random(12), []
    crossings = near_text._over_lists

    def counted(lists, of, names):
        out = crossings(lists, of, names)
        if of is near_text.crossings:
            last.append(out.count())
        return out

    monkeypatch.setattr("lumetric.llm.near_text._over_lists", counted)
    words = [f"g{i}" for i in range(150)]
    texts = []
    for k in range(500):
        own = list(words)
        for at in rng.sample(range(150), (1, 2, 3, 5)[k % 4]):
            own[at] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(own))
    want = sorted(survivors(as_rows(texts)))
    assert sorted(stay(spark, as_rows(texts))["doc_id"]) == want and len(want) > 50
    assert sum(last) < 4 * len(texts)


def test_more_links_extend_components(spark):
    rng = np.random.default_rng(13)
    for _ in range(3):
        parts = [[(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2))] for n in (25, 10, 0, 12)]
        tables = [spark.createDataFrame(p, "a long, b long") for p in parts]
        labels, done = components(tables[0], "test"), tables[0]
        for more in tables[1:]:
            done = done.unionByName(more)
            labels = extended(labels, more, "test")
        want = components(done, "test")
        assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.collect()))
    assert extended(labels, tables[2], "test") is labels
