"""The pipeline's near-duplicate stage against all pairs of texts."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumetric.llm import near_text, simhash
from lumetric.llm.common import shared_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Places of the rows that stay, by comparing all pairs."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()]


def edited(rng, words, times):
    words = list(words)
    for at in rng.sample(range(len(words)), times):
        words[at] = f"edit{rng.random()}"
    return " ".join(words)


def near_rows():
    rng, texts = random.Random(4), []
    stock = [f"stock{i}" for i in range(12)]
    for _ in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 300))] + stock
        # edits far apart touch five shingles each: about 0.75 to 0.95 of them stay common
        texts += [" ".join(words), *[edited(rng, words, max(1, round(len(words) * share))) for share in (0.005, 0.01, 0.02, 0.025, 0.03)]]
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 40, 8)]  # neighbours are alike, the ends are not
    texts += ["a b", "a b", "A  b", "", " ", None]
    rng.shuffle(texts)
    return [(i, t, "en", "a", 3) for i, t in enumerate(texts)]


def stay(spark, rows):
    docs = shared_table(spark.createDataFrame(rows, SCHEMA).repartition(5), "test", "docs")
    return corpus_pipeline.near_stage(spark, docs, "").toPandas()


def test_near_stage_is_all_pairs(spark):
    rows = near_rows()
    want = sorted(rows[i][0] for i in survivors(rows))
    assert len(want) < len(rows) - 20
    assert sorted(stay(spark, rows)["doc_id"]) == want


@pytest.mark.parametrize("common", [1, 10**9])
def test_the_order_of_shingles_changes_nothing(spark, monkeypatch, common):
    monkeypatch.setattr("lumetric.llm.near_text.OFTEN", common)
    rows = near_rows()
    assert sorted(stay(spark, rows)["doc_id"]) == sorted(rows[i][0] for i in survivors(rows))


def test_signatures_lose_no_pair():
    """Whatever the sizes, a pair that is alike enough stays within reach; one that shares a tenth doesn't."""
    rng = np.random.default_rng(7)
    first, second, sizes, alike = [], [], [], []
    for k in range(400):
        n = int(10 ** rng.uniform(0, 4))
        base = np.unique(rng.integers(-(2**63), 2**63, n))
        share = (0.1, 0.85, 0.889, 0.95, 1.0)[k % 5]
        kept = base[: max(round(share * len(base)), 1)]
        other = np.unique(np.r_[kept, rng.integers(-(2**63), 2**63, len(base) - len(kept))])
        same = len(np.intersect1d(base, other))
        first.append(near_text.signature(base))
        second.append(near_text.signature(other))
        sizes.append((len(base), len(other)))
        alike.append(5 * same >= 4 * (len(base) + len(other) - same))
    reach = near_text.within_reach(first, second, np.array(sizes).T)
    alike = np.array(alike)
    assert reach[alike].all() and alike.sum() > 100
    large = np.array([min(x) > 100 for x in sizes]) & (np.arange(400) % 5 == 0)
    assert not reach[large].any() and large.sum() > 20
    full = np.zeros(3000, np.int64) + 8 * np.arange(3000)  # one bucket in eight: counts beyond a byte
    assert near_text.within_reach([near_text.signature(full)], [near_text.signature(full[:2500])], np.array([[3000], [2500]])).all()


def test_a_hot_group_of_near_copies_leaves_one(spark):
    rng, words = random.Random(5), [f"h{i}" for i in range(200)]
    rows = [(i, edited(rng, words, 2), "en", "a", 3) for i in range(150)]
    assert stay(spark, rows)["doc_id"].tolist() == [0]


def test_the_near_stage_goes_through_the_fingerprints(spark, monkeypatch):
    """The byte-position index joins near copies before any list of shingles; those it can't reach come after."""
    rng, words = random.Random(6), [f"g{i}" for i in range(300)]
    texts = [" ".join(words), *[edited(rng, words, 1) for _ in range(8)]]
    docs = shared_table(spark.createDataFrame([(i, t, "en", "a", 3) for i, t in enumerate(texts)], SCHEMA).withColumn("row_", F.col("doc_id")), "test", "docs")
    asked = []
    index = simhash.link_table

    def kept(distinct, bits, **more):
        out = index(distinct, bits, **more)
        asked.append((bits, {r["fp"] for r in distinct.collect()}, out.collect()))
        return out

    monkeypatch.setattr("lumetric.llm.simhash.link_table", kept)
    assert {r["root"] for r in near_text.near_groups(docs, "test").collect()} == {0}
    ((bits, fps, links),) = asked
    assert bits == 4 and fps == {simhash.signed(simhash.fingerprint(t, 5)) for t in texts} and links


def test_lists_of_three_positions_hold_every_four():
    sets = [set(s) for s in simhash.position_sets(4)]
    assert len(sets) == 20 and all(any(s <= set(four) for s in sets) for four in combinations(range(8), 4))


@pytest.mark.parametrize("block", [4, 1000])
def test_the_index_without_a_bit_bound_joins_what_shares_four_bytes(block):
    rng = np.random.default_rng(3)
    octets = rng.integers(0, 3, (60, 8), dtype=np.uint8)
    octets[:, :3] = 7  # a list of three positions
    fps = np.unique(octets.copy().view(np.uint64).ravel())
    octets = fps.view(np.uint8).reshape(-1, 8)
    links = simhash.run_links(fps, (3, 4, 5, 6, 7), 4, block, 64)
    assert all((octets[a] == octets[b]).sum() >= 4 for a, b in links)
    def roots(pairs):
        up = list(range(len(fps)))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    every = [(i, j) for i, j in combinations(range(len(fps)), 2) if (octets[i] == octets[j]).sum() >= 4]
    assert roots(links) == roots(every) and len(links) < len(fps)


def test_pairs_of_a_hot_group_grow_with_its_size(spark, monkeypatch):
    """Half the copies are alike, the others miss by little and are alike to none: no pair of those is made for each of these."""
    rng, words, asked = random.Random(8), [f"p{i}" for i in range(200)], []
    enough = near_text._near_enough

    def counted(prints, pairs):
        asked.append(pairs.count())
        return enough(prints, pairs)

    monkeypatch.setattr("lumetric.llm.near_text._near_enough", counted)
    rows = [(i, edited(rng, words, (1, 2, 5, 6)[i % 4]), "en", "a", 3) for i in range(240)]
    want = sorted(rows[i][0] for i in survivors(rows))
    assert sorted(stay(spark, rows)["doc_id"]) == want and len(want) > 100
    assert sum(asked) < 20 * len(rows)


def test_positions_lose_no_pair():
    """Of a list, `able`, `crossings` and `partners` give what pairs of different components allow."""
    rng = np.random.default_rng(9)
    for size in [1, 2, 3, 10, 60, 200]:
        n = rng.integers(5, 60, size)
        need = 4 * n
        room = 9 * (n - rng.integers(0, n // 5 + 2)) - need
        row, label = rng.permutation(1000)[:size].astype(np.int64), rng.integers(0, max(size // 4, 1), size)
        want = {(min(row[i], row[j]), max(row[i], row[j])) for i, j in combinations(range(size), 2) if label[i] != label[j] and need[i] <= room[j] and need[j] <= room[i]}
        got = [set(zip(*map(np.concatenate, zip(*found, strict=True)), strict=True)) if (found := list(of(row, need, room, label))) else set() for of in (near_text.crossings, near_text.partners)]
        assert got[0] == want and got[1] <= want and bool(got[1]) == bool(want)
        assert set(row[near_text.able(row, need, room, label)]) == {x for pair in want for x in pair}
        assert sum(len(a) for a, _ in near_text.partners(row, need, room, label)) <= near_text.TRIES * size
