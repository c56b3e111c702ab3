"""Fits, validation, replies, guards and streams against plain versions on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetric.functions.unicode import all_composed, composed
from lumetric.kernels import cat, em
from lumetric.operators import dif, panels, power, replies
from lumetric.plans import fitting
from lumetric.sources import records, scratch
from lumetric.streaming import early_stop


def panel(models=40, items=12, holes=0.2, seed=3):
    rng = np.random.default_rng(seed)
    theta, a, b = rng.normal(size=models), np.exp(rng.normal(0, 0.3, items)), rng.normal(size=items)
    y = (rng.random((models, items)) < 1 / (1 + np.exp(-a * (theta[:, None] - b)))).astype(float)
    y[rng.random(y.shape) < holes] = np.nan
    return theta, a, b, y


def long(spark, y):
    return spark.createDataFrame([(int(m), int(i), int(y[m, i])) for m, i in np.argwhere(~np.isnan(y))], "model_id long, item_id long, correct int")


@pytest.mark.parametrize("guessing", [False, True])
def test_the_block_fit_is_the_dense_fit(spark, guessing):
    *_, y = panel()
    guess = np.arange(y.shape[1]) % 2 == 0 if guessing else np.zeros(y.shape[1], bool)
    items = spark.createDataFrame([(int(i),) for i in np.flatnonzero(guess)], "item_id long")
    got = fitting.fit(long(spark, y), items if guessing else None, parts=3)
    want = em.fit_matrix(np.nan_to_num(y), ~np.isnan(y), guess)
    p = got.params.orderBy("item_id").toPandas()
    assert got.converged == want.converged and got.iterations == want.iterations and p["converged"].all()
    assert np.allclose(p["a"], want.a, atol=1e-6) and np.allclose(p["b"], em.difficulty(want.a, want.d), atol=1e-5) and np.allclose(p["c"], want.c, atol=1e-6)
    with pytest.raises(ValueError, match="bound"):
        fitting.checked(fitting.MOST_SHARED_BYTES + 1, "it")


def test_leave_one_out_has_all_methods(spark):
    *_, y = panel(models=12, holes=0)
    rows = fitting.leave_one_out(long(spark, y), {i: f"b{i % 3}" for i in range(12)}, (3, 6, 30), rounds=5).collect()
    seen = {(r["method"], r["n"]) for r in rows}
    assert seen == {(m, n) for m in ("adaptive", "random", "random_raw", "stratified") for n in (3, 6, 30)}
    assert len(rows) == 12 * 12
    by = {(r["model_id"], r["method"], r["n"]): r["estimate"] for r in rows}
    assert all(np.isclose(by[m, "random_raw", 30], y[m].mean()) for m in range(12))  # more than there are: all


def test_validation_scores_and_bills_the_common_frame(spark):
    theta, a, b, y = panel(models=10, items=10, holes=0)
    y[0, 3] = np.nan  # not in the frame
    cells = long(spark, y).withColumn("cost_usd", F.when(F.col("item_id") != 5, (F.col("item_id") + 1.0)))
    bank = spark.createDataFrame([(i, f"b{i % 2}", float(a[i]), float(b[i]), 0.0) for i in range(10)], "item_id long, benchmark string, a double, b double, c double")
    rows = fitting.validate(cells, bank, (2, 4, 50)).collect()
    frame = [i for i in range(10) if i != 3]
    for r in rows:
        own = y[r["model_id"], frame]
        assert np.isclose(r["truth"], own.mean()) and r["n"] in (2, 4, 9)
        if r["method"] == "all":
            want = cat.scored(own, np.arange(9), a[frame], b[frame], np.zeros(9))
            assert np.isclose(r["estimate"], want[0]) and np.isclose(r["se"], want[1]) and r["usd"] == sum(i + 1 for i in frame if i != 5)
    assert len([r for r in rows if r["model_id"] == 4]) == 1 + 2 * 4


def test_stratified_draw():
    rng = np.random.default_rng(1)
    got = cat.stratified(np.arange(40), 10, np.arange(40) % 2, np.array([0.5, 0.5]), np.arange(40.0), rng)
    assert len(got) == 8 and len(set(got)) == 8 and np.bincount(got % 2).tolist() == [4, 4]
    assert cat.stratified(np.arange(3), 10, np.zeros(3, int), np.ones(1), np.zeros(3), rng).tolist() == [0, 1, 2]
    assert cat.scored(np.ones(3), np.empty(0, int), np.ones(3), np.zeros(3), np.zeros(3))[0] == pytest.approx(0)


def test_power_api(spark):
    params = spark.createDataFrame([(i, 1.0, 0.0, 0.0) for i in range(400)], "item_id long, a double, b double, c double")
    r = power.Resolution.of(params)
    n, capped = r.items_needed(10)
    assert not capped and r.power_at(n, 10) >= 0.8 > r.power_at(n - 1, 10) and r.detectable_effect(n) == pytest.approx(10, rel=0.01)
    assert r.items_needed(1) == (400, True) and r.items_needed(10, paired=False)[0] < n and r.items_needed(10, max_items=5) == (5, True)
    for bad in ((0, 0.8), (-1, 0.8), (3, 0.0), (3, 1.0)):
        with pytest.raises(ValueError):
            r.items_needed(*bad)
    with pytest.raises(ValueError, match="rise"):
        power.Resolution([1.0], 0.0).items_needed(3)


CHOICES = [("Answer: B", "B"), ("The final answer is (c).", "C"), ("d", "D"), ("a", "A"), ("I think a cat", None), ("Answer: E", None), ("B and C", None), ("**A**", "A"), ("", None), (None, None), ("surely B, yes", "B"), ("Answer: Ｂ", "B"), ("Answer: No", "B"), ("there is no link", None), ("Answer: none of these; C then", "C"), ("answer: A. No wait, answer: D", "D")]


def test_choices(spark):
    options = ["Yes", "No", "Maybe", "Both"]
    rows = spark.createDataFrame([(k, r, options) for k, (r, _) in enumerate(CHOICES)], "k int, reply string, options array<string>")
    got = {r["k"]: r["choice"] for r in replies.with_choice(rows, "reply", 4, "options").collect()}
    assert [got[k] for k in range(len(CHOICES))] == [w for _, w in CHOICES]
    two = spark.createDataFrame([("Maybe, so A",), ("Both",)], "reply string").withColumn("options", F.array(*map(F.lit, options)))
    assert [r["choice"] for r in replies.with_choice(two, "reply", 2, "options").collect()] == ["A", None]  # named but not offered: on to the letters
    with pytest.raises(Exception, match="1 to 10"):
        replies.with_choice(two, "reply", 11).collect()


def test_composition(spark):
    d = spark.createDataFrame([("é", ["é", None, "a"]), ("plain", []), (None, None)], "t string, l array<string>")
    assert [tuple(r) for r in d.select(composed(F.col("t")), all_composed(F.col("l"))).collect()] == [("é", ["é", None, "a"]), ("plain", []), (None, None)]


def test_failed_calls(spark):
    rows = [("returned 429", None, True), ("returned 400", None, False), ("returned 429", False, False), ("refused", True, True), ("returned ReadError", False, True), (None, True, False), ("Read_Error", None, True)]
    d = spark.createDataFrame([(*r[:2], str(k)) for k, r in enumerate(rows)], "error string, retryable boolean, request_sha256 string")
    assert [r[0] for r in d.select(replies.worth_repeating()).collect()] == [r[2] for r in rows]
    assert {r[0] for r in replies.done(d).collect()} == {str(k) for k, r in enumerate(rows) if not r[2]}


def test_guards(spark):
    path = scratch.shared_path(spark, "guards")
    items = spark.createDataFrame([(1, "b"), (2, "b")], "item_id long, benchmark string")
    params = spark.createDataFrame([(1, 1.0), (2, 1.0)], "item_id long, a double")
    able = spark.createDataFrame([(1, 0.0)], "model_id long, theta double")
    for v in ("v1", "v2"):
        records.save_bank(spark, path, v, params, items, able)
    assert records.versions(spark, path) == ["v1", "v2"] and records.versions(spark, path + "/none") == []
    records.save_fit(spark, path, "v1", "2pl", params, able)
    assert records.load_fit(spark, path, "v1", "2pl", items)["params"].count() == 2
    with pytest.raises(ValueError, match="same items"):
        records.load_fit(spark, path, "v1", "2pl", items.limit(1))
    records.save_bank(spark, path, "v1", params, items.withColumn("benchmark", F.lit("c")), able)
    with pytest.raises(ValueError, match="other items"):
        records.load_fit(spark, path, "v1", "2pl", items)


def test_contrasts_need_both_sides(spark):
    models = spark.createDataFrame([(k, "open" if k % 2 else "closed", "merge" if k == 0 else "base", "1995-01-01" if k < 30 else "") for k in range(40)], "model_id long, access string, family string, release_date string")
    found = dif.contrasts(models, spark.createDataFrame([("x", "1994-01"), ("y", "")], "benchmark string, month string"))
    kept, skipped = dif.enough(found, models.select("model_id"))
    assert {r[0] for r in kept.select("split").distinct().collect()} == {"open_vs_api"}
    assert {tuple(r) for r in skipped.collect()} == {("merge_vs_trained", 39, 1), ("contamination_x", 0, 30)}


def test_stacked_panels_fill_benchmarks(spark):
    one = spark.createDataFrame([("m", 1, "b", 1)], "alias string, item_id long, benchmark string, correct int")
    two = spark.createDataFrame([("d", 1, None, 0), ("d", 2, None, 1)], "alias string, item_id long, benchmark string, correct int")
    assert {(r["alias"], r["item_id"], r["benchmark"]) for r in panels.stacked(one, two).collect()} == {("m", 1, "b"), ("d", 1, "b"), ("d", 2, None)}


def test_early_stops_are_those_of_a_plain_walk(spark):
    theta, a, b, y = panel(models=8, items=30, holes=0)
    params = spark.createDataFrame([(i, float(a[i]), float(b[i]), 0.0) for i in range(30)], "item_id long, a double, b double, c double")
    path = scratch.shared_path(spark, "stops")
    cells = [(p, i, int(y[p, i]), int(y[p + 4, i])) for p in range(4) for i in range(30)]
    for k in range(3):  # three files, three micro-batches, items in order
        spark.createDataFrame([c for c in cells if c[1] // 10 == k], "pair long, item_id long, correct_a int, correct_b int").coalesce(1).write.mode("append").json(f"{path}/in")
    x, lw = em.quadrature()
    got = {r["pair"]: r for r in early_stop.decisions(spark, f"{path}/in", params, f"{path}/out", f"{path}/check", files=1).collect()}
    for p in range(4):
        logs, n, apart = [lw.copy(), lw.copy()], 0, False
        while n < 30 and not apart:
            q = np.clip(1 / (1 + np.exp(-a[n] * (x - b[n]))), em.EPS, 1 - em.EPS)
            logs = [l + np.log(q if y[m, n] else 1 - q) for l, m in zip(logs, (p, p + 4), strict=True)]
            n += 1
            (l1, h1), (l2, h2) = (early_stop.interval(np.exp(l - l.max()) / np.exp(l - l.max()).sum(), x) for l in logs)
            apart = l1 > h2 or l2 > h1
        assert (got[p]["separated"], got[p]["items"]) == (apart, n)
