"""Spark operators against their kernels and definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumetric.functions import irt
from lumetric.kernels import em
from lumetric.operators import bank, dependence, itemfit, power, scoring, text
from lumetric.plans import fitting
from lumetric.plans.queries import QUERIES
from lumetric.sources import fixtures as fx
from lumetric.sources import records


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repeats_and_ties(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (1, 2, 1), (1, 2, 1), (1, 2, 0), (2, 1, 0)], "model_id int, item_id int, correct int")
    assert sorted(tuple(r) for r in bank.collapse_repeats(rows).collect()) == [(1, 2, 1, 3), (2, 1, 0, 1)]
    out = bank.repeat_agreement(rows).first()
    assert (out["repeated_cells"], out["agreement"], out["tied_cells"]) == (2, 0.0, 1)


def test_relational_scoring_is_the_kernel(spark, sf):
    rows, n = fx.responses_dense(spark, sf), fx.DENSE_ITEMS
    got = {r["model_id"]: r for r in scoring.eap(rows, fx.params(spark, n), fx.quadrature(spark)).collect()}
    p = fx.params(spark, n).orderBy("item_id").toPandas()
    x, lw = em.quadrature()
    prob = em.probability(x, p["a"].to_numpy(), -(p["a"] * p["b"]).to_numpy(), p["c"].to_numpy())
    for model, f in rows.toPandas().groupby("model_id"):
        y, at = f["correct"].to_numpy() == 1, f["item_id"].to_numpy()
        post, l = em.posterior(np.log(prob[at[y]]).sum(axis=0)[None], np.log(1 - prob[at[~y]]).sum(axis=0)[None], lw)
        assert abs(got[model]["theta"] - post[0] @ x) < 1e-9 and abs(got[model]["loglik"] - l[0]) < 1e-8


def test_stream_equals_batch(spark, sf):
    batch = {r["model_id"]: r for r in QUERIES["eap_ability"](spark, sf).collect()}
    stream = QUERIES["ability_stream"](spark, sf).collect()
    assert len(stream) == len(batch)
    assert all(abs(r["theta"] - batch[r["model_id"]]["theta"]) < 1e-4 for r in stream)


def test_packed_fit_is_the_dense_fit(spark, sf):
    rows = fx.responses_dense(spark, sf)
    packed = fitting.fit(rows, most=4).params.orderBy("item_id").toPandas()
    _, ids, y = fitting.matrix(rows)
    dense = em.fit_matrix(np.nan_to_num(y), ~np.isnan(y), most=4)
    assert packed["item_id"].tolist() == ids
    assert np.abs(packed["a"].to_numpy() - dense.a).max() < 1e-6


def test_blocks(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.85), (7, 8, 0.95), (3, 7, 0.1)], "i int, j int, q3 double")
    got = sorted((r["block_id"], r["item_id"], r["size"], r["max_value"]) for r in dependence.blocks(pairs).collect())
    assert got == [(1, 1, 3, 0.9), (1, 2, 3, 0.9), (1, 3, 3, 0.9), (7, 7, 2, 0.95), (7, 8, 2, 0.95)]


def test_bank_hash_guard(spark, tmp_path):
    rows = spark.createDataFrame([("m", "i", 1), ("m", "j", 0)], "model_id string, item_id string, correct int")
    assert bank.content_hash(rows) == bank.content_hash(rows.orderBy(F.desc("item_id")).repartition(3))
    assert bank.content_hash(rows) != bank.content_hash(rows.limit(1))
    records.save_bank(spark, str(tmp_path), "v", rows, rows.select("item_id"), rows.select("model_id"))
    assert records.load_bank(spark, str(tmp_path), "v")["responses"].count() == 2
    rows.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/v/responses.parquet")
    with pytest.raises(ValueError, match="responses"):
        records.load_bank(spark, str(tmp_path), "v")


def test_records_skip_a_broken_line(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"alias": "m", "item_id": "i", "correct": 1, "ledger_id": 1}\n{"alias": "m", "item_id": "i", "correct": 0, "ledger_id": 2}\n{"alias": "m", "it')
    rows = records.read_records(spark, str(tmp_path))
    assert rows.count() == 2
    suite = spark.createDataFrame([("i",)], "item_id string")
    assert [tuple(r)[:3] for r in records.panel(rows, suite).collect()] == [("m", "i", 0)]


def test_wilson_and_tests(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in zip(("lo", "hi"), irt.wilson(F.lit(8), F.lit(10)), strict=True)], irt.binomial_two_sided(F.lit(3).cast("bigint"), F.lit(10).cast("bigint")).alias("p")).first()
    assert abs(row["lo"] - 0.4902) < 1e-3 and abs(row["hi"] - 0.9433) < 1e-3 and abs(row["p"] - 0.34375) < 1e-9


def test_decision_ties_and_rotation(spark):
    rows = spark.createDataFrame([('{"answer": {"probabilities": {"A": 0.4, "B": 0.4}}}',), ('{"answer": {"probabilities": {"B": 0.4, "Z": 0.6}}}',), ('{"answer": {"choice": "C"}}',), ("x",), (None,)], "r string")
    assert [r[0] for r in rows.select(text.decision_choice(F.col("r"), 3)).collect()] == [None, "B", "C", None, None]
    assert spark.range(1).select(text.rotate(F.array(*map(F.lit, "abcd")), F.lit(1))).first()[0] == ["d", "a", "b", "c"]


def test_items_needed(spark):
    needed = [power.items_needed(fx.params(spark), e) for e in (10, 5, 3)]
    assert needed == sorted(needed) and needed[-1] <= fx.ITEMS


def test_flags_see_a_flipped_item(spark, sf):
    rows = fx.responses_dense(spark, sf)
    flipped = rows.withColumn("correct", F.when(F.col("item_id") == 3, 1 - F.col("correct")).otherwise(F.col("correct")))
    r = {x["item_id"]: x["r"] for x in itemfit.point_biserial(flipped, fx.abilities(spark)).collect()}
    assert r[3] < 0 < np.mean([v for k, v in r.items() if k != 3])


def test_the_rest_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['lumetric.llm'] = None; import __spark_entry__ as e; assert 'eap_ability' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1])).returncode == 0
