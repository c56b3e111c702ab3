"""What of the driver's lines travels and is stored, and that the answers stay the same."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumetric.operators import experiments
from lumetric.plans import oracle, queries
from lumetric.sources import fixtures as fx
from lumetric.sources import records, scratch

VIEWS = {
    "framing": lambda s, sf: fx.first_of(s, sf, "template"),
    "position_bias": lambda s, sf: fx.first_of(s, sf, "rotation"),
    "build_summary": queries.responses,
    "pooled_retest": lambda s, sf: queries.administration(s, sf, 2),
    "selector_step": lambda s, sf: fx.first_answers(s, sf, fx.DENSE_ITEMS),
    "fit_2pl": fx.responses_dense,
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", VIEWS)
def test_what_is_stored_follows_cells_and_is_cut_before_it_travels(spark, sf, monkeypatch, name):
    kept = []
    monkeypatch.setattr(fx, "_BANKS", {})
    monkeypatch.setattr(fx, "stored", lambda df, label: kept.append(df) or scratch.stored(df, label))
    VIEWS[name](spark, sf).count()
    (df,) = kept
    text = plan(df)
    assert "BroadcastHashJoin" not in text and text.count("Exchange hashpartitioning") == 3
    assert ("row_number()" in text and "Partial" in text) or "partial_count" in text
    assert df.count() < fx.table(spark, sf, "lineitem").count()


def test_a_view_of_right_answers_takes_three_columns_of_the_lines(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(fx, "_BANKS", {})
    monkeypatch.setattr(fx, "stored", lambda df, label: kept.append(df) or scratch.stored(df, label))
    fx.responses_dense(spark, sf).count()
    assert "l_linenumber" in plan(kept[0]) and "l_extendedprice" not in plan(kept[0]) and "l_shipdate" not in plan(kept[0])


@pytest.mark.parametrize("items", [fx.ITEMS, fx.DENSE_ITEMS])
def test_numbers_of_administrations_are_those_of_sql(spark, tmp_path, items):
    """Lines that agree in key, number, price and flag, and orders of two customers."""
    line = "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp"
    rows = [(o, p, k % 2, 10.0 + k % 3 // 2, 0.01 * (k % 4), "AN"[k // 4 % 2], None) for o in range(6) for p in (1, 1 + items, 2) for k in range(12)]
    lines = spark.createDataFrame(rows, line).withColumn("l_shipdate", F.timestamp_seconds(F.lit(8e8) + F.col("l_tax") * 1e8))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(o, c) for o in range(6) for c in (3, 3 + fx.MODELS, 4)], "o_orderkey bigint, o_custkey bigint")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names = "model_id, item_id, rep, correct, template, rotation, round(cost_usd, 12) AS cost_usd, CAST(ts AS string) AS ts"

    def found(df):
        return sorted(map(tuple, df.selectExpr(*names.split(", ")[:6], "round(cost_usd, 12) AS cost_usd", "CAST(ts AS string) AS ts").toPandas().itertuples(index=False)))

    sql = con.sql(f"SELECT {names.replace('CAST(ts AS string)', 'strftime(ts, $$%Y-%m-%d %H:%M:%S$$)')} FROM {oracle._administrations(items)}").to_arrow_table().to_pandas()
    want = sorted(map(tuple, sql.itertuples(index=False)))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found(fx.administrations(spark, str(tmp_path), items)) == want
    assert found(fx.first_answers(spark, str(tmp_path), items)) == [r for r in want if r[2] <= 2]
    if items == fx.DENSE_ITEMS:
        assert sorted(map(tuple, fx.responses_dense(spark, str(tmp_path)).collect())) == sorted((r[0], r[1], r[3]) for r in want if r[2] == 1)


def test_framing_is_the_same_in_every_order_of_the_rows(spark, sf):
    rows = fx.first_of(spark, sf, "template").toPandas()
    seen = set()
    for seed in range(4):
        mixed = spark.createDataFrame(rows.sample(frac=1, random_state=seed)).repartition(7)
        seen.add(tuple(sorted(map(str, experiments.framing(mixed, 0.1).collect()))))
    assert len(seen) == 1


def test_logs_are_compressed_and_read_back_beside_plain_lines(spark, tmp_path):
    cell = F.col("id").cast("string")
    rows = spark.range(3000, numPartitions=2).select(cell.alias("cell"), cell.alias("item_id"), F.lit("m1").alias("alias"), F.lit(1).alias("correct"), F.sha2(cell, 256).alias("request_sha256"))
    path = f"{tmp_path}/log"
    records.append_records(rows, path)
    files = list((tmp_path / "log").glob("part-*"))
    plain = rows.select(F.sum(F.length(F.to_json(F.struct("*"))) + 1)).first()[0]
    assert sum(f.stat().st_size for f in files) < plain / 2
    spark.createDataFrame([('{"cell": "x", "item_id": "1"}',), ('{"cell": "cut',)], "value string").write.mode("append").text(path)
    read = records.read_records(spark, path)
    assert read.count() == 3001 and read.select("cell", "request_sha256").where("cell <> 'x'").exceptAll(rows.select("cell", "request_sha256")).count() == 0
