"""More queries: replies and records, tasks and panels, power, sinks, refits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import agreement, bank, dif, panels, power, raw, replies, selection, text
from ..sources import fixtures as fx
from ..sources import records, scratch
from ..streaming import early_stop
from . import fitting
from .queries import REPLIES, administration, dense_bank, dense_eap, difficulty_rates, lettered, query, responses, rounded, score_curve

# ---- replies -------------------------------------------------------------------

#: Benchmarks of the fixture with the month they were published; b3's isn't known.
PUBLISHED = [("b0", "1992-06", "Arithmetic"), ("b1", "1995-01", "Botany"), ("b2", "1998-12", None), ("b4", "1993-03", "Logic")]


def asked(spark: SparkSession) -> DataFrame:
    """Items as asked: rotated options, some as decisions, some calls failed, free answers for b4."""
    i = F.col("item_id")
    free = F.col("kind") == "free_response"
    said = F.element_at(F.array(*map(F.lit, REPLIES)), (i % len(REPLIES) + 1).cast("int"))
    return lettered(spark).join(fx.items(spark).select("item_id", "kind"), "item_id").select(
        "item_id", "kind", "options", F.when(i % 31 == 0, "").when(free, F.element_at(F.array(F.lit("0.5"), F.lit("1234"), F.lit("x")), (i % 3 + 1).cast("int"))).otherwise(F.col("answer")).alias("answer"),
        (i % 4).cast("int").alias("rotation"), F.when(i % 5 == 2, "decision").otherwise("plain").alias("template"),
        F.when(i % 37 == 0, "call returned 429").alias("error"), F.when(i % 5 == 2, F.lit('{"answer": {"choice": "B"}}')).otherwise(said).alias("reply"),
    )


@query
def score_replies(spark, sf):
    return replies.scored(asked(spark)).select("item_id", "key", "parsed", "correct")


@query
def rescore_replies(spark, sf):
    """Stored readings, of which every seventh was made by an older parser."""
    i = F.col("item_id")
    stored = replies.scored(asked(spark)).select(i.cast("string").alias("cell"), "item_id", "template", "rotation", "reply", "error", F.when(i % 7 == 0, "A").otherwise(F.col("parsed")).alias("parsed"), F.when(i % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("correct")).alias("correct"))
    return replies.rescored(stored, asked(spark))


@query
def final_answers(spark, sf):
    return fx.items(spark).select("item_id", replies.final_answer(F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("item_id") % len(REPLIES) + 1).cast("int"))).alias("value"))


@query
def retry_classes(spark, sf):
    i = F.col("event_id")
    errors = F.array(*map(F.lit, ("call returned 429", "returned ConnectError", "refused", "read timeout", "returned 400", "model not ready")))
    rows = fx.table(spark, sf, "events").select("event_id", F.when(i % 4 != 0, F.element_at(errors, (i % 6 + 1).cast("int"))).alias("error"), F.when(i % 3 == 0, i % 2 == 0).alias("retryable"))
    return rows.select("event_id", replies.worth_repeating().alias("again"))


@query
def settled_requests(spark, sf):
    i = F.col("event_id")
    rows = fx.table(spark, sf, "events").select(F.when(i % 10 != 9, (i % 100).cast("string")).alias("request_sha256"), F.when(i % 4 != 0, "call returned 503").alias("error"), F.when(i % 3 == 0, i % 2 == 0).alias("retryable"))
    return replies.done(rows)


@query
def display_names(spark, sf):
    i = F.col("p_partkey")
    model = F.concat(F.lower("p_brand"), F.lit("/"), F.lower(F.regexp_replace("p_type", " ", "-")), F.when(i % 3 == 0, "-20251001").when(i % 3 == 1, "-2026-03-17").otherwise(""))
    return fx.table(spark, sf, "part").select("p_partkey", replies.display_name(model).alias("shown"))


@query
def quoted_questions(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", replies.quoted(F.col("text")).alias("quote"))


@query
def benchmark_lookup(spark, sf):
    known = spark.createDataFrame(PUBLISHED, "benchmark string, month string, name string")
    names = fx.items(spark).select("benchmark").distinct().join(F.broadcast(known), "benchmark", "left")
    return names.select("benchmark", F.coalesce("month", F.lit("")).alias("published"), F.coalesce("name", "benchmark").alias("title"))


@query
def rendered_prompts(spark, sf):
    body = F.concat_ws("\n", F.concat(F.lit("Question "), F.col("item_id").cast("string")), text.format_options(text.rotate(F.col("options"), F.col("item_id") % 4)), F.lit("Answer:"))
    return lettered(spark).select("item_id", body.alias("prompt"), F.concat_ws("|", F.lit("m"), F.col("item_id").cast("string"), F.lit("plain"), (F.col("item_id") % 4).cast("string")).alias("cell"), F.sha2(F.to_json(F.struct(body.alias("prompt"), F.lit(64).alias("tokens"))), 256).alias("request_sha256"))


# ---- power ---------------------------------------------------------------------


def resolutions(spark: SparkSession) -> dict[int, power.Resolution]:
    return {t: power.Resolution.of(fx.params(spark, guessing=True), float(t)) for t in (-1, 0, 1)}


@query
def items_needed(spark, sf):
    rows = [(t, e, paired, *r.items_needed(e, 0.8, paired=paired)) for t, r in resolutions(spark).items() for e in (1, 3, 10, 25) for paired in (True, False)]
    return spark.createDataFrame(rows, "ability int, effect int, paired boolean, items bigint, capped boolean")


@query
def detectable_effect(spark, sf):
    return rounded(spark.createDataFrame([(t, n, r.detectable_effect(n)) for t, r in resolutions(spark).items() for n in (10, 50, 200)], "ability int, n int, effect double"), 6, "effect")


@query
def power_at(spark, sf):
    return rounded(spark.createDataFrame([(t, n, e, r.power_at(n, e)) for t, r in resolutions(spark).items() for n in (10, 50, 200) for e in (2, 10)], "ability int, n int, effect int, power double"), 4, "power")


@query
def precision_stop(spark, sf):
    n = fx.responses_dense(spark, sf).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(panels.precise(dense_eap(spark, sf).join(n, "model_id"), 0.45), 4, "se")


@query
def target_reached(spark, sf):
    return panels.first_reach(score_curve(spark, sf), "value", F.lit(0.8))


@query
def carried_estimates(spark, sf):
    run = fx.responses_dense(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("model_id").orderBy("item_id")))
    run = run.withColumn("theta", F.avg("correct").over(W.partitionBy("model_id").orderBy("item_id").rowsBetween(W.unboundedPreceding, 0)))
    points = spark.createDataFrame([(n,) for n in (5, 20, 40, 60)], "n int")
    return rounded(panels.carried(run.select("model_id", "n", "theta"), points), 6, "theta")


# ---- panels, tasks, banks ---------------------------------------------------------


@query
def panel_frame(spark, sf):
    """By model: answered cells, and those on items the bank can place."""
    params = fx.params(spark).withColumn("b", F.when(F.col("item_id") % 9 == 0, F.lit(float("nan"))).when(F.col("item_id") % 11 == 0, F.lit(None)).otherwise(F.col("b")))
    rows = responses(spark, sf)
    return bank.scores(rows).select("model_id", "n").join(panels.measurable(rows, params).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_measurable")), "model_id", "left")


@query
def stacked_panels(spark, sf):
    kinds = fx.items(spark).select("item_id", "benchmark")
    first = administration(spark, sf, 1).join(kinds, "item_id").select(F.concat(F.lit("text-"), F.col("model_id").cast("string")).alias("alias"), "item_id", "benchmark", "correct")
    second = administration(spark, sf, 2).select(F.concat(F.lit("decision-"), F.col("model_id").cast("string")).alias("alias"), "item_id", F.lit(None).cast("string").alias("benchmark"), "correct")
    return rounded(panels.stacked(first, second).groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.count("benchmark").alias("n_known"), F.avg("correct").alias("accuracy")), 6, "accuracy")


def task_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the items of tasks (sources), answered by the models of as many runs."""
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id", F.col("text").alias("question"), (F.col("doc_id") % 2).cast("string").alias("answer_key"))
    runs = spark.range(4).select(F.col("id").alias("model_id"))
    scores = docs.select("task", "doc_id").crossJoin(F.broadcast(runs)).where("(doc_id + model_id) % 3 <> 0").select("task", "doc_id", "model_id", ((F.col("doc_id") + F.col("model_id")) % 2).cast("int").alias("correct"))
    return panels.task_scores(raw.identities(docs), scores)


@query
def task_union(spark, sf):
    """Every task's identities joined to its scores, all tasks in one frame."""
    return rounded(task_answers(spark, sf).groupBy("task", "model_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"), F.avg("correct").alias("score")), 6, "score")


@query
def key_drift(spark, sf):
    rows = task_answers(spark, sf)
    seen = rows.withColumn("answer_key", F.when((F.col("doc_id") % 50 == 0) & (F.col("model_id") == 3), F.lit("x")).otherwise(F.col("answer_key")))
    return panels.key_drift(seen)


@query
def bank_bridge(spark, sf):
    i = F.col("id")
    first = spark.range(300).select(i.alias("item_id"), F.concat(F.lit("v1:q"), (i % 120).cast("string")).alias("question_id"))
    second = spark.range(300).select((i + 1000).alias("item_id"), F.concat(F.lit("leaderboard/task#q"), (i * 2 % 250).cast("string")).alias("question_id"))
    return panels.bridge(first, second)


@query
def discrimination(spark, sf):
    planted = fx.params(spark).withColumn("a", F.col("a") - 0.5)
    return rounded(panels.discrimination(planted), 6, "median_a", "share_low", "share_negative")


@query
def build_summary(spark, sf):
    rows = responses(spark, sf)
    return panels.build_summary(rows, bank.restrict(rows, bank.item_floor(rows, 110)), fx.items(spark))


@query
def reason_counts(spark, sf):
    """How many items of each task can't be asked, and why; by ROLLUP with the totals."""
    from .queries import administrable_reasons

    rows = administrable_reasons(spark, sf).withColumn("reason", F.coalesce("reason", F.lit("can be asked")))
    return rows.groupBy("benchmark", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("n_items"))


@query
def reliability_record(spark, sf):
    i = F.col("model_id")
    from .queries import each_retest

    rows = each_retest(spark, sf).select(F.when(i % 2 == 0, "own").otherwise("public").alias("source"), F.concat(F.when(i % 5 == 0, "local-").otherwise("hosted-"), i.cast("string")).alias("alias"), "agreement")
    return rounded(rounded(panels.reliability(rows, 500), 6, "flip_rate"), 5, "points_sd")


@query
def dif_contrasts(spark, sf):
    """Every contrast with ten models on both sides, over its own items."""
    able, rows = itemfit_bins(spark), fx.responses_dense(spark, sf)
    kind = F.when(F.col("model_id") % 4 == 1, "merge").otherwise("base").alias("family")
    found = dif.contrasts(fx.models(spark, sf).select("*", kind), spark.createDataFrame(PUBLISHED, "benchmark string, month string, name string").select("benchmark", "month"))
    kept, _ = dif.enough(found, rows)
    out = dif.mantel_haenszel(rows, able, kept.select("split", "model_id", "focal"))
    own = kept.select("split", "benchmark").distinct().join(fx.items(spark, fx.DENSE_ITEMS).select("item_id", F.col("benchmark").alias("of")), F.coalesce(F.col("benchmark") == F.col("of"), F.lit(True))).select("split", "item_id")
    return rounded(out.join(own, ["split", "item_id"], "left_semi").select("split", "item_id", "n_reference", "n_focal", "delta"), 4, "delta")


@query
def dif_skipped(spark, sf):
    kind = F.when(F.col("model_id") % 4 == 1, "merge").otherwise("base").alias("family")
    found = dif.contrasts(fx.models(spark, sf).select("*", kind), spark.createDataFrame([("b0", "1992-06"), ("b1", "1999-12"), ("b2", "1900-01")], "benchmark string, month string"))
    return dif.enough(found, fx.responses_dense(spark, sf))[1]


def itemfit_bins(spark: SparkSession) -> DataFrame:
    from ..operators import itemfit

    return itemfit.bins(fx.abilities(spark))


@query
def duplicate_section(spark, sf):
    """Repeated questions within and across benchmarks, and the ten largest of them."""
    from .queries import question_key_duplicates

    found = question_key_duplicates(spark, sf)
    n = found.groupBy("cross_benchmark").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("size").alias("n_items"))
    top = found.orderBy(F.desc("size"), "first_item").limit(10).agg(F.array_join(F.array_sort(F.collect_list(F.col("first_item").cast("string"))), ",").alias("largest"))
    return n.crossJoin(F.broadcast(top))


@query
def framing_exceptions(spark, sf):
    """Templates that cost a model accuracy beyond doubt (the interval of its flips' net cost
    is above 0): the three dearest named, the rest counted."""
    first, second = (administration(spark, sf, k).select("model_id", "item_id", F.col("correct").alias(c)) for k, c in ((1, "x"), (2, "y")))
    cost = first.join(second, ["model_id", "item_id"]).groupBy("model_id").agg(F.avg(F.col("x") - F.col("y")).alias("cost"), F.stddev_pop(F.col("x") - F.col("y")).alias("sd"), F.count(F.lit(1)).alias("n"))
    sure = cost.where(F.col("cost") - F.col("sd") / F.sqrt("n") > 0).withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("cost", 9)), "model_id")))
    return sure.groupBy(F.when(F.col("place") <= 3, F.col("model_id")).alias("model_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cost"), 6).alias("cost"))


@query
def suite_mix(spark, sf):
    """A suite's benchmarks with what asking them would take: priced totals and what has no price."""
    chosen = selection.suite(fx.items(spark), 61, "suite").groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    priced = chosen.withColumn("usd", F.when(F.col("benchmark") != "b3", F.col("n") * 0.002))
    return priced.agg(F.sum("n").alias("n_items"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 6).alias("usd"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))) * 1.25, 6).alias("with_margin"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("usd").isNull(), F.col("benchmark")))), ",").alias("unpriced"))


@query
def route_check(spark, sf):
    """Whether each wanted route is listed; where it isn't, the nearest that is."""
    listed = fx.table(spark, sf, "part").select(F.lower("p_type").alias("listed")).distinct()
    wanted = listed.select(F.concat("listed", F.when(F.length("listed") % 2 == 0, " xl").otherwise("")).alias("wanted"))
    near = text.nearest_routes(wanted, listed, 1).select("wanted", F.col("listed").alias("nearest"))
    known = wanted.join(listed, wanted["wanted"] == listed["listed"], "left")
    return known.join(near, "wanted", "left").select("wanted", F.col("listed").isNotNull().alias("listed"), F.when(F.col("listed").isNull(), F.col("nearest")).alias("nearest"))


def picked(*parts) -> Column:
    """A hash-drawn place below n."""
    return F.least(F.floor(fx.uniform(*parts) * F.col("n")), F.col("n") - 1).cast("bigint")


@query
def bootstrap_mean(spark, sf):
    rows = fx.responses_dense(spark, sf)
    of = W.partitionBy("model_id")
    values = rows.select(F.col("model_id").alias("group"), (F.row_number().over(of.orderBy("item_id")) - 1).cast("bigint").alias("place"), F.count(F.lit(1)).over(of).alias("n"), F.col("correct").cast("double").alias("value"))
    draws = spark.range(200).withColumnRenamed("id", "draw")
    return rounded(panels.bootstrap_mean(values, draws, picked(F.lit("boot"), F.col("group"), F.col("draw"), F.col("place"))).withColumnRenamed("group", "model_id"), 6, "point", "lo", "hi")


@query
def bootstrap_crossbank(spark, sf):
    rates = difficulty_rates(spark, sf)
    values = rates.select((F.row_number().over(W.orderBy("item_id")) - 1).cast("bigint").alias("place"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"), F.col("x"), F.col("y"))
    draws = spark.range(200).withColumnRenamed("id", "draw")
    return rounded(panels.bootstrap_correlation(values, draws, picked(F.lit("cross"), F.col("draw"), F.col("place"))), 5, "point", "lo", "hi")


# ---- raw records, sinks and loaders ---------------------------------------------------


@query
def raw_results(spark, sf):
    """Answers as per-instance statistics in JSON, read back by the response scan."""
    one = F.struct(F.struct(F.lit("exact_match").alias("name")).alias("name"), F.lit(1).alias("count"), F.col("correct").cast("double").alias("mean"))
    other = F.struct(F.struct(F.lit("runtime").alias("name")).alias("name"), F.lit(1).alias("count"), F.lit(0.7).alias("mean"))
    none = F.struct(F.struct(F.lit("exact_match").alias("name")).alias("name"), F.lit(0).alias("count"), F.lit(0.5).alias("mean"))
    js = F.to_json(F.struct(F.concat_ws("-", "model_id", "item_id").alias("instance_id"), F.array(other, none, one).alias("stats")))
    parsed = fx.responses_dense(spark, sf).select(F.from_json(js, raw.RESULT).alias("r")).select("r.*")
    return raw.responses(parsed, "exact_match")


@query
def model_metadata(spark, sf):
    """Model records in JSON, scanned to one row each."""
    js = F.to_json(F.struct(F.lower(F.regexp_replace("c_name", "#", "/")).alias("name"), F.struct(F.col("c_mktsegment").alias("creator"), F.when(F.col("c_acctbal") > 0, "open").otherwise("closed").alias("access")).alias("info"), F.when(F.col("c_custkey") % 3 != 0, F.lit("1996-05-01")).alias("release_date")))
    return raw.models(fx.table(spark, sf, "customer").select(js.alias("value")))


@query
def first_runs(spark, sf):
    runs = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), (F.col("o_custkey") % 50).alias("suite"), "o_orderdate", "o_orderkey")
    return raw.first_of(runs, ["scenario", "suite"], "o_orderdate", "o_orderkey").select("scenario", "suite", "o_orderkey")


@query
def instance_scan(spark, sf):
    """Wanted instances over all runs, the first of each counting."""
    runs = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber", "l_quantity")
    wanted = fx.table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return raw.first_of(runs.join(wanted, "id", "left_semi"), ["id"], "l_orderkey", "l_linenumber").select("id", "l_orderkey", "l_quantity")


def record_log(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id").cast("string")
    taken = ("model_id", "item_id", "rep", "correct", "rotation", "cost_usd")
    rows = fx.once(spark, sf, "ledger", lambda: fx.administrations(spark, sf, fx.DENSE_ITEMS).select(*taken))
    return rows.select(
        F.concat_ws("|", "model_id", "item_id", "rep").alias("cell"), i.alias("item_id"), F.concat(F.lit("m"), F.col("model_id").cast("string")).alias("alias"),
        F.when(F.col("rotation") != 3, F.col("correct")).alias("correct"), "cost_usd", F.col("rep").cast("bigint").alias("ledger_id"),
        bank.request_hash(F.col("model_id"), F.col("item_id"), F.col("rep")).alias("request_sha256"),
    )


@query
def record_panel(spark, sf):
    """Records appended in two runs beside a line that was cut off, read back as a panel of the suite."""
    path = scratch.shared_path(spark, "records")
    log = record_log(spark, sf)
    records.append_records(log.where("ledger_id = 1"), path)
    records.append_records(log.where("ledger_id > 1"), path)
    spark.createDataFrame([('{"item_id": "1", "alias": "m1", "cor',)], "value string").write.mode("append").text(path)
    suite = fx.items(spark, fx.DENSE_ITEMS).where("benchmark <> 'b4'").select(F.col("item_id").cast("string").alias("item_id"))
    found = records.panel(records.read_records(spark, path), suite)
    return rounded(found.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right"), F.sum("cost_usd").alias("usd")), 5, "usd")


@query
def superseded_log(spark, sf):
    path = scratch.shared_path(spark, "records")
    records.append_records(record_log(spark, sf), f"{path}/old")
    records.supersede_file(spark, f"{path}/old", f"{path}/new", [f"m{k}" for k in range(0, 150, 7)])
    both = [records.read_records(spark, f"{path}/{k}").groupBy(F.lit(k).alias("log")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("alias").alias("aliases")) for k in ("old", "new")]
    return both[0].unionByName(both[1])


@query
def latest_prices(spark, sf):
    """Dated price files on disk; the latest one's rows."""
    path = scratch.shared_path(spark, "prices")
    rows = fx.table(spark, sf, "supplier").select(F.concat(F.lit("p"), (F.col("s_suppkey") % 5).cast("string")).alias("provider"), F.lower("s_name").alias("model"), F.abs("s_acctbal").alias("input"), F.concat(F.lit("2026-0"), (F.col("s_suppkey") % 4 + 1).cast("string"), F.lit("-01")).alias("date"))
    records.save_prices(rows, path)
    return records.latest_prices(spark, path).select("provider", "model", "input")


@query
def fit_sinks(spark, sf):
    """Parameters, abilities, dependence and a suite saved with a bank's version, loaded with their guards."""
    path = scratch.shared_path(spark, "bank")
    items, params = fx.items(spark, fx.DENSE_ITEMS), fx.params(spark, fx.DENSE_ITEMS)
    rows = fx.responses_dense(spark, sf)
    records.save_bank(spark, path, "v1", rows, items, fx.models(spark, sf))
    records.save_fit(spark, path, "v1", "2pl", params, fx.abilities(spark))
    records.save_dependence(items.groupBy("benchmark").agg(F.array_sort(F.collect_list("item_id")).alias("items")), path, "v1")
    records.save_suite(selection.suite(items, 20, "suite"), path, "v1", "small")
    loaded = records.load_fit(spark, path, "v1", "2pl", items)
    n = loaded["params"].agg(F.lit("params").alias("what"), F.count(F.lit(1)).alias("n"), F.round(F.sum("b"), 6).alias("value"))
    n = n.unionByName(loaded["abilities"].agg(F.lit("abilities").alias("what"), F.count(F.lit(1)).alias("n"), F.round(F.sum("theta"), 6).alias("value")))
    n = n.unionByName(records.dependence_index(spark, path, "v1").agg(F.lit("dependence").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("block").cast("double").alias("value")))
    n = n.unionByName(records.load_suite(spark, path, "v1", "small").agg(F.lit("suite").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("item_id").cast("double").alias("value")))
    return n.unionByName(spark.createDataFrame([("versions", len(records.versions(spark, path)), 0.0)], "what string, n bigint, value double"))


@query
def packed_matrix(spark, sf):
    """The bank as one row for each item: its answers by model, a byte each (2: none), and back."""
    rows = responses(spark, sf).select("model_id", "item_id", "correct")
    path = scratch.shared_path(spark, "packed")
    records.save_packed(rows, spark.range(fx.MODELS).select(F.col("id").alias("model_id")), path)
    return records.load_packed(spark, path)


# ---- refits and streams -----------------------------------------------------------------


@query
def ability_halves(spark, sf):
    return fitting.half_fits(fx.responses_dense(spark, sf), fx.abilities(spark))


@query
def benchmark_abilities(spark, sf):
    return fitting.benchmark_abilities(responses(spark, sf), fx.items(spark), least_items=40)


@query
def own_run_validation(spark, sf):
    """By method and size: tau against the panel's accuracy, mean posterior error and the bill."""
    cells = fx.first_answers(spark, sf, fx.DENSE_ITEMS).where("rep = 1")
    found = fitting.validate(cells, dense_bank(spark))
    tau = agreement.kendall_by(found, ["method", "n"], "estimate", "truth", "model_id")
    return tau.join(found.groupBy("method", "n").agg(F.avg("se").alias("mean_se"), F.sum("usd").alias("usd")), ["method", "n"])


@query
def early_stop_stream(spark, sf):
    """Pairs of models asked the same items; each pair stops when their intervals part."""
    path = scratch.shared_path(spark, "stream")
    rows = fx.responses_dense(spark, sf)
    pairs = spark.range(75).select(F.col("id").alias("pair"), F.col("id").alias("a"), (F.col("id") + 75).alias("b"))
    left = rows.select(F.col("model_id").alias("a"), "item_id", F.col("correct").alias("correct_a"))
    right = rows.select(F.col("model_id").alias("b"), "item_id", F.col("correct").alias("correct_b"))
    pairs.join(left, "a").join(right, ["b", "item_id"]).select("pair", "item_id", "correct_a", "correct_b").write.json(f"{path}/in")
    return early_stop.decisions(spark, f"{path}/in", fx.params(spark, fx.DENSE_ITEMS), f"{path}/out", f"{path}/checkpoint")
