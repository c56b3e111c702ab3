"""The operators applied to the fixture bank, one query for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import irt
from ..operators import agreement, bank, dependence, dif, emstep, experiments, itemfit, power, raw, replies, scoring, selection, text
from ..sources import fixtures as fx
from ..sources import records, scratch
from ..streaming import ability_stream as streaming
from . import fitting, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return fx.once(spark, sf, "responses", lambda: bank.collapse_repeats(fx.answers(spark, sf)))


def dense_post(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.posterior(fx.responses_dense(spark, sf), fx.params(spark, fx.DENSE_ITEMS), fx.quadrature(spark))


def dense_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return itemfit.residuals(fx.responses_dense(spark, sf), fx.params(spark, fx.DENSE_ITEMS), fx.abilities(spark))


def grid(spark: SparkSession) -> DataFrame:
    """Items with guessing at thirteen abilities from -3 to 3."""
    points = spark.range(-6, 7).select(F.col("id").alias("grid"), (F.col("id") / 2).alias("theta"))
    return fx.params(spark, guessing=True).crossJoin(F.broadcast(points))


@query
def collapse_repeats(spark, sf):
    return responses(spark, sf)


@query
def repeat_agreement(spark, sf):
    return rounded(bank.repeat_agreement(fx.answers(spark, sf)), 6, "agreement")


@query
def full_suite_scores(spark, sf):
    return rounded(bank.scores(responses(spark, sf)), 6, "score")


@query
def response_floor(spark, sf):
    return bank.item_floor(responses(spark, sf))


@query
def semi_join_restrict(spark, sf):
    rows = responses(spark, sf)
    return bank.restrict(rows, bank.item_floor(rows, 110)).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_items"))


@query
def resume_anti_join(spark, sf):
    hashed = bank.request_hash(F.col("model_id"), F.col("item_id"))
    cells = fx.once(spark, sf, "rotations", lambda: fx.answers(spark, sf).select("model_id", "item_id", "rotation").distinct())
    records = cells.withColumn("request_sha256", hashed)
    asked = records.where("rotation = 1").select("model_id", "item_id", "request_sha256").distinct()
    left = bank.outstanding(asked, records.where("rotation = 2"))
    return left.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_left"))


@query
def common_frame(spark, sf):
    return bank.common_items(fx.responses_dense(spark, sf))


@query
def initial_items(spark, sf):
    p = irt.clip(F.avg("correct"), 0.02, 0.98)
    out = responses(spark, sf).groupBy("item_id").agg(p.alias("p"))
    return out.select("item_id", F.lit(1.0).alias("a"), F.round(irt.clip(-F.ln(F.col("p") / (1 - F.col("p"))), -6, 6), 6).alias("b"))


@query
def eap_ability(spark, sf):
    out = scoring.eap(fx.responses_dense(spark, sf), fx.params(spark, fx.DENSE_ITEMS), fx.quadrature(spark))
    return rounded(out, 4, "theta", "se", "loglik")


@query
def eap_interval(spark, sf):
    return rounded(scoring.interval(dense_post(spark, sf)), 4, "lo", "hi")


@query
def ability_scores(spark, sf):
    """Which model is better: ability, its error and the plain score, best first."""
    rows = fx.responses_dense(spark, sf)
    out = scoring.eap(rows, fx.params(spark, fx.DENSE_ITEMS), fx.quadrature(spark)).join(bank.scores(rows), "model_id")
    return rounded(out, 4, "theta", "se").select("model_id", "theta", "se", "n", F.round("score", 6).alias("score")).orderBy(F.desc("theta"), "model_id")


@query
def p_correct(spark, sf):
    p = irt.p_correct(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    return grid(spark).select("item_id", "grid", F.round(p, 6).alias("p"))


@query
def fisher_information(spark, sf):
    i = irt.information(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    return grid(spark).select("item_id", "grid", F.round(i, 6).alias("information"))


@query
def test_information(spark, sf):
    i = irt.information(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    return grid(spark).groupBy("grid").agg(F.round(F.sum(i), 4).alias("information"))


@query
def tcc(spark, sf):
    p = irt.p_correct(F.col("theta"), F.col("a"), F.col("b"), F.col("c"))
    return grid(spark).groupBy("grid").agg(F.round(F.avg(p), 6).alias("expected_score"))


@query
def residuals(spark, sf):
    return dense_residuals(spark, sf).select("model_id", "item_id", F.round("z", 5).alias("z"))


@query
def item_infit_outfit(spark, sf):
    return rounded(itemfit.infit_outfit(dense_residuals(spark, sf)), 5, "infit", "outfit")


@query
def point_biserial(spark, sf):
    out = itemfit.point_biserial(fx.responses_dense(spark, sf), fx.abilities(spark))
    return rounded(rounded(out, 6, "proportion"), 5, "r")


def dense_curve(spark: SparkSession, sf: str) -> DataFrame:
    return itemfit.empirical_curve(fx.responses_dense(spark, sf), itemfit.bins(fx.abilities(spark)))


@query
def empirical_curve(spark, sf):
    return rounded(dense_curve(spark, sf), 6, "proportion")


@query
def monotone_drop(spark, sf):
    return itemfit.monotone_drop(dense_curve(spark, sf)).select("item_id", F.round("drop", 6).alias("fall"), "least_n", "n_bins")


@query
def separation_auc(spark, sf):
    return rounded(itemfit.separation(fx.responses_dense(spark, sf), fx.abilities(spark)), 6, "auc")


@query
def item_flags(spark, sf):
    rows, able = fx.responses_dense(spark, sf), fx.abilities(spark)
    return itemfit.flags(
        fx.params(spark, fx.DENSE_ITEMS), itemfit.infit_outfit(dense_residuals(spark, sf)), itemfit.point_biserial(rows, able),
        itemfit.separation(rows, able), itemfit.monotone_drop(dense_curve(spark, sf)),
    )


@query
def flags_by_benchmark(spark, sf):
    return itemfit.flags_by_benchmark(item_flags(spark, sf), fx.items(spark, fx.DENSE_ITEMS))


# ---- differential functioning and dependence --------------------------------


def binned(spark: SparkSession) -> DataFrame:
    return itemfit.bins(fx.abilities(spark))


def planted_groups(spark: SparkSession) -> DataFrame:
    return spark.range(fx.MODELS).select(F.lit("planted").alias("split"), F.col("id").alias("model_id"), (F.col("id") % 2 == 1).alias("focal"))


@query
def mantel_haenszel(spark, sf):
    out = dif.mantel_haenszel(fx.responses_dense(spark, sf), binned(spark), planted_groups(spark))
    return rounded(out, 4, "delta", "chi2", "p")


@query
def dif_summary(spark, sf):
    out = dif.mantel_haenszel(fx.responses_dense(spark, sf), binned(spark), planted_groups(spark))
    return rounded(dif.summary(out), 4, "median_abs_delta")


@query
def contamination_dif(spark, sf):
    groups = dif.by_date(fx.models(spark, sf), "1995-01", "after 1995-01")
    return rounded(dif.mantel_haenszel(fx.responses_dense(spark, sf), binned(spark), groups), 4, "delta", "p").drop("chi2")


@query
def generation_split(spark, sf):
    return dif.generation(fx.models(spark, sf)).select("model_id", "focal")


def benchmark_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return dense_residuals(spark, sf).join(fx.items(spark, fx.DENSE_ITEMS), "item_id").select("benchmark", "model_id", "item_id", "z", "correct")


@query
def q3_pairs(spark, sf):
    return rounded(dependence.q3(benchmark_residuals(spark, sf)), 5, "q3")


@query
def q3_summary(spark, sf):
    out = dependence.q3_summary(dependence.q3(benchmark_residuals(spark, sf))).withColumnRenamed("max", "largest")
    return rounded(out, 5, "mean", "sd", "p95", "largest", "share_above")


@query
def dependence_design_effect(spark, sf):
    sizes = fx.items(spark, fx.DENSE_ITEMS).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))
    out = dependence.design_effect(dependence.q3_summary(dependence.q3(benchmark_residuals(spark, sf))), sizes)
    return rounded(rounded(out, 5, "design_effect"), 4, "effective_items")


@query
def dependent_blocks(spark, sf):
    return rounded(dependence.blocks(dependence.q3(benchmark_residuals(spark, sf)), least=0.15), 5, "max_value")


@query
def tetrachoric_pairs(spark, sf):
    return rounded(dependence.tetrachoric(benchmark_residuals(spark, sf)), 5, "rho")


@query
def ability_correlations(spark, sf):
    scored = fx.responses_dense(spark, sf).join(fx.items(spark, fx.DENSE_ITEMS), "item_id").groupBy("model_id", "benchmark").agg(F.avg("correct").alias("theta"))
    return rounded(dependence.ability_correlations(scored), 5, "r")


# ---- agreement ---------------------------------------------------------------


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return bank.scores(fx.responses_dense(spark, sf)).join(fx.abilities(spark), "model_id").select("model_id", "score", "theta")


def difficulty_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = responses(spark, sf).groupBy("item_id").agg(F.avg("correct").alias("y"))
    return rates.join(fx.params(spark), "item_id").select("item_id", "y", F.col("b").alias("x"))


@query
def kendall_tau(spark, sf):
    return rounded(agreement.kendall(truth(spark, sf), "score", "theta", "model_id"), 5, "tau")


@query
def spearman(spark, sf):
    return rounded(agreement.spearman(difficulty_rates(spark, sf), "item_id", "x", "y"), 5, "rho")


@query
def decile_overlap(spark, sf):
    return rounded(agreement.decile_overlap(difficulty_rates(spark, sf), "item_id", "x", "y"), 5, "overlap")


@query
def crossbank_agreement(spark, sf):
    one = fx.params(spark, fx.DENSE_ITEMS).select("item_id", F.col("a").alias("a1"), F.col("b").alias("b1"))
    two = fx.params(spark).select("item_id", F.col("a").alias("a2"), F.col("b").alias("b2"))
    return rounded(agreement.cross_bank(one.join(two, "item_id")), 5, "pearson_b", "spearman_b", "pearson_a", "spearman_a")


# ---- experiments -------------------------------------------------------------


def administration(spark: SparkSession, sf: str, rep: int) -> DataFrame:
    """The first or the second."""
    return fx.first_answers(spark, sf).where(F.col("rep") == rep)


def each_retest(spark: SparkSession, sf: str) -> DataFrame:
    return experiments.retest(administration(spark, sf, 1), administration(spark, sf, 2))


@query
def retest(spark, sf):
    return rounded(rounded(each_retest(spark, sf), 5, "agreement", "phi", "p"), 4, "net_points")


@query
def pooled_retest(spark, sf):
    out = experiments.pooled_retest(each_retest(spark, sf))
    return rounded(rounded(rounded(out, 4, "largest_move", "median_move"), 6, "flip_rate"), 5, "p")


@query
def resampling(spark, sf):
    p = irt.p_correct(F.col("theta"), F.col("a"), F.col("b"))
    first = administration(spark, sf, 1).join(fx.abilities(spark), "model_id").join(fx.params(spark), "item_id").withColumn("p", p)
    return rounded(experiments.resampling(first, administration(spark, sf, 2)), 5, "observed", "predicted")


@query
def position_bias(spark, sf):
    rows = fx.first_of(spark, sf, "rotation").withColumnRenamed("rotation", "arm")
    return rounded(experiments.position_bias(rows, 0.1), 5, "spread", "raw", "noise", "net", "floor")


@query
def framing(spark, sf):
    return rounded(experiments.framing(fx.first_of(spark, sf, "template"), 0.1), 5, "item_share", "template_share", "interaction_share", "noise_share")


# ---- power and selection -----------------------------------------------------


@query
def wilson_interval(spark, sf):
    n = responses(spark, sf).groupBy("model_id").agg(F.sum("correct").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = irt.wilson(F.col("k"), F.col("n"))
    return n.select("model_id", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query
def power_prefix_information(spark, sf):
    return rounded(power.prefix_information(fx.params(spark, guessing=True)), 6, "information", "mean_information")


@query
def power_grid(spark, sf):
    effects = spark.range(1, 6).select(F.col("id").alias("effect"))
    return rounded(power.power_grid(fx.params(spark, guessing=True), effects), 4, "power")


def score_curve(spark: SparkSession, sf: str) -> DataFrame:
    """How well the score over the first n items follows ability: items by
    discrimination against items by number."""
    placed = fx.params(spark, fx.DENSE_ITEMS)
    by_a = agreement.ranked(placed.withColumn("minus_a", -F.col("a")), "item_id", "minus_a").select("item_id", F.lit("informative").alias("method"), F.col("rank_minus_a").alias("place"))
    orders = by_a.unionByName(placed.select("item_id", F.lit("plain").alias("method"), (F.col("item_id") + 1).alias("place")))
    steps = spark.createDataFrame([(n,) for n in (5, 10, 20, 40, 60)], "n int")
    cells = fx.responses_dense(spark, sf).join(F.broadcast(orders), "item_id").join(F.broadcast(steps), F.col("place") <= F.col("n"))
    scored = cells.groupBy("method", "n", "model_id").agg(F.avg("correct").alias("score")).join(fx.abilities(spark), "model_id")
    return scored.groupBy("method", "n").agg(F.round(irt.pearson("score", "theta"), 9).alias("value"))


@query
def equivalent_budget(spark, sf):
    return rounded(power.equivalent_budget(score_curve(spark, sf), "informative", "plain"), 3, "equivalent")


def dense_eap(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.eap(fx.responses_dense(spark, sf), fx.params(spark, fx.DENSE_ITEMS), fx.quadrature(spark))


@query
def separated_pairs(spark, sf):
    able = dense_eap(spark, sf).select("model_id", F.round("theta", 6).alias("theta"), F.round(F.col("theta") - irt.Z95 * F.col("se"), 6).alias("lo"), F.round(F.col("theta") + irt.Z95 * F.col("se"), 6).alias("hi"))
    return power.separated_pairs(able).groupBy("leader").agg(F.count(F.lit(1)).alias("n_below"))


@query
def power_validation(spark, sf):
    return rounded(power.power_validation(truth(spark, sf)), 5, "right_order")


@query
def benchmark_strata(spark, sf):
    return rounded(selection.strata(fx.items(spark)), 6, "weight")


@query
def selector_step(spark, sf):
    dense = fx.first_answers(spark, sf, fx.DENSE_ITEMS).where("rep = 1 AND ts < '1995-01-01'").select("model_id", "item_id")  # asked so far
    items = fx.items(spark, fx.DENSE_ITEMS)
    out = selection.selector_step(fx.abilities(spark), dense, items.join(fx.params(spark, fx.DENSE_ITEMS), "item_id"), selection.strata(items))
    return rounded(out, 6, "information")


@query
def random_subset(spark, sf):
    return selection.random_subset(responses(spark, sf).select("model_id", "item_id"), 10, "random")


@query
def sample_per_benchmark(spark, sf):
    return selection.per_benchmark(fx.items(spark), 12, "sample").select("benchmark", "item_id")


@query
def stratified_subset(spark, sf):
    return selection.stratified_subset(fx.items(spark).join(fx.params(spark), "item_id"), 50, "strata")


@query
def suite_apportion(spark, sf):
    return selection.apportion(fx.items(spark), 61)


@query
def suite_choose(spark, sf):
    return selection.suite(fx.items(spark), 61, "suite")


@query
def cost_by_checkpoint(spark, sf):
    cells = administration(spark, sf, 1)
    return rounded(selection.cost_by_checkpoint(cells, [10, 20, 50], "cost"), 5, "spend")


@query
def run_estimate(spark, sf):
    prompts = fx.table(spark, sf, "documents").select(F.col("source").alias("alias"), F.length("text").alias("chars"))
    prices = prompts.select("alias").distinct().where("alias <> 'src3'").select("alias", (F.length("alias") * 0.1).alias("input"), (F.length("alias") * 0.5).alias("output"), F.when(F.col("alias") == "src1", F.lit(0.5)).alias("batch"))
    return rounded(selection.run_estimate(prompts, prices, 200), 6, "cost_usd", "with_margin")


# ---- one EM step -------------------------------------------------------------


def dense_sums(spark: SparkSession, sf: str) -> DataFrame:
    counts = emstep.expected_counts(fx.responses_dense(spark, sf), dense_post(spark, sf))
    return emstep.sums(counts, fx.params(spark, fx.DENSE_ITEMS), fx.quadrature(spark))


@query
def em_one_step(spark, sf):
    return rounded(emstep.step(dense_sums(spark, sf)), 4, "a", "d")


@query
def item_se(spark, sf):
    return rounded(emstep.standard_errors(dense_sums(spark, sf)), 4, "se_a", "se_b")


# ---- text --------------------------------------------------------------------


def lettered(spark: SparkSession) -> DataFrame:
    """Items with four options, generated from their numbers."""
    i = F.col("item_id")
    option = [F.concat(F.lit("option "), (i * k % 23 + k).cast("string")) for k in (3, 5, 7, 11)]
    return fx.items(spark).select("item_id", "benchmark", F.array(*option).alias("options"), F.element_at(F.array(*option), (i % 4 + 1).cast("int")).alias("answer"))


@query
def rotate_options(spark, sf):
    out = lettered(spark).select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "options")
    return out.select("item_id", "k", F.array_join(text.rotate(F.col("options"), F.col("k")), "|").alias("rotated"))


@query
def answer_letter(spark, sf):
    return lettered(spark).select("item_id", text.answer_letter(F.col("options"), F.col("answer")).alias("letter"), text.format_options(F.col("options")).alias("shown"))


@query
def item_hash(spark, sf):
    docs = fx.table(spark, sf, "benchmark")
    words = F.split("text", " ")
    return docs.select("item_id", text.item_hash(F.lit("bench"), F.col("text"), words, F.element_at(words, 1)).alias("hash"))


@query
def question_key_duplicates(spark, sf):
    docs = fx.table(spark, sf, "documents")
    keyed = docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("benchmark"), text.question_key(F.col("text"), F.array(F.col("lang"))).alias("key"), (F.col("doc_id") % 2).alias("answer"))
    return text.duplicates(keyed)


@query
def decision_choice(spark, sf):
    i = F.col("item_id")
    p = [(i * k % 7).cast("string") for k in (2, 3, 5)]
    body = F.concat(F.lit('{"answer": {"probabilities": {"A": 0.'), p[0], F.lit(', "B": 0.'), p[1], F.lit(', "C": 0.'), p[2], F.lit(', "Z": 0.99}}}'))
    reply = F.when(i % 11 == 0, F.lit("not json")).when(i % 11 == 1, F.lit('{"answer": {"choice": "B"}}')).otherwise(body)
    return fx.items(spark).select("item_id", text.decision_choice(reply, 3).alias("choice"))


@query
def family_classify(spark, sf):
    kinds = F.array(*map(F.lit, ("Base merges and moerges", "continuously pretrained", "pretrained", "fine-tuned on domain data", "chat models", "unknown", "Pretrained base", "instruction")))
    return spark.range(fx.MODELS).select(F.col("id").alias("model_id"), text.family(F.element_at(kinds, (F.col("id") * 5 % 8 + 1).cast("int"))).alias("family"))


@query
def administrable_reasons(spark, sf):
    i, base = F.col("item_id"), lettered(spark)
    rows = base.join(fx.items(spark).select("item_id", "kind"), "item_id").select(
        "item_id", "benchmark", (i % 3).alias("task"), "kind", F.when(i % 13 == 0, "[encrypted_text]").otherwise("What?").alias("question"),
        F.when(i % 10 == 3, F.slice("options", 1, 1)).otherwise(F.col("options")).alias("options"),
        F.when(i % 17 == 0, F.lit("")).when((i % 19 == 0) & (F.col("kind") == "free_response"), "none").when(i % 23 == 0, "elsewhere").otherwise(F.col("answer")).alias("answer"),
    )
    return text.administrable(rows)


@query
def route_nearest(spark, sf):
    names = fx.table(spark, sf, "part").select(F.lower("p_type").alias("listed")).distinct()
    wanted = names.withColumnRenamed("listed", "wanted")
    return rounded(text.nearest_routes(wanted, names), 6, "score")


@query
def incomplete_items(spark, sf):
    i = F.col("item_id")
    options = F.when(i % 4 == 0, F.array(*map(F.lit, ("I only", "II only", "I and II", "I, II and III")))).when(i % 4 == 1, F.array(*map(F.lit, ("1 only", "2 only", "1,2", "3")))).when(i % 4 == 2, F.array(*map(F.lit, ("4, 7", "5, 5", "3, 9", "9, 8")))).otherwise(F.array(*map(F.lit, ("$1,000", "1,824", "4", "5"))))
    question = F.when(i % 6 == 0, "Which holds? I. It rains. II. It snows.").otherwise("Which of the statements holds?")
    return text.incomplete(fx.items(spark).select("item_id", question.alias("question"), options.alias("options")))


# ---- reports and raw records ---------------------------------------------------


@query
def worst_items(spark, sf):
    counts = responses(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_models"))
    return rounded(reports.worst_items(fx.params(spark), counts), 6, "a", "b")


@query
def slope_histogram(spark, sf):
    return reports.histogram(fx.params(spark), "a", 0.5, 1.9, 14)


@query
def information_curve(spark, sf):
    points = spark.range(-12, 13).select(F.col("id").alias("grid"), (F.col("id") / 4).alias("theta"))
    return rounded(reports.information_curve(fx.params(spark, guessing=True), points, 50), 4, "whole", "best")


@query
def flagged_evidence(spark, sf):
    return rounded(reports.flagged_evidence(responses(spark, sf), fx.items(spark).where("item_id % 9 = 0")), 6, "lo", "hi")


@query
def decision_table(spark, sf):
    out = reports.decision_table(fx.responses_dense(spark, sf), dense_eap(spark, sf))
    return rounded(rounded(out, 6, "lo", "hi"), 4, "theta", "theta_lo", "theta_hi")


@query
def panel_table(spark, sf):
    return rounded(rounded(reports.panel_table(administration(spark, sf, 1)), 6, "accuracy"), 5, "spend")


@query
def observed_output(spark, sf):
    said = fx.table(spark, sf, "conversations")
    records = said.select(F.col("role").alias("alias"), F.when(F.col("turn") % 5 == 4, "length").otherwise("stop").alias("finish_reason"), F.length("text").cast("bigint").alias("output_tokens"))
    return rounded(reports.observed_output(records), 5, "mean_output")


@query
def template_flip_rates(spark, sf):
    two = administration(spark, sf, 1).select("model_id", "item_id", "template", F.col("correct").alias("x")).join(administration(spark, sf, 2).select("model_id", "item_id", F.col("correct").alias("y")), ["model_id", "item_id"])
    agree = two.groupBy("template", F.col("model_id").alias("alias")).agg(F.avg((F.col("x") == F.col("y")).cast("int")).alias("agreement"))
    return rounded(reports.flip_rates(agree), 6, "flip_rate")


@query
def results_table(spark, sf):
    tau = agreement.kendall(truth(spark, sf), "score", "theta", "model_id").select(F.round("tau", 5).alias("point"), F.col("pairs").alias("n"))
    repeat = bank.repeat_agreement(fx.answers(spark, sf)).select(F.round("agreement", 6).alias("point"), F.col("repeated_cells").alias("n"))
    return reports.results(kendall_tau=tau, repeat_agreement=repeat)


@query
def raw_instances(spark, sf):
    """Documents as raw instances of JSON, read back by the instance scan."""
    words = F.split("text", " ")
    one = F.transform(words, lambda w, i: F.struct(F.struct(w.alias("text")).alias("output"), F.when(i == 1, F.array(F.lit("correct"))).otherwise(F.array().cast("array<string>")).alias("tags")))
    js = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.struct(F.col("text")).alias("input"), one.alias("references")))
    parsed = fx.table(spark, sf, "benchmark").select(F.from_json(js, raw.INSTANCE).alias("i")).select("i.*")
    return raw.instances(parsed).select("id", F.size("options").alias("n_options"), "answer")


@query
def run_names(spark, sf):
    name = F.concat(F.lower("p_brand"), F.lit(":subject="), F.col("p_size").cast("string"), F.lit(",model="), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit(",split=test"))
    key, model = raw.run_name(name)
    return fx.table(spark, sf, "part").select("p_partkey", key.alias("scenario_key"), model.alias("model"))


@query
def task_identities(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("source").alias("task"), "doc_id", F.col("text").alias("question"), (F.col("doc_id") % 2).cast("string").alias("answer_key"))
    return raw.identities(docs)


@query
def leaderboard_candidates(spark, sf):
    rows = fx.table(spark, sf, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 37).cast("string")).alias("fullname"), "s_acctbal", F.col("s_name").alias("eval_name"), F.col("s_acctbal").alias("average"), (F.col("s_suppkey") % 11 == 0).alias("flagged"))
    return raw.candidates(rows).select("fullname", "eval_name", "average")


# ---- iterative, random and per-model operators (rows only) --------------------


def dense_bank(spark: SparkSession) -> DataFrame:
    return fx.items(spark, fx.DENSE_ITEMS).join(fx.params(spark, fx.DENSE_ITEMS), "item_id")


@query
def fit_2pl(spark, sf):
    return fitting.fit(fx.responses_dense(spark, sf)).params


@query
def fit_3pl(spark, sf):
    choice = fx.items(spark, fx.DENSE_ITEMS).where("kind = 'multiple_choice'").select("item_id")
    return fitting.fit(fx.responses_dense(spark, sf), choice).params


@query
def adaptive_path(spark, sf):
    return fitting.adaptive_paths(fx.responses_dense(spark, sf), dense_bank(spark))


@query
def loo_curve(spark, sf):
    kinds = {i: f"b{i % 5}" for i in range(fx.DENSE_ITEMS)}
    out = fitting.leave_one_out(fx.responses_dense(spark, sf), kinds).join(bank.scores(fx.responses_dense(spark, sf)).withColumnRenamed("n", "answered"), "model_id")
    return agreement.kendall_by(out, ["method", "n"], "estimate", "score", "model_id")


@query
def kendall_bootstrap(spark, sf):
    return fitting.kendall_bootstrap(truth(spark, sf), "score", "theta")


@query
def bootstrap_items(spark, sf):
    return fitting.bootstrap_items(fx.responses_dense(spark, sf))


@query
def logistic_dif(spark, sf):
    return fitting.logistic_dif(fx.responses_dense(spark, sf), fx.abilities(spark), planted_groups(spark))


@query
def parallel_analysis(spark, sf):
    rows = fx.responses_dense(spark, sf).join(fx.items(spark, fx.DENSE_ITEMS), "item_id")
    return fitting.parallel_analysis(dependence.complete_cases(rows))


@query
def tetrachoric_exact(spark, sf):
    pairs = dependence.item_pairs(dependence.complete_cases(benchmark_residuals(spark, sf)), "correct")
    n = {x + y: F.count_if((F.col("correct1") == int(x)) & (F.col("correct2") == int(y))).cast("double").alias(f"n{x}{y}") for x in "10" for y in "10"}
    t = pairs.groupBy("benchmark", "i", "j").agg(*n.values())
    return t.select("benchmark", "i", "j", fitting.tetrachoric_exact("n11", "n10", "n01", "n00").alias("rho"))


@query
def ability_mle(spark, sf):
    return fitting.ability_mle(fx.responses_dense(spark, sf), fx.params(spark, fx.DENSE_ITEMS))


@query
def dense_block(spark, sf):
    return fitting.dense_block(responses(spark, sf)).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_items"))


@query
def stratified_panel(spark, sf):
    owner = (F.col("model_id") % 20).cast("string")
    return fitting.stratified_panel(bank.scores(responses(spark, sf)).select("model_id", owner.alias("owner"), F.round("score", 6).alias("average")), 30)


REPLIES = ["Answer: B", "The final answer is (C).", "d", "I think a cat", "**A**", "Answer: E", "B and C both", "It is $\\boxed{\\frac{1}{2}}$", "so 1,234 apples", "Answer: 3/4", "", "no idea"]


def reply_rows(spark: SparkSession) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("item_id") % len(REPLIES) + 1).cast("int"))
    return lettered(spark).select("item_id", "options", said.alias("reply"))


@query
def parse_choice(spark, sf):
    return replies.with_choice(reply_rows(spark), "reply", 4, "options").select("item_id", "choice")


@query
def parse_math(spark, sf):
    return reply_rows(spark).select("item_id", replies.stated_value("reply").alias("value"))


@query
def bank_build(spark, sf):
    """Collapse, floor, restrict, save, load and verify: the bank's own summary."""
    rows = responses(spark, sf).drop("n")
    kept = bank.restrict(rows, bank.item_floor(rows))
    path = scratch.shared_path(spark, "bank")
    records.save_bank(spark, path, "v1", kept, fx.items(spark), fx.models(spark, sf))
    loaded = records.load_bank(spark, path, "v1")
    n = loaded["responses"].agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("item_id").alias("items"), F.count_distinct("model_id").alias("models"))
    return n.withColumn("density", F.round(F.try_divide(F.col("cells").cast("double"), F.col("items") * F.col("models")), 6))


@query
def ability_stream(spark, sf):
    path = scratch.shared_path(spark, "stream")
    rows = fx.responses_dense(spark, sf).select("model_id", "item_id", "correct", bank.request_hash(F.col("model_id"), F.col("item_id")).alias("request_sha256"))
    rows.repartition(4, "item_id").write.json(f"{path}/in")
    return rounded(streaming.final_abilities(spark, f"{path}/in", fx.params(spark, fx.DENSE_ITEMS), f"{path}/out", f"{path}/checkpoint"), 4, "theta", "se")


from . import more_queries  # noqa: E402, F401 - registers the rest
