"""Iterative and per-model operators: EM, refits, adaptive runs, bootstraps.

EM packs the responses once, by item, into dense blocks of a stored table. An iteration
is one job without a shuffle: every block gets all posteriors, updates its items and
returns them with its share of each model's log likelihood at every node, which the
driver adds up. What travels is items x 3 doubles and, for each block, models x 61; the
sizes are checked against MOST_SHARED_BYTES first, and a larger bank (some half a million
models) is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import cat, em, stats
from ..operators.bank import common_items, item_floor, restrict
from ..sources.scratch import shared_path, stored

MOST_SHARED_BYTES = 256 * 2**20


@dataclass
class Fitted:
    params: DataFrame
    abilities: DataFrame
    iterations: int
    converged: bool
    loglik: float


def checked(n_bytes: int, what: str) -> None:
    if n_bytes > MOST_SHARED_BYTES:
        raise ValueError(f"{what} would take {n_bytes} bytes in every task; the bound is {MOST_SHARED_BYTES}")


def blocks(responses: DataFrame, parts: int) -> tuple[DataFrame, list, list]:
    """A stored table of blocks (item places, answers), the item ids and the model ids.
    answers: a byte for each item and model, 0, 1 or 2 (none). A block holds all of its items' answers."""
    spark = responses.sparkSession
    ids = [r["item_id"] for r in responses.select("item_id").distinct().orderBy("item_id").toLocalIterator()]
    names = [r["model_id"] for r in responses.select("model_id").distinct().orderBy("model_id").toLocalIterator()]
    at = spark.sparkContext.broadcast(({v: k for k, v in enumerate(ids)}, {v: k for k, v in enumerate(names)}))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, models = at.value
        held = pd.concat([f for f in frames if len(f)] or [pd.DataFrame({"item_id": [], "model_id": [], "correct": []})])
        if len(held):
            place = held["item_id"].map(items).to_numpy()
            own = np.unique(place)
            answers = np.full((len(own), len(models)), 2, np.uint8)
            answers[np.searchsorted(own, place), held["model_id"].map(models).to_numpy()] = held["correct"].to_numpy()
            yield pd.DataFrame({"items": [own.astype(np.int64)], "answers": [answers.tobytes()]})

    path = shared_path(spark, "em")
    schema = "items array<bigint>, answers binary"
    responses.select("item_id", "model_id", "correct").repartition(parts, "item_id").mapInPandas(pack, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path), ids, names


def fit(responses: DataFrame, guessing: DataFrame | None = None, most: int = 200, tolerance: float = 1e-4, parts: int | None = None) -> Fitted:
    """Two-parameter fit, three-parameter for the items of `guessing` (item_id)."""
    spark = responses.sparkSession
    sc = spark.sparkContext
    parts = parts or sc.defaultParallelism
    shape = responses.agg(F.count_distinct("item_id").alias("items"), F.count_distinct("model_id").alias("models")).first()
    checked(24 * shape["items"], "item parameters")
    checked(8 * em.NODES * shape["models"] * parts, "posteriors")
    packed, ids, names = blocks(responses, parts)
    guessed = {r["item_id"] for r in guessing.toLocalIterator()} if guessing is not None else set()
    guess = np.array([i in guessed for i in ids], bool)
    x, lw = em.quadrature()
    n_models = len(names)

    def job(state, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """New parameters (items by 3) and the models' summed log likelihoods by node."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (a, d, c), post = state.value
            for f in frames:
                for own, raw in zip(f["items"], f["answers"], strict=True):
                    y = np.frombuffer(raw, np.uint8).reshape(len(own), n_models)
                    right, seen = (y == 1).astype(float), (y < 2).astype(float)
                    g = guess[own]
                    if first:
                        new = em.start(right.sum(axis=1) / np.maximum(seen.sum(axis=1), 1), g)
                    else:
                        new = em.m_step(seen @ post, right @ post, x, a[own], d[own], c[own], g)
                    p = em.probability(x, *new)
                    share = right.T @ np.log(p) + (seen - right).T @ np.log(1 - p)
                    yield pd.DataFrame({"items": [own], "params": [np.column_stack(new).tobytes()], "share": [share.tobytes()]})

        params, sums = np.zeros((len(ids), 3)), np.zeros((n_models, em.NODES))
        found = packed.mapInPandas(run, "items array<bigint>, params binary, share binary").toArrow()
        # one order of addition, whatever order the tasks end in
        for own, new, share in sorted(zip(*[found.column(k).to_pylist() for k in range(3)], strict=True)):
            params[own] = np.frombuffer(new).reshape(-1, 3)
            sums += np.frombuffer(share).reshape(n_models, em.NODES)
        return params, sums

    params, sums = job(sc.broadcast(((None,) * 3, None)), True)
    old, converged, k = -np.inf, False, 0
    post, each = em.posterior(sums, 0.0, lw)
    for k in range(1, most + 1):
        total = float(each.sum())
        state = sc.broadcast((tuple(params.T), post))
        new, sums = job(state, False)
        state.unpersist()
        moved = np.abs(new - params).max(initial=0.0)
        params = new
        post, each = em.posterior(sums, 0.0, lw)
        if moved < tolerance or 0 <= total - old < 1e-8 * abs(total):
            converged = True
            break
        old = total
    theta = post @ x
    a, d, c = params.T
    b = em.difficulty(a, d)
    table = pd.DataFrame({"item_id": ids, "a": a, "b": b, "c": c, "difficulty_unidentified": np.abs(a) < 0.05, "iterations": k, "converged": converged})
    abilities = pd.DataFrame({"model_id": names, "theta": theta, "se": np.sqrt(np.maximum(post @ (x * x) - theta**2, 0))})
    return Fitted(spark.createDataFrame(table), spark.createDataFrame(abilities), k, converged, float(each.sum()))


def matrix(responses: DataFrame) -> tuple[list, list, np.ndarray]:
    """Models, items and the answers with NaN holes; the size is checked first."""
    shape = responses.agg(F.count_distinct("model_id").alias("m"), F.count_distinct("item_id").alias("i")).first()
    checked(8 * shape["m"] * shape["i"], "the response matrix")
    wide = responses.toPandas().pivot(index="model_id", columns="item_id", values="correct").sort_index()
    wide = wide[sorted(wide.columns)]
    return wide.index.tolist(), wide.columns.tolist(), wide.to_numpy(dtype=float)


def adaptive_paths(responses: DataFrame, bank: DataFrame, most: int = 30, top: int = 1) -> DataFrame:
    """model_id, step, item_id, theta, se: one kernel call for each model."""
    b = bank.orderBy("item_id").toPandas()
    checked(40 * len(b), "the bank")
    names = sorted(b["benchmark"].unique())
    strata = b["benchmark"].map({v: k for k, v in enumerate(names)}).to_numpy()
    shared = responses.sparkSession.sparkContext.broadcast((b["item_id"].to_numpy(), b["a"].to_numpy(), b["b"].to_numpy(), b["c"].to_numpy(), strata, np.bincount(strata) / len(b)))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, a, bb, c, s, w = shared.value
        answers = pd.Series(f["correct"].to_numpy(dtype=float), index=f["item_id"]).reindex(ids).to_numpy()
        model = int(f["model_id"].iloc[0])
        path = cat.adaptive_order(answers, a, bb, c, s, w, most, top, seed=model)
        return pd.DataFrame([(model, k + 1, int(ids[i]), t, e) for k, (i, t, e) in enumerate(path)], columns=["model_id", "step", "item_id", "theta", "se"])

    return responses.groupBy("model_id").applyInPandas(run, "model_id bigint, step int, item_id bigint, theta double, se double")


def leave_one_out(responses: DataFrame, benchmark_of: dict, budgets: tuple[int, ...] = (5, 10, 20), rounds: int = 15, held: list | None = None) -> DataFrame:
    """model_id, method, n, estimate, se for each held-out model (all, if none are named):
    the bank is refitted without it from the whole panel's fit, then ranked by the adaptive
    test, by scoring a random and a stratified subset, and by a random subset's plain
    average. A model that runs out of items keeps its last estimate. One task for each model."""
    names, ids, y = matrix(responses)
    spark = responses.sparkSession
    held = names if held is None else held
    base = em.fit_matrix(np.nan_to_num(y), ~np.isnan(y), most=200)
    kinds = sorted(set(benchmark_of.values()))
    strata = np.array([kinds.index(benchmark_of[i]) for i in ids])
    shared = spark.sparkContext.broadcast((names, y, (base.a, base.d, base.c), strata))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, y, begin, strata = shared.value
        weights = np.bincount(strata) / len(strata)
        for f in frames:
            out = []
            for m in f["model_id"]:
                row = names.index(m)
                rest = np.arange(len(names)) != row
                fit = em.fit_matrix(np.nan_to_num(y[rest]), ~np.isnan(y[rest]), most=rounds, begin=begin)
                b = em.difficulty(fit.a, fit.d)
                rng = np.random.default_rng(int(m))
                path = cat.adaptive_order(y[row], fit.a, b, fit.c, strata, weights, max(budgets), 5, seed=int(m))
                there = np.flatnonzero(~np.isnan(y[row]))
                for n in budgets:
                    if path:
                        out.append((m, "adaptive", n, *path[min(n, len(path)) - 1][1:]))
                    some = rng.permutation(there)[:n]
                    out.append((m, "random", n, *cat.scored(y[row], some, fit.a, b, fit.c)))
                    if len(some):
                        out.append((m, "random_raw", n, float(y[row][some].mean()), None))
                    out.append((m, "stratified", n, *cat.scored(y[row], cat.stratified(there, n, strata, weights, b, rng), fit.a, b, fit.c)))
            yield pd.DataFrame(out, columns=["model_id", "method", "n", "estimate", "se"])

    todo = spark.createDataFrame([(m,) for m in held], "model_id bigint").repartition(min(max(len(held), 1), 64), "model_id")
    return todo.mapInPandas(run, "model_id bigint, method string, n int, estimate double, se double")


def validate(cells: DataFrame, bank: DataFrame, budgets: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Does a bank fitted on other models rank these, from how few items and for how much?
    cells: model_id, item_id, correct, cost_usd; bank: item_id, benchmark, a, b, c. Nothing is
    refitted. Over the items that every model answered: model_id, method (all, adaptive,
    random, random_raw, stratified), n, estimate, se, usd of exactly those cells (an uncosted
    one adds nothing) and truth, the model's accuracy."""
    b = bank.orderBy("item_id").toPandas()
    checked(48 * len(b), "the bank")
    kinds = sorted(b["benchmark"].unique())
    b["stratum"] = b["benchmark"].map({v: k for k, v in enumerate(kinds)})
    shared = cells.sparkSession.sparkContext.broadcast(b)
    frame = common_items(cells.join(bank.select("item_id"), "item_id", "left_semi"))
    rows = restrict(cells, frame).select("model_id", "item_id", "correct", "cost_usd")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        both = shared.value.merge(f, on="item_id").sort_values("item_id")
        y, a, d, c, strata = (both[k].to_numpy() for k in ("correct", "a", "b", "c", "stratum"))
        y, usd, m = y.astype(float), both["cost_usd"].fillna(0.0).to_numpy(dtype=float), int(f["model_id"].iloc[0])
        strata = np.unique(strata, return_inverse=True)[1]
        weights, there, rng, truth = np.bincount(strata) / len(strata), np.arange(len(y)), np.random.default_rng(m), float(y.mean())
        out = [(m, "all", len(y), *cat.scored(y, there, a, d, c), float(usd.sum()), truth)]
        path = cat.adaptive_order(y, a, d, c, strata, weights, max(budgets), 5, seed=m)
        for n in (n for n in budgets if n <= len(y)):
            out.append((m, "adaptive", n, *path[n - 1][1:], float(usd[[i for i, *_ in path[:n]]].sum()), truth))
            some, spread = rng.permutation(there)[:n], cat.stratified(there, n, strata, weights, d, rng)
            out.append((m, "random", n, *cat.scored(y, some, a, d, c), float(usd[some].sum()), truth))
            out.append((m, "random_raw", n, float(y[some].mean()), None, float(usd[some].sum()), truth))
            out.append((m, "stratified", n, *cat.scored(y, spread, a, d, c), float(usd[spread].sum()), truth))
        return pd.DataFrame(out, columns=["model_id", "method", "n", "estimate", "se", "usd", "truth"])

    return rows.groupBy("model_id").applyInPandas(run, "model_id bigint, method string, n int, estimate double, se double, usd double, truth double")


def half_fits(responses: DataFrame, abilities: DataFrame, least: int = 25, most: int = 120) -> DataFrame:
    """The items as the weaker and the stronger half of the panel show them: for each half
    its models and items (of `least` answers in it), median slope, shares of slopes under
    0.3 and 0, and whether its fit converged."""
    spark = responses.sparkSession
    n = abilities.count()
    ranks = abilities.withColumn("place", F.row_number().over(W.orderBy("theta", "model_id")))  # a row for each model
    out = []
    for name, side in (("weaker", F.col("place") <= n // 2), ("stronger", F.col("place") > n // 2)):
        rows = responses.join(ranks.where(side).select("model_id"), "model_id", "left_semi")
        kept = restrict(rows, item_floor(rows, least))
        if not kept.limit(1).count():
            continue
        found = fit(kept, most=most)
        s = found.params.agg(F.count(F.lit(1)), F.median("a"), F.avg((F.col("a") < 0.3).cast("int")), F.avg((F.col("a") < 0).cast("int"))).first()
        out.append((name, rows.select("model_id").distinct().count(), *s, found.converged))
    return spark.createDataFrame(out, "half string, n_models bigint, n_items bigint, median_a double, share_low double, share_negative double, converged boolean")


def benchmark_abilities(responses: DataFrame, items: DataFrame, least_items: int = 50, least_answers: int = 25, most: int = 120) -> DataFrame:
    """benchmark, model_id, theta, n: a fit of its own for each benchmark of `least_items`
    items; null for a model with fewer than `least_answers` answers there. One loop step for
    each benchmark: they are a few dozen by name."""
    sizes = items.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_items)
    out = responses.sparkSession.createDataFrame([], "benchmark string, model_id bigint, theta double, n bigint")
    for name in sorted(r["benchmark"] for r in sizes.toLocalIterator()):
        rows = restrict(responses, items.where(F.col("benchmark") == name))
        n = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
        found = fit(rows, most=most).abilities.join(n, "model_id")
        out = out.unionByName(found.select(F.lit(name).alias("benchmark"), "model_id", F.when(F.col("n") >= least_answers, F.col("theta")).alias("theta"), "n"))
    return out


def kendall_bootstrap(rows: DataFrame, x: str, y: str, draws: int = 2000, seed: int = 5) -> DataFrame:
    """tau with its percentile interval over resampled rows (models: few)."""
    f = rows.select("model_id", x, y).orderBy("model_id").toPandas()
    checked(24 * len(f), "the models")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((f[x].to_numpy(dtype=float), f[y].to_numpy(dtype=float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = shared.value
        for g in frames:
            weights = (np.bincount(np.random.default_rng([seed, int(k)]).integers(len(u), size=len(u)), minlength=len(u)) for k in g["id"])
            yield pd.DataFrame({"tau": [cat.kendall(u, v, w) for w in weights]})

    taus = spark.range(draws).repartition(8).mapInPandas(run, "tau double").where(~F.isnan("tau"))
    point = cat.kendall(*shared.value)
    return taus.agg(F.lit(point).alias("tau"), F.expr("percentile(tau, 0.025)").alias("lo"), F.expr("percentile(tau, 0.975)").alias("hi"), F.count(F.lit(1)).alias("draws"))


def bootstrap_items(responses: DataFrame, draws: int = 200, rounds: int = 60, seed: int = 3) -> DataFrame:
    """Spread of item parameters over refits to resampled models; one task for each draw."""
    names, ids, y = matrix(responses)
    spark = responses.sparkSession
    shared = spark.sparkContext.broadcast(y)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            for k in g["id"]:
                z = shared.value[np.random.default_rng([seed, int(k)]).integers(len(shared.value), size=len(shared.value))]
                fit = em.fit_matrix(np.nan_to_num(z), ~np.isnan(z), most=rounds)
                yield pd.DataFrame({"item_id": ids, "a": fit.a, "b": em.difficulty(fit.a, fit.d)})

    out = spark.range(draws).repartition(min(draws, 64), "id").mapInPandas(run, "item_id bigint, a double, b double")
    return out.groupBy("item_id").agg(F.stddev_pop("a").alias("sd_a"), F.stddev_pop("b").alias("sd_b"), F.count(F.lit(1)).alias("draws"))


def logistic_dif(responses: DataFrame, abilities: DataFrame, groups: DataFrame) -> DataFrame:
    both = responses.join(abilities, "model_id").join(groups.select("model_id", "focal"), "model_id")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("model_id")
        u, n = stats.logistic_dif(f["theta"].to_numpy(), f["focal"].to_numpy(dtype=float), f["correct"].to_numpy(dtype=float))
        return pd.DataFrame([(f["item_id"].iloc[0], u, n, len(f))], columns=["item_id", "uniform_p", "nonuniform_p", "n"])

    return both.groupBy("item_id").applyInPandas(run, "item_id bigint, uniform_p double, nonuniform_p double, n bigint")


def parallel_analysis(rows: DataFrame, draws: int = 20) -> DataFrame:
    """rows: benchmark, model_id, item_id, correct over complete cases. Eigenvalues
    beside the 95th percentile of permuted columns'; one task for each benchmark and draw."""
    cases = rows.select("benchmark", "model_id", "item_id", "correct")
    many = cases.crossJoin(F.broadcast(cases.sparkSession.range(-1, draws).withColumnRenamed("id", "draw")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        wide = f.pivot(index="model_id", columns="item_id", values="correct").sort_index().to_numpy(dtype=float)
        draw = int(f["draw"].iloc[0])
        found = stats.eigenvalues(wide if draw < 0 else stats.permuted(wide, draw))
        return pd.DataFrame({"benchmark": f["benchmark"].iloc[0], "draw": draw, "place": range(1, len(found) + 1), "value": found})

    values = many.groupBy("benchmark", "draw").applyInPandas(run, "benchmark string, draw int, place int, value double")
    return values.groupBy("benchmark", "place").agg(F.max(F.when(F.col("draw") < 0, F.col("value"))).alias("eigenvalue"), F.expr("percentile(CASE WHEN draw >= 0 THEN value END, 0.95)").alias("chance_p95"))


@F.pandas_udf(T.DoubleType())
def tetrachoric_exact(n11: pd.Series, n10: pd.Series, n01: pd.Series, n00: pd.Series) -> pd.Series:
    return pd.Series([stats.tetrachoric(*v) for v in zip(n11, n10, n01, n00, strict=True)])


def ability_mle(responses: DataFrame, params: DataFrame) -> DataFrame:
    both = responses.join(params, "item_id")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item_id")
        return pd.DataFrame([(f["model_id"].iloc[0], cat.mle(*(f[q].to_numpy(dtype=float) for q in ("correct", "a", "b", "c"))))], columns=["model_id", "theta"])

    return both.groupBy("model_id").applyInPandas(run, "model_id bigint, theta double")


def dense_block(responses: DataFrame, least: float = 0.98, share: float = 0.05, rounds: int = 60) -> DataFrame:
    """Peels the sparsest models or items (those at or under the 5 % quantile of the
    sparser side) until the rest is dense; returns the rest's cells."""
    rows = responses.select("model_id", "item_id", "correct")
    for _ in range(rounds):
        rows = stored(rows, "block")
        by = {k: rows.groupBy(k).agg(F.count(F.lit(1)).alias("n")) for k in ("model_id", "item_id")}
        low = {k: v.agg(F.count(F.lit(1)).alias("size"), F.expr(f"percentile(n, {share})").alias("q"), F.sum("n").alias("cells"), F.min("n").alias("least")).first() for k, v in by.items()}
        m, i = low["model_id"], low["item_id"]
        if not m["size"] or m["cells"] >= least * m["size"] * i["size"]:
            break
        side = "model_id" if m["least"] / i["size"] <= i["least"] / m["size"] else "item_id"
        rows = rows.join(by[side].where(F.col("n") > low[side]["q"]).select(side), side, "left_semi")
    return rows


def stratified_panel(models: DataFrame, size: int, strata: int = 5, most_by_owner: int = 3) -> DataFrame:
    """models: model_id, owner, average. Equal-width bands of the average take turns;
    an owner gives at most so many. The turn order is sequential, and a panel is small."""
    f = models.orderBy("model_id").toPandas()
    checked(100 * len(f), "the candidates")
    low, high = f["average"].min(), f["average"].max()
    f["band"] = np.minimum(((f["average"] - low) / max((high - low) / strata, 1e-12)).astype(int), strata - 1)
    queues = [g.sort_values(["average", "model_id"], ascending=[False, True]).to_dict("records") for _, g in f.groupby("band")]
    given: dict = {}
    chosen = []
    while len(chosen) < size and any(queues):
        for q in queues:
            while q and given.get(q[0]["owner"], 0) >= most_by_owner:
                q.pop(0)
            if q and len(chosen) < size:
                pick = q.pop(0)
                given[pick["owner"]] = given.get(pick["owner"], 0) + 1
                chosen.append((int(pick["model_id"]), pick["owner"], float(pick["average"]), int(pick["band"])))
    return models.sparkSession.createDataFrame(chosen, "model_id bigint, owner string, average double, band int")
