"""The queries of plans.queries as DuckDB SQL over the raw tables."""

from __future__ import annotations


def _administrations(items: int) -> str:
    return f"""(SELECT model_id, item_id, row_number() OVER (PARTITION BY model_id, item_id ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate, l_tax) AS rep,
      CAST(('0x' || substr(h, 1, 8))::BIGINT / 4294967296e0 < 1 / (1 + exp(-((0.4e0 + (item_id * 17 % {items}) / {items}e0 * 1.6e0)
        * (((model_id * 53 % 150) / 150e0 * 4 - 2) - ((item_id * 37 % {items}) / {items}e0 * 3 - 1.5e0))))) AS INT) AS correct,
      l_returnflag AS template, l_linenumber % 4 AS rotation, l_extendedprice * l_tax / 1e6 AS cost_usd, l_shipdate AS ts
    FROM (SELECT *, o_custkey % 150 AS model_id, l_partkey % {items} AS item_id,
            md5(concat_ws('|', o_custkey % 150, l_partkey % {items}, l_orderkey, l_linenumber)) AS h
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def _params(items: int, guessing: bool = False) -> str:
    c = f"(i * 13 % {items}) / {items}e0 * 0.25e0" if guessing else "0e0"
    return f"(SELECT i AS item_id, 0.4e0 + (i * 17 % {items}) / {items}e0 * 1.6e0 AS a, (i * 37 % {items}) / {items}e0 * 3 - 1.5e0 AS b, {c} AS c FROM range({items}) t(i))"


def _items(n: int) -> str:
    return f"(SELECT i AS item_id, 'b' || (i % 5) AS benchmark, CASE WHEN i % 5 = 4 THEN 'free_response' ELSE 'multiple_choice' END AS kind FROM range({n}) t(i))"


VIEWS = {
    "adm": _administrations(200),
    "cells": "(SELECT model_id, item_id, sum(correct)::BIGINT AS k, count(*) AS n FROM adm GROUP BY ALL)",
    "responses": "(SELECT model_id, item_id, CAST(2 * k > n AS INT) AS correct, n FROM cells WHERE 2 * k <> n)",
    "adm60": _administrations(60),
    "dense": "(SELECT model_id, item_id, correct FROM adm60 WHERE rep = 1)",
    "params": _params(200),
    "params60": _params(60),
    "params3": _params(200, True),
    "items": _items(200),
    "items60": _items(60),
    "abilities": "(SELECT i AS model_id, (i * 53 % 150) / 150e0 * 4 - 2 AS theta FROM range(150) t(i))",
    "models": "(SELECT o_custkey % 150 AS model_id, CASE o_custkey % 150 % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'limited' ELSE 'closed' END AS access, strftime(min(o_orderdate), '%Y-%m-%d') AS release_date FROM orders GROUP BY ALL)",
    "quad": "(SELECT q, x, -x * x / 2 - ln(sum(exp(-x * x / 2)) OVER ()) AS lw FROM (SELECT i AS q, -4.5e0 + 0.15e0 * i AS x FROM range(61) t(i)))",
    "lp": "(SELECT item_id, q, ln(p) AS lp1, ln(1 - p) AS lp0 FROM (SELECT item_id, q, least(greatest(1 / (1 + exp(-(a * (x - b)))), 1e-10), 1 - 1e-10) AS p FROM params60, quad))",
    "post": """(SELECT model_id, q, x, e / sum(e) OVER (PARTITION BY model_id) AS post, top + ln(sum(e) OVER (PARTITION BY model_id)) AS loglik FROM (
        SELECT *, exp(l - top) AS e FROM (SELECT *, max(l) OVER (PARTITION BY model_id) AS top FROM (
          SELECT model_id, q, x, s + lw AS l FROM (SELECT model_id, q, sum(CASE WHEN correct = 1 THEN lp1 ELSE lp0 END) AS s FROM dense JOIN lp USING (item_id) GROUP BY ALL) JOIN quad USING (q)))))""",
    "eap": "(SELECT model_id, t AS theta, sqrt(greatest(s - t * t, 0)) AS se, loglik FROM (SELECT model_id, sum(post * x) AS t, sum(post * x * x) AS s, max(loglik) AS loglik FROM post GROUP BY ALL))",
    "res": "(SELECT *, (correct - p) / sqrt(p * (1 - p)) AS z FROM (SELECT model_id, item_id, correct, theta, a, least(greatest(1 / (1 + exp(-(a * (theta - b)))), 1e-6), 1 - 1e-6) AS p FROM dense JOIN abilities USING (model_id) JOIN params60 USING (item_id)))",
    "edges": "(SELECT quantile_cont(theta, 0.2) AS e1, quantile_cont(theta, 0.4) AS e2, quantile_cont(theta, 0.6) AS e3, quantile_cont(theta, 0.8) AS e4 FROM abilities)",
    "binned": "(SELECT model_id, theta, (theta > e1)::INT + (theta > e2)::INT + (theta > e3)::INT + (theta > e4)::INT AS bin FROM abilities, edges)",
    "curve": "(SELECT item_id, bin, count(*) AS n, avg(correct) AS proportion FROM dense JOIN binned USING (model_id) GROUP BY ALL)",
    "drops": "(SELECT item_id, greatest(coalesce(max(CASE WHEN bin = bin0 + 1 THEN before - proportion END), 0), 0) AS drop, min(n) AS least_n, count(*) AS n_bins FROM (SELECT *, lag(proportion) OVER w AS before, lag(bin) OVER w AS bin0 FROM curve WINDOW w AS (PARTITION BY item_id ORDER BY bin)) GROUP BY ALL)",
    "fit": "(SELECT item_id, count(*) AS n, sum((correct - p) ** 2) / sum(p * (1 - p)) AS infit, avg((correct - p) ** 2 / (p * (1 - p))) AS outfit FROM res GROUP BY ALL)",
    "bis": "(SELECT item_id, count(*) AS n, avg(correct) AS proportion, CASE WHEN stddev_pop(correct) > 1e-9 AND stddev_pop(theta) > 1e-9 THEN corr(theta, correct) END AS r FROM dense JOIN abilities USING (model_id) GROUP BY ALL)",
    "auc": "(SELECT item_id, sum(correct)::BIGINT AS n1, sum(1 - correct)::BIGINT AS n0, sum(correct * below)::DOUBLE / nullif(sum(correct) * sum(1 - correct), 0) AS auc FROM (SELECT *, sum(1 - correct) OVER (PARTITION BY item_id ORDER BY theta, model_id ROWS UNBOUNDED PRECEDING) AS below FROM dense JOIN abilities USING (model_id)) GROUP BY ALL)",
    "flagged": """(SELECT item_id, coalesce(auc >= 1, false) AS perfect_separation, a < 0 AS negative_slope, a >= 0 AND a < 0.3 AS low_slope, outfit > 1.3 AS underfit, outfit < 0.7 AS overfit,
        least_n >= 5 AND drop > 0.15 AS non_monotone, proportion > 0.99 AS too_easy, proportion < 0.01 AS too_hard,
        a * a * (1 / (1 + exp(a * b))) * (1 - 1 / (1 + exp(a * b))) < 0.01 AS no_information
        FROM params60 JOIN fit USING (item_id) JOIN bis USING (item_id) JOIN auc USING (item_id) JOIN drops USING (item_id))""",
}

BODIES: dict[str, str] = {
    "collapse_repeats": "SELECT * FROM responses",
    "repeat_agreement": "SELECT count(*) FILTER (n > 1) AS repeated_cells, round(coalesce(count(*) FILTER (n > 1 AND (k = 0 OR k = n))::DOUBLE / nullif(count(*) FILTER (n > 1), 0), 1), 6) AS agreement, count(*) FILTER (2 * k = n) AS tied_cells FROM cells",
    "full_suite_scores": "SELECT model_id, count(*) AS n, round(avg(correct), 6) AS score FROM responses GROUP BY ALL",
    "response_floor": "SELECT item_id, count(*) AS n_models FROM responses GROUP BY ALL HAVING count(*) >= 40",
    "semi_join_restrict": "SELECT model_id, count(*) AS n_items FROM responses WHERE item_id IN (SELECT item_id FROM responses GROUP BY item_id HAVING count(*) >= 110) GROUP BY ALL",
    "resume_anti_join": "SELECT model_id, count(*) AS n_left FROM (SELECT DISTINCT model_id, item_id FROM adm WHERE rotation = 1 AND (model_id, item_id) NOT IN (SELECT (model_id, item_id) FROM adm WHERE rotation = 2)) GROUP BY ALL",
    "common_frame": "SELECT item_id, count(DISTINCT model_id) AS n_models FROM dense GROUP BY ALL HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM dense)",
    "initial_items": "SELECT item_id, 1e0 AS a, round(least(greatest(-ln(p / (1 - p)), -6), 6), 6) + 0 AS b FROM (SELECT item_id, least(greatest(avg(correct), 0.02), 0.98) AS p FROM responses GROUP BY ALL)",
    "eap_ability": "SELECT model_id, round(theta, 4) + 0 AS theta, round(se, 4) AS se, round(loglik, 4) AS loglik FROM eap",
    "eap_interval": """SELECT model_id, round(coalesce(min_by(v, q) FILTER (f >= 0.025), max(x)), 4) AS lo, round(coalesce(min_by(w, q) FILTER (f >= 0.975), max(x)), 4) AS hi FROM (
        SELECT *, CASE WHEN f0 IS NULL THEN x ELSE x0 + (0.025 - f0) / nullif(f - f0, 0) * (x - x0) END AS v, CASE WHEN f0 IS NULL THEN x ELSE x0 + (0.975 - f0) / nullif(f - f0, 0) * (x - x0) END AS w FROM (
          SELECT *, lag(f) OVER (PARTITION BY model_id ORDER BY q) AS f0, lag(x) OVER (PARTITION BY model_id ORDER BY q) AS x0 FROM (
            SELECT *, sum(post) OVER (PARTITION BY model_id ORDER BY q ROWS UNBOUNDED PRECEDING) AS f FROM post))) GROUP BY ALL""",
    "ability_scores": "SELECT model_id, round(theta, 4) + 0 AS theta, round(se, 4) AS se, count(*) AS n, round(avg(correct), 6) AS score FROM eap JOIN dense USING (model_id) GROUP BY model_id, theta, se",
    "p_correct": "SELECT item_id, t::BIGINT AS grid, round(c + (1 - c) / (1 + exp(-(a * (t / 2e0 - b)))), 6) AS p FROM params3, range(-6, 7) g(t)",
    "fisher_information": "SELECT item_id, t::BIGINT AS grid, round(a * a * (1 - p) / p * ((p - c) / (1 - c)) ** 2, 6) AS information FROM (SELECT *, c + (1 - c) / (1 + exp(-(a * (t / 2e0 - b)))) AS p FROM params3, range(-6, 7) g(t))",
    "test_information": "SELECT t::BIGINT AS grid, round(sum(a * a * (1 - p) / p * ((p - c) / (1 - c)) ** 2), 4) AS information FROM (SELECT *, c + (1 - c) / (1 + exp(-(a * (t / 2e0 - b)))) AS p FROM params3, range(-6, 7) g(t)) GROUP BY ALL",
    "tcc": "SELECT t::BIGINT AS grid, round(avg(c + (1 - c) / (1 + exp(-(a * (t / 2e0 - b))))), 6) AS expected_score FROM params3, range(-6, 7) g(t) GROUP BY ALL",
    "residuals": "SELECT model_id, item_id, round(z, 5) + 0 AS z FROM res",
    "item_infit_outfit": "SELECT item_id, n, round(infit, 5) AS infit, round(outfit, 5) AS outfit FROM fit",
    "point_biserial": "SELECT item_id, n, round(proportion, 6) AS proportion, round(r, 5) + 0 AS r FROM bis",
    "empirical_curve": "SELECT item_id, bin, n, round(proportion, 6) AS proportion FROM curve",
    "monotone_drop": "SELECT item_id, round(drop, 6) AS fall, least_n, n_bins FROM drops",
    "separation_auc": "SELECT item_id, n1, n0, round(auc, 6) AS auc FROM auc",
    "item_flags": "SELECT * FROM flagged",
    "flags_by_benchmark": "SELECT benchmark, count(*) AS n_items, " + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in "perfect_separation negative_slope low_slope underfit overfit non_monotone too_easy too_hard no_information".split()) + " FROM flagged JOIN items60 USING (item_id) GROUP BY ROLLUP (benchmark)",
}

MH = """(SELECT split, item_id, n_reference, n_focal,
      CASE WHEN ad > 0 AND bc > 0 THEN -2.35 * ln(ad / bc) END AS delta, CASE WHEN v > 0 THEN (abs(a - e) - 0.5) ** 2 / v END AS chi2
    FROM (SELECT split, item_id, count(*) FILTER (NOT focal) AS n_reference, count(*) FILTER (focal) AS n_focal FROM dense JOIN binned USING (model_id) JOIN groups USING (model_id) GROUP BY ALL)
    LEFT JOIN (SELECT split, item_id, sum(a * d / n) AS ad, sum(b * c / n) AS bc, sum(a) AS a, sum((a + b) * (a + c) / n) AS e, sum(v) AS v FROM (
    SELECT *, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * greatest(n - 1, 1)) AS v FROM (
      SELECT *, a + b + c + d AS n FROM (
        SELECT split, item_id, bin, count(*) FILTER (NOT focal AND correct = 1)::DOUBLE AS a, count(*) FILTER (NOT focal AND correct = 0)::DOUBLE AS b,
               count(*) FILTER (focal AND correct = 1)::DOUBLE AS c, count(*) FILTER (focal AND correct = 0)::DOUBLE AS d
        FROM dense JOIN (SELECT *, count(*) FILTER (focal) OVER p AS f, count(*) FILTER (NOT focal) OVER p AS r FROM binned JOIN groups USING (model_id) WINDOW p AS (PARTITION BY split, bin)) USING (model_id)
        WHERE f > 0 AND r > 0 GROUP BY ALL)) WHERE a + b >= 2 AND c + d >= 2) GROUP BY ALL) USING (split, item_id))"""
_FIT = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _tail(x: str) -> str:
    root = f"sqrt(({x}) / 2)"
    t, poly = f"(1e0 / (1 + 0.5e0 * {root}))", f"{_FIT[-1]}e0"
    for k in reversed(_FIT[:-1]):
        poly = f"({k}e0 + {t} * {poly})"
    return f"{t} * exp(-({x}) / 2 + {poly})"


def _binomial(k: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN least(1, 2 * list_sum([exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) - {n} * ln(2)) for j in range(0, least({k}, {n} - {k}) + 1)])) END"


VIEWS |= {
    "groups_true": "(SELECT 'planted' AS split, i AS model_id, i % 2 = 1 AS focal FROM range(150) t(i))",
    "mh_true": MH.replace("groups", "groups_true"),
    "groups_date": "(SELECT 'after 1995-01' AS split, model_id, substr(release_date, 1, 7) > '1995-01' AS focal FROM models WHERE release_date <> '')",
    "mh_date": MH.replace("groups", "groups_date"),
    "res_b": "(SELECT benchmark, model_id, item_id, z, correct FROM res JOIN items60 USING (item_id))",
    "sizes_b": "(SELECT benchmark, count(DISTINCT item_id) AS n_items FROM res_b GROUP BY ALL)",
    "whole": "(SELECT benchmark, model_id FROM (SELECT benchmark, model_id, count(DISTINCT item_id) AS k FROM res_b GROUP BY ALL) JOIN sizes_b USING (benchmark) WHERE k = n_items)",
    "full_res": "(SELECT res_b.* FROM res_b JOIN whole USING (benchmark, model_id))",
    "pairs": "(SELECT x.benchmark, x.item_id AS i, y.item_id AS j, count(*) AS n, CASE WHEN stddev_pop(x.z) > 1e-9 AND stddev_pop(y.z) > 1e-9 THEN corr(x.z, y.z) END AS q3, count(*) FILTER (x.correct = 1 AND y.correct = 1) AS n11, count(*) FILTER (x.correct = 0 AND y.correct = 0) AS n00, count(*) FILTER (x.correct = 1 AND y.correct = 0) AS n10, count(*) FILTER (x.correct = 0 AND y.correct = 1) AS n01 FROM full_res x JOIN full_res y ON x.benchmark = y.benchmark AND x.model_id = y.model_id AND x.item_id < y.item_id GROUP BY ALL HAVING count(*) >= 20)",
    "q3s": "(SELECT benchmark, count(*) AS n_pairs, avg(q3) AS mean, stddev_pop(q3) AS sd, quantile_cont(q3, 0.95) AS p95, max(q3) AS max, avg((q3 > 0.2)::INT) AS share_above FROM pairs WHERE q3 IS NOT NULL GROUP BY ALL)",
    "edges_q": "(SELECT i, j, q3 FROM pairs WHERE q3 > 0.15)",
    "score_b": "(SELECT model_id, benchmark, avg(correct) AS theta FROM dense JOIN items60 USING (item_id) GROUP BY ALL)",
    "truth": "(SELECT model_id, avg(correct) AS score, theta FROM dense JOIN abilities USING (model_id) GROUP BY ALL)",
    "rates": "(SELECT item_id, avg(correct) AS y, b AS x FROM responses JOIN params USING (item_id) GROUP BY item_id, b)",
    "banks": "(SELECT params60.item_id, params60.a AS a1, params60.b AS b1, p.a AS a2, p.b AS b2 FROM params60 JOIN params p USING (item_id))",
    "first_a": "(SELECT * FROM adm WHERE rep = 1)",
    "second_a": "(SELECT * FROM adm WHERE rep = 2)",
    "retests": """(SELECT *, 100e0 * (up - down) / n AS net_points FROM (SELECT model_id, count(*) AS n, avg((x.correct = y.correct)::INT) AS agreement,
        CASE WHEN stddev_pop(x.correct) > 1e-9 AND stddev_pop(y.correct) > 1e-9 THEN corr(x.correct, y.correct) END AS phi,
        count(*) FILTER (x.correct = 0 AND y.correct = 1) AS up, count(*) FILTER (x.correct = 1 AND y.correct = 0) AS down
        FROM first_a x JOIN second_a y USING (model_id, item_id) GROUP BY ALL))""",
    "tmpl": "(SELECT model_id, item_id, template, min_by(correct, rep) AS correct FROM adm GROUP BY ALL)",
    "rot": "(SELECT model_id, item_id, rotation AS arm, min_by(correct, rep) AS correct FROM adm GROUP BY ALL)",
}
#: Connected items: everything reachable from each, then the smallest.
REACH = """walk(root, item_id) AS (SELECT i, i FROM (SELECT i FROM edges_q UNION SELECT j FROM edges_q)
  UNION SELECT walk.root, n.b FROM walk JOIN (SELECT i AS a, j AS b FROM edges_q UNION ALL SELECT j, i FROM edges_q) n ON walk.item_id = n.a),
reach AS (SELECT min(root) AS root, item_id FROM walk GROUP BY item_id)"""
BODIES |= {
    "mantel_haenszel": f"SELECT split, item_id, n_reference, n_focal, round(delta, 4) + 0 AS delta, round(chi2, 4) AS chi2, round({_tail('chi2')}, 4) AS p FROM mh_true",
    "dif_summary": f"SELECT split, count(*) AS n_items, count(*) FILTER (abs(delta) > 1.5 AND {_tail('chi2')} < 0.01) AS n_flagged, round(median(abs(delta)), 4) AS median_abs_delta FROM mh_true GROUP BY ALL",
    "contamination_dif": f"SELECT split, item_id, n_reference, n_focal, round(delta, 4) + 0 AS delta, round({_tail('chi2')}, 4) AS p FROM mh_date",
    "generation_split": "SELECT model_id, substr(release_date, 1, 7) > (SELECT list_sort(list(substr(release_date, 1, 7)))[count(*) // 2 + 1] FROM models WHERE release_date <> '') AS focal FROM models WHERE release_date <> ''",
    "q3_pairs": "SELECT benchmark, i, j, n, round(q3, 5) + 0 AS q3 FROM pairs",
    "q3_summary": "SELECT benchmark, n_pairs, round(mean, 5) + 0 AS mean, round(sd, 5) AS sd, round(p95, 5) + 0 AS p95, round(max, 5) AS largest, round(share_above, 5) AS share_above FROM q3s",
    "dependence_design_effect": "SELECT benchmark, n, round(1 + greatest(n - 1, 0) * greatest(mean, 0), 5) AS design_effect, round(n / (1 + greatest(n - 1, 0) * greatest(mean, 0)), 4) AS effective_items FROM q3s JOIN (SELECT benchmark, count(*) AS n FROM items60 GROUP BY ALL) USING (benchmark)",
    "dependent_blocks": "SELECT r.root AS block_id, r.item_id, count(*) OVER (PARTITION BY r.root) AS size, round((SELECT max(q3) FROM edges_q e JOIN reach r2 ON e.i = r2.item_id WHERE r2.root = r.root), 5) AS max_value FROM reach r",
    "tetrachoric_pairs": "SELECT benchmark, i, j, n, round(least(greatest((u - 1) / (u + 1), -0.999), 0.999), 5) + 0 AS rho FROM (SELECT *, ((n11 + 0.5) * (n00 + 0.5) / ((n10 + 0.5) * (n01 + 0.5))) ** 0.75 AS u FROM pairs)",
    "ability_correlations": "SELECT x.benchmark AS b1, y.benchmark AS b2, count(*) AS n, round(CASE WHEN count(*) >= 5 AND stddev_pop(x.theta) > 1e-9 AND stddev_pop(y.theta) > 1e-9 THEN corr(x.theta, y.theta) END, 5) AS r FROM score_b x JOIN score_b y ON x.model_id = y.model_id AND x.benchmark < y.benchmark GROUP BY ALL",
    "kendall_tau": "SELECT count(*) AS pairs, round(sum(sx * sy) / sqrt(sum(abs(sx))::DOUBLE * sum(abs(sy))), 5) AS tau FROM (SELECT sign(x.score - y.score) AS sx, sign(x.theta - y.theta) AS sy FROM truth x JOIN truth y ON x.model_id < y.model_id)",
    "spearman": "SELECT count(*) AS n, round(corr(rx, ry), 5) AS rho FROM (SELECT row_number() OVER (ORDER BY x, item_id) AS rx, row_number() OVER (ORDER BY y, item_id) AS ry FROM rates)",
    "decile_overlap": "SELECT greatest(1, max(n) // 10)::BIGINT AS size, round(count(*) FILTER (rx > n - greatest(1, n // 10) AND ry > n - greatest(1, n // 10)) / greatest(1, max(n) // 10), 5) AS overlap FROM (SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY x, item_id) AS rx, row_number() OVER (ORDER BY y, item_id) AS ry FROM rates)",
    "crossbank_agreement": "SELECT scope, count(*) AS n, round(corr(b1, b2), 5) + 0 AS pearson_b, round(corr(rb1, rb2), 5) + 0 AS spearman_b, round(corr(a1, a2), 5) + 0 AS pearson_a, round(corr(ra1, ra2), 5) + 0 AS spearman_a FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a1, item_id) AS ra1, row_number() OVER (PARTITION BY scope ORDER BY a2, item_id) AS ra2, row_number() OVER (PARTITION BY scope ORDER BY b1, item_id) AS rb1, row_number() OVER (PARTITION BY scope ORDER BY b2, item_id) AS rb2 FROM (SELECT *, 'all' AS scope FROM banks UNION ALL SELECT *, 'working' FROM banks WHERE a1 > 0.3 AND a2 > 0.3)) GROUP BY ALL",
    "retest": f"SELECT model_id, n, round(agreement, 5) AS agreement, round(phi, 5) + 0 AS phi, up, down, round(net_points, 4) + 0 AS net_points, round({_binomial('up', '(up + down)')}, 5) AS p FROM retests",
    "pooled_retest": f"SELECT n_models, round(largest_move, 4) AS largest_move, round(median_move, 4) AS median_move, round(flip_rate, 6) AS flip_rate, up, down, round({_binomial('up', '(up + down)')}, 5) AS p FROM (SELECT count(*) AS n_models, max(abs(net_points)) AS largest_move, median(abs(net_points)) AS median_move, (sum(up) + sum(down)) / sum(n) AS flip_rate, sum(up)::BIGINT AS up, sum(down)::BIGINT AS down FROM retests)",
    "resampling": "SELECT model_id, count(*) AS n, round(avg((x.correct <> y.correct)::INT), 5) AS observed, round(avg(2 * p * (1 - p)), 5) AS predicted FROM first_a x JOIN second_a y USING (model_id, item_id) JOIN (SELECT model_id, item_id, 1 / (1 + exp(-(a * (theta - b)))) AS p FROM abilities, params) USING (model_id, item_id) GROUP BY ALL",
    "position_bias": """SELECT model_id, letters, round(spread, 5) AS spread, round(raw, 5) AS raw, round(noise, 5) AS noise, round(greatest(raw - noise, 0), 5) AS net,
        round(CASE letters WHEN 2 THEN 1.128e0 WHEN 3 THEN 1.693e0 WHEN 4 THEN 2.059e0 WHEN 5 THEN 2.326e0 WHEN 6 THEN 2.534e0 END * sqrt(q * (1 - q) / mean_n), 5) AS floor FROM (
        SELECT *, 1 - q ** k - (1 - q) ** k AS noise FROM (SELECT model_id, avg((answers > 1)::INT) AS raw, avg(k) AS k FROM (SELECT model_id, item_id, count(DISTINCT arm) AS k, count(DISTINCT correct) AS answers FROM rot GROUP BY ALL HAVING count(DISTINCT arm) >= 2) GROUP BY ALL)
        JOIN (SELECT model_id, max(accuracy) - min(accuracy) AS spread, count(*) AS letters, avg(n) AS mean_n FROM (SELECT model_id, arm, count(*) AS n, avg(correct) AS accuracy FROM rot GROUP BY ALL HAVING count(*) >= 30) GROUP BY ALL) USING (model_id), (SELECT (1 - sqrt(1 - 2 * 0.1e0)) / 2 AS q))""",
    "framing": """SELECT model_id, cells, round(item / total, 5) AS item_share, round(template / total, 5) AS template_share, round(greatest(total - item - template, 0) / total, 5) AS interaction_share, round(greatest(cells - n_items - n_templates + 1, 0) * 0.05e0 / total, 5) AS noise_share FROM (
        SELECT model_id, cells, n_items, n_templates, total, n_templates * i.s AS item, n_items * t.s AS template FROM
        (SELECT model_id, count(*) AS cells, count(DISTINCT item_id) AS n_items, count(DISTINCT template) AS n_templates, nullif(var_pop(correct) * count(*), 0) AS total FROM tmpl GROUP BY ALL)
        JOIN (SELECT model_id, sum((x - g) ** 2) AS s FROM (SELECT model_id, item_id, avg(correct) AS x FROM tmpl GROUP BY ALL) JOIN (SELECT model_id, avg(correct) AS g FROM tmpl GROUP BY ALL) USING (model_id) GROUP BY ALL) i USING (model_id)
        JOIN (SELECT model_id, sum((x - g) ** 2) AS s FROM (SELECT model_id, template, avg(correct) AS x FROM tmpl GROUP BY ALL) JOIN (SELECT model_id, avg(correct) AS g FROM tmpl GROUP BY ALL) USING (model_id) GROUP BY ALL) t USING (model_id))""",
}

_U = "('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT / 4294967296e0"


def _u(*parts: str) -> str:
    return _U.format(", ".join(parts))


_OPTIONS = "list_transform([3, 5, 7, 11], lambda k: 'option ' || (item_id * k % 23 + k))"
VIEWS |= {
    "pinfo": "(SELECT item_id, information, row_number() OVER w AS n, avg(information) OVER (ORDER BY information DESC, item_id ROWS UNBOUNDED PRECEDING) AS mean_information FROM (SELECT item_id, a * a * (1 - p) / p * ((p - c) / (1 - c)) ** 2 AS information FROM (SELECT *, c + (1 - c) / (1 + exp(a * b)) AS p FROM params3)) WINDOW w AS (ORDER BY information DESC, item_id))",
    "slope": "(SELECT avg(c + (1 - c) / (1 + exp(-(a * (0.05e0 - b)))) - c - (1 - c) / (1 + exp(-(a * (-0.05e0 - b))))) / 0.1e0 AS slope FROM params3)",
    "orders_by": "(SELECT item_id, 'informative' AS method, row_number() OVER (ORDER BY a DESC, item_id) AS place FROM params60 UNION ALL SELECT item_id, 'plain', item_id + 1 FROM params60)",
    "score_curve": "(SELECT method, n, round(corr(score, theta), 9) AS value FROM (SELECT method, n, model_id, avg(correct) AS score FROM dense JOIN orders_by USING (item_id), (SELECT unnest([5, 10, 20, 40, 60]) AS n) WHERE place <= n GROUP BY ALL) JOIN abilities USING (model_id) GROUP BY ALL)",
    "base_curve": "(SELECT n AS n1, lag(n) OVER (ORDER BY n) AS n0, value AS v1, lag(value) OVER (ORDER BY n) AS v0 FROM score_curve WHERE method = 'plain')",
    "bounds": "(SELECT model_id, round(theta, 6) AS theta, round(theta - 1.959964e0 * se, 6) AS lo, round(theta + 1.959964e0 * se, 6) AS hi FROM eap)",
    "answered": "(SELECT model_id, item_id, benchmark FROM adm60 JOIN items60 USING (item_id) WHERE rep = 1 AND ts < TIMESTAMP '1995-01-01')",
    "used": "(SELECT model_id, benchmark, count(*) AS used FROM answered GROUP BY ALL)",
    "used_all": "(SELECT model_id, count(*) AS total FROM answered GROUP BY ALL)",
    "strata": "(SELECT benchmark, n, row_number() OVER (ORDER BY benchmark) - 1 AS place, n / sum(n) OVER () AS weight FROM (SELECT benchmark, count(*) AS n FROM items GROUP BY ALL))",
    "strata60": "(SELECT benchmark, n / sum(n) OVER () AS weight FROM (SELECT benchmark, count(*) AS n FROM items60 GROUP BY ALL))",
    "seats": "(SELECT benchmark, n, (base + (row_number() OVER (ORDER BY round(exact - base, 9) DESC, benchmark) <= 61 - sum(base) OVER ())::INT)::BIGINT AS seats FROM (SELECT benchmark, n, 61e0 * n / sum(n) OVER () AS exact, floor(61e0 * n / sum(n) OVER ()) AS base FROM (SELECT benchmark, count(*) AS n FROM items GROUP BY ALL)))",
    "counts_nr": "(SELECT item_id, q, sum(post) AS n, sum(post * correct) AS r FROM dense JOIN post USING (model_id) GROUP BY ALL)",
    "em_p": "(SELECT item_id, a, -a * b AS d, x, n, r, least(greatest(1 / (1 + exp(-(a * x - a * b))), 1e-10), 1 - 1e-10) AS p FROM counts_nr JOIN params60 USING (item_id) JOIN quad USING (q))",
    "em_h": "(SELECT item_id, a, d, sum((r - n * p) * x) - (a - 1) AS ga, sum(r - n * p) - d / 16 AS gd, sum(n * p * (1 - p) * x * x) + 1 AS haa, sum(n * p * (1 - p) * x) AS had, sum(n * p * (1 - p)) + 1 / 16e0 AS hdd FROM em_p GROUP BY item_id, a, d)",
    "em_s": "(SELECT *, greatest(haa * hdd - had * had, 1e-10) AS det FROM em_h)",
    "lettered": f"(SELECT item_id, benchmark, kind, {_OPTIONS} AS options, ({_OPTIONS})[item_id % 4 + 1] AS answer FROM items)",
    "posed": "(SELECT item_id, benchmark, item_id % 3 AS task, kind, item_id % 13 = 0 AS withheld, CASE WHEN item_id % 10 = 3 THEN options[1:1] ELSE options END AS options, CASE WHEN item_id % 17 = 0 THEN '' WHEN item_id % 19 = 0 AND kind = 'free_response' THEN 'none' WHEN item_id % 23 = 0 THEN 'elsewhere' ELSE answer END AS answer FROM lettered)",
    "labels_of": "(SELECT benchmark, task, list_sort(list(DISTINCT answer)) AS labels FROM posed WHERE answer <> '' GROUP BY ALL)",
    "listed_words": "(SELECT DISTINCT listed, w FROM (SELECT DISTINCT lower(p_type) AS listed, unnest(string_split_regex(lower(p_type), '[^a-z0-9.]+')) AS w FROM part) WHERE w <> '')",
    "word_weight": "(SELECT w, 1e0 / count(*) AS weight FROM listed_words GROUP BY ALL)",
    "wanted_words": "(SELECT DISTINCT wanted, w FROM (SELECT DISTINCT lower(p_type) AS wanted, unnest(string_split_regex(lower(p_type), '[^a-z0-9.]+')) AS w FROM part) WHERE w <> '')",
    "squeezed": "(SELECT doc_id, source, doc_id % 2 AS answer, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') || chr(31) || lang), 1, 16) AS key FROM documents)",
}
Z = "1.959963984540054e0"
_SHIFT = f"(effect / 100e0 / slope / sqrt(2 / (n * mean_information)))"


def _upper(z: str) -> str:
    half = f"({_tail(f'(({z}) * ({z}))')}) / 2"
    return f"CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END"


BODIES |= {
    "wilson_interval": "SELECT model_id, k, n, round(greatest((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4e0 * n * n)) / (1 + z * z / n), 0), 6) AS lo, round(least((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4e0 * n * n)) / (1 + z * z / n), 1), 6) AS hi FROM (SELECT model_id, sum(correct)::BIGINT AS k, count(*) AS n, 1.959964e0 AS z FROM responses GROUP BY ALL)",
    "power_prefix_information": "SELECT item_id, round(information, 6) AS information, n, round(mean_information, 6) AS mean_information FROM pinfo",
    "power_grid": f"SELECT effect, n, round({_upper(f'({Z} - {_SHIFT})')} + {_upper(f'({Z} + {_SHIFT})')}, 4) AS power FROM pinfo, slope, range(1, 6) e(effect)",
    "equivalent_budget": "SELECT n, round(min_by(CASE WHEN n0 IS NULL OR v0 >= value THEN n1 ELSE n0 + (value - v0) / (v1 - v0) * (n1 - n0) END, n1) FILTER (v1 >= value), 3) AS equivalent FROM (SELECT n, value FROM score_curve WHERE method = 'informative'), base_curve GROUP BY ALL",
    "separated_pairs": "SELECT x.model_id AS leader, count(*) AS n_below FROM bounds x JOIN bounds y ON x.lo > y.hi AND x.theta > y.theta GROUP BY ALL",
    "power_validation": "SELECT floor(abs(x.theta - y.theta) / 0.5 + 1e-9)::BIGINT AS band, count(*) AS pairs, round(avg((sign(x.theta - y.theta) = sign(x.score - y.score))::INT), 5) AS right_order FROM truth x JOIN truth y ON x.model_id < y.model_id GROUP BY ALL HAVING count(*) >= 20",
    "benchmark_strata": "SELECT benchmark, n, place, round(weight, 6) AS weight FROM strata",
    "selector_step": "SELECT model_id, item_id, benchmark, round(information, 6) AS information FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY round(weight * greatest(coalesce(total, 0), 1) - coalesce(used, 0), 9) DESC, benchmark, round(information, 9) DESC, item_id) AS r FROM (SELECT abilities.model_id, items60.item_id, items60.benchmark, weight, total, used, a * a * (1 / (1 + exp(-(a * (theta - b))))) * (1 - 1 / (1 + exp(-(a * (theta - b))))) AS information FROM abilities CROSS JOIN items60 JOIN params60 USING (item_id) JOIN strata60 USING (benchmark) LEFT JOIN used USING (model_id, benchmark) LEFT JOIN used_all USING (model_id) ANTI JOIN answered ON answered.model_id = abilities.model_id AND answered.item_id = items60.item_id)) WHERE r = 1",
    "random_subset": f"SELECT model_id, item_id FROM responses QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY {_u(chr(39) + 'random' + chr(39), 'model_id', 'item_id')}, item_id) <= 10",
    "sample_per_benchmark": f"SELECT benchmark, item_id FROM items QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY {_u(chr(39) + 'sample' + chr(39), 'item_id')}, item_id) <= 12",
    "stratified_subset": f"SELECT benchmark, run::INT AS run, item_id FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, run ORDER BY {_u(chr(39) + 'strata' + chr(39), 'item_id')}, item_id) AS r FROM (SELECT *, CASE WHEN m <= want THEN 0 WHEN pos < m % 4 * (m // 4 + 1) THEN pos // (m // 4 + 1) ELSE m % 4 + (pos - m % 4 * (m // 4 + 1)) // greatest(m // 4, 1) END AS run FROM (SELECT item_id, benchmark, count(*) OVER (PARTITION BY benchmark) AS m, round_even(50e0 * count(*) OVER (PARTITION BY benchmark) / count(*) OVER (), 0)::INT AS want, row_number() OVER (PARTITION BY benchmark ORDER BY b, item_id) - 1 AS pos FROM items JOIN params USING (item_id)))) WHERE want > 0 AND r <= CASE WHEN m <= want THEN m ELSE greatest(want // 4, 1) END",
    "suite_apportion": "SELECT * FROM seats",
    "suite_choose": f"SELECT benchmark, item_id FROM items JOIN seats USING (benchmark) QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY {_u(chr(39) + 'suite' + chr(39), 'item_id')}, item_id) <= seats",
    "cost_by_checkpoint": f"SELECT model_id, n, round(spend, 5) AS spend FROM (SELECT model_id, count(*) OVER w AS n, sum(cost_usd) OVER w AS spend FROM adm WHERE rep = 1 WINDOW w AS (PARTITION BY model_id ORDER BY {_u(chr(39) + 'cost' + chr(39), 'model_id', 'item_id')}, item_id ROWS UNBOUNDED PRECEDING)) WHERE n IN (10, 20, 50)",
    "run_estimate": "SELECT alias, calls, input_tokens, round(cost, 6) AS cost_usd, round(cost * 1.25, 6) AS with_margin FROM (SELECT *, CASE WHEN alias <> 'src3' THEN (input_tokens * (length(alias) * 0.1e0) + calls * 200 * (length(alias) * 0.5e0)) / 1e6 * CASE WHEN alias = 'src1' THEN 0.5e0 ELSE 1e0 END END AS cost FROM (SELECT source AS alias, count(*) AS calls, sum(floor(length(text) / 4 + 0.5))::BIGINT AS input_tokens FROM documents GROUP BY ALL))",
    "em_one_step": "SELECT item_id, round(least(greatest(a + least(greatest((hdd * ga - had * gd) / det, -2), 2), -6), 6), 4) + 0 AS a, round(least(greatest(d + least(greatest((haa * gd - had * ga) / det, -4), 4), -30), 30), 4) + 0 AS d FROM em_s",
    "item_se": "SELECT item_id, round(sqrt(hdd / det), 4) AS se_a, round(sqrt(greatest((d / (a * a)) ** 2 * hdd / det + (1 / a) ** 2 * haa / det + 2 * (d / (a * a)) * (1 / a) * had / det, 0)), 4) AS se_b FROM em_s",
    "rotate_options": "SELECT item_id, k::INT AS k, array_to_string(list_transform(range(4), lambda i: options[(i - k + 4) % 4 + 1]), '|') AS rotated FROM lettered, range(4) r(k)",
    "answer_letter": "SELECT item_id, substr('ABCDEFGHIJ', list_position(options, answer)::INT, 1) AS letter, array_to_string(list_transform(range(4), lambda i: substr('ABCDEFGHIJ', (i + 1)::INT, 1) || '. ' || options[i + 1]), chr(10)) AS shown FROM lettered",
    "item_hash": "SELECT item_id, substr(sha256('bench' || chr(0) || t || array_to_string(list_transform(w, lambda o: chr(1) || trim(regexp_replace(o, '\\s+', ' ', 'g'), ' ')), '') || chr(2) || trim(regexp_replace(w[1], '\\s+', ' ', 'g'), ' ')), 1, 16) AS hash FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t, string_split(text, ' ') AS w FROM benchmark)",
    "question_key_duplicates": "SELECT key, count(*) AS size, min(doc_id) AS first_item, count(DISTINCT source) > 1 AS cross_benchmark, count(DISTINCT answer) > 1 AS keys_disagree FROM squeezed GROUP BY ALL HAVING count(*) > 1",
    "decision_choice": "SELECT item_id, CASE WHEN item_id % 11 = 0 THEN NULL WHEN item_id % 11 = 1 THEN 'B' WHEN a > b AND a > c THEN 'A' WHEN b > a AND b > c THEN 'B' WHEN c > a AND c > b THEN 'C' END AS choice FROM (SELECT item_id, item_id * 2 % 7 AS a, item_id * 3 % 7 AS b, item_id * 5 % 7 AS c FROM items)",
    "family_classify": "SELECT i AS model_id, ['merge', 'tuned', 'base', 'tuned', 'tuned', 'other', 'base', 'tuned'][i * 5 % 8 + 1] AS family FROM range(150) t(i)",
    "administrable_reasons": "SELECT item_id, benchmark, CASE WHEN withheld THEN 'question withheld' WHEN answer = '' THEN 'no answer key' WHEN kind <> 'multiple_choice' AND NOT regexp_matches(answer, '[0-9]') THEN 'no final answer' WHEN kind <> 'multiple_choice' THEN NULL WHEN len(offered) < 2 THEN 'fewer than two labels' WHEN NOT list_contains(offered, answer) THEN 'key is not an option' END AS reason FROM (SELECT *, CASE WHEN len(options) >= 2 THEN options ELSE coalesce(labels, []) END AS offered FROM posed LEFT JOIN labels_of USING (benchmark, task))",
    "route_nearest": "SELECT wanted, listed, round(score, 6) AS score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY round(score, 9) DESC, listed) AS place FROM (SELECT wanted, listed, sum(weight) AS score FROM wanted_words JOIN listed_words USING (w) JOIN word_weight USING (w) GROUP BY ALL)) WHERE place <= 4",
    "worst_items": "SELECT item_id, round(a, 6) AS a, round(b, 6) + 0 AS b, n_models FROM params JOIN (SELECT item_id, count(*) AS n_models FROM responses GROUP BY ALL HAVING count(*) >= 60) USING (item_id) ORDER BY params.a, item_id LIMIT 20",
    "slope_histogram": "SELECT least(floor((least(greatest(a, 0.5e0), 1.9e0) - 0.5e0) / ((1.9e0 - 0.5e0) / 14) + 1e-9), 13)::BIGINT AS bin, count(*) AS n FROM params GROUP BY ALL",
    "information_curve": "SELECT grid, round(sum(i), 4) AS whole, round(sum(i) FILTER (r <= 50), 4) AS best FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY i DESC) AS r FROM (SELECT t::BIGINT AS grid, a * a * (1 - p) / p * ((p - c) / (1 - c)) ** 2 AS i FROM (SELECT *, c + (1 - c) / (1 + exp(-(a * (t / 4e0 - b)))) AS p FROM params3, range(-12, 13) g(t)))) GROUP BY ALL",
    "flagged_evidence": "SELECT flagged, k, n, round((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4e0 * n * n)) / (1 + z * z / n), 6) AS lo, round((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4e0 * n * n)) / (1 + z * z / n), 6) AS hi FROM (SELECT item_id % 9 = 0 AS flagged, sum(correct)::BIGINT AS k, count(*) AS n, 1.96e0 AS z FROM responses GROUP BY ALL)",
    "decision_table": "SELECT model_id, k, n, round(greatest((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4e0 * n * n)) / (1 + z * z / n), 0), 6) AS lo, round(least((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4e0 * n * n)) / (1 + z * z / n), 1), 6) AS hi, round(theta, 4) + 0 AS theta, round(theta - 1.96e0 * se, 4) + 0 AS theta_lo, round(theta + 1.96e0 * se, 4) + 0 AS theta_hi FROM (SELECT model_id, sum(correct)::BIGINT AS k, count(*) AS n, 1.959964e0 AS z FROM dense GROUP BY ALL) JOIN eap USING (model_id)",
    "panel_table": "SELECT model_id, count(*) AS usable, round(avg(correct), 6) AS accuracy, round(sum(cost_usd), 5) AS spend FROM adm WHERE rep = 1 GROUP BY ALL",
    "observed_output": "SELECT role AS alias, round(avg(length(text)), 5) AS mean_output, count(*) AS n FROM conversations WHERE turn % 5 <> 4 AND text IS NOT NULL GROUP BY ALL",
    "template_flip_rates": "SELECT template, round(avg(1 - agreement), 6) AS flip_rate, count(*) AS n FROM (SELECT x.template, model_id, avg((x.correct = y.correct)::INT) AS agreement FROM first_a x JOIN second_a y USING (model_id, item_id) GROUP BY ALL) GROUP BY ALL",
    "results_table": "SELECT 'kendall_tau' AS measure, round(sum(sx * sy) / sqrt(sum(abs(sx))::DOUBLE * sum(abs(sy))), 5) AS point, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, count(*) AS n FROM (SELECT sign(x.score - y.score) AS sx, sign(x.theta - y.theta) AS sy FROM truth x JOIN truth y ON x.model_id < y.model_id) UNION ALL SELECT 'repeat_agreement', round(coalesce(count(*) FILTER (n > 1 AND (k = 0 OR k = n))::DOUBLE / nullif(count(*) FILTER (n > 1), 0), 1), 6), NULL, NULL, count(*) FILTER (n > 1) FROM cells",
    "raw_instances": "SELECT item_id::VARCHAR AS id, len(string_split(text, ' '))::INT AS n_options, string_split(text, ' ')[2] AS answer FROM benchmark",
    "run_names": "SELECT p_partkey, lower(p_brand) || ':subject=' || p_size || ',split=test' AS scenario_key, lower(replace(p_type, ' ', '_')) AS model FROM part",
    "task_identities": "SELECT source AS task, doc_id, answer_key, substr(sha256(source || chr(0) || q || CASE WHEN same > 1 THEN chr(31) || answer_key || chr(31) || pos ELSE '' END), 1, 16) AS item_id FROM (SELECT *, count(*) OVER (PARTITION BY source, q) AS same, row_number() OVER (PARTITION BY source, q, answer_key ORDER BY doc_id) AS pos FROM (SELECT source, doc_id, (doc_id % 2)::VARCHAR AS answer_key, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS q FROM documents))",
    "leaderboard_candidates": "SELECT 'm' || (s_suppkey % 37) AS fullname, s_name AS eval_name, s_acctbal AS average FROM supplier WHERE s_suppkey % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY s_suppkey % 37 ORDER BY s_acctbal DESC, s_name) = 1",
    "bank_build": "SELECT count(*) AS cells, count(DISTINCT item_id) AS items, count(DISTINCT model_id) AS models, round(count(*) / (count(DISTINCT item_id) * count(DISTINCT model_id)), 6) AS density FROM responses WHERE item_id IN (SELECT item_id FROM responses GROUP BY item_id HAVING count(*) >= 40)",
    "incomplete_items": "SELECT item_id FROM items WHERE item_id % 4 IN (0, 1) AND item_id % 6 <> 0",
}


from . import more_oracle  # noqa: E402 - the rest of the queries

VIEWS |= more_oracle.VIEWS | {"mh_contrast": MH.replace("groups", "groups_contrast")}
BODIES |= more_oracle.BODIES
BODIES["reason_counts"] = f"SELECT benchmark, coalesce(reason, 'can be asked') AS reason, count(*) AS n, count(DISTINCT item_id) AS n_items FROM ({BODIES['administrable_reasons']}) GROUP BY ALL"


def _needed(body: str) -> list[str]:
    """The views a text uses, those they use first."""
    import re

    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"(?:\bFROM|\bJOIN|,)\s*\(?\s*{name}\b", text):
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(body + (REACH if "reach" in body else ""))
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        views = ",\n".join(f"{v} AS MATERIALIZED {VIEWS[v]}" for v in _needed(body))
        if name == "dependent_blocks":
            views += f",\n{REACH}"
        out[name] = (f"WITH RECURSIVE {views}\n" if views else "") + body
    return out
