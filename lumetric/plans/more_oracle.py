"""SQL of plans.more_queries, and of the queries that had none."""

from __future__ import annotations

from statistics import NormalDist

REPLIES = r"['Answer: B', 'The final answer is (C).', 'd', 'I think a cat', '**A**', 'Answer: E', 'B and C both', 'It is $\boxed{\frac{1}{2}}$', 'so 1,234 apples', 'Answer: 3/4', '', 'no idea']"
PUBLISHED = "(VALUES ('b0', '1992-06', 'Arithmetic'), ('b1', '1995-01', 'Botany'), ('b2', '1998-12', NULL), ('b4', '1993-03', 'Logic')) p(benchmark, month, name)"
SAYS = r"(?:final\s+answer|answer|option|choice|response)"


def _choice(body: str, options: str) -> str:
    """The choice rules for four options, without look-around."""
    offered = "['A', 'B', 'C', 'D']"

    def kept(pattern: str) -> str:
        return f"list_filter(list_transform(regexp_extract_all({body}, '{pattern}', 1), lambda x: upper(x)), lambda x: list_contains({offered}, x))"

    def bare(x: str) -> str:
        return rf"lower(regexp_replace({x}, '^[.,:;!?\"()\[\]{{}}\s]+|[.,:;!?\"()\[\]{{}}\s]+$', '', 'g'))"

    explicit = kept(rf"(?i){SAYS}\s*(?:is|:|=)?\s*[*\s(\[{{\"]*([A-J])(?:[^A-Za-z0-9]|$)")
    alone = rf"upper(regexp_extract({body}, '^[*\s(\[{{\"]*([A-Ja-j])[*)\]}}\".,:\s]*$', 1))"
    rest = f"regexp_replace({body}, '(?i)^.*{SAYS}\\s*(?:is|:|=)\\s*', '')"

    def named(x: str) -> str:
        return f"CASE WHEN len(list_filter({options}, lambda o: {bare('o')} = {bare(x)})) = 1 THEN {offered}[list_position(list_transform({options}, lambda o: {bare('o')}), {bare(x)})] END"

    prose = rf"list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({body}, '(?:^|[^A-Za-z0-9])[*(\[{{\"]*([A-Ja-j])[*)\]}}\".,:]*(?:[^A-Za-z0-9]|$)', 1), lambda x: x NOT IN ('a', 'i', 'I')), lambda x: upper(x)), lambda x: list_contains({offered}, x)))"
    return f"""CASE WHEN {body} = '' THEN NULL WHEN len({explicit}) > 0 THEN ({explicit})[-1] WHEN {alone} <> '' THEN CASE WHEN list_contains({offered}, {alone}) THEN {alone} END
        WHEN coalesce({named(rest)}, {named(body)}) IS NOT NULL THEN coalesce({named(rest)}, {named(body)}) WHEN len({prose}) = 1 THEN ({prose})[1] END"""


def _math(said: str) -> str:
    """Box of a simple fraction, stated answer, last number; values as lowest terms of the fixed replies."""
    last = rf"coalesce(nullif(regexp_extract({said}, '(?i)answer(?:\s*(?:is|:|=))?\s*(-?[0-9,./]+)', 1), ''), (regexp_extract_all({said}, '-?[0-9][0-9,]*\.?[0-9]*'))[-1])"
    return rf"CASE WHEN {said} LIKE '%boxed%' THEN regexp_extract({said}, 'frac\{{(\d+)\}}', 1) || '/' || regexp_extract({said}, 'frac\{{\d+\}}\{{(\d+)\}}', 1) ELSE replace({last}, ',', '') END"


_CLEAN = r"trim(regexp_replace(regexp_replace(reply, '```|`|\*\*|__', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_TURNED = "list_transform(range(4), lambda i: options[(i - rotation + 4) % 4 + 1])"
_ASKED = f"""(SELECT item_id, kind, options, CASE WHEN item_id % 31 = 0 THEN '' WHEN kind = 'free_response' THEN ['0.5', '1234', 'x'][item_id % 3 + 1] ELSE answer END AS answer, item_id % 4 AS rotation,
    item_id % 5 = 2 AS decides, item_id % 37 = 0 AS failed, CASE WHEN item_id % 5 = 2 THEN '{{"answer": {{"choice": "B"}}}}' ELSE {REPLIES}[item_id % 12 + 1] END AS reply FROM lettered)"""


def _resolution() -> str:
    return """(SELECT t AS ability, n, means, rise FROM (SELECT t, avg(p1 - p0) / 0.1e0 AS rise FROM (SELECT t, c + (1 - c) / (1 + exp(-(a * (t + 0.05e0 - b)))) AS p1, c + (1 - c) / (1 + exp(-(a * (t - 0.05e0 - b)))) AS p0 FROM params3, (SELECT unnest([-1, 0, 1]) AS t)) GROUP BY ALL)
      JOIN (SELECT t, n, avg(i) OVER (PARTITION BY t ORDER BY n ROWS UNBOUNDED PRECEDING) AS means FROM (SELECT t, i, row_number() OVER (PARTITION BY t ORDER BY i DESC, item_id) AS n FROM (
        SELECT t, item_id, a * a * (1 - p) / p * ((p - c) / (1 - c)) ** 2 AS i FROM (SELECT *, c + (1 - c) / (1 + exp(-(a * (t - b)))) AS p FROM params3, (SELECT unnest([-1, 0, 1]) AS t))))) USING (t))"""


_Z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
_Z2 = NormalDist().inv_cdf(0.975)
_FIT = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _upper(z: str) -> str:
    """The normal distribution's upper tail."""
    t, poly = f"(1e0 / (1 + 0.5e0 * abs({z}) / sqrt(2)))", f"{_FIT[-1]}e0"
    for k in reversed(_FIT[:-1]):
        poly = f"({k}e0 + {t} * {poly})"
    half = f"({t} * exp(-({z}) * ({z}) / 2 + {poly}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN {half} ELSE 1 - {half} END"


def _u(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296e0"


VIEWS: dict[str, str] = {
    "said": f"(SELECT item_id, options, {REPLIES}[item_id % 12 + 1] AS reply FROM lettered)",
    "asked": _ASKED,
    "keyed_replies": f"""(SELECT *, CASE WHEN kind = 'free_response' THEN nullif(answer, '') WHEN answer <> '' THEN ['A', 'B', 'C', 'D'][nullif(list_position({_TURNED}, answer), 0)] END AS key FROM asked)""",
    "read_replies": f"""(SELECT item_id, kind, key, CASE WHEN failed OR key IS NULL THEN NULL WHEN kind = 'free_response' THEN {_math('reply')} WHEN decides THEN 'B' ELSE {_choice('body', 'shown')} END AS parsed
        FROM (SELECT *, {_CLEAN} AS body, {_TURNED} AS shown FROM keyed_replies))""",
    "scored_replies": "(SELECT item_id, key, parsed, CASE WHEN parsed IS NOT NULL THEN (CASE WHEN kind = 'free_response' AND key = '0.5' THEN parsed = '1/2' ELSE parsed = key END)::INT END AS correct FROM read_replies)",
    "resolution": _resolution(),
    "drift_rows": """(SELECT source AS task, doc_id, m AS model_id, (doc_id + m) % 2 AS correct, CASE WHEN doc_id % 50 = 0 AND m = 3 THEN 'x' ELSE (doc_id % 2)::VARCHAR END AS seen_key,
        substr(sha256(source || chr(0) || q || CASE WHEN same > 1 THEN chr(31) || (doc_id % 2) || chr(31) || pos ELSE '' END), 1, 16) AS item_id
        FROM (SELECT *, count(*) OVER (PARTITION BY source, q) AS same, row_number() OVER (PARTITION BY source, q, doc_id % 2 ORDER BY doc_id) AS pos FROM (SELECT source, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS q FROM documents)), range(4) r(m) WHERE (doc_id + m) % 3 <> 0)""",
    "kinds_of": "(SELECT model_id, access, CASE WHEN model_id % 4 = 1 THEN 'merge' ELSE 'base' END AS family, release_date FROM models)",
    "contrast_rows": f"""(SELECT 'open_vs_api' AS split, NULL::VARCHAR AS benchmark, model_id, access = 'open' AS focal FROM kinds_of UNION ALL SELECT 'merge_vs_trained', NULL, model_id, family = 'merge' FROM kinds_of
        UNION ALL SELECT 'contamination_' || benchmark, benchmark, model_id, substr(release_date, 1, 7) > month FROM kinds_of, {PUBLISHED} WHERE release_date <> '')""",
    "groups_contrast": "(SELECT * FROM contrast_rows WHERE model_id IN (SELECT model_id FROM dense) QUALIFY least(count(*) FILTER (focal) OVER (PARTITION BY split), count(*) FILTER (NOT focal) OVER (PARTITION BY split)) >= 10)",
    "skip_rows": """(SELECT 'open_vs_api' AS split, model_id, access = 'open' AS focal FROM kinds_of UNION ALL SELECT 'merge_vs_trained', model_id, family = 'merge' FROM kinds_of
        UNION ALL SELECT 'contamination_' || benchmark, model_id, substr(release_date, 1, 7) > month FROM kinds_of, (VALUES ('b0', '1992-06'), ('b1', '1999-12'), ('b2', '1900-01')) p(benchmark, month) WHERE release_date <> '')""",
    "repeat_keys": "(SELECT key, count(*) AS size, min(doc_id) AS first_item, count(DISTINCT source) > 1 AS cross_benchmark FROM squeezed GROUP BY key HAVING count(*) > 1)",
    "flips": "(SELECT model_id, avg(x.correct - y.correct) AS cost, stddev_pop(x.correct - y.correct) AS sd, count(*) AS n FROM first_a x JOIN second_a y USING (model_id, item_id) GROUP BY ALL)",
    "logged": "(SELECT model_id, item_id, rep, CASE WHEN rotation <> 3 THEN correct END AS correct, cost_usd FROM adm60)",
    "boot_values": "(SELECT model_id, row_number() OVER (PARTITION BY model_id ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY model_id) AS n, correct::DOUBLE AS value FROM dense)",
    "cross_values": "(SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n, x, y FROM rates)",
}

BODIES: dict[str, str] = {
    "parse_choice": f"SELECT item_id, {_choice('body', 'options')} AS choice FROM (SELECT *, {_CLEAN} AS body FROM said)",
    "parse_math": f"SELECT item_id, {_math('reply')} AS value FROM said",
    "final_answers": f"SELECT item_id, {_math('reply')} AS value FROM said",
    "score_replies": "SELECT * FROM scored_replies",
    "rescore_replies": """SELECT item_id::VARCHAR AS cell, item_id, 'A' AS old_parsed, parsed, NULL::INT AS old_correct, correct FROM scored_replies
        WHERE item_id % 7 = 0 AND (parsed IS DISTINCT FROM 'A' OR correct IS NOT NULL)""",
    "retry_classes": """SELECT event_id, coalesce(error IS NOT NULL AND (regexp_matches(error, '(?i)returned \\w*(?:Error|Timeout)\\b') OR coalesce(verdict, regexp_matches(error, '\\breturned (?:408|409|429|500|502|503|504|529)\\b|(?i:timeout|connect_?error|read_?error|not ready)'))), false) AS again
        FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN ['call returned 429', 'returned ConnectError', 'refused', 'read timeout', 'returned 400', 'model not ready'][event_id % 6 + 1] END AS error, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS verdict FROM events)""",
    "settled_requests": "SELECT DISTINCT (event_id % 100)::VARCHAR AS request_sha256 FROM events WHERE event_id % 10 <> 9 AND NOT (event_id % 4 <> 0 AND (event_id % 3 <> 0 OR event_id % 2 = 0))",
    "display_names": "SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS shown FROM part",
    "quoted_questions": "SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 87) || '...' ELSE t END AS quote FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents)",
    "benchmark_lookup": f"SELECT benchmark, coalesce(month, '') AS published, coalesce(name, benchmark) AS title FROM (SELECT DISTINCT benchmark FROM items) LEFT JOIN {PUBLISHED} USING (benchmark)",
    "rendered_prompts": """SELECT item_id, prompt, 'm|' || item_id || '|plain|' || (item_id % 4) AS cell, sha256('{"prompt":' || to_json(prompt) || ',"tokens":64}') AS request_sha256 FROM (
        SELECT item_id, 'Question ' || item_id || chr(10) || array_to_string(list_transform(range(4), lambda i: ['A', 'B', 'C', 'D'][i + 1] || '. ' || options[(i - item_id % 4 + 4) % 4 + 1]), chr(10)) || chr(10) || 'Answer:' AS prompt FROM lettered)""",
    "items_needed": f"""SELECT ability, effect, paired, least(n, size)::BIGINT AS items, n > size AS capped FROM (
        SELECT ability, effect, paired, size, list_reduce(list_prepend(50, list_transform(range(12), lambda r: r)), lambda n, r: greatest(ceil(CASE WHEN paired THEN 2 ELSE 1 END * {_Z * _Z}e0 / ((effect / 100e0 / rise) ** 2 * greatest(means[least(n, size)::BIGINT], 1e-9))), 1)::BIGINT) AS n
        FROM (SELECT ability, any_value(rise) AS rise, list(means ORDER BY n) AS means, count(*) AS size FROM resolution GROUP BY ability), (SELECT unnest([1, 3, 10, 25]) AS effect), (SELECT unnest([true, false]) AS paired))""",
    "detectable_effect": f"SELECT ability, n, round(100 * rise * {_Z}e0 * sqrt(2 / (n * means)), 6) AS effect FROM resolution WHERE n IN (10, 50, 200)",
    "power_at": f"SELECT ability, n, effect, round({_upper(f'({_Z2}e0 - s)')} + {_upper(f'({_Z2}e0 + s)')}, 4) AS power FROM (SELECT *, effect / 100e0 / rise / sqrt(2 / (n * means)) AS s FROM resolution, (SELECT unnest([2, 10]) AS effect) WHERE n IN (10, 50, 200))",
    "precision_stop": "SELECT model_id, n, round(se, 4) AS se, n >= 10 AND se <= 0.45 AS reached FROM eap JOIN (SELECT model_id, count(*) AS n FROM dense GROUP BY ALL) USING (model_id)",
    "target_reached": "SELECT method, min(n) FILTER (value >= 0.8) AS n FROM score_curve GROUP BY ALL",
    "carried_estimates": """SELECT model_id, "at", round(max_by(theta, n), 6) AS theta, max(n) AS n FROM (SELECT model_id, row_number() OVER w AS n, avg(correct) OVER (w ROWS UNBOUNDED PRECEDING) AS theta FROM dense WINDOW w AS (PARTITION BY model_id ORDER BY item_id))
        JOIN (SELECT unnest([5, 20, 40, 60]) AS "at") ON n <= "at" GROUP BY ALL""",
    "panel_frame": "SELECT model_id, count(*) AS n, nullif(count(*) FILTER (item_id % 9 <> 0 AND item_id % 11 <> 0), 0) AS n_measurable FROM responses GROUP BY ALL",
    "stacked_panels": """SELECT alias, count(*) AS n, count(k) AS n_known, round(avg(correct), 6) AS accuracy FROM (SELECT 'text-' || model_id AS alias, item_id, correct FROM first_a UNION ALL SELECT 'decision-' || model_id, item_id, correct FROM second_a)
        LEFT JOIN (SELECT DISTINCT item_id, benchmark AS k FROM first_a JOIN items USING (item_id)) USING (item_id) GROUP BY ALL""",
    "task_union": "SELECT task, model_id, count(*) AS n, count(DISTINCT item_id) AS items, round(avg(correct), 6) AS score FROM drift_rows GROUP BY ALL",
    "key_drift": """SELECT task, n_models, count(*) AS n_items, count(*) FILTER (drifted) AS n_drifted, count(*) FILTER (by_ = n_models) AS answered_by_all, count(*) FILTER (2 * by_ < n_models) AS under_half FROM (
        SELECT task, item_id, count(DISTINCT model_id) AS by_, count(DISTINCT seen_key) > 1 AS drifted FROM drift_rows GROUP BY ALL) JOIN (SELECT task, count(DISTINCT model_id) AS n_models FROM drift_rows GROUP BY ALL) USING (task) GROUP BY ALL""",
    "bank_bridge": "SELECT q, min(f) AS first_id, min(s) AS second_id FROM (SELECT i AS f, 'q' || (i % 120) AS q FROM range(300) t(i)) JOIN (SELECT i + 1000 AS s, 'q' || (i * 2 % 250) AS q FROM range(300) t(i)) USING (q) GROUP BY ALL",
    "discrimination": "SELECT count(*) AS n_items, round(median(a - 0.5e0), 6) AS median_a, round(avg((a - 0.5e0 < 0.3)::INT), 6) AS share_low, round(avg((a - 0.5e0 < 0)::INT), 6) AS share_negative FROM params",
    "build_summary": "SELECT benchmark, count(*) AS n_items, count(*) FILTER (n < 110) AS n_dropped, coalesce(sum(n) FILTER (n >= 110), 0)::BIGINT AS n_responses FROM (SELECT item_id, count(*) AS n FROM responses GROUP BY ALL) JOIN items USING (item_id) GROUP BY ALL",
    "reliability_record": """SELECT round(coalesce(own, others), 6) AS flip_rate, own IS NOT NULL AS measured, round(100 * sqrt(coalesce(own, others) / 500), 5) AS points_sd FROM (
        SELECT max(1 - agreement) FILTER (model_id % 2 = 0 AND model_id % 5 <> 0) AS own, max(1 - agreement) FILTER (model_id % 2 <> 0 AND model_id % 5 <> 0) AS others FROM retests)""",
    "dif_contrasts": "SELECT split, item_id, n_reference, n_focal, round(delta, 4) + 0 AS delta FROM mh_contrast JOIN (SELECT DISTINCT split, benchmark AS of_ FROM groups_contrast) USING (split) JOIN items60 USING (item_id) WHERE of_ IS NULL OR of_ = benchmark",
    "dif_skipped": """SELECT split, n_reference, n_focal FROM (SELECT split, count(*) FILTER (NOT focal AND t) AS n_reference, count(*) FILTER (focal AND t) AS n_focal FROM (SELECT *, model_id IN (SELECT model_id FROM dense) AS t FROM skip_rows) GROUP BY ALL) WHERE least(n_reference, n_focal) < 10""",
    "duplicate_section": """SELECT cross_benchmark, count(*) AS n_keys, sum(size)::BIGINT AS n_items, (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT first_item::VARCHAR AS f FROM repeat_keys ORDER BY size DESC, first_item LIMIT 10)) AS largest FROM repeat_keys GROUP BY ALL""",
    "framing_exceptions": """SELECT CASE WHEN place <= 3 THEN model_id END AS model_id, count(*) AS n, round(max(cost), 6) AS cost FROM (SELECT *, row_number() OVER (ORDER BY round(cost, 9) DESC, model_id) AS place FROM flips WHERE cost - sd / sqrt(n) > 0) GROUP BY 1""",
    "suite_mix": """SELECT sum(seats)::BIGINT AS n_items, round(sum(seats * 0.002e0) FILTER (benchmark <> 'b3'), 6) AS usd, round(1.25e0 * sum(seats * 0.002e0) FILTER (benchmark <> 'b3'), 6) AS with_margin, string_agg(benchmark, ',' ORDER BY benchmark) FILTER (benchmark = 'b3') AS unpriced FROM seats""",
    "route_check": """SELECT wanted, listed, CASE WHEN NOT listed THEN nearest END AS nearest FROM (SELECT DISTINCT lower(p_type) || CASE WHEN length(p_type) % 2 = 0 THEN ' xl' ELSE '' END AS wanted, length(p_type) % 2 <> 0 AS listed FROM part)
        LEFT JOIN (SELECT wanted, listed AS nearest FROM (SELECT wanted, listed, sum(weight) AS score FROM (SELECT DISTINCT wanted, w FROM (SELECT wanted, unnest(string_split_regex(wanted, '[^a-z0-9.]+')) AS w FROM (SELECT DISTINCT lower(p_type) || CASE WHEN length(p_type) % 2 = 0 THEN ' xl' ELSE '' END AS wanted FROM part))) JOIN listed_words USING (w) JOIN word_weight USING (w) GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY round(score, 9) DESC, listed) = 1) USING (wanted)""",
    "bootstrap_mean": f"""SELECT model_id, round(any_value(point), 6) AS point, any_value(k) AS n, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM (
        SELECT p.model_id, p.draw, avg(v.value) AS mean FROM (SELECT model_id, draw, least(floor({_u("'boot'", 'model_id', 'draw', 'place')} * n), n - 1)::BIGINT AS place FROM boot_values, range(200) d(draw)) p JOIN boot_values v ON p.model_id = v.model_id AND p.place = v.place GROUP BY ALL)
        JOIN (SELECT model_id, avg(value) AS point, count(*) AS k FROM boot_values GROUP BY ALL) USING (model_id) GROUP BY model_id""",
    "bootstrap_crossbank": f"""SELECT round((SELECT corr(x, y) FROM cross_values), 5) + 0 AS point, (SELECT count(*) FROM cross_values) AS n, round(quantile_cont(r, 0.025), 5) + 0 AS lo, round(quantile_cont(r, 0.975), 5) + 0 AS hi FROM (
        SELECT draw, corr(v.x, v.y) AS r FROM (SELECT draw, least(floor({_u("'cross'", 'draw', 'place')} * n), n - 1)::BIGINT AS place FROM cross_values, range(200) d(draw)) p JOIN cross_values v USING (place) GROUP BY ALL)""",
    "raw_results": "SELECT model_id || '-' || item_id AS instance_id, correct FROM dense",
    "model_metadata": "SELECT lower(replace(c_name, '#', '/')) AS model_id, c_mktsegment AS creator, CASE WHEN c_acctbal > 0 THEN 'open' ELSE 'closed' END AS access, CASE WHEN c_custkey % 3 <> 0 THEN '1996-05-01' ELSE '' END AS release_date FROM customer",
    "first_runs": "SELECT o_orderpriority AS scenario, o_custkey % 50 AS suite, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 50 ORDER BY o_orderdate, o_orderkey) = 1",
    "instance_scan": "SELECT l_partkey AS id, l_orderkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "record_panel": """SELECT 'm' || model_id AS model_id, count(*) AS n, sum(correct)::BIGINT AS right, round(sum(cost_usd), 5) AS usd FROM (SELECT * FROM logged WHERE correct IS NOT NULL AND item_id % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY model_id, item_id ORDER BY rep DESC) = 1) GROUP BY ALL""",
    "superseded_log": "SELECT 'old' AS log, count(*) AS n, count(DISTINCT model_id) AS aliases FROM adm60 UNION ALL SELECT 'new', count(*), count(DISTINCT model_id) FROM adm60 WHERE model_id % 7 <> 0",
    "latest_prices": "SELECT 'p' || (s_suppkey % 5) AS provider, lower(s_name) AS model, abs(s_acctbal) AS input FROM supplier WHERE s_suppkey % 4 = (SELECT max(s_suppkey % 4) FROM supplier)",
    "fit_sinks": f"""SELECT 'params' AS what, count(*) AS n, round(sum(b), 6) AS value FROM params60 UNION ALL SELECT 'abilities', count(*), round(sum(theta), 6) FROM abilities UNION ALL SELECT 'dependence', count(*), count(*)::DOUBLE FROM items60
        UNION ALL SELECT 'suite', count(*), sum(item_id)::DOUBLE FROM (SELECT item_id FROM items60 QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY {_u("'suite'", 'item_id')}, item_id) <= 4) UNION ALL SELECT 'versions', 1, 0e0""",
    "packed_matrix": "SELECT model_id, item_id, correct FROM responses",
    "ability_stream": "SELECT model_id, round(theta, 4) + 0 AS theta, round(se, 4) AS se, n FROM eap JOIN (SELECT model_id, count(*) AS n FROM dense GROUP BY ALL) USING (model_id)",
}
