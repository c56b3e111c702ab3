"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and fits to banks of the
published sizes; prints one JSON line.

The session is warm before the first query is timed: the fixture banks are stored and a Python
worker has started. fit_bank_v1 is the two-parameter fit of 150 models x 20,365 items, of which
54 % are observed (planted parameters, drawn by hashes; stored before the clock starts).
"""

import json
import os
import time

from pyspark.sql import functions as F

from lumetric.plans import fitting
from lumetric.plans.queries import QUERIES
from lumetric.session import local_session
from lumetric.sources import fixtures, scratch

HEADLINE = """collapse_repeats full_suite_scores common_frame eap_ability eap_interval item_infit_outfit empirical_curve separation_auc
item_flags mantel_haenszel q3_pairs q3_summary tetrachoric_pairs kendall_tau retest position_bias framing power_grid items_needed selector_step
random_subset stratified_subset cost_by_checkpoint em_one_step item_se question_key_duplicates task_union score_replies adaptive_path fit_2pl""".split()


def planted_bank(spark, models, items, observed):
    def u(salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 32)) / float(1 << 32)

    def normal(key, salt):  # sum of twelve uniforms
        return sum(F.pmod(F.xxhash64(F.col(key), F.lit(salt + k)), F.lit(1 << 32)) / float(1 << 32) for k in range(12)) - 6

    cells = spark.range(models * items).select("id", (F.col("id") % models).alias("model_id"), F.floor(F.col("id") / models).alias("item_id")).where(u(1) < observed)
    p = 1 / (1 + F.exp(-F.exp(0.35 * normal("item_id", 100)) * (normal("model_id", 200) - 1.2 * normal("item_id", 300))))
    return scratch.stored(cells.select("model_id", "item_id", (u(2) < p).cast("int").alias("correct")), "bank")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    for n in (fixtures.ITEMS, fixtures.DENSE_ITEMS):
        fixtures.first_answers(spark, sf, n).count()
    fitting.fit(fixtures.responses_dense(spark, sf), most=1)
    bank = planted_bank(spark, 150, 20_365, 0.54)
    seconds = {}

    def timed(name, run):
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    found = []
    timed("fit_bank_v1", lambda: found.append(fitting.fit(bank)))
    notes = {"fit_bank_v1": {"iterations": found[0].iterations, "converged": found[0].converged, "cells": bank.count()}}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "notes": notes}))


if __name__ == "__main__":
    main()
