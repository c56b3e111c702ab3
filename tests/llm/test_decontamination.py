"""Leaks that many documents share."""

from lumetric.llm import decontamination


def test_partial_copies_are_found_beside_a_rarer_rest(spark):
    item = [f"term{i}" for i in range(40)]
    texts = [" ".join(item[:28]) + f" own{i} words{i}" for i in range(20)]  # score 0.7
    texts += ["x " + " ".join(item[33:38])] + [f"clean text {i}" for i in range(179)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontamination.contaminated(d, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["score"]) for r in got) == [(i, 0.7) for i in range(20)]
