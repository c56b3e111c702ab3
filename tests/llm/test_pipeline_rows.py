"""The pipeline decides by row, not by doc_id."""

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from lumetric.llm.common import shared_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_a_doc_id_or_have_none(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(20))
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    rows = [(None, texts["a"]), (None, texts["b"]), (5, texts["c"]), (5, texts["d"]), (None, item), (5, item + " more"), (9, texts["d"] + " more"), (None, texts["e"]), (2, texts["e"])]
    docs = shared_table(spark.createDataFrame([(*r, "en", "a", 3) for r in rows], SCHEMA), "test", "rows")
    near = shared_table(corpus_pipeline.near_stage(spark, docs, str(tmp_path)), "test", "near")
    left = [r["doc_id"] for r in near.collect()]
    assert len(left) == 6 and left.count(None) == 2 and left.count(5) == 3 and left.count(2) == 1
    clean = corpus_pipeline.decontamination_stage(spark, near, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in clean} == {(None, texts["a"]), (None, texts["b"]), (5, texts["c"]), (5, texts["d"]), (2, texts["e"])}
