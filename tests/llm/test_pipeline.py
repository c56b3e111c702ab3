"""The pipeline against a brute-force version of its five stages."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from lumetric.llm import bpe, decontamination, line_dedup, quality_rules
from lumetric.llm.common import shared_table

from .test_operators import WORD, plain_dedup, plain_features


def passes(text):
    n, chars, symbols, _, repeat = plain_features(text)
    letters = sum(c.isalpha() for c in text)
    upper = sum(c.isupper() for c in text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    long, own = sum(map(len, lines)), sum(map(len, set(lines)))
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n or chars < 2 * n or chars > 14 * n or 100 * (long - own) > 30 * long or 100 * upper > 40 * letters or 100 * letters < 60 * chars)


def plain_near(texts):
    """For each text the first of its group: 5-word shingles with a Jaccard of 0.8 link."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = len(a & sets[j])
            if 5 * same >= 4 * (len(a) + len(sets[j]) - same):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_pipeline(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    docs = [d for d in docs if passes(d["text"] or "")]
    cleaned = plain_dedup([(d["doc_id"], d["source"], d["text"]) for d in docs], line_dedup.RATIO, line_dedup.LEAST_PAGES)
    text = {doc_id: t for doc_id, t, *_ in cleaned}
    ids = sorted(text)
    groups = defaultdict(list)
    for doc_id, root in zip(ids, plain_near([text[i] for i in ids]), strict=True):
        groups[root].append(doc_id)
    left = [min(g) for g in groups.values()]

    def grams(t):
        w = decontamination.words_of(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = [(grams(x["text"]), decontamination.words_of(x["text"])) for x in items]
    kept = []
    for i in left:
        own, w = grams(text[i]), decontamination.words_of(text[i])
        number = {}
        as_ids = np.array([number.setdefault(x, len(number)) for x in w])
        bad = any(own & g and decontamination.alignment(np.array([number.get(x, -5) for x in item]), as_ids) >= decontamination.LEAST_SCORE * len(item) for g, item in wanted)
        if not bad:
            kept.append(i)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    want = Counter()
    for i in kept:
        t = enc.encode_ordinary(text[i])
        want[i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest()] += 1
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, kept_ int"
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose, "en", "a", 3, "", 0), (1, prose, "en", "a", 3, "", 0), (None, prose + " more", None, None, None, None, None), (2, None, None, None, None, None, None), (3, "", "", "", 0, "", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared_table(stage(spark, docs, "/root/testdata/sf0.001"), "test", "stage")
            assert docs.columns == corpus_pipeline.COLUMNS
        assert [r["doc_id"] for r in docs.collect()] == ([1] if data else [])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(data[:1])


def test_rules_are_those_of_the_operator():
    assert [r.name for r in quality_rules.default_rules() if r.base] == ["too_few_words", "repeated_passages"]
