"""Every operator against a brute-force version, on rows that try to break it."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumetric.llm import bpe, decontamination, html_blocks, html_extraction, line_dedup, quality_model, quality_rules, registry, simhash, token_store, toxicity, warc
from lumetric.llm.common import labelled, read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names clash with inputs (by case) and with outputs.
SCHEMA = "TEXT string, doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, host string, row int"


def rows():
    prose = "The quick brown fox jumps over the lazy dog near the river bank today. " * 1
    many = " ".join(f"word{i} goes{i % 7}" for i in range(40))
    texts = [None, "", "   \n\t ", "one", "two words", prose, prose, many + " tail one", many + " tail two", "a b c " * 400, "é漢🙂 #*$ \x1c x\n\n\nx\nx y", "same line\nother\nsame line", " ".join(f"w{i}" for i in range(20000)), "ZWJ ‍   nbsp em ² ½ Ⅷ 's 'S don't <|endoftext|>"]
    out = [("other", i, t, ["en", None][i % 2], ["a", "b", None][i % 3], None, i, "k", "h", 1) for i, t in enumerate(texts)]
    return [*out, out[5], ("other", None, prose, None, None, 1, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# ---- 1, 2 -------------------------------------------------------------------


def plain_dedup(data, ratio, least):
    pages, on = Counter(), defaultdict(set)
    for k, (_, source, text) in enumerate(data):
        pages[source] += 1
        for line in (text or "").split("\n") if text is not None else ():
            if WORD.search(line):
                on[source, line].add(k)
    out = []
    for doc_id, source, text in data:
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (WORD.search(x) and len(on[source, x]) >= least and len(on[source, x]) > ratio * pages[source])]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("broadcast_lines", [10**6, 0])
def test_line_dedup(spark, docs, empty, broadcast_lines):
    got = line_dedup.clean(docs, ["doc_id", "source", "text"], 0.3, 2, broadcast_lines)
    want = plain_dedup([(r[1], r[4], r[2]) for r in rows()], 0.3, 2)
    assert table(got, "doc_id", "text", "n_lines", "n_dropped") == want
    assert line_dedup.clean(empty, ["doc_id", "source", "text"]).count() == 0


def test_line_at_the_ratio_stays(spark):
    d = spark.createDataFrame([(i, "x\ny" if i < 2 else "z", "h") for i in range(4)], "doc_id long, text string, source string")
    assert table(line_dedup.clean(d, ["doc_id", "source", "text"], 0.5, 1), "n_dropped") == {(0,): 4}


def test_pages_of_very_many_lines(spark):
    page = "\n".join(f"line number {i % 150_000}" for i in range(200_000))
    d = spark.createDataFrame([(i, page if i < 2 else f"own {i}", "h") for i in range(4)], "doc_id long, text string, source string")
    began = time.perf_counter()
    got = table(line_dedup.clean(d, ["doc_id", "source", "text"], 0.3, 2), "doc_id", "n_lines", "n_dropped")
    assert got == {(0, 200_000, 200_000): 1, (1, 200_000, 200_000): 1, (2, 1, 0): 1, (3, 1, 0): 1}
    assert time.perf_counter() - began < 60


def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if wins[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(hit)


def test_quality_features(docs, empty):
    got = table(quality_rules.features(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((r[1], *plain_features(r[2])) for r in rows())
    assert quality_rules.judge(empty).count() == 0


def test_many_repeated_windows_go_by_sorting(spark):
    text = " ".join(f"w{i}" for i in range(300))
    d = spark.createDataFrame([(1, f"{text} x {text}")], "doc_id long, text string")
    assert quality_rules.features(d).first()["n_repeat_words"] == plain_features(f"{text} x {text}")[4] == 600


def test_order_of_rules_changes_no_verdict(docs):
    rules = quality_rules.default_rules()
    verdicts = [table(quality_rules.judge(docs, r, ordered=True).selectExpr("doc_id", "rejected_by IS NULL AS k"), "doc_id", "k") for r in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]
    kept = quality_rules.keep_good(docs, ["doc_id", "text"])
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(n for (_, k), n in verdicts[0].items() if k)


def test_the_cascade_skips_features_of_rejected_rows(spark, monkeypatch):
    """Windows of a short text would raise an error; they are read only if the rule that needs them comes first."""
    whole = quality_rules._features()
    trap = F.when(F.col("text_").contains("short"), F.raise_error(F.lit("read"))).otherwise(whole["windows_"].make)
    monkeypatch.setattr(quality_rules, "_features", lambda: whole | {"windows_": quality_rules.Feature(trap, ("hashes_",))})
    good = " ".join(f"word{i} goes" for i in range(60))
    d = spark.createDataFrame([(1, "short"), (2, good), (3, "a short one"), (4, None)], "doc_id long, text string")
    rules = quality_rules.default_rules()
    assert [r["doc_id"] for r in quality_rules.keep_good(d, ["doc_id", "text"], rules).collect()] == [2]
    with pytest.raises(Exception, match="read"):
        quality_rules.keep_good(d, ["doc_id", "text"], [rules[1], rules[0], *rules[2:]]).collect()


def test_rules_are_ranked_by_rejection_per_cost(spark):
    rules = quality_rules.default_rules()[:3]
    few, repeated, symbols = (r.name for r in rules)
    order = quality_rules.ranked(rules, {few: 0.2, repeated: 0.4, symbols: 0.2}, {few: 0.011, repeated: 0.4, symbols: 0.01})
    assert [r.name for r in order] == [few, symbols, repeated]
    prose = " ".join(f"word{i} goes" for i in range(3000))
    d = spark.createDataFrame([(i, prose) for i in range(30)], "doc_id long, text string")
    dear = quality_rules.Rule("windows", ("n_repeat_words",), F.col("n_repeat_words") >= 0)
    cheap = quality_rules.Rule("characters", ("word_chars",), F.col("word_chars") >= 0)
    assert [r.name for r in quality_rules.measured_order(d, [dear, cheap])] == ["characters", "windows"]


def test_the_sample_reads_a_few_files(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "'x' AS text").repartition(20).write.parquet(str(tmp_path / "t"))
    some = quality_rules.some_files(spark.read.parquet(str(tmp_path / "t")), 4)
    assert 4 == some.selectExpr("_metadata.file_path AS f").distinct().count()
    assert 0 < quality_rules.drawn(spark.read.parquet(str(tmp_path / "t")), 50).count() <= 50


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(registry.SQL[name])
    assert table(registry.QUERIES[name](spark, sf), *want.columns) == Counter(want.fetchall())


# ---- 3 ----------------------------------------------------------------------


def test_extraction_on_unseen_pages(spark):
    labeller = html_extraction.trained()
    pages = html_extraction.synthetic_pages(80, 4321)
    truth = np.concatenate([[bool(b.label) for b in p] for p in pages])
    assert (truth == np.concatenate(labeller.label(pages))).mean() > 0.98


def test_block_f1_on_real_pages(sf):
    """By rule: the blocks of an <article> are the main text. No page of the tables is trained on."""
    labeller, hit, said, true = html_extraction.trained(), 0, 0, 0
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist():
        page = html_blocks.blocks((r["html"] or "").replace("<article", '<article data-label="1"'))
        truth = np.array([b.label == 1 for b in page], bool)
        flags = labeller.label([page])[0]
        hit, said, true = hit + int((truth & flags).sum()), said + int(flags.sum()), true + int(truth.sum())
    assert 2 * hit / (said + true) > 0.99


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_nothing_is_cut_before_the_labeller():
    assert texts("<p>x <svg><path></p><p>rest of page</p>") == ["x", "rest of page"]
    assert texts("<p>a <math><mi>b</mi></math> c</p><noscript>n</noscript><object>o</object><select><option>1<option>2</select>z") == ["a b c", "n", "o", "1", "2", "z"]
    assert texts("<script src=/a/>var leak=1;</script>t") == ["t"] == texts("<script src='x' />t") == texts("<title>t")
    assert texts("<!-- c --><p title='a>b' x=\"1>2\">k</p><!x><?y?>") == ["k"] and texts("a<b<c >d") == ["ad"] and texts("1 < 2 <") == ["1 < 2 <"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e<tr><td>f</table>") == list("abcdef")


@pytest.mark.parametrize("page", ["<div>x" * 60_000, "<a " * 200_000, '<a "' * 200_000, '<a ">" ' * 100_000, "<p>x<svg>" * 50_000, "<li>x</p></ul>" * 50_000, "<title>" * 100_000, "<!x" * 200_000, "<ul><div>" * 20_000 + "<li>x</li>" * 20_000])
def test_broken_pages_are_read_in_one_pass(page):
    began = time.process_time()
    found = html_blocks.blocks(page)
    assert time.process_time() - began < 15
    html_extraction.trained().label([found])
    assert time.process_time() - began < 60


def test_the_network_is_the_plain_lstm():
    """Every block of every page unrolled by itself, without padding, batches or shared paths."""
    net = html_extraction.trained()
    pages = [p for p in (html_blocks.blocks(html_extraction.Composer(random.Random(k)).page()) for k in range(6)) if p]

    def sigmoid(z):
        return 1 / (1 + np.exp(-z))

    def plain(rows, d):
        h, s, out = np.zeros(html_extraction.HIDDEN), np.zeros(html_extraction.HIDDEN), []
        for x in rows:
            i, f, o, g = np.split(np.concatenate([x, h]) @ net.p["w" + d] + net.p["c" + d], 4)
            s = sigmoid(f) * s + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(s)
            out.append(h)
        return out

    for page, flags in zip(pages, net.label(pages), strict=True):
        rows = []
        for i, b in enumerate(page):
            words = html_blocks.word_buckets(b.text) or [0]
            rows.append(np.concatenate([net.p["path"][b.path.flat()].mean(axis=0), net.p["own"][list(b.path.tokens)].mean(axis=0), net.p["word"][words].mean(axis=0), html_blocks.numbers(b, i, len(page))]))
        both = [np.concatenate([f, b]) for f, b in zip(plain(rows, "f"), plain(rows[::-1], "b")[::-1], strict=True)]
        z = np.array([x @ net.p["out"] + net.p["bias"][0] for x in both])
        sure = np.abs(z) > 1e-3
        assert ((z > 0) == flags)[sure].all() and sure.mean() > 0.9


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><article><h1>A  &amp; B</h1><p>First <b>bold</b>\n text here, with &eacute;.<p>Second paragraph<br>goes on.</p><script>var x='</p>';</script></article><div class=\"cookie-notice\">We use cookies</div><footer>&copy; All rights reserved</footer>"


def test_extraction_rows(spark):
    d = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<<<p <a <!-- open", 5), (1, "u", PAGE, 5), (4, "u", "<p>" * 3000 + "x " * 50000, 5)], "page_id long, url string, html string, text int")
    got = html_extraction.extract(d).collect()
    assert len(got) == 6
    text = [r["text"] for r in got if r["page_id"] == 1]
    assert text == ["A & B\nFirst bold text here, with é.\nSecond paragraph goes on."] * 2
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3))
    assert html_extraction.extract(d.limit(0)).count() == 0


# ---- 4, 5 -------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})


def test_transducer_is_the_definition(encoding):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    machine, rng = bpe.Transducer(ranks, most_states=50), np.random.default_rng(3)
    for _ in range(1500):
        piece = "".join(rng.choice(list("etaoinshrdluñéß漢🙂=-'  \n"), rng.integers(1, 14))).encode()
        assert machine.encode(piece) == bpe.merged(piece, ranks)
    assert machine.encode(b"") == []
    assert machine.encode(b"a" * 2000) == encoding._core_bpe.encode_single_piece(b"a" * 2000)


def test_ids_are_emitted_within_a_long_piece(encoding, monkeypatch):
    machine, rng = bpe.Transducer(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), most_states=5000), np.random.default_rng(4)
    monkeypatch.setattr(bpe, "WINDOW", 50)
    held, settle = [], machine.settle
    monkeypatch.setattr(machine, "settle", lambda state, last: (settle(state, last), held.append(len(last)))[0])
    for piece in (b"a" * 3000, "".join(rng.choice(list("etaoinshrdé"), 3000)).encode()):
        assert machine.encode(piece) == encoding._core_bpe.encode_single_piece(piece)
        assert held and max(held) < 200 and len(machine.table) <= 5001


def test_texts_are_split_in_blocks():
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1  \n\n'sé漢!\u2003"), 120))
        assert [p for found in bpe.pieces(text, int(rng.integers(1, 30))) for p in found] == bpe.SPLIT.findall(text)


def cut_rows(texts):
    found, numbers, ends = bpe.cut(pa.array(texts, pa.string()))
    return [[found[k] for k in numbers[s:e]] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def test_splitting_by_classes_is_the_pattern(sf):
    rng = np.random.default_rng(6)
    letters = list("abstmdrevlL12½ '' \n\t\u2003\u3000é漢!?-\u0301🙂")
    texts = [None, "", *("".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(3000))]
    texts += pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += [f"a{c}b {c}{c} 1{c}2  {c}! '{c}ll" for c in map(chr, range(0x3100))]
    assert cut_rows(texts) == [bpe.SPLIT.findall(t or "") for t in texts]
    assert bpe.cut(pa.array(["xx", "it's  a", None, "b"]).slice(1))[0] == ["it", "'s", " ", " a", "b"]


def test_memo_forgets_by_bytes():
    memo = bpe.Memo(lambda found: [bpe.pack([len(p)]) for p in found], most=2000)
    assert [x.tolist() for x in memo.text_ids(pa.array(["ab abc, 12", None, "a"]))] == [[2, 4, 1, 3], [], [1]]
    assert len(memo.text_ids(pa.array([" ".join(f"w{i}" for i in range(500))]))[0]) == 1000
    assert memo.held <= 2000 and len(memo) < 20 and memo.all(["x" * 65]) == [bpe.pack([65])] and "x" * 65 not in memo


def test_a_very_long_text_goes_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 100)
    memo = bpe.Memo(lambda found: [bpe.pack([len(p)]) for p in found])
    text = "some words, and more " * 50
    assert memo.text_ids(pa.array([text]))[0].tolist() == [len(p) for p in bpe.SPLIT.findall(text)]
    parts = [b.num_rows for b in bpe.sliced([pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 200, 3, 3, 90, 1)])], ["t"])], 0, size=100)]
    assert parts == [1, 1, 4]


def test_bpe_rows(docs, empty, encoding):
    got = table(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = Counter()
    for r in rows():
        ids = encoding.encode_ordinary(r[2] or "")
        want[r[1], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[2] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(empty).count() == 0
    assert table(bpe.decode(bpe.encode(docs)), "doc_id", "text") == Counter((r[1], r[2] or "") for r in rows())


def test_segments_are_directly_addressable():
    rng = np.random.default_rng(0)
    ids = (2 ** rng.uniform(0, 31, 3000)).astype(np.uint32)
    seg = token_store.Segment(token_store.encode_segment(ids, np.array([0, 7, 7, 3000])))
    assert seg.offsets.tolist() == [0, 7, 7, 3000]
    assert all((seg.span(s, e) == ids[s:e]).all() for s, e in ((0, 3000), (7, 2999), (511, 513), (1024, 1024), (2999, 3000)))
    assert (seg.span(0, 3000) == ids).all() and all(seg.get(i) == ids[i] for i in range(0, 3000, 13))
    assert len(token_store.Segment(token_store.encode_segment(ids[:0], np.array([0]))).span(0, 0)) == 0


def test_token_store(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    want, start = Counter(), 0
    for r in sorted(rows(), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        ids = [*tok.encode(r[2] or "", add_special_tokens=False).ids, 0]
        want[r[1], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    segments = token_store.write_segments(docs, segment_ids=200)
    assert segments.count() > 3
    assert table(token_store.read_documents(token_store.with_starts(segments)), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_store.read_documents(token_store.with_starts(token_store.write_segments(empty))).count() == 0


def test_token_store_deals_hot_ids_over_parts(spark):
    tok = Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))
    data = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"text {i} <|endoftext|> end" if i % 2 else "copy") for i in range(300)]
    segments = token_store.write_segments(spark.createDataFrame(data, "doc_id long, text string").repartition(3), parts=12)
    assert segments.groupBy("part").count().count() >= 11
    got = sorted(token_store.read_documents(token_store.with_starts(segments), with_ids=True).collect(), key=lambda r: r["start"])
    place, last = 0, -1
    for r in got:
        assert r["start"] == place and r["n_tokens"] == len(r["ids"]) and (-1 if r["doc_id"] is None else r["doc_id"]) >= last
        place, last = place + r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((k, (*tok.encode(t, add_special_tokens=False).ids, 0)) for k, t in data)


# ---- 6 ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash(docs, empty):
    data = rows()
    prints = [plain_fingerprint(r[2]) for r in data]
    roots = plain_components(prints)
    ids = defaultdict(list)
    for r, root in zip(data, roots, strict=True):
        ids[root].append(r[1])
    want = Counter((r[1], simhash.signed(p), min((x for x in ids[root] if x is not None), default=None)) for r, p, root in zip(data, prints, roots, strict=True))
    assert table(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4, 10**6])
def test_links_within_a_list(block):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, dtype=np.uint64) & ~np.uint64(0xFFFFFF)
    fps = np.unique(base | rng.integers(0, 2**9, 150).astype(np.uint64) << np.uint64(4) | rng.integers(0, 2**2, 150).astype(np.uint64) << np.uint64(20))
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in simhash.run_links(fps, (0, 1, 2), block=block):
        assert int(fps[a] ^ fps[b]).bit_count() <= 3
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = plain_components([int(x) for x in fps])
    assert len({(root(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({root(i) for i in range(len(fps))})


def test_every_five_positions_hold_a_list():
    sets = [set(s) for s in simhash.position_sets()]
    assert len(sets) == 14 and all(len(s) == 4 for s in sets)
    assert all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))
    assert all(any(set(s) <= set(six) for s in simhash.position_sets(2)) for six in combinations(range(8), 6))


def test_the_count_filter_rejects():
    """Pairs that meet in a list of 4 positions but share no fifth go before any bits are compared."""
    fps = np.array([0, 0x0101010100000000, 0x0001010100000000, 7], np.uint64)
    octets = fps.view(np.uint8).reshape(-1, 8)
    assert simhash.tallied(octets, 0, 5).tolist() == [2, 3] and simhash.tallied(octets, 1, 5).tolist() == [2]
    assert simhash.run_links(fps, (4, 5, 6, 7)) == [(0, 2), (0, 3), (1, 2)]


@pytest.mark.parametrize("block", [4, 10**6])
def test_long_lists_of_four_positions(block):
    rng = np.random.default_rng(18)
    fps = np.unique(np.bitwise_or.reduce([np.uint64(1) << rng.integers(32, 64, 120).astype(np.uint64) for _ in range(3)], axis=0))
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in simhash.run_links(fps, (4, 5, 6, 7), block=block):
        assert int(fps[a] ^ fps[b]).bit_count() <= 3
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = plain_components([int(x) for x in fps])
    assert len({(root(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({root(i) for i in range(len(fps))})


@pytest.mark.parametrize("most_list", [2, 10**6])
def test_hot_lists_are_cut(spark, most_list):
    from lumetric.llm.components import components

    rng = np.random.default_rng(19)
    hot = [int(x) for x in np.bitwise_or.reduce([np.uint64(1) << rng.integers(30, 63, 60).astype(np.uint64) for _ in range(3)], axis=0)]
    prints = sorted({*hot, *map(int, rng.integers(0, 2**63, 20))})
    d = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["v"]: r["root"] for r in components(simhash.link_table(d, most_list=most_list), "test").collect()}
    want = plain_components(prints)
    groups = {(roots.get(p, p), prints[w]) for p, w in zip(prints, want, strict=True)}
    assert len(groups) == len({a for a, _ in groups}) == len({b for _, b in groups})


def test_a_chain_and_random_prints(spark):
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(0, 2**63, 40)]
    chain = [prints[0]]
    for k in range(20):
        chain.append(chain[-1] ^ (0b111 << (3 * k)))
    prints = list(dict.fromkeys(prints + chain))
    d = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    from lumetric.llm.components import components

    roots = {r["v"]: r["root"] for r in components(simhash.link_table(d), "test").collect()}
    groups = Counter(roots[simhash.signed(p)] for p in chain)
    assert len(groups) == 1 and len(roots) == len(chain)


# ---- 7, 9 -------------------------------------------------------------------


def test_quality_model_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op7_quality_classifier"](spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) > 0.9 * len(got)


def test_quality_model_rows(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.learn(docs, labels)
    both = [quality_model.posterior(docs, model, broadcast_paths=n).count() for n in (10**6, 0)]
    assert both == [len(rows())] * 2
    assert quality_model.posterior(empty, model).count() == 0


def plain_posterior(data, model):
    """(doc_id, host, path, text) rows: the same sums group by group, each document left out by hand."""
    odds = [float(model.log_odds(np.array([quality_model.text_features(t)]))[0]) for *_, t in data]
    p = [1 / (1 + np.exp(-z)) for z in odds]
    base = min(max(sum(p) / len(p), 1e-4), 1 - 1e-4)

    def groups(key):
        out = defaultdict(list)
        for r, x in zip(data, p, strict=True):
            out[key(r)].append(x)
        return out

    def strength(found):
        usable = [g for g in found.values() if len(g) >= 2]
        if len(usable) < 2:
            return quality_model.MOST_STRENGTH
        spread = np.mean([(np.mean(g) - base) ** 2 for g in usable])
        between = max(spread - base * (1 - base) * np.mean([1 / len(g) for g in usable]), 1e-9)
        return min(max(base * (1 - base) / between - 1, quality_model.LEAST_STRENGTH), quality_model.MOST_STRENGTH)

    hosts, paths = groups(lambda r: r[1]), groups(lambda r: (r[1], r[2]))
    k_host, k_path, out = strength(hosts), strength(paths), []
    for r, z, x in zip(data, odds, p, strict=True):
        host, path = hosts[r[1]], paths[r[1], r[2]]
        host_rate = (k_host * base + max(sum(host) - x, 0)) / (k_host + len(host) - 1)
        path_rate = (k_path * host_rate + max(sum(path) - x, 0)) / (k_path + len(path) - 1)
        rate = min(max(path_rate, 1e-4), 1 - 1e-4)
        out.append((r[0], host_rate, path_rate, 1 / (1 + np.exp(-(z - model.base + np.log(rate / (1 - rate)))))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_paths", [10**6, 0])
def test_quality_posterior_is_the_plain_one(spark, docs, broadcast_paths):
    rng = np.random.default_rng(6)
    more = [(1000 + i, " ".join(f"w{j}" for j in rng.integers(0, 60, int(rng.integers(1, 200)))) + "!" * int(rng.integers(0, 9)), f"h{i % 7 * (i % 2)}", f"p{i % 3}") for i in range(150)]
    data = [(r[1], r[4], r[3], r[2]) for r in rows()] + [(i, h, p, t) for i, t, h, p in more]
    x = np.array([quality_model.text_features(t) for *_, t in data])
    model = quality_model.Evidence().fit(x, (x[:, 0] > np.median(x[:, 0])).astype(float))
    d = spark.createDataFrame([(i, t, h, p) for i, h, p, t in data], "doc_id long, text string, source string, lang string")
    got = sorted(((r["doc_id"], r["host_rate"], r["path_rate"], r["score"]) for r in quality_model.posterior(d, model, broadcast_paths=broadcast_paths).collect()), key=repr)
    want = {k: sorted(v) for k, v in groupby_id(plain_posterior(data, model)).items()}
    for k, v in groupby_id(got).items():
        assert np.allclose(sorted(v), want[k], rtol=1e-9, atol=1e-12)


def groupby_id(found):
    out = defaultdict(list)
    for k, *v in found:
        out[k].append(v)
    return out


def test_hot_labelled_ids_are_learned_from_once(spark):
    d = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1), (2, None), (2, 7)], "doc_id long, quality int")
    got = labelled(d, labels, "quality", 100, 7).collect()
    held = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sorted((r["row"], r["quality"]) for r in got) == [x for x in [(1, 1), (2, 0)] if x[0] not in held]


def test_sparse_sites_shrink(spark):
    d = spark.createDataFrame([(i, "x", "big" if i < 400 else f"s{i}", "p") for i in range(403)], "doc_id long, text string, source string, lang string")
    model = quality_model.Evidence()
    got = {r["doc_id"]: r for r in quality_model.posterior(d, model).collect()}
    assert abs(got[402]["path_rate"] - 0.5) < 1e-9 and abs(got[402]["score"] - 0.5) < 1e-9


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op9_toxicity"](spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.93 * len(got)


def test_grammar_reads_clauses():
    g = toxicity.Grammar([("idiot", 5.0, False)])
    score = {t: g.score(t) for t in ("you are an idiot", "the idiot box", "you are not an idiot", "he said you are an idiot", "i will kill you", "kill the lights", "", "nice day")}
    assert score["you are an idiot"] > score["the idiot box"] > score["you are not an idiot"]
    assert score["he said you are an idiot"] < score["you are an idiot"]
    assert score["i will kill you"] > score["kill the lights"] == score[""] == score["nice day"]
    assert g.score("not today, you idiot") > g.score("you are not an idiot")
    assert g.score("he said hello but you are an idiot") > g.score("he said you are an idiot")


def plain_matches(classes):
    """The five machines by definition, one after the other over a list of classes."""
    T = toxicity
    out, clause = [], []
    for at, kind in enumerate([*classes, T.END]):
        clause.append(kind)
        if kind not in (T.END, T.CONTRAST):
            continue
        words = [i for i, k in enumerate(clause) if k not in (T.COMMA, T.END, T.CONTRAST)]
        rank = {i: n for n, i in enumerate(words)}

        def near(i, kinds, reach, stop_at_comma=False):
            for j in range(i - 1, -1, -1):
                if stop_at_comma and clause[j] == T.COMMA:
                    return None
                if j in rank and clause[j] in kinds:
                    return j if rank[i] - rank[j] <= reach else None
            return None

        said = [any(k == T.REPORT for k in clause[:i]) for i in range(len(clause))]
        negated = [i in rank and near(i, (T.NEGATION,), T.NEGATION_REACH, True) is not None for i in range(len(clause))]
        used = set()
        for i in words:
            if clause[i] == T.INSULT:
                out.append((T.INSULT, near(i, (T.TARGET,), T.TARGET_REACH) is not None, negated[i], said[i]))
            if clause[i] == T.TARGET:
                j = near(i, (T.THREAT,), T.THREAT_REACH)
                if j is not None and j not in used:
                    used.add(j)
                    out.append((T.THREAT, True, negated[j], said[i]))
        clause = []
    return out


def test_the_composition_is_its_machines_in_turn():
    rng = np.random.default_rng(12)
    nexts, outs = toxicity.tabulated(toxicity.clause_machine(), range(toxicity.END + 1))
    kinds = set()
    for _ in range(4000):
        classes = rng.choice(9, int(rng.integers(1, 25)), p=[0.2, 0.12, 0.15, 0.12, 0.05, 0.03, 0.25, 0.06, 0.02]).tolist()
        state, found = 0, []
        for c in classes:
            if outs[state][c] >= 0:
                found.append(toxicity.KINDS[outs[state][c]])
            state = nexts[state][c]
        assert found == plain_matches(classes)
        kinds |= set(found)
    assert len(kinds) == 12 and len(nexts) < 2000  # every insult, and threats that are aimed


def test_composing_two_machines():
    def plus(n):
        return toxicity.Machine(0, lambda s, x: ((s + x) % n, s))

    both, one, two = toxicity.compose(plus(3), plus(5)), plus(3), plus(5)
    s, a, b = both.start, one.start, two.start
    for x in [1, 2, 2, 0, 1, 1, 2]:
        s, got = both.step(s, x)
        a, y = one.step(a, x)
        b, want = two.step(b, y)
        assert got == want and s == (a, b)


def test_patterns_are_the_plain_greedy_ones(spark):
    rng, T = np.random.default_rng(13), toxicity
    data = []
    for i in range(240):
        toxic = int(i % 3 == 0)
        words = [f"common{chr(97 + j)}" for j in rng.integers(0, 20, 12)]
        if toxic:
            words += [("zzinsult", "aardvarked", "mean" + chr(97 + i % 5) + "er", "rarely" + chr(97 + i % 26))[int(rng.integers(4))]]
        data.append((i, " ".join(words), toxic))
    fixed, pos, neg = frozenset(w for v in T.FIXED.values() for w in v.split()), 80, 160
    keys = [T.keys_of(t, fixed) for _, t, _ in data]
    count = Counter((k, y) for found, (*_, y) in zip(keys, data, strict=True) for k in found)

    def score(a, b):
        def part(k, n):
            return sum(x * np.log(x / n) for x in (k, n - k) if x)

        return 2 * (part(a, pos) + part(b, neg) - part(a + b, pos + neg)) if a * neg > b * pos else 0.0

    strong = {k for k, y in count if y and count[k, 1] >= T.LEAST_DOCS and count[k, 1] * neg > 10 * pos * count[k, 0] and score(count[k, 1], count[k, 0]) >= T.LEAST_RATIO}
    left, want = {i for i, (*_, y) in enumerate(data) if y}, []
    while True:
        gains = [(round(score(a, count[k, 0]), 9) if a >= T.LEAST_DOCS / 2 else 0.0, len(k.rstrip("*")), k) for k in strong if k not in want for a in [sum(k in keys[i] for i in left)]]
        if not gains or max(gains)[0] < T.LEAST_RATIO:
            break
        want.append(max(gains)[2])
        left = {i for i in left if want[-1] not in keys[i]}
    rest = {k for k in strong if k not in want and not k.endswith("*") and count[k, 1] >= 10 * max(count[k, 0], 1)}
    got = T.patterns(spark.createDataFrame(data, "row long, text string, toxic int"))
    assert [w + "*" * p for w, _, p in got][: len(want)] == want and {w for w, _, _ in got[len(want) :]} == rest and "zzinsult" in {w for w, *_ in got}


def test_toxicity_rows(spark, docs, empty):
    g = toxicity.learn(docs, spark.createDataFrame([(5, None), (6, 1)], "doc_id long, toxic int"))
    assert toxicity.scored(docs, g).count() == len(rows())
    assert toxicity.scored(empty, g).count() == 0


# ---- 8 ----------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    edited = " ".join([*w[:6], "changed", *w[7:12], "an", "insert", *w[12:]])
    texts = ["pre " * 30 + item.upper() + " post" * 40, "x " + edited, " ".join(w[:6]) + " something else entirely", None, "", "clean text " * 50, item + " " + "pad " * 5000 + item, "this is Too short!", "too long, not short, too short"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, item, 1), (7, texts[7], 1)], "doc_id long, text string, score int")
    bench = spark.createDataFrame([(7, item, "x"), (8, "too short", "x"), (9, None, "x"), (7, item, "y")], "item_id long, text string, TEXT string")
    got = decontamination.contaminated(d, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == {(k, 7): 2 for k in (0, 1, 6, None)} | {(7, 8): 2, (8, 8): 1}
    assert sum(r["item_id"] == 8 for r in got) == 3
    assert all(r["score"] == 1.0 for r in got if r["doc_id"] != 1) and all(0.6 <= r["score"] < 1 for r in got if r["doc_id"] == 1)
    blocks = decontamination.contaminated(d, bench, block_words=10).collect()
    assert Counter(tuple(r) for r in blocks) == Counter(tuple(r) for r in got)
    assert decontamination.contaminated(empty, bench).count() == 0 == decontamination.contaminated(docs, bench.limit(0)).count()


def test_decontamination_is_the_plain_search(spark):
    """Every document against every item: a shared seed, then the whole document aligned."""
    rng = np.random.default_rng(11)
    common = [f"stock{i}" for i in range(8)]
    items = [[*common, *[f"i{k}w{j}" for j in range(12)]] for k in range(12)]
    texts = []
    for k in range(60):
        words = [f"pad{j}" for j in rng.integers(0, 50, 40)]
        item = items[int(rng.integers(12))]
        part = item[: int(rng.integers(4, 21))] if k % 2 else [w if rng.random() > 0.15 else "edit" for w in item]
        texts.append(" ".join([*words[:20], *part, *words[20:], *(common if k % 3 else [])]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        number = {}
        words = np.array([number.setdefault(w, len(number)) for w in t.split()])
        for k, item in enumerate(items):
            own = np.array([number.get(w, -9) for w in item])
            seeded = {tuple(words[j : j + 5].tolist()) for j in range(len(words) - 4)} & {tuple(own[j : j + 5].tolist()) for j in range(len(own) - 4)}
            score = decontamination.alignment(own, words) / len(item)
            if seeded and score >= decontamination.LEAST_SCORE:
                want[i, k] = round(score, 6)
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(d, bench).collect()} == want and len(want) > 15


def test_stock_phrases_make_no_rows():
    stock = "the stock phrase that all items share"
    index = decontamination.Index([(k, f"{stock} " + " ".join(f"i{k}w{j}" for j in range(9))) for k in range(500)])
    ids = index.numbers(decontamination.words_of(f"{stock} " * 3))
    seeds, _ = index.hits(ids)
    items = np.unique(index.seed_item[seeds])
    assert len(items) == 500 and index.shared[seeds].min() == 500 and not (index.reach(ids, items) >= 0.6).any()
    rare = decontamination.windows(np.arange(1, 1000, dtype=np.int32), np.array([10, 500, 900]), 5, np.array([3, 9, 1]))
    assert rare[0] == 891 and rare.tolist().count(-1) == 2


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.alignment(a, b) == h.max()


def test_a_leak_in_a_third_of_all_documents_is_found(spark):
    item = " ".join(f"term{i}" for i in range(20))
    d = spark.createDataFrame([(i, item if i % 3 == 0 else "other words here " * 9) for i in range(90)], "doc_id long, text string")
    assert decontamination.contaminated(d, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 30


# ---- 10 ---------------------------------------------------------------------


def test_warc_round_trip(spark):
    data = [(1, "u1", "<p>é</p>"), (2, "u2", "<p>é</p>"), (3, None, None), (4, "u4", ""), (5, "u\r\n5", "WARC/1.1\r\nfake: x\r\n\r\n\x1f\x8b\x08"), (None, "u", "<p>é</p>"), (6, "u6", "x" * 300000), (6, "u6", "x" * 300000)]
    d = spark.createDataFrame([(*r, 9) for r in data], "page_id long, url string, html string, refers_to int")
    from lumetric.llm.common import shared_path

    path = shared_path(spark, "test", "warc")
    warc.write_archives(d.coalesce(1), path, archive_bytes=300)
    assert len({r["file"] for r in warc.read_archives(spark, path).collect()}) > 2
    got = warc.read_archives(spark, path).collect()
    assert not [r for r in got if r["gap"]]
    largest = {h or "": max(p for p, _, g in data if p is not None and (g or "") == (h or "")) for _, _, h in data}
    want = Counter()
    for p, _, h in data:
        raw, first = (h or "").encode(), largest[h or ""]
        own = first == p
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    path = shared_path(spark, "test", "warc")
    warc.write_archives(d, path, least_bytes=10**6)
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_no_archives_of_no_pages(spark):
    from lumetric.llm.common import shared_path

    path = shared_path(spark, "test", "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def records(n=20):
    return [warc.record_bytes(i, "u", f"<p>{'text ' * i}</p>".encode(), False, None, "X") for i in range(n)]


def test_salvage_after_damage():
    members = [warc.gzip_member(r) for r in records()]
    data = b"".join(members)
    assert len(warc.salvage(data).records) == 20 == len(warc.salvage(b"".join(records())).records)
    assert len(warc.salvage(gzip.compress(b"".join(records()))).records) == 20
    hurt = bytearray(data)
    at = sum(map(len, members[:5]))
    hurt[at + 60] ^= 255
    found = warc.salvage(bytes(hurt))
    assert len(found.records) == 19 and [(s, e) for s, e, _ in found.gaps] == [(at, at + len(members[5]))]
    cut = warc.salvage(data[:-10])
    assert len(cut.records) == 19 and cut.gaps[0][1] == len(data) - 10
    junk = warc.salvage(b"junk" + data[:at] + b"\x1f\x8b\x08nonsense" + data[at:])
    assert len(junk.records) == 20 and len(junk.gaps) == 2
    plain = b"".join(records()).replace(b"text text text text text </p>", b"text teXt text text text </p>", 1)
    assert len(warc.salvage(plain).records) == 19 and len(warc.salvage(plain).gaps) == 1
    assert warc.salvage(b"").records == [] and warc.salvage(b"").gaps == []


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_quality_rules", "op3_html_extraction", "op4_byte_bpe", "op5_token_store", "op6_simhash_near_dedup", "op10_warc"])
def test_a_row_for_each_input_row(spark, sf, name):
    rows_in = read(spark, sf, "pages" if name in ("op3_html_extraction", "op10_warc") else "documents").count()
    assert registry.QUERIES[name](spark, sf).count() == rows_in
