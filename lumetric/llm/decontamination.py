"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every item's 5-word runs are its seeds; a shorter item is one seed as a whole. One
scan of the corpus finds the seeds of each document. An item whose words the
document doesn't hold to the least score, in any order, can't be aligned that
well and goes before a row is made, so that stock phrases shared by many items
cost no rows. For the others the words around the seeds leave the scan, windows
with the rarest seeds (by the number of items that have them) first, and are aligned
with the item in that order (match 1, mismatch and gap -1) until one is perfect;
no hit is dropped for the frequency of its seeds. The best local score over the
item's length says how much of it the document holds, edited words and gaps
allowed.

Scale: items are searched in blocks of at most BLOCK_WORDS words, a proven bound
on what is broadcast; a larger benchmark takes one scan for each block. Only
document numbers and word numbers leave a scan, a row for each (document, item)
that may reach the score; nothing is grouped by document or by seed.

Defined results
    null or empty text   no passage, whatever the item
    null or empty items  never found
    items of 1 to 4 words  found where all their words stand in a row
    very long text       whole text; passages are windows around seeds
    repeated rows        each row of either table counts for itself
    null doc_id/item_id  carried along
    ties                 equal scores: one row for each (document row, item)
    empty tables         empty result
    other columns        ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_table, take

SEED_WORDS, LEAST_SCORE = 5, 0.6
#: Words of the items that are searched in one scan.
BLOCK_WORDS = 400_000
OWNER = "decontamination"
#: ASCII punctuation and controls end a word, but for the apostrophe.
_SPACES = bytes(32 if b < 128 and not chr(b).isalnum() and b != 39 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


class Index:
    """The seeds of a block of items; small enough to broadcast."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed_words: int = SEED_WORDS) -> None:
        self.vocabulary = {}
        self.item_ids, self.items = [], []
        for item_id, text in items:
            if words := words_of(text):
                self.item_ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        self.sizes = [min(len(x), seed_words) for x in self.items]
        #: The lengths of the seeds.
        self.lengths = sorted(set(self.sizes))
        hashes = [self.hashes(x, n)[0] for x, n in zip(self.items, self.sizes, strict=True)]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owners = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.lexsort((owners, flat))
        flat, owners = flat[order], owners[order]
        new = np.r_[True, (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1])] if len(flat) else np.empty(0, bool)
        #: (hash, item) entries, sorted; an entry's place is its seed number
        self.seed_hash, self.seed_item = flat[new], owners[new]
        #: By seed number: how many items have the seed.
        self.shared = np.searchsorted(self.seed_hash, self.seed_hash, "right") - np.searchsorted(self.seed_hash, self.seed_hash, "left")
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.seed_hash >> np.uint64(44)] = True
        #: All items' words in one array, and where each item begins.
        self.begins = np.r_[0, np.cumsum([len(x) for x in self.items])].astype(np.int64)
        self.words = np.concatenate(self.items) if self.items else np.empty(0, np.int32)

    def hashes(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n known words, and where the runs start."""
        if len(ids) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = np.r_[0, np.cumsum(ids > 0)]
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        h = np.full(len(at), n, np.uint64)
        wide = ids.astype(np.uint64)
        for k in range(n):
            h = (h ^ wide[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h, at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter([get(w, 0) for w in words], np.int32, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed number, place) of every seed in a text."""
        found = [self.hashes(ids, n) for n in self.lengths]
        h, at = (np.concatenate([x[i] for x in found]) for i in range(2)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        maybe = self.filter[h >> np.uint64(44)]
        h, at = h[maybe], at[maybe]
        low, high = np.searchsorted(self.seed_hash, h, "left"), np.searchsorted(self.seed_hash, h, "right")
        times = high - low
        first = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]] if len(times) else low, times)
        return first + np.arange(int(times.sum())), np.repeat(at, times)

    def reach(self, ids: np.ndarray, items: np.ndarray) -> np.ndarray:
        """The share of each item's words that a text holds: no alignment scores more."""
        here = np.zeros(len(self.vocabulary) + 1, bool)
        here[ids] = True
        sizes = self.begins[items + 1] - self.begins[items]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[items] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        held = np.r_[0, np.cumsum(here[self.words[at]])]
        return (held[ends] - held[ends - sizes]) / sizes


def windows(ids: np.ndarray, places: np.ndarray, length: int, shared: np.ndarray) -> np.ndarray:
    """The words around the seeds' places, -1 between windows that don't meet; those
    with the rarest seed (the least of `shared`) first."""
    order = np.argsort(places, kind="stable")
    places, shared = places[order], shared[order]
    first = np.flatnonzero(np.r_[True, np.diff(places) > 4 * length])
    rarest = np.minimum.reduceat(shared, first)
    out = []
    for k in np.argsort(rarest, kind="stable").tolist():
        last = (first[k + 1] if k + 1 < len(first) else len(places)) - 1
        out += [ids[max(0, places[first[k]] - 2 * length) : places[last] + 2 * length], np.array([-1], np.int32)]
    return np.concatenate(out[:-1])


def alignment(item: np.ndarray, passage: np.ndarray) -> int:
    """The best local alignment score: match 1, mismatch -1, gap -1."""
    best = 0
    for part in np.split(passage, np.flatnonzero(passage < 0)):
        part = part[part >= 0]
        steps, row = np.arange(len(part) + 1), np.zeros(len(part) + 1, np.int64)
        for word in item:
            new = np.zeros_like(row)
            new[1:] = np.maximum(row[:-1] + np.where(part == word, 1, -1), row[1:] - 1)
            row = np.maximum.accumulate(np.maximum(new, 0) + steps) - steps
            best = max(best, int(row.max()))
        if best == len(item):
            break
    return best


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks, streamed to the driver a partition at a time."""
    block, words = [], 0
    rows = take(benchmark, "item_id", "text").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    for row in rows.toLocalIterator():
        n = len(words_of(row["text"]))
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row["item_id"], row["text"]))
        words += n
    if block:
        yield block


def _scan(docs: DataFrame, index, least_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Index = index.value
        schema = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("passage", pa.list_(pa.int32()))])
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = found.numbers(words_of(text.as_py()))
                seeds, places = found.hits(ids)
                if not len(seeds):
                    continue
                order = np.argsort(found.seed_item[seeds], kind="stable")
                seeds, places = seeds[order], places[order]
                items, first = np.unique(found.seed_item[seeds], return_index=True)
                last = np.r_[first[1:], len(seeds)]
                for k in np.flatnonzero(found.reach(ids, items) >= least_score).tolist():
                    mine, item = slice(first[k], last[k]), int(items[k])
                    out.append((doc_id.as_py(), item, windows(ids, places[mine], len(found.items[item]), found.shared[seeds[mine]])))
            for at in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[at : at + 2000], strict=True), schema, strict=True)], schema=schema)

    rows = take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id bigint, item bigint, passage array<int>")


def _align(hits: DataFrame, index, least_score: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, memo = index.value, {}
        for b in batches:
            out = []
            for doc_id, item, passage in zip(*[b.column(i) for i in range(3)], strict=True):
                words, own = passage.values.to_numpy(), item.as_py()
                # again for the passage alone, which is less than the text
                if np.isin(found.items[own], words).sum() / len(found.items[own]) < least_score:
                    continue
                key = (own, words.tobytes())
                if key not in memo:
                    memo = memo if len(memo) < 5000 else {}
                    memo[key] = alignment(found.items[own], words) / len(found.items[own])
                if memo[key] >= least_score:
                    out.append((doc_id.as_py(), found.item_ids[own], round(memo[key], 6)))
            if out:
                d, i, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "item_id", "score"])

    return hits.mapInArrow(run, "doc_id bigint, item_id bigint, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS, owner: str = OWNER) -> DataFrame:
    """doc_id, item_id, score: every document and item that align well enough."""
    spark = docs.sparkSession
    sc, found = spark.sparkContext, []
    for block in _blocks(benchmark, block_words):
        index = Index(block, seed_words)
        if not len(index.seed_hash):
            continue
        shared = sc.broadcast(index)
        hits = shared_table(_scan(docs, shared, least_score), owner, "hits")
        found.append(_align(hits, shared, least_score))
    if not found:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
