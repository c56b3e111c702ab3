"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints link at `bits` (3) or fewer differing bits, so a linked pair
differs in 3 of its 8 bytes at most and shares 5 positional bytes: that is the
guaranteed minimum of the count filter. Single (position, byte) lists hold
1/256 of all rows each, and joining on them grows with the square of the input;
so lists are keyed by 4 positions with their 4 bytes. 14 choices of 4 positions
(the Steiner system S(3, 4, 8)) suffice: every 5 positions contain one of them, so a
linked pair meets. For each pair that meets, shared positional bytes are tallied
over all 8 positions, pairs under the minimum of 5 go, and the rest is verified
by the count of differing bits.

Only *distinct* fingerprints are indexed: exact copies, a hot group of any
size, are one entry. A list of more than MOST_LIST fingerprints (counted) is
replaced by its 4 lists of one more position, whose members differ in 3 given
bytes only, so that they hold 2^24 fingerprints (128 MB) at the very most, whatever
the input. Lists are read as sorted runs; short ones are tallied in blocks; long
ones are first cut by one more position each, and where pairs would still grow
with the square, all links come from sorting by every choice of 3 of the 24 free
bits (fingerprints equal elsewhere are linked). Either way a list emits a
spanning forest of its links and never the pairs.

The pipeline's near-duplicate stage takes the same index for alike texts, which differ in
more bits: a minimum of 4 shared bytes, lists of 3 positions (20 hold every 4), and
`within` 64, since whole texts decide there. Of fingerprints that meet, the nearest are
joined first.

Defined results
    null or empty text, or only white space: fingerprint zero, linked as any other
    fewer than 3 words: one shingle of all words
    repeated rows      each appears, with the same component
    null doc_id        kept; not a candidate for the smallest id unless alone
    very long text     whole text
    empty table        empty result
    other columns      ignored
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_table, take
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Fingerprints of one list up to which links are tallied pair by pair, in blocks.
BLOCK = 1024
#: Fingerprints from which a list of 4 positions is replaced by lists of 5.
MOST_LIST = 1 << 20
OWNER = "simhash"


def position_sets(bits: int = BITS) -> list[tuple[int, ...]]:
    """Choices of positions such that every 8 - bits positions contain one of them."""
    if bits == 4:
        # Turan's triples: within a group, or two of a group and one of the next
        groups = (0, 1, 2), (3, 4, 5), (6, 7)
        out = [t for g in groups for t in combinations(g, 3)]
        return out + [tuple(sorted((*two, x))) for g, after in zip(groups, groups[1:] + groups[:1], strict=True) for two in combinations(g, 2) for x in after]
    if bits != 3:
        return list(combinations(range(8), 8 - bits))
    halves = (0, 1, 2, 3), (4, 5, 6, 7)
    # the three ways to pair a half's positions; equal ways of both halves go together
    pairings = [[((h[0], h[k]), tuple(x for x in h[1:] if x != h[k])) for k in (1, 2, 3)] for h in halves]
    return [*halves, *[(*a, *b) for left, right in zip(*pairings, strict=True) for a in left for b in right]]


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes (unsigned) of a text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) < shingle:
        parts: Iterable[bytes] = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    of = xxhash.xxh64_intdigest
    return np.array([of(p, SEED) for p in parts], dtype="<u8")


def folded(h: np.ndarray) -> int:
    """The fingerprint: the bits set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return folded(hashes(text, shingle))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (bigint, the fingerprint's bits)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([signed(fingerprint(x.as_py(), shingle)) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(rows, "doc_id bigint, fp bigint")


class Forest:
    """Union-find over positions; keeps the unions that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        apart = self.up[a] != self.up[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.kept.append((x, y))


def tallied(octets: np.ndarray, i: int, least: int) -> np.ndarray:
    """The count filter: the rows behind row i that share `least` positional bytes with it."""
    return np.flatnonzero((octets[i + 1 :] == octets[i]).sum(axis=1) >= least) + i + 1


def run_links(fps: np.ndarray, free: tuple[int, ...], bits: int = BITS, block: int = BLOCK, within: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (uint64) that
    may differ in the `free` byte positions only: 8 - bits shared bytes and at most
    `within` differing bits (None: bits; beyond that only 64, no bound) make a link."""
    within = bits if within is None else within
    forest, n = Forest(len(fps)), len(fps)
    octets = fps.view(np.uint8).reshape(-1, 8)
    if n <= block:
        for i in range(n - 1):
            near = tallied(octets, i, 8 - bits)
            apart = np.bitwise_count(fps[near] ^ fps[i])
            near = near[apart <= within] if within < 64 else near[np.argsort(apart, kind="stable")]
            if len(near):
                forest.join(np.full(len(near), i), near)
        return forest.kept
    if len(free) > bits:
        # a linked pair shares one more position
        for position in free:
            order = np.argsort(octets[:, position], kind="stable")
            cut = np.flatnonzero(np.diff(octets[order, position])) + 1
            for part in np.split(order, cut):
                if len(part) > 1:
                    links = run_links(np.ascontiguousarray(fps[part]), tuple(p for p in free if p != position), bits, block, within)
                    if links:
                        a, b = np.array(links).T
                        forest.join(part[a], part[b])
        return forest.kept
    if within == 64:
        # all of them share the least number of bytes
        order = np.argsort(fps, kind="stable")
        return list(zip(order[:-1].tolist(), order[1:].tolist(), strict=True))
    open_bits = [8 * p + k for p in free for k in range(8)]
    for chosen in combinations(open_bits, bits):
        mask = ~np.uint64(sum(1 << k for k in chosen))
        order = np.argsort(fps & mask, kind="stable")
        held = (fps & mask)[order]
        same = np.flatnonzero(held[1:] == held[:-1])
        forest.join(order[same], order[same + 1])
        if len(forest.kept) == n - 1:
            break
    return forest.kept


def list_links(postings: DataFrame, subsets: list[tuple[int, ...]], bits: int = BITS, within: int | None = None) -> DataFrame:
    """a, b: forests of the lists, which come as sorted runs of (list, key, fp)."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.empty(0, np.int64)] * 3

        def out(ids: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(ids):
                return
            cut = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(ids)]
            found: list[tuple[int, int]] = []
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                run = fps[s:e].astype(np.int64).view(np.uint64)
                free = tuple(p for p in range(8) if p not in subsets[ids[s]])
                signed_run = fps[s:e]
                found += [(int(signed_run[i]), int(signed_run[j])) for i, j in run_links(np.ascontiguousarray(run), free, bits, within=within)]
            if found:
                a, b = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(left)]
            ids, keys = cols[0], cols[1]
            # the last run may go on in the next batch
            last = int(np.flatnonzero((ids != ids[-1]) | (keys != keys[-1]))[-1]) + 1 if len(ids) and ((ids != ids[-1]) | (keys != keys[-1])).any() else 0
            yield from out(*[c[:last] for c in cols])
            left = [c[last:] for c in cols]
        yield from out(*left)

    return postings.mapInArrow(links, "a bigint, b bigint")


def link_table(distinct: DataFrame, bits: int = BITS, most_list: int = MOST_LIST, owner: str = OWNER, within: int | None = None) -> DataFrame:
    """a, b: links among the distinct fingerprints of column fp that connect
    exactly what all links of `bits` or fewer differing bits connect; with `within` 64
    all fingerprints that share 8 - bits bytes, list by list."""
    whole = position_sets(bits)
    cuts = [tuple(sorted((*w, p))) for w in whole for p in range(8) if p not in w] if bits in (3, 4) else []
    subsets = [*whole, *dict.fromkeys(cuts)]

    def entries(sets: list[tuple[int, ...]]) -> Column:
        keys = [F.col("fp").bitwiseAND(F.lit(signed(sum(0xFF << (8 * p) for p in s)))) for s in sets]
        return F.array(*[F.struct(F.lit(subsets.index(s)).cast("bigint").alias("list"), k.alias("key")) for s, k in zip(sets, keys, strict=True)])

    def posted(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
        return rows.select(F.explode(entries(sets)).alias("e"), "fp").select("e.list", "e.key", "fp")

    postings = posted(distinct, whole)
    if cuts:
        long = postings.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_list)
        long = shared_table(long.select("list", "key"), owner, "long")  # few: each has over most_list of 14 entries for a fingerprint
        if long.limit(1).count():
            parts = [posted(postings.where(F.col("list") == i).join(long, ["list", "key"], "left_semi").select("fp"), [c for c in subsets[len(whole) :] if set(w) < set(c)]) for i, w in enumerate(whole)]
            postings = postings.join(long, ["list", "key"], "left_anti")
            for part in parts:
                postings = postings.unionByName(part)
    postings = postings.repartition("list", "key").sortWithinPartitions("list", "key")
    return list_links(postings, subsets, bits, within)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, owner: str = OWNER) -> DataFrame:
    """doc_id, fp and component_id for every row of docs."""
    prints = shared_table(fingerprints(docs, shingle), owner, "prints")
    distinct = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), owner, "distinct")
    links = shared_table(link_table(distinct.select("fp"), bits, owner=owner), owner, "forest")
    roots = components(links, owner)
    named = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = shared_table(named, owner, "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = shared_table(named.join(least, "root").select("fp", "component_id"), owner, "of_print")
    # both sides are stored tables, so adaptive execution can split a hot fingerprint
    return prints.join(of_print, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
