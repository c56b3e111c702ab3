"""Near-duplicate texts: every pair whose 5-word shingles have a Jaccard of 0.8 at least.

Operator 6's method comes first: SimHash fingerprints over 5-word shingles, its
byte-position inverted index and count filter, here at a minimum of 4 shared bytes, since
texts as alike as that differ in 10 bits on average. What the index joins is verified by
whole sets. No minimum of shared bytes is certain at that Jaccard, so the pairs that the
fingerprints leave are found in an exact way, between different components only.

That join is exact. Shingles are put in one order for all texts, those common in
a sample last; of two texts as alike as that, each has a shared shingle among
its first n - ceil(0.8 n) + 1, so only these are posted and only texts that
meet in a list are compared. The sample sets the order only, and any order finds the
same pairs. Where two sets first meet they share at most what each has from there on, so
a pair counts in a list only where both have enough left, and one of them even
without the shingles that no other row posted. Rows with such a
partner in another component are ranked once more by their whole sets, shingles of a
single component first, since no pair across components shares them.

Equal sets are one entry. A list of the byte-position index emits a forest, so that a
hot group of near copies is connected by about as many pairs as it has members. In a
few rounds each list of shingles then proposes TRIES pairs for each member at most, across
components, and the rows are ranked anew by the components found; at last all pairs
of different components that positions still allow are compared, so no link is lost. Pairs
within a component need no comparison.

In a hot group whose texts miss 0.8 by little, shingles that nearly all of them hold would
let nearly all pairs meet. So rows that proposals connect at a Jaccard of 0.5 make a family,
its centre is the shingles that over half of its rows hold, and a row is listed by its
differences: what it lacks of the centre and what it has beyond. Two sets share at least
the centre less what either lacks. Where that is enough by itself the pair is alike,
and linking all such rows to the one with the least need connects all such pairs. Any other
alike pair has differences in common, at least as many as it is short of, and meets in a list
of these by the same rule of positions. Rows of different families meet in lists of whole
sets. Families decide only by which of the two a pair is found.

A pair is first held against a bound: a set's count signature says how many
of its shingles fall into each of a few buckets, and two sets share at most the sum of
the lesser counts. Pairs that share a passage but not 0.8 go there, for some hundred bytes
a text; the rest is compared by whole sets.

Defined results
    null or empty text, or only white space: no shingles, alike among themselves
    fewer than 5 words: one shingle of all words
    repeated rows      each appears, in the same group
    very long text     whole text
    empty table        empty result
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import remove, shared_path, shared_table
from .components import components, extended

SHINGLE, SEED = 5, 42
#: Bytes in which fingerprints may differ: at least 4 of the 8 are shared.
APART = 4
#: Least Jaccard similarity, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Texts of the sample, the count from which it calls a shingle common, and as how many at most.
SAMPLE, OFTEN, MOST_COMMON = 20_000, 3, 200_000
#: Least Jaccard, as a fraction, of proposed pairs that make a family.
KIN_OVER, KIN_UNDER = 1, 2
#: Rounds of linear proposals before all pairs that are left are compared.
ROUNDS, TRIES = 3, 4
#: Row keys up to which they are broadcast, so under 20 MB.
BROADCAST_ROWS = 1_000_000


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes (int64) of a text's shingles."""
    return np.unique(simhash.hashes(text, SHINGLE).view(np.int64))


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, where two texts alike enough must meet."""
    if not len(found):
        return found
    place = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        place = np.where(common[at] == found, rank[at], 0)
    return found[np.lexsort((found, place))][: len(found) + (-OVER * len(found) // UNDER) + 1]


def signature(found: np.ndarray) -> bytes:
    """How many shingles fall into each bucket (the low bits of the hash): a power of two of
    buckets, about 8 shingles each; 255 says that many or more."""
    buckets = 1 << max(5, min(14, (max(len(found), 1) - 1).bit_length() - 3))
    return np.minimum(np.bincount(found & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def within_reach(first: list[bytes], second: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Whether pairs of signatures allow a Jaccard of 0.8; sizes: of both sets, (2, pairs)."""
    out = np.zeros(len(first), bool)
    lengths = np.array([list(map(len, first)), list(map(len, second))]).reshape(2, -1)
    for a, b in {tuple(x) for x in lengths.T.tolist()}:
        at = np.flatnonzero((lengths[0] == a) & (lengths[1] == b))
        low = min(a, b)
        x, y = (np.frombuffer(b"".join([side[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, low) for side in (first, second))
        full = (x == 255).any(axis=(1, 2)) | (y == 255).any(axis=(1, 2))
        same = np.minimum(x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64)).sum(axis=1)
        out[at] = full | (UNDER * same >= OVER * (sizes[:, at].sum(axis=0) - same))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(x.as_py()) for x in b.column(1)])], ["row_", "found"])

    return texts.select("row_", "text").mapInArrow(run, "row_ bigint, found array<bigint>")


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, sorted, with their counts."""
    step = max(1, texts.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("row_"), F.lit(step)) == 0)
    counts = _sets(some).select(F.explode("found").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    t = counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    s, n = t["s"].to_numpy().astype(np.int64), t["n"].to_numpy().astype(np.int64)
    order = np.argsort(s)
    return s[order], n[order]


def _prints(texts: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [simhash.hashes(x.as_py(), SHINGLE) for x in b.column(2)]
            fps = pa.array([simhash.signed(simhash.folded(x)) for x in every], pa.int64())
            sets = [np.unique(x.view(np.int64)) for x in every]
            whole = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            first = _lists([prefix(x, *shared.value) for x in sets])
            signs = pa.array([signature(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), first, signs, fps], ["row_", "doc_id", "whole", "n", "prefix", "sign", "fp"])

    rows = texts.select("row_", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row_ bigint, doc_id bigint, whole bigint, n bigint, prefix array<bigint>, sign binary, fp bigint")


def few(rows: DataFrame) -> DataFrame:
    """A stored table of row keys, broadcast if its counted number is within the bound."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _near_enough(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and signatures allow to be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = within_reach(b.column(2).to_pylist(), b.column(3).to_pylist(), np.array([b.column(4).to_numpy(), b.column(5).to_numpy()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    of = {k: prints.select(F.col("row_").alias(k), F.col("n").alias(f"n_{k}"), F.col("sign").alias(f"sign_{k}")) for k in "ab"}
    both = pairs.join(of["a"], "a").join(of["b"].withColumnRenamed("b", "other"), F.col("b") == F.col("other"))
    sizes = UNDER * F.least("n_a", "n_b") >= OVER * F.greatest("n_a", "n_b")
    return both.where(sizes).select("a", "b", "sign_a", "sign_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint")


def _sets_of(texts: DataFrame, rows: DataFrame, owner: str) -> tuple[DataFrame, str]:
    """row_ and found of the given rows, a stored table, and its path."""
    path = shared_path(texts.sparkSession, owner, "sets")
    _sets(texts.join(few(rows), "row_", "left_semi")).write.parquet(path)
    return texts.sparkSession.read.parquet(path), path


def _alike(texts: DataFrame, prints: DataFrame, pairs: DataFrame, owner: str, stored: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose whole sets make them kin, with whether they are alike enough; of pairs
    that sizes and signatures allow. stored: sets of all their rows, if there are any."""
    left = shared_table(_near_enough(prints, pairs), owner, "left")
    need = shared_table(left.select(F.explode(F.array("a", "b")).alias("row_")).distinct(), owner, "need")
    sets, path = (stored.join(few(need), "row_", "left_semi"), None) if stored else _sets_of(texts, need, owner)
    both = left.join(sets.select(F.col("row_").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("row_").alias("b"), F.col("found").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("sum"))
    alike, kin = (under * F.col("same") >= over * (F.col("sum") - F.col("same")) for over, under in ((OVER, UNDER), (KIN_OVER, KIN_UNDER)))
    out = shared_table(both.where(kin).select("a", "b", alike.alias("alike")), owner, "alike")
    if path:
        remove(texts.sparkSession, path)
    return out


def _met(firsts: DataFrame, owner: str) -> DataFrame:
    """a, b: rows whose fingerprints the byte-position index joins, as forests of its lists."""
    hubs = shared_table(firsts.groupBy("fp").agg(F.min("row_").alias("hub")), owner, "hubs")
    same = firsts.join(hubs, "fp").where("row_ <> hub").select(F.col("hub").alias("a"), F.col("row_").alias("b"))
    forest = shared_table(simhash.link_table(hubs.select("fp"), APART, owner=owner, within=64).distinct(), owner, "forest")
    ends = {k: hubs.select(F.col("fp").alias(k), F.col("hub").alias(f"row_{k}")) for k in "ab"}
    pairs = forest.join(ends["a"], "a").join(ends["b"], "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    return shared_table(same.unionByName(pairs).distinct(), owner, "met")


def _offered(need: np.ndarray, room: np.ndarray, offer: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which members of a list have room for the need of one of another component whose offer
    is theirs: in a pass by need, with the best offers of two components."""
    out, order = np.zeros(len(need), bool), np.argsort(need, kind="stable")
    none = np.iinfo(np.int64).min
    best = [(none, -1, none)]
    for r, k in zip(offer[order].tolist(), label[order].tolist(), strict=True):
        most, of, other = best[-1]
        if k == of:
            most = max(most, r)
        elif r > most:
            most, of, other = r, k, most
        else:
            other = max(other, r)
        best.append((most, of, other))
    reach = np.searchsorted(need[order], room, side="right")
    for i, (k, n, at) in enumerate(zip(label.tolist(), need.tolist(), reach.tolist(), strict=True)):
        most, of, other = best[at]
        out[i] = (other if of == k else most) >= n
    return out


def able(row: np.ndarray, need: np.ndarray, room: np.ndarray, label: np.ndarray, tight: np.ndarray | None = None) -> np.ndarray:
    """Which members of a list have one of another component in it that positions allow to be
    alike: each has room for the other's need, one of them tight room."""
    if tight is None:
        return _offered(need, room, room, label)
    return _offered(need, tight, room, label) | _offered(need, room, tight, label)


Arrays = tuple[np.ndarray, ...]


def rows_able(*of: np.ndarray) -> Iterator[Arrays]:
    yield (of[0][able(*of)],)


def partners(*of: np.ndarray) -> Iterator[Arrays]:
    """For each member of a list that has one, members of other components: TRIES of them, a largest
    component or more further on, so that pairs don't grow faster than the list."""
    fit = able(*of)
    row, need, room, label, *_ = (x[fit] for x in of)
    if not len(row):
        return
    order = np.argsort(row)
    dealt = np.random.default_rng([len(row), int(row[order[0]]) & 0xFFFFFFFF, int(row[order[-1]]) & 0xFFFFFFFF])
    order = order[np.lexsort((dealt.random(len(row)), label[order]))]
    row, need, room, label = row[order], need[order], room[order], label[order]
    most = int(np.unique(label, return_counts=True)[1].max())
    for step in {most, *dealt.integers(1, len(row), TRIES - 1).tolist()}:
        other = np.roll(np.arange(len(row)), -step)
        near = (label != label[other]) & (need <= room[other]) & (need[other] <= room)
        yield np.minimum(row, row[other])[near], np.maximum(row, row[other])[near]


def crossings(*of: np.ndarray) -> Iterator[Arrays]:
    """All pairs of a list's members of different components that positions allow to be alike."""
    fit = able(*of)
    row, need, room, label, *_ = (x[fit] for x in of)
    for i in range(len(row) - 1):
        rest = slice(i + 1, None)
        other = row[rest][(label[rest] != label[i]) & (need[rest] <= room[i]) & (need[i] <= room[rest])]
        if len(other):
            yield np.minimum(other, row[i]), np.maximum(other, row[i])


def _over_lists(lists: DataFrame, of: Callable[..., Iterator[Arrays]], names: str) -> DataFrame:
    """The distinct rows (bigint columns of the names) that `of` gives for every list of a table of
    s, row_, need, room, label and tight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.empty(0, np.int64)] * 6

        def batch_of(found: list[Arrays]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names.split())

        def out(s: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(s[1:] != s[:-1]) + 1
            found: list[Arrays] = []
            held = 0
            for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(s)], strict=True):
                part = [c[begin:end] for c in cols]
                if len(part[0]) and (part[3] != part[3][0]).any():
                    for x in of(*part):
                        found.append(x)
                        held += len(x[0])
                        if held >= 1 << 16:
                            yield batch_of(found)
                            found, held = [], 0
            if held:
                yield batch_of(found)

        for batch in batches:
            cols = [np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(left)]
            # the last list may go on in the next batch
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            yield from out(*[c[:last] for c in cols])
            left = [c[last:] for c in cols]
        yield from out(*left)

    runs = lists.select("s", "row_", "need", "room", "label", "tight").repartition("s").sortWithinPartitions("s")
    return runs.mapInArrow(run, ", ".join(f"{x} bigint" for x in names.split())).distinct()


def _room(place: Column) -> Column:
    """Two sets can't share more than what each has from their first common shingle on, and 0.8
    takes OVER / (UNDER + OVER) of the sum of their sizes: each needs OVER times its size of this."""
    return (UNDER + OVER) * (F.col("n") - place) - OVER * F.col("n")


def _first() -> Column:
    """How many shingles of a set are posted."""
    return F.expr(f"n - ({OVER} * n + {UNDER - 1}) div {UNDER} + 1")


def _tight(lists: DataFrame) -> DataFrame:
    """lists (s, row_, n, place: the posted shingles that more rows posted) with the room there is once
    the shingles that a row alone posted are left out. That holds for the one of two rows whose
    posted shingles end first in the order: the other has posted all it shares of them."""
    of = Window.partitionBy("row_")
    place = _first() - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("place")) - 1
    return lists.withColumn("tight", _room(place)).withColumn("room", _room(F.col("place"))).withColumn("need", OVER * F.col("n"))


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    labels = roots.select(F.col("v").alias("row_"), F.col("root").alias("label"))
    return rows.join(labels, "row_", "left").withColumn("label", F.coalesce("label", "row_"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """The shingles that rows of different components have."""
    return labelled.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s")


#: Of a row, in the columns of its tokens: how many tokens, the need, the room before the first
#: token, and the least need of a row alike to it. By whole sets, and by differences.
WHOLE = {"size": "n", "need": f"{OVER} * n", "room": f"{UNDER} * n", "least": f"({OVER * OVER} * n + {UNDER - 1}) div {UNDER}"}
APART_BY = {"size": "size", "need": "need", "room": "need + n", "least": "least"}


def _ranked(tokens: DataFrame, roots: DataFrame, owner: str, of: dict[str, str] = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Lists of the first tokens of each row once more, in an order that knows the components:
    tokens of a single component come first, since no pair across components shares them, then
    the others, rare ones first. tokens: s, row_ and the columns of `of`. Also the tokens that
    aren't of a single one."""
    by, names = Window.partitionBy("s"), tokens.columns
    held = _labelled(tokens, roots).select(*names, "label")
    held = held.select("*", F.min("label").over(by).alias("lo"), F.max("label").over(by).alias("hi"), F.count(F.lit(1)).over(by).alias("times"))
    kept = shared_table(held.where("lo <> hi").drop("lo", "hi"), owner, "tokens")
    row = Window.partitionBy("row_")
    place = F.expr(of["size"]) - F.count(F.lit(1)).over(row) + F.row_number().over(row.orderBy("times", "s")) - 1
    room = F.expr(of["room"]) - (UNDER + OVER) * place
    lists = kept.select("s", "row_", F.expr(of["need"]).alias("need"), room.alias("room"), "label", F.expr(of["least"]).alias("least")).where("room >= least")
    lists = lists.select("s", "row_", "need", "room", "label", F.col("room").alias("tight"))
    return shared_table(lists, owner, "ranked"), kept.select(*names)


def _apart(tokens: DataFrame, roots: DataFrame, families: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """The differences of rows from the centre of their family, of families that hold several components:
    s, row_ and the columns of APART_BY. Also links (a, b) that connect all pairs that are alike
    by the centre alone. tokens: s, row_, n."""
    rows = _labelled(tokens.groupBy("row_", "n").agg(F.collect_list("s").alias("found")), roots)
    rows = shared_table(rows.join(families.select(F.col("v").alias("row_"), F.col("root").alias("family")), "row_"), owner, "kin")
    several = rows.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("family", "members")
    several = shared_table(several, owner, "several")
    held = rows.select("family", F.explode("found").alias("s")).groupBy("family", "s").agg(F.count(F.lit(1)).alias("times"))
    centre = held.join(several, "family").where("2 * times > members").groupBy("family").agg(F.collect_list("s").alias("centre"))
    centre = several.select("family").join(centre, "family", "left").select("family", F.coalesce("centre", F.expr("cast(array() as array<bigint>)")).alias("centre"))
    both = rows.join(shared_table(centre, owner, "centre"), "family").select("family", "row_", "n", F.array_except("centre", "found").alias("lacks"), F.array_except("found", "centre").alias("more"), F.size("centre").cast("bigint").alias("all"))
    lacks = F.size("lacks").cast("bigint")
    both = both.select(
        "family", "row_", "n", (OVER * F.col("n") + (UNDER + OVER) * lacks).alias("need"), (F.col("n") - F.col("all") + 2 * lacks).alias("size"),
        ((UNDER + OVER) * (F.col("all") - lacks) - OVER * F.col("n")).alias("sure"),
        F.expr("concat(transform(lacks, x -> xxhash64(family, x, 1)), transform(more, x -> xxhash64(family, x, 0)))").alias("apart"),
    )
    both = shared_table(both, owner, "apart")
    hubs = both.groupBy("family").agg(F.min(F.struct("need", "row_", "sure")).alias("hub"))
    both = both.join(shared_table(hubs.select("family", "hub.*").toDF("family", "first", "hub", "sure_of_hub"), owner, "hubs"), "family")
    sure = both.where("row_ <> hub and need <= sure_of_hub").select(F.col("hub").alias("a"), F.col("row_").alias("b"))
    apart = both.select(F.explode("apart").alias("s"), "row_", "n", "size", "need", F.greatest("first", F.expr(WHOLE["least"])).alias("least"))
    return apart, shared_table(sure, owner, "sure")


def near_groups(texts: DataFrame, owner: str) -> DataFrame:
    """row_, doc_id and root for every row of texts, a stored table with row_, doc_id
    and text, its row_ a key: rows that alike pairs connect have one root."""
    shared = texts.sparkSession.sparkContext.broadcast(_common(texts))
    prints = shared_table(_prints(texts, shared), owner, "prints")
    firsts = shared_table(prints.groupBy("whole").agg(F.min("row_").alias("row_"), F.min_by("fp", "row_").alias("fp")), owner, "firsts")
    met = _met(firsts, owner)
    roots = components(_alike(texts, prints, met, owner).where("alike").select("a", "b"), owner)
    posted = prints.join(firsts.select("row_"), "row_", "left_semi").select(F.posexplode("prefix").alias("place", "s"), "row_", "n")
    shared_by = shared_table(posted.groupBy("s").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("s"), owner, "shared_by")
    lists_path = shared_path(texts.sparkSession, owner, "lists")
    _labelled(_tight(posted.join(shared_by, "s")), roots).select("s", "row_", "need", "room", "label", "tight").write.parquet(lists_path)
    lists = texts.sparkSession.read.parquet(lists_path)
    mixed = shared_table(_mixed(lists), owner, "mixed")
    rows = shared_table(_over_lists(lists.join(mixed, "s", "left_semi"), rows_able, "row_"), owner, "rows")
    remove(texts.sparkSession, lists_path)
    sets, _ = _sets_of(texts, rows, owner)
    tokens = sets.select(F.explode("found").alias("s"), "row_", F.size("found").cast("bigint").alias("n"))
    ranked, tokens = _ranked(tokens, roots, owner)
    able_rows = shared_table(_over_lists(ranked, rows_able, "row_"), owner, "rows")
    tokens = shared_table(tokens.join(few(able_rows), "row_", "left_semi"), owner, "open")
    lists, families, fresh = [ranked], roots, True  # fresh: components or families have changed since the lists were made
    for step, of in enumerate([partners] * ROUNDS + [crossings]):
        if of is partners and not fresh:
            continue
        if step and fresh:
            apart, sure = _apart(tokens, roots, families, owner)
            roots = extended(roots, sure, owner)
            lists = [_ranked(apart, roots, owner, APART_BY)[0], _ranked(tokens, families, owner)[0]]
        pairs = [_over_lists(x, of, "a b") for x in lists]
        pairs = shared_table(pairs[0].unionByName(pairs[1]) if pairs[1:] else pairs[0], owner, "pairs")
        found = _alike(texts, prints, pairs, owner, sets)
        before = roots, families
        roots, families = extended(roots, found.where("alike"), owner), extended(families, found, owner)
        fresh = not step or roots is not before[0] or families is not before[1]
    named = firsts.select("whole", "row_").join(roots.withColumnRenamed("v", "row_"), "row_", "left").select("whole", F.coalesce("root", "row_").alias("root"))
    # both sides are stored tables, so adaptive execution can split a hot text
    return prints.select("row_", "doc_id", "whole").join(shared_table(named, owner, "named"), "whole").select("row_", "doc_id", "root")
