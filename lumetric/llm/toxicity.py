"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers are composed:

    lexicon    letters of a word -> its class (insult, threat, target, negation,
               report, contrast) and weight; a trie whose arcs may end in "any continuation"
    negation   marks what stands within NEGATION_REACH words of a negation, up to a comma
    report     marks what follows a verb of speech
    target     marks an insult that stands near a word of address
    threat     a threat counts only where a target follows in the same clause; it
               turns marked classes into kinds of matches

The last four read and write symbols, one for each word or break. Each is a machine of its
own; compose() makes one of two, and the composition is tabulated once over its
reachable states. The end of a clause and a contrast ("but") reset all of them, a
comma the negation. A kind is insult or threat, plain or aimed, negated, reported. A
document's features are its matched weights by kind, how many clauses matched,
and how many of its words that is; a logistic model, shrunk towards the grammar's
own weights, turns them into a score.

Threat, target, negation, report and contrast words are fixed. Insults are learned:
words and word beginnings that toxic documents hold far more often than others, chosen
greedily by likelihood ratio, on at most MOST_LABELLED labelled documents outside
the held-out fold (crc32(doc_id) mod 5 = 0). Labels, language, source and doc_id
are no inputs of a score. Texts stay on the executors: the driver gets the counts of
strong patterns, which documents hold them, and features.

Defined results
    null or empty text   no match: the score of a document without matches
    very long text       whole text, clause by clause
    repeated rows        each row is scored by itself; of rows that share a labelled
                         doc_id one text is learned from
    null doc_id          not held out; scored
    null label           not learned from
    no usable labels     fixed parts only, at the grammar's own weights
    empty table          empty result
    other columns        ignored
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled, read, shared_table, take

#: The bound of the labelled sample.
MOST_LABELLED = 8_000
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 4, 5
#: Insults: least toxic documents, least likelihood ratio of a pattern.
LEAST_DOCS, LEAST_RATIO = 4, 12.0
PREFIXES = (4, 5, 6, 7)
OWNER = "toxicity"

INSULT, THREAT, TARGET, NEGATION, REPORT, CONTRAST, OTHER, COMMA, END = range(9)
#: Words of the fixed classes (English, German, French, Spanish).
FIXED = {
    THREAT: "kill killing murder hurt beat stab shoot strangle burn destroy töten umbringen schlagen verletzen tuer frapper détruire brûler matar golpear destruir quemar",
    TARGET: "you your yours yourself he him his she her they them their dich dir dein ihr euch sie tu toi ton vous votre lui eux tú ti te usted vosotros ellos",
    NEGATION: "not never no nobody nor neither cannot don doesn didn isn aren wasn won nicht nie kein keine niemals pas jamais aucun nunca jamás ningún tampoco",
    REPORT: "said says say wrote writes quoted quotes reported claims claimed called according sagte schrieb meinte laut dit écrit déclaré selon dijo escribió según",
    CONTRAST: "but however although though whereas aber sondern jedoch obwohl mais cependant pourtant pero sino aunque",
}
#: Kinds of matches (kind, aimed, negated, reported) and the grammar's own weights.
KINDS = list(product((INSULT, THREAT), (False, True), (False, True), (False, True)))
OWN_WEIGHT = [(1.0 if kind == INSULT else 0.8) * (1.3 if aimed else 1.0) * (0.3 if negated else 1.0) * (0.6 if reported else 1.0) for kind, aimed, negated, reported in KINDS]
OWN_BIAS = -3.0

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n,]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAKS = dict.fromkeys(".!?;\n", END) | {",": COMMA}


class Lexicon:
    """A trie transducer from letters to (class, weight)."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[int, float]] = {}
        self.begins: dict[int, tuple[int, float]] = {}

    def add(self, word: str, kind: int, weight: float, prefix: bool = False) -> None:
        at = 0
        for letter in word:
            if letter not in self.arcs[at]:
                self.arcs[at][letter] = len(self.arcs)
                self.arcs.append({})
            at = self.arcs[at][letter]
        (self.begins if prefix else self.whole).setdefault(at, (kind, weight))

    def read(self, word: str) -> tuple[int, float]:
        """The whole word's output, else that of its longest known beginning."""
        at, best = 0, (OTHER, 0.0)
        for letter in word:
            nxt = self.arcs[at].get(letter)
            if nxt is None:
                return best
            at = nxt
            best = self.begins.get(at, best)
        return self.whole.get(at, best)


@dataclass(frozen=True)
class Machine:
    """A sequential transducer: step(state, symbol) -> (state, symbol written)."""

    start: Hashable
    step: Callable


def compose(first: Machine, second: Machine) -> Machine:
    """What `first` writes, `second` reads."""

    def step(state, symbol):
        one, between = first.step(state[0], symbol)
        two, written = second.step(state[1], between)
        return (one, two), written

    return Machine((first.start, second.start), step)


def negation(reach: int = NEGATION_REACH) -> Machine:
    """class -> (class, negated); a state is how many words a negation still reaches."""

    def step(left: int, kind: int):
        after = reach if kind == NEGATION else 0 if kind in (COMMA, CONTRAST, END) else max(left - 1, 0)
        return after, (kind, left > 0)

    return Machine(0, step)


def report() -> Machine:
    """Adds whether a verb of speech came before in the clause."""

    def step(said: bool, symbol: tuple):
        kind = symbol[0]
        return kind == REPORT or (said and kind not in (CONTRAST, END)), (*symbol, said)

    return Machine(False, step)


def target(reach: int = TARGET_REACH) -> Machine:
    """Adds whether a word of address stands near before."""

    def step(left: int, symbol: tuple):
        kind = symbol[0]
        after = reach if kind == TARGET else 0 if kind in (CONTRAST, END) else left if kind == COMMA else max(left - 1, 0)
        return after, (*symbol, left > 0)

    return Machine(0, step)


def threat(reach: int = THREAT_REACH) -> Machine:
    """(class, negated, reported, aimed) -> the kind of a match, or -1; a state is how many
    words a threat still waits for its target, and whether it was negated."""
    number = {k: i for i, k in enumerate(KINDS)}

    def step(state: tuple[int, bool], symbol: tuple):
        (left, was_negated), (kind, negated, reported, aimed) = state, symbol
        if kind == THREAT:
            return (reach, negated), -1
        if kind == TARGET and left:
            return (0, False), number[THREAT, True, was_negated, reported]
        written = number[INSULT, aimed, negated, reported] if kind == INSULT else -1
        after = 0 if kind in (CONTRAST, END) else left if kind == COMMA else max(left - 1, 0)
        return (after, was_negated and after > 0), written

    return Machine((0, False), step)


def tabulated(machine: Machine, symbols: Iterable[int]) -> tuple[list[list[int]], list[list[int]]]:
    """(next state, symbol written) by state and symbol, over the reachable states; 0 is the start."""
    symbols = list(symbols)
    number, order, nexts, outs = {machine.start: 0}, [machine.start], [], []
    for state in order:
        row = [machine.step(state, symbol) for symbol in symbols]
        for new, _ in row:
            if new not in number:
                number[new] = len(order)
                order.append(new)
        nexts.append([number[new] for new, _ in row])
        outs.append([written for _, written in row])
    return nexts, outs


def clause_machine() -> Machine:
    return compose(compose(compose(negation(), report()), target()), threat())


class Grammar:
    """Compiled lexicon and clause machine, and the model over their matches."""

    N = len(KINDS) + 3

    def __init__(self, insults: Iterable[tuple[str, float, bool]] = ()) -> None:
        self.lexicon = Lexicon()
        for kind, words in FIXED.items():
            for word in words.split():
                self.lexicon.add(word, kind, 1.0)
        for word, weight, prefix in insults:
            self.lexicon.add(word, INSULT, weight, prefix)
        self.nexts, self.outs = tabulated(clause_machine(), range(END + 1))
        self.memo: dict[str, tuple[int, float]] = {}
        self.model = np.r_[OWN_BIAS, OWN_WEIGHT, 0.3, 0.0, 0.0]

    def features(self, text: str | None) -> np.ndarray:
        """Matched weight by kind, matched clauses, matches, matches in 100 words."""
        out, memo, lexicon = np.zeros(self.N), self.memo, self.lexicon
        if len(memo) > 300_000:
            memo.clear()
        state, words, matches, clauses, hit, still = 0, 0, 0, 0, False, True
        for token in _TOKEN.findall((text or "").lower()):
            found = memo.get(token)
            if found is None:
                found = memo[token] = (_BREAKS[token], 0.0) if token in _BREAKS else lexicon.read(token)
            kind, weight = found
            if kind == OTHER and still:
                words += 1
                continue
            if kind == END:
                clauses, hit, state, still = clauses + hit, False, 0, True
                continue
            words += kind != COMMA
            emitted = self.outs[state][kind]
            state = self.nexts[state][kind]
            still = state == 0
            if emitted >= 0:
                out[emitted] += weight if kind == INSULT else 1.0
                matches, hit = matches + 1, True
        out[:-3] = np.log1p(out[:-3])
        out[-3:] = math.log1p(clauses + hit), math.log1p(matches), 100 * matches / (words + 20)
        return out

    def score(self, text: str | None) -> float:
        z = self.model[0] + float(self.features(text) @ self.model[1:])
        return 1 / (1 + math.exp(-max(min(z, 30), -30)))


def ratio(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """The likelihood ratio of patterns in a of pos and b of neg documents; 0 where one speaks against."""
    a, b = np.asarray(a, float), np.asarray(b, float)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        return k * np.log(np.maximum(k, 1) / n) + (n - k) * np.log(np.maximum(n - k, 1) / n)

    return np.where(a * neg > b * pos, 2 * (part(a, pos) + part(b, neg) - part(a + b, pos + neg)), 0.0)


def keys_of(text: str, fixed: frozenset[str]) -> set[str]:
    """A text's words and, with a star, their beginnings."""
    words = set(_WORD.findall(text.lower())) - fixed
    return words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k}


def weight(a: int, b: int, pos: int, neg: int) -> float:
    return math.log((a + 0.5) / (pos + 1)) - math.log((b + 0.5) / (neg + 1))


def chosen(names: list[str], a: np.ndarray, b: np.ndarray, holders: dict[int, list[int]], pos: int, neg: int) -> list[tuple[str, float, bool]]:
    """(word or beginning, weight, is beginning), greedily: each must tell apart the
    toxic documents that those before it don't reach. a, b: toxic and other
    documents with each name; holders: the names of each toxic document. Of equals the
    longer, then the later in the alphabet goes first."""
    order = sorted(range(len(names)), key=lambda i: (len(names[i].rstrip("*")), names[i]), reverse=True)
    place = np.empty(len(names), int)
    place[order] = np.arange(len(names))
    names, a, b = [names[i] for i in order], np.asarray(a)[order], np.asarray(b)[order]
    of_doc = {d: place[np.asarray(found, int)] for d, found in holders.items()}
    docs_of: list[list[int]] = [[] for _ in names]
    for d, found in of_doc.items():
        for i in found:
            docs_of[i].append(d)
    left, gains, out = a.copy(), ratio(a, b, pos, neg), []
    while len(names) and gains.max() >= LEAST_RATIO:
        best = int(gains.argmax())
        out.append(best)
        for d in docs_of[best]:
            np.subtract.at(left, of_doc.pop(d, np.empty(0, int)), 1)
        gains = np.where(left >= LEAST_DOCS / 2, ratio(left, b, pos, neg), 0.0)
        gains[out] = 0.0
    # what was left uncovered only because others came first still counts as an insult
    rest = [i for i in range(len(names)) if i not in set(out) and not names[i].endswith("*") and a[i] >= 10 * max(b[i], 1)]
    return [(names[i].rstrip("*"), weight(a[i], b[i], pos, neg), names[i].endswith("*")) for i in out + rest]


def patterns(sample: DataFrame) -> list[tuple[str, float, bool]]:
    """sample: a stored table of row (a key), text (never null) and toxic (0 or 1)."""
    fixed = frozenset(w for words in FIXED.values() for w in words.split())
    pos, total = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    neg = total - pos
    if not pos or not neg:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text, toxic in zip(*[b.column(i) for i in range(3)], strict=True):
                found = sorted(keys_of(text.as_py(), fixed))
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(some), pa.int64()), pa.array([toxic.as_py()] * len(some), pa.int64()), pa.array(some, pa.string())], ["row", "toxic", "name"])

    keys = shared_table(sample.select("row", "text", F.col("toxic").cast("bigint").alias("toxic")).mapInArrow(run, "row bigint, toxic bigint, name string"), OWNER, "keys")
    a, n = F.sum("toxic"), F.count(F.lit(1))
    counts = keys.groupBy("name").agg(a.alias("a"), (n - a).alias("b")).where((F.col("a") >= LEAST_DOCS) & (F.col("a") * neg > 10 * pos * F.col("b")))

    def part(k: Column, m: int) -> Column:
        return k * F.ln(F.greatest(k, F.lit(1)) / m) + (m - k) * F.ln(F.greatest(m - k, F.lit(1)) / m)

    strong = shared_table(counts.where(2 * (part(F.col("a"), pos) + part(F.col("b"), neg) - part(F.col("a") + F.col("b"), pos + neg)) >= LEAST_RATIO), OWNER, "strong")
    found = strong.orderBy("name").toArrow()
    names = found.column("name").to_pylist()
    number, holders = {x: i for i, x in enumerate(names)}, {}
    for row, name in zip(*[c.to_pylist() for c in keys.where("toxic = 1").join(strong, "name").select("row", "name").orderBy("row", "name").toArrow().columns], strict=True):
        holders.setdefault(row, []).append(number[name])
    return chosen(names, found.column("a").to_numpy(), found.column("b").to_numpy(), holders, pos, neg)


def fitted(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic coefficients with a normal prior around the given ones (Newton)."""
    a, w = np.c_[np.ones(len(x)), x], prior.copy()
    strength = np.r_[1e-3, np.full(x.shape[1], ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - strength * (w - prior)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(strength), grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Grammar:
    """A grammar from at most `most` labelled documents outside the held-out fold."""
    sample = shared_table(labelled(docs, labels, "toxic", most, 9), OWNER, "sample")
    grammar = Grammar(patterns(sample))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [shared.value.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["row", "toxic", "x"])

    rows = sample.select("row", "text", F.col("toxic").cast("bigint").alias("toxic")).mapInArrow(run, "row bigint, toxic bigint, x array<double>")
    held = sorted(zip(*[c.to_pylist() for c in rows.toArrow().columns], strict=True))
    toxic = np.array([t for _, t, _ in held], float)
    if 0 < toxic.sum() < len(toxic):
        grammar.model = fitted(np.array([x for *_, x in held]), toxic, grammar.model)
    grammar.memo = {}
    return grammar


def scored(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.score
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    rows = take(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
