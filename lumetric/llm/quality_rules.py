"""Quality rules: a short-circuit cascade, ordered by rejection per cost.

A rule is a Column over features of a text and names the features it needs. The
cascade owns the features: going through the rules in turn, it computes what the
next rule needs, for the rows that no rule has rejected yet, and then the rule.
keep_good() so never cuts a rejected text into words or windows; judge() returns
the public features and computes these for all rows, whatever else is skipped.

The order comes from a sample: the share of the documents that a rule rejects,
over what the rule costs by itself. The cost is the time of the rule's whole
expression over the sample's raw texts, repeated to a fixed amount of text within
one task, less that of an empty rule. It counts in powers of two, and equals keep
their declared order, so that small noise changes nothing. The verdict is the
conjunction of all rules and never depends on the order; the name of the first
rule that rejects does.

Everything on the main path is DataFrame functions.

Defined results
    null text          no words: the word-count rule rejects it
    empty text         the same
    very long text     whole text, n log n in its words
    repeated rows      each row is judged by itself
    empty table        empty result (the rules keep their declared order)
    nulls elsewhere    carried along untouched
    other columns      ignored, whatever their names
"""

from __future__ import annotations

import math
import time
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD, read, shared_table, take

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Documents that the order of the rules is measured on, how they are drawn, from how
#: many files at most, and the characters of text that a cost is measured over.
SAMPLE_ROWS, SAMPLE_SALT, SAMPLE_FILES, COST_CHARS = 512, 17, 16, 4_000_000


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def matched(text: Column, characters: str) -> Column:
    """How many code points are of a character class; only runs of them are visited."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))


def window_hashes(hashes: Column) -> Column:
    """One 64-bit hash for each 3-word window, from a column of word hashes (a
    materialised one: the lambda reads it by place)."""
    whole = F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
    return F.transform(whole, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))


def repeats(ordered: Column) -> Column:
    """The distinct values that stand twice or more in a sorted column."""
    m = F.greatest(F.size(ordered) - 1, F.lit(0))
    twice = F.zip_with(F.slice(ordered, 1, m), F.slice(ordered, 2, m), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.filter(twice, lambda x: x.isNotNull()))


def covered(windows: Column, twice: Column) -> Column:
    """Words under the windows that stand twice or more, each word once.

    A few repeated hashes are looked up one by one; many are found by sorting
    (hash, place) pairs, so that the time stays n log n for any text.
    """
    m = F.greatest(F.size(windows) - 1, F.lit(0))
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.zip_with(F.slice(ordered, 1, m), F.slice(ordered, 2, m), lambda a, b: a["h"] == b["h"])
    no = F.array(F.lit(False))
    by_order = F.zip_with(
        ordered, F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b),
        lambda x, repeated: F.when(repeated, x["i"]),
    )
    by_lookup = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
    places = F.when(F.size(twice) <= 32, F.filter(by_lookup, lambda i: i.isNotNull())).otherwise(F.array_sort(F.filter(by_order, lambda i: i.isNotNull())))
    return F.aggregate(
        places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


@dataclass(frozen=True)
class Feature:
    """make: a Column over text_ (never null) and the features named by needs."""

    make: Column
    needs: tuple[str, ...] = ()


def _features() -> dict[str, Feature]:
    text, words, lines, windows, twice = map(F.col, ("text_", "words_", "lines_", "windows_", "twice_"))
    alone = F.size(F.array_distinct(windows)) == F.size(windows)
    return {
        "words_": Feature(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        "n_words": Feature(F.size(words).cast("bigint"), ("words_",)),
        "word_chars": Feature(F.length(without(text, ASCII_SPACE)).cast("bigint")),
        "n_symbols": Feature(matched(text, f"[{SYMBOLS}]").cast("bigint")),
        "letters": Feature(matched(text, r"\p{L}")),
        "capitals": Feature(matched(text, r"\p{Lu}")),
        "lines_": Feature(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))),
        "own_lines_": Feature(F.array_distinct(lines), ("lines_",)),
        "n_dup_lines": Feature((F.size(lines) - F.size("own_lines_")).cast("bigint"), ("lines_", "own_lines_")),
        "line_chars": Feature(F.length(F.array_join(lines, "")).cast("bigint"), ("lines_",)),
        "own_line_chars": Feature(F.length(F.array_join("own_lines_", "")).cast("bigint"), ("own_lines_",)),
        "hashes_": Feature(F.transform(words, lambda w: F.xxhash64(w)), ("words_",)),
        "windows_": Feature(window_hashes(F.col("hashes_")), ("hashes_",)),
        "twice_": Feature(F.when(alone, F.array().cast("array<bigint>")).otherwise(repeats(F.sort_array(windows))), ("windows_",)),
        "n_repeat_words": Feature(F.when(F.size(twice) == 0, F.lit(0)).otherwise(covered(windows, twice)).cast("bigint"), ("windows_", "twice_")),
    }


#: The features that judge() returns.
PUBLIC = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """reject: true where a document fails. base: part of the fixed base verdict."""

    name: str
    needs: tuple[str, ...]
    reject: Column
    base: bool = False


def default_rules() -> list[Rule]:
    n, chars, letters = F.col("n_words"), F.col("word_chars"), F.col("letters")
    return [
        Rule("too_few_words", ("n_words",), n < 50, base=True),
        Rule("repeated_passages", ("n_words", "n_repeat_words"), 100 * F.col("n_repeat_words") > 50 * n, base=True),
        Rule("symbols", ("n_words", "n_symbols"), 100 * F.col("n_symbols") > 10 * n),
        Rule("short_words", ("n_words", "word_chars"), chars < 2 * n),
        Rule("long_words", ("n_words", "word_chars"), chars > 14 * n),
        # by characters: a header that returns as a footer is little of a text
        Rule("repeated_lines", ("line_chars", "own_line_chars"), 100 * (F.col("line_chars") - F.col("own_line_chars")) > 30 * F.col("line_chars")),
        Rule("capitals", ("letters", "capitals"), 100 * F.col("capitals") > 40 * letters),
        Rule("few_letters", ("letters", "word_chars"), 100 * letters < 60 * chars),
    ]


def closure(names: Iterable[str], features: dict[str, Feature]) -> set[str]:
    """The features and all that they need."""
    out, left = set(), list(names)
    while left:
        name = left.pop()
        if name not in out:
            out.add(name)
            left += features[name].needs
    return out


def cascade(texts: DataFrame, rules: Sequence[Rule], public: Sequence[str] = ()) -> DataFrame:
    """texts has text_ (never null). Adds rejected_by and the features, of which only
    the public ones are there for rows that an earlier rule has rejected."""
    features = _features()
    always, have = closure(public, features), set()
    rejected = F.col("rejected_by")

    def grown(df: DataFrame, names: Iterable[str]) -> DataFrame:
        missing = closure(names, features) - have
        while missing:
            ready = sorted(x for x in missing if have.issuperset(features[x].needs))
            df = df.select("*", *[(features[x].make if x in always else F.when(rejected.isNull(), features[x].make)).alias(x) for x in ready])
            have.update(ready)
            missing.difference_update(ready)
        return df

    df = texts.withColumn("rejected_by", F.lit(None).cast("string"))
    # A filter on the verdict must not be pushed below these projections: the optimizer would
    # copy their expressions into it, each as often as it is used. A column that counts as
    # nondeterministic keeps it above.
    fence = F.monotonically_increasing_id() < 0
    for rule in rules:
        df = grown(df, rule.needs)
        df = df.withColumn("rejected_by", F.when(rejected.isNotNull(), rejected).when(fence | rule.reject, F.lit(rule.name)))
    return grown(df, public)


def _texts(docs: DataFrame, *keys: str) -> DataFrame:
    return take(docs, *dict.fromkeys((*keys, "text"))).select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("text_"))


def some_files(docs: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """The rows of a few of the table's files; all rows where they can't be told apart."""
    names = {f.rpartition("/")[2] for f in docs.inputFiles()}
    if len(names) <= most:
        return docs
    chosen = sorted(names, key=lambda f: (zlib.crc32(f.encode()), f))[:most]
    try:
        return docs.where(F.col("_metadata.file_name").isin(chosen))
    except AnalysisException:
        return docs


def drawn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many documents, by the hash of their ids."""
    few = take(some_files(docs), "doc_id", "text")
    share = min(1.0, 4 * sample_rows / max(few.count(), 1))
    return few.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SAMPLE_SALT)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows)


def measured_order(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by share rejected over cost, both measured on a sample.

    The sample only sets the order in which rules are tried, never a verdict.
    """
    sample = shared_table(_texts(drawn(docs, sample_rows)), "quality_rules", "sample")
    total, chars = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text_")), F.lit(0))).first()
    if not total:
        return list(rules)
    times = max(1, min(64, COST_CHARS // max(chars, 1)))
    again = sample.coalesce(1).select("text_", F.explode(F.sequence(F.lit(1), F.lit(times)))).select("text_")
    empty = Rule("empty", (), F.length("text_") < 0)
    hits, seconds = {}, {}
    for _ in range(2):  # the first run also compiles
        for rule in (empty, *rules):
            began = time.perf_counter()
            hits[rule.name] = cascade(again, [rule]).agg(F.count("rejected_by")).first()[0]
            seconds[rule.name] = time.perf_counter() - began
    cost = {r.name: max(seconds[r.name] - seconds["empty"], 1e-3) for r in rules}
    return ranked(rules, {r.name: hits[r.name] / (total * times) for r in rules}, cost)


def ranked(rules: Sequence[Rule], rejected: dict[str, float], cost: dict[str, float]) -> list[Rule]:
    """By rejection per cost, the cost to a power of two; equals in the given order."""
    return sorted(rules, key=lambda r: -rejected[r.name] / 2.0 ** round(math.log2(cost[r.name])))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text and all public features."""
    return take(cascade(_texts(docs, "doc_id"), (), PUBLIC), "doc_id", "text_", *PUBLIC).withColumnRenamed("text_", "text")


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, ordered: bool = False) -> DataFrame:
    """doc_id, text, the public features and rejected_by (null where the document stays)."""
    rules = rules or default_rules()
    rules = rules if ordered else measured_order(docs, rules, sample_rows)
    return cascade(_texts(docs, "doc_id"), rules, PUBLIC).select("doc_id", F.col("text_").alias("text"), *PUBLIC, "rejected_by")


def keep_good(docs: DataFrame, columns: Sequence[str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with the given columns; rules: in the order
    to try them, measured if not given."""
    rules = rules or measured_order(docs, default_rules())
    texts = take(docs, *columns).select(F.struct(*columns).alias("row_"), F.coalesce(F.col("text"), F.lit("")).alias("text_"))
    return cascade(texts, rules).where(F.col("rejected_by").isNull()).select("row_.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = default_rules()
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | rule.reject
    out = judge(read(spark, sf_dir, "documents"), rules)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM p) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ln AS (SELECT r, sum(n) - count(*) AS dup, sum(n * length(line)) AS line_chars, sum((n - 1) * length(line)) AS dup_chars
       FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
             WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
f AS (
  SELECT d.r, doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(line_chars, 0) AS line_chars, coalesce(dup_chars, 0) AS dup_chars,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS letters,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS upper_letters
  FROM d JOIN w USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 10 * n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * dup_chars > 30 * line_chars
            OR 100 * upper_letters > 40 * letters OR 100 * letters < 60 * word_chars) AS kept
FROM f
"""
