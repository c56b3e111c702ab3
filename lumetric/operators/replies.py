"""Model replies: which letter they choose, whether that is right, and whether a failed
call is worth another. Choices are Columns, a table of rules tried in turn; short
mathematical answers are an Arrow function over kernels.math_text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.unicode import composed
from ..kernels import math_text
from .text import LETTERS, answer_letter, decision_choice, rotate

MOST_OPTIONS = len(LETTERS)
#: How replies state a choice (fixed values of the reply format).
SAYS = r"(?:final\s+answer|answer|option|choice|response)"
EXPLICIT = rf"(?i){SAYS}\s*(?:is|:|=)?\s*[*\s(\[{{\"']*([A-J])(?![A-Za-z0-9])"
MARK = rf"(?i)^.*{SAYS}\s*(?:is|:|=)\s*"
ALONE = r"^[*\s(\[{\"']*([A-Ja-j])[*)\]}\"'.,:\s]*$"
BARE = r"(?<![A-Za-z0-9])[*(\[{\"']*([A-Ja-j])[*)\]}\"'.,:]*(?![A-Za-z0-9])"
EDGES = r"^[.,:;!?\"'()\[\]{}\s]+|[.,:;!?\"'()\[\]{}\s]+$"
#: How errors say that no response came, and, in records without a verdict, that the vendor was busy.
NO_RESPONSE = r"(?i)returned \w*(?:Error|Timeout)\b"
BUSY = r"\breturned (?:408|409|429|500|502|503|504|529)\b|(?i:timeout|connect_?error|read_?error|not ready)"


def clean(reply: Column) -> Column:
    """Compatibility forms composed, code and bold marks gone, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(composed(reply, "NFKC"), r"```|`|\*\*|__", " "), r"(?U)\s+", " "))


def _bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, EDGES, ""))


def _letter(body: Column, offered: Column, options: Column) -> Column:
    """The rules in their order: (applies, letter). One that applies ends the search."""

    def upper_all(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), F.upper)

    def named(said: Column) -> Column:
        """The place of the one option that a text is, null if there is none or more."""
        places = F.filter(F.transform(options, lambda o, i: F.when(_bare(o) == _bare(said), i)), lambda i: i.isNotNull())
        return F.when((F.size(places) == 1) & (F.get(places, 0) < F.size(offered)), F.get(offered, F.get(places, 0)))

    allowed = F.filter(upper_all(EXPLICIT), lambda x: F.array_contains(offered, x))
    single = F.upper(F.regexp_extract(body, ALONE, 1))
    rest = F.when(body.rlike(MARK), F.regexp_replace(body, MARK, ""))
    by_name = F.coalesce(named(F.when(rest != "", rest)), named(body))
    words = F.filter(F.regexp_extract_all(body, F.lit(BARE), F.lit(1)), lambda x: ~x.isin("a", "i", "I"))
    prose = F.array_distinct(F.filter(F.transform(words, F.upper), lambda x: F.array_contains(offered, x)))
    rules: list[tuple[Column, Column]] = [
        (F.size(allowed) > 0, F.get(allowed, F.size(allowed) - 1)),
        (single != "", F.when(F.array_contains(offered, single), single)),
        (by_name.isNotNull(), by_name),
        (F.size(prose) == 1, F.get(prose, 0)),
    ]
    out = F.lit(None).cast("string")
    for applies, letter in reversed(rules):
        out = F.when(applies, letter).otherwise(out)
    return out


def with_choice(rows: DataFrame, reply: str = "reply", n_options: Column | int = 4, options: str | None = None, name: str = "choice") -> DataFrame:
    """Adds the letter a reply chooses, null where it doesn't say. Another number of options
    than 1 to 10 is an error."""
    n = F.lit(n_options) if isinstance(n_options, int) else n_options
    checked = F.when(n.between(1, MOST_OPTIONS), n).otherwise(F.raise_error(F.concat(F.lit("options must be 1 to 10, not "), n.cast("string"))).cast("int"))
    held = rows.withColumns({"body_": clean(F.coalesce(F.col(reply), F.lit(""))), "offered_": F.slice(F.array(*map(F.lit, LETTERS)), F.lit(1), checked)})
    listed = F.coalesce(F.col(options), F.array().cast("array<string>")) if options else F.array().cast("array<string>")
    return held.withColumn(name, F.when(F.col("body_") != "", _letter(F.col("body_"), F.col("offered_"), listed))).drop("body_", "offered_")


@F.pandas_udf(T.StringType())
def stated_value(reply: pd.Series) -> pd.Series:
    return reply.map(lambda r: math_text.stated(r) if isinstance(r, str) else None)


@F.pandas_udf(T.BooleanType())
def same_value(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([math_text.same(a, b) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(first, second, strict=True)], dtype=object)


def expected_key(rows: DataFrame) -> Column:
    """kind, options, answer, rotation: what a right answer is; null where an item can't be scored."""
    own = F.when(F.trim("answer") != "", F.trim("answer"))
    letter = F.when((F.size("options") > 0) & (F.col("answer") != ""), answer_letter(rotate(F.col("options"), F.coalesce("rotation", F.lit(0))), F.col("answer")))
    return F.when(F.col("kind") == "free_response", own).otherwise(letter)


def scored(rows: DataFrame, n_options: int = 4) -> DataFrame:
    """rows: kind, options, answer, rotation, template, reply, error. Adds key, parsed and
    correct. A failed call, an unreadable reply or an item without a key scores null, never 0."""
    usable = F.col("error").isNull() & F.col("reply").isNotNull() & F.col("key").isNotNull()
    free, decides = F.col("kind") == "free_response", F.col("template") == "decision"
    held = rows.withColumn("key", expected_key(rows)).withColumn("shown_", rotate(F.col("options"), F.coalesce("rotation", F.lit(0))))
    held = with_choice(held, "reply", n_options, "shown_", "choice_")
    held = held.withColumns({"value_": stated_value(F.when(usable & free, F.col("reply"))), "decided_": decision_choice(F.col("reply"), n_options)})
    parsed = F.when(usable, F.when(free, F.col("value_")).when(decides, F.col("decided_")).otherwise(F.col("choice_")))
    held = held.withColumn("parsed", parsed)
    equal = F.when(free, same_value(F.when(free, F.col("parsed")), F.when(free, F.col("key")))).otherwise(F.col("parsed") == F.col("key"))
    return held.withColumn("correct", F.when(F.col("parsed").isNotNull(), equal.cast("int"))).drop("shown_", "choice_", "value_", "decided_")


def rescored(records: DataFrame, items: DataFrame, n_options: int = 4) -> DataFrame:
    """records: cell, item_id, template, rotation, reply, error, parsed, correct; items: item_id,
    kind, options, answer. Stored replies read again, each by its own template: the cells
    whose score or reading changes, with both."""
    old = records.select("cell", "item_id", "template", "rotation", "reply", "error", F.col("parsed").alias("old_parsed"), F.col("correct").alias("old_correct"))
    new = scored(old.join(items.select("item_id", "kind", "options", "answer"), "item_id"), n_options)
    changed = ~F.col("old_parsed").eqNullSafe(F.col("parsed")) | ~F.col("old_correct").eqNullSafe(F.col("correct"))
    return new.where(changed).select("cell", "item_id", "old_parsed", "parsed", "old_correct", "correct")


def worth_repeating(error: str = "error", retryable: str = "retryable") -> Column:
    """Whether a failed call is asked again: the record's verdict, where there is none the
    error's words; and always where no response came, whatever the record says."""
    said = F.coalesce(F.col(error), F.lit(""))
    return F.col(error).isNotNull() & (said.rlike(NO_RESPONSE) | F.coalesce(F.col(retryable), said.rlike(BUSY)))


def done(records: DataFrame) -> DataFrame:
    """request_sha256 of the calls that needn't be made again."""
    return records.where(F.col("request_sha256").isNotNull() & ~worth_repeating()).select("request_sha256").distinct()


def display_name(model: Column) -> Column:
    """Without the host before a slash and the date of a snapshot behind."""
    return F.regexp_replace(F.substring_index(model, "/", -1), r"-(?:\d{8}|\d{4}-\d{2}-\d{2})$", "")


def quoted(question: Column, width: int = 90) -> Column:
    flat = F.trim(F.regexp_replace(question, r"(?U)\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def final_answer(solution: Column) -> Column:
    """The value a worked solution settles on, by the reading of replies; null if none."""
    found: Callable[[Column], Column] = stated_value
    return F.when(F.trim(found(solution)) != "", found(solution))
