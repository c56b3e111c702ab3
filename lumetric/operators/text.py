"""Items as text: identities, duplicates, options, replies, administrability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import all_composed, composed

LETTERS = "ABCDEFGHIJ"
ROMANS = "i ii iii iv v vi vii viii ix".split()
WITHHELD = "[encrypted_text"


def normalise(text: Column) -> Column:
    """Composed, white space runs single, ends gone."""
    return spaced(composed(text))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def item_hash(benchmark: Column, text: Column, options: Column, answer: Column) -> Column:
    """16 hex digits over benchmark, text, options and answer, set apart by control characters."""
    listed = F.array_join(F.transform(all_composed(options), lambda o: F.concat(F.lit("\x01"), spaced(o))), "")
    return F.substring(F.sha2(F.concat(benchmark, F.lit("\x00"), normalise(text), listed, F.lit("\x02"), normalise(answer)), 256), 1, 16)


def question_key(question: Column, options: Column) -> Column:
    """Equal for the same question with the same options in any order."""
    parts = F.concat(F.array(spaced(question)), F.array_sort(F.transform(options, spaced)))
    return F.substring(F.sha2(F.array_join(parts, "\x1f"), 256), 1, 16)


def duplicates(items: DataFrame) -> DataFrame:
    """items: item_id, benchmark, key, answer. Keys that repeat: size, whether they
    cross benchmarks, whether their answers disagree."""
    return items.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("item_id").alias("first_item"), (F.count_distinct("benchmark") > 1).alias("cross_benchmark"), (F.count_distinct("answer") > 1).alias("keys_disagree")
    ).where("size > 1")


def rotate(options: Column, k: Column) -> Column:
    """out[i] = options[(i - k) mod n]."""
    n = F.size(options)
    return F.transform(options, lambda _, i: F.element_at(options, (F.pmod(i - k, n) + 1).cast("int")))


def answer_letter(options: Column, answer: Column) -> Column:
    place = F.array_position(options, answer).cast("int")
    return F.when(place > 0, F.substring(F.lit(LETTERS), place, F.lit(1)))


def format_options(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), o)), "\n")


def decision_choice(reply: Column, n_options: int) -> Column:
    """The letter with the highest probability among those offered; null on a tie or
    an unreadable reply. A bare choice counts as certain."""
    answer = F.from_json(reply, "answer struct<choice: string, probabilities: map<string, double>>")["answer"]
    given = F.map_filter(answer["probabilities"], lambda k, p: F.array_contains(F.array(*map(F.lit, LETTERS[:n_options])), k) & p.isNotNull())
    ranked = F.sort_array(F.transform(F.map_entries(given), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))), asc=False)
    best, second = F.get(ranked, 0), F.get(ranked, 1)
    bare = F.when(F.array_contains(F.array(*map(F.lit, LETTERS[:n_options])), answer["choice"]), answer["choice"])
    none = F.coalesce(F.size(answer["probabilities"]), F.lit(0)) <= 0
    return F.when(none, bare).when(second.isNull() | (best["p"] > second["p"]), best["k"])


def family(model_type: Column) -> Column:
    """base, merge, tuned or other; the order of the tests matters."""
    t = F.lower(model_type)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | t.contains(w)
        return out

    return F.when(has("merge", "moerge"), "merge").when(has("continuously pretrained"), "tuned").when(has("pretrained"), "base").when(has("fine-tuned", "chat", "instruction"), "tuned").otherwise("other")


def statement_numbers(option: Column) -> Column:
    """The statements an option names, in order; null where it is anything else."""
    bare = F.regexp_replace(F.regexp_replace(option, r"^[()\[\]. ]+|[()\[\]. ]+$", ""), r"(?i)\s*\bonly\b\s*$", "")
    pieces = F.filter(F.transform(F.split(bare, r"\s*(?:,|&|\band\b)\s*|\s+"), lambda x: F.lower(F.regexp_replace(x, r"^[()\[\]. ]+|[()\[\]. ]+$", ""))), lambda x: x != "")
    roman = F.array(*map(F.lit, ROMANS))
    numbers = F.transform(pieces, lambda x: F.when(F.array_contains(roman, x), F.array_position(roman, x).cast("int")).when(x.rlike("^[1-9]$"), F.expr("0") + x.try_cast("int")))
    return F.when((F.size(numbers) > 0) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def incomplete(items: DataFrame) -> DataFrame:
    """items: item_id, question, options. Those whose options name statements 1..k
    (all do, ascending, two at least join or qualify) that the question doesn't list."""
    options = F.filter("options", lambda o: F.trim(o) != "")
    read = items.select("item_id", "question", F.transform(options, lambda o: F.struct(statement_numbers(o).alias("n"), o.rlike(r"(?i)\bonly\b\s*$").alias("only"))).alias("o"))
    orderly = F.forall("o", lambda x: x["n"].isNotNull() & (F.array_sort(F.array_distinct(x["n"])) == x["n"]))
    joins = F.size(F.filter("o", lambda x: (F.size(x["n"]) > 1) | x["only"]))
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform("o", lambda x: x["n"]))))
    whole = seen == F.sequence(F.lit(1), F.greatest(F.size(seen), F.lit(1)))
    arabic = F.regexp_count("question", F.lit(r"(?m)(?:^|\s)\(?[1-9]\)?[.)]\s+\S"))
    roman = F.regexp_count("question", F.lit(r"(?mi)(?:^|\s)\(?(?:i{1,3}v?|iv|vi{0,3})\)?[.)]\s+\S"))
    return read.where((F.size("o") >= 2) & orderly).where((joins >= 2) & whole & (arabic < 2) & (roman < 2)).select("item_id")


def administrable(items: DataFrame) -> DataFrame:
    """items: item_id, benchmark, task, kind, question, options, answer. Adds reason:
    why the item can't be asked, null if it can. A task's answers stand in for
    options where an item has fewer than two."""
    labels = items.where(F.col("answer") != "").groupBy("benchmark", "task").agg(F.array_sort(F.collect_set("answer")).alias("labels"))
    both = items.join(labels, ["benchmark", "task"], "left")
    offered = F.when(F.size("options") >= 2, F.col("options")).otherwise(F.coalesce("labels", F.array().cast("array<string>")))
    reason = (
        F.when(F.col("question").startswith(WITHHELD), "question withheld")
        .when(F.coalesce("answer", F.lit("")) == "", "no answer key")
        .when((F.col("kind") != "multiple_choice") & ~F.col("answer").rlike(r"\d|\\boxed"), "no final answer")
        .when(F.col("kind") != "multiple_choice", F.lit(None))
        .when(F.size(offered) < 2, "fewer than two labels")
        .when(~F.array_contains(offered, F.col("answer")), "key is not an option")
    )
    return both.select("item_id", "benchmark", reason.alias("reason"))


def nearest_routes(wanted: DataFrame, listed: DataFrame, limit: int = 4) -> DataFrame:
    """Listed names that share words with a wanted one, a word counting the less the
    more listed names have it."""
    from pyspark.sql import Window as W

    def words(df: DataFrame, name: str) -> DataFrame:
        last = F.lower(F.substring_index(name, "/", -1))
        return df.select(name, F.explode(F.array_distinct(F.filter(F.split(last, "[^a-z0-9.]+"), lambda x: x != ""))).alias("word"))

    known = words(listed, "listed")
    weight = known.groupBy("word").agg((1 / F.count(F.lit(1))).alias("weight"))
    scored = words(wanted, "wanted").join(known, "word").join(weight, "word").groupBy("wanted", "listed").agg(F.sum("weight").alias("score"))
    order = W.partitionBy("wanted").orderBy(F.desc(F.round("score", 9)), "listed")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
