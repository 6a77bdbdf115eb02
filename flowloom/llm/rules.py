"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in column expression over the words, symbols, stop words and lines of the
text; every rule is a row (name, numerator, denominator, lowest, highest) of ``RULES``.  Nothing runs
outside the JVM and nothing is shuffled: the operator is one map over the scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import c, words

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = """
a an and are as at be by for from in is it of on or that the this to was with
auf das dem den der des die ein eine im ist mit nicht sich und von zu
avec dans de des du en est et la le les par pas pour que qui sur un une
al con de del el en es la las lo los no o para por que se su un una y
""".split()


class Rule(NamedTuple):
    """``low <= numerator / denominator <= high`` must hold; no bound where None."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The threshold table.
RULES = (
    Rule("few_words", "n_words", None, 10, None),
    Rule("short_words", "word_chars", "n_words", 2.0, None),
    Rule("long_words", "word_chars", "n_words", None, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("shouts_per_word", "n_shouts", "n_words", None, 0.4),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)


def _repeats(docs: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside five-word windows that the text holds twice or more.

    Windows are compared by 64-bit hashes.  Only texts with a repeated hash sort their windows.
    """
    window = F.when(F.col("n_words") >= 5, F.transform(
        F.sequence(F.lit(1), F.col("n_words") - 4), lambda i: F.xxhash64(F.slice("_w", i, 5))))
    docs = docs.withColumn("_h", F.coalesce(window, F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    docs = docs.withColumn("_s", F.when(some, F.sort_array(F.transform(
        "_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.transform("_s", lambda s, k: F.when(
        (s["h"] == F.get("_s", k - 1)["h"]) | (s["h"] == F.get("_s", k + 1)["h"]), s["i"]))
    docs = docs.withColumn("_at", F.sort_array(F.filter(at, lambda i: i.isNotNull())))
    docs = docs.withColumn("_at", F.coalesce("_at", F.array().cast("array<int>")))
    # each window adds five words, or fewer where the next repeated window begins sooner
    gaps = F.transform("_at", lambda p, k: F.least(
        F.lit(5), F.coalesce(F.get("_at", k + 1) - p, F.lit(5))))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)
    return docs.withColumn("n_repeat_words", total).drop("_h", "_s", "_at")


def metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per input row; a null text counts as the empty one."""
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = (docs.select(c(id_col).alias("doc_id"), F.coalesce(c(text_col), F.lit("")).alias("_t"))
            .withColumn("_w", words(F.col("_t"))).withColumn("_l", lines)
            .withColumn("n_words", F.size("_w")))

    def chars(of: str) -> Column:
        return F.length("_t") - F.length(F.translate("_t", of, ""))

    docs = _repeats(docs)
    return docs.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"),
        chars(" \t\n\x0b\x0c\r").alias("_blank"), F.length("_t").alias("_len"),
        chars(SYMBOLS).cast("bigint").alias("n_symbols"),
        chars("!").cast("bigint").alias("n_shouts"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(sorted(set(STOP_WORDS)))))
        .cast("bigint").alias("n_stop_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09]*[-*•]")))
        .cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$")))
        .cast("bigint").alias("n_ellipsis_lines"),
        "n_repeat_words",
    ).withColumn("word_chars", (F.col("_len") - F.col("_blank")).cast("bigint")).drop("_len", "_blank")


def broken(rule: Rule) -> Column:
    """True where a rule is broken; a ratio over nothing breaks none."""
    value = F.col(rule.numerator).cast("double")
    if rule.denominator:
        value = F.try_divide(value, F.col(rule.denominator).cast("double"))
    low = F.lit(False) if rule.low is None else value < rule.low
    high = F.lit(False) if rule.high is None else value > rule.high
    return F.coalesce(low | high, F.lit(False))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES, repeat_share: int = 20) -> DataFrame:
    """Judge every row by the threshold table.

    ``base_failed`` holds for texts under ten words and for those with more than ``repeat_share``
    percent of their words in repeated five-word windows.  ``kept`` holds for texts that pass this and
    every rule; ``broken_rules`` names the broken ones.  Null, empty and blank texts have no words and
    fail.  Every input row gives one output row; repeated rows and null ids stay; other columns are
    ignored.
    """
    judged = metrics(docs, id_col=id_col, text_col=text_col)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))
    names = [F.when(broken(r), F.lit(r.name)) for r in rules]
    failed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return (judged.withColumn("broken_rules", failed).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)))
