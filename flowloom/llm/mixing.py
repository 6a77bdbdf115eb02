"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size gives the expected copies of each of its documents.  The whole
part of that number is certain and is allocated first.  The fraction is the inclusion probability p of
one more copy: every document gets the ranking number (u / (1 - u)) / odds, with u uniform by the
document's id and odds = p / (1 - p), times the document's own odds where given; the documents with
the smallest numbers are taken until the words of the source reach what is left of its target.

The fixed size counts words.  Sorting a source is avoided: its documents are dealt into slices of the
ranking number, slice totals find the one slice in which the budget ends, and only that slice is
ordered.  At last one more document of each source, the one whose size is nearest to the words still
missing, is taken if it brings the source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.common import c, join_facts, numbered, uniform, words
from flowloom.session import materialize


def source_targets(sizes: DataFrame, *, cycle: tuple[int, ...] = (1, 2, 3),
                   most: int = 3) -> DataFrame:
    """Targets of sources, from a table (source, source_size) of one row per source.

    Sources in code point order, null last, weigh ``cycle`` repeating and share all words; a target
    stops at ``most`` times its source's size and the excess is shared again by weight among the
    others until none is above.  Only sums reach the driver.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "_n")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_n") % len(cycle) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight.cast("bigint")).drop("_n"), "targets")
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    rate, above = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(rate) > cap if above >= 0 else F.lit(False)
        r = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))),
                       F.count(F.when(over, 1))).first()
        if r[2] == above or not r[1]:
            break
        rate, above = float(total - (r[0] or 0)) / r[1], r[2]
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(rate), cap.cast("double")))


def pareto_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", odds_col: str | None = None,
               cycle: tuple[int, ...] = (1, 2, 3), most: int = 3,
               slice_rows: int = 10_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Copies of every document in a mix whose sources have given shares.

    Returns one row per input row: doc_id, source, size (words; null text: 0), source_size, target,
    inclusion (probability of the copy beyond the certain ones), copies and taken (copies * size).
    ``carry`` names small columns of ``docs`` that the result holds too.  ``odds_col`` multiplies a document's inclusion odds (null or not positive: 1).  Null sources form
    one source.  Documents of no words have the copies of their rank and take nothing.  Ties of the
    ranking number go by id, then size; equal rows are interchangeable.  Only ids, sizes and sources
    are shuffled, never texts.
    """
    odds = F.lit(1.0) if odds_col is None else F.coalesce(
        F.when(c(odds_col) > 0, c(odds_col).cast("double")), F.lit(1.0))
    u = F.col("_u")
    rows = docs.select(c(id_col).alias("doc_id"), c(source_col).alias("source"),
                       F.size(words(c(text_col))).cast("bigint").alias("size"),
                       odds.alias("_odds"), uniform(c(id_col)).alias("_u"), *[c(x) for x in carry])
    rows = materialize(rows.withColumn("_q", u / (1 - u) / F.col("_odds"))
                       .withColumn("_row", F.monotonically_increasing_id()), "sizes")
    slices = max(16, rows.count() // slice_rows)
    sources = materialize(source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), cycle=cycle, most=most)
        .withColumn("_whole", F.floor(F.try_divide("target", F.col("source_size").cast("double"))))
        .withColumn("_whole", F.coalesce("_whole", F.lit(0)))
        .withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))
        .drop("weight"), "sources")

    at = F.floor(F.col("_q") / (1 + F.col("_q")) * slices)
    rows = rows.withColumn("_slice", at)
    order = Window.partitionBy("source").orderBy("_slice")
    totals = (rows.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
              .withColumn("_before", F.sum("_n").over(order) - F.col("_n")))
    totals = join_facts(totals, sources.select("source", "_left"), ["source"])
    cut = (totals.where(F.col("_before") + F.col("_n") > F.col("_left"))
           .groupBy("source").agg(F.min(F.struct("_slice", "_before")).alias("_cut"))
           .select("source", F.col("_cut._slice").alias("_cut"), F.col("_cut._before").alias("_before")))
    cut = materialize(join_facts(sources, cut, ["source"]), "cuts")

    # a source without a cut slice takes all of its documents once more (nothing is left over then)
    rows = join_facts(rows, cut, ["source"])
    inside = Window.partitionBy("source").orderBy("_q", "doc_id", "size", "_row").rowsBetween(
        Window.unboundedPreceding, 0)
    edge = (rows.where(F.col("_slice") == F.col("_cut"))
            .withColumn("_sum", F.col("_before") + F.sum("size").over(inside))
            .withColumn("_more", (F.col("_sum") <= F.col("_left")).cast("int")))
    rest = (rows.where(F.col("_cut").isNull() | (F.col("_slice") != F.col("_cut")))
            .withColumn("_sum", F.lit(None).cast("bigint"))
            .withColumn("_more", F.coalesce(F.col("_slice") < F.col("_cut"), F.lit(True)).cast("int")))
    drawn = materialize(edge.unionByName(rest), "drawn")

    # one more document per source, if its size brings the source nearer to the target
    short = (drawn.groupBy("source").agg(F.sum(F.col("_more") * F.col("size")).alias("_got")))
    short = (join_facts(sources.select("source", "_left"), short, ["source"])
             .select("source", (F.col("_left") - F.col("_got")).alias("_miss")))
    spare = (join_facts(drawn.where("_more = 0"), short, ["source"])
             .where(F.abs(F.col("size") - F.col("_miss")) < F.col("_miss"))
             .groupBy("source").agg(F.min(F.struct(
                 F.abs(F.col("size") - F.col("_miss")), "_q", "doc_id", "size", "_row")).alias("_x"))
             .select("source", F.col("_x._row").alias("_extra")))
    out = join_facts(drawn, spare, ["source"])
    copies = F.col("_whole") + F.col("_more") + F.coalesce(
        (F.col("_row") == F.col("_extra")).cast("int"), F.lit(0))
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce(F.try_divide("_left", F.col("source_size").cast("double")), F.lit(0.0)).alias("inclusion"),
        F.least(copies, F.lit(most)).cast("bigint").alias("copies"), *[c(x) for x in carry],
    ).withColumn("taken", F.col("copies") * F.col("size"))
