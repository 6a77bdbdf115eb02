"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences.

A document is a sequence of line IDs.  Prefix doubling names the runs of 1, 2, 4, ... lines that start
at each position: a run's name is the position of its first occurrence in the corpus, found by grouping
on the pair of names of its halves.  All suffixes with the same name form one interval of the suffix
array with a longest common prefix of at least that many lines, so order beyond the names is not
needed, and positions that no other shares drop out.  Two overlapping runs of a power of two name any
window.  Later copies of every maximal repeated run of enough words are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.common import c, join_facts, words
from flowloom.session import materialize

_DOC = ("_d", "_h")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add the document key: id and text hash, so that equal rows are one document."""
    return docs.withColumn("_d", c(id_col)).withColumn("_t", F.coalesce(c(text_col), F.lit(""))) \
        .withColumn("_h", F.xxhash64("_t"))


def _with_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that holds a word: document key, place among such lines, words, line ID."""
    lines = F.filter(F.split("_t", "\n"), _with_word)
    rows = _keyed(docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text")), "doc_id", "text")
    rows = rows.select(*_DOC, F.posexplode(lines).alias("seq", "_line"))
    return rows.select(*_DOC, "seq", F.size(words(F.col("_line"))).alias("n"),
                       F.xxhash64("_line").alias("_a"), F.xxhash64(F.lit(1), "_line").alias("_b"))


def _names(rows: DataFrame, keys: list[str], name: str, place: Column) -> DataFrame:
    """Add ``name``: the first place of rows with equal keys; null where no other row has them."""
    some = rows.where(" and ".join(f"{k} is not null" for k in keys))
    first = some.groupBy(*keys).agg(F.min(place).alias(name), F.max(place).alias("_last"))
    first = materialize(first.where(f"{name} <> _last").drop("_last"), "names")
    return join_facts(rows, first, keys)


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     min_words: int = 30) -> DataFrame:
    """Later copies of runs: (_d, _h, seq, size) of windows that occur earlier in the corpus.

    A window is the shortest run of ``min_words`` words or more that starts, or that ends, at a line.
    Every line of a maximal repeated run of that many words is in such a window inside the run, so the
    windows that are later copies cover exactly the later copies of all such runs.
    """
    place = F.struct(*_DOC, "seq")
    lines = materialize(line_table(docs, id_col=id_col, text_col=text_col), "lines")
    rows = _names(lines, ["_a", "_b"], "n0", place).where("n0 is not null").drop("_a", "_b").distinct()
    # chains of neighbouring repeated lines, with words before and up to each line
    by_doc = Window.partitionBy(*_DOC).orderBy("seq")
    rows = rows.withColumn("_chain", F.col("seq") - F.row_number().over(by_doc))
    chain = Window.partitionBy(*_DOC, "_chain").orderBy("seq")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("_end", F.sum("n").over(chain)).withColumn("_start", F.col("_end") - F.col("n"))
            .withColumn("_last", F.last("seq").over(whole)).withColumn("_first", F.first("seq").over(whole))
            .withColumn("_all", F.sum("n").over(whole)))
    ahead = Window.partitionBy(*_DOC, "_chain").orderBy("_start").rangeBetween(
        min_words, Window.unboundedFollowing)
    behind = Window.partitionBy(*_DOC, "_chain").orderBy("_end").rangeBetween(
        Window.unboundedPreceding, -min_words)
    to = F.coalesce(F.first("seq").over(ahead) - 1,
                    F.when(F.col("_all") - F.col("_start") >= min_words, F.col("_last")))
    since = F.coalesce(F.last("seq").over(behind) + 1,
                       F.when(F.col("_end") >= min_words, F.col("_first")))
    rows = rows.withColumn("_to", to).withColumn("_since", since)
    rows = materialize(rows.where(F.col("_all") >= min_words)
                       .drop("_end", "_start", "_last", "_first", "_all"), "chains")

    size = F.greatest(F.col("_to") - F.col("seq"), F.col("seq") - F.col("_since")) + 1
    longest = rows.agg(F.max(size)).first()[0] or 0
    levels = max(1, longest).bit_length()
    for k in range(1, levels):
        half = F.lead(f"n{k - 1}", 1 << (k - 1)).over(chain)
        rows = rows.withColumn("_half", half)
        rows = materialize(_names(rows, [f"n{k - 1}", "_half"], f"n{k}", place).drop("_half"), "doubled")

    found = None
    for k in range(levels):
        least, most = 1 << k, (2 << k) - 1
        frame = chain.rowsBetween(0, most)
        at = rows.withColumn("_names", F.collect_list(F.struct(F.col(f"n{k}").alias("x"))).over(frame)) \
            if k else rows.withColumn("_names", F.array(F.struct(F.col("n0").alias("x"))))
        starts = at.select(F.col("_d").alias("_sd"), F.col("_h").alias("_sh"), F.col("seq").alias("_ss"),
                           F.col(f"n{k}").alias("_p"), "_names")
        forward = rows.select(*_DOC, "seq", (F.col("_to") - F.col("seq") + 1).alias("size"))
        backward = rows.select(*_DOC, F.col("_since").alias("seq"),
                               (F.col("seq") - F.col("_since") + 1).alias("size"))
        sized = (forward.unionByName(backward).where(F.col("size").between(least, most)).distinct()
                 .join(starts, F.col("_d").eqNullSafe(F.col("_sd")) & F.expr("_h = _sh and seq = _ss")))
        sized = sized.withColumn("_q", F.get("_names", F.col("size") - least)["x"])
        named = _names(sized.select(*_DOC, "seq", "size", "_p", "_q"), ["size", "_p", "_q"], "_one", place)
        later = named.where(F.col("_one") != place).select(*_DOC, "seq", "size")
        found = later if found is None else found.unionByName(later)
    return found


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               min_words: int = 30) -> DataFrame:
    """The rows of ``docs``, all columns, with later copies of repeated line runs cut from the text.

    A run is a sequence of neighbouring lines of one document, blank lines left aside, that occurs
    elsewhere in the corpus or again in the document and has at least ``min_words`` words; its first
    occurrence, by id (null first), text hash and line, stays.  Lines are compared whole, by 128 bits.
    Adds ``n_lines`` (lines with a word) and ``deleted`` (their 0-based places that were cut).  Null
    texts stay null.  Equal rows (id and text) count as one document and stay as many as they were; an
    empty table gives an empty result.  ``n_lines`` and ``deleted`` replace columns of that name.
    """
    cut = repeated_windows(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    cut = (cut.select(*_DOC, F.explode(F.sequence("seq", F.col("seq") + F.col("size") - 1)).alias("_s"))
           .groupBy(F.col("_d").alias("_cd"), F.col("_h").alias("_ch"))
           .agg(F.sort_array(F.collect_set("_s")).alias("_cut")))
    columns = [x for x in docs.columns if x not in ("n_lines", "deleted")]
    rows = docs.select(F.struct(*[c(x) for x in columns]).alias("row"), c(id_col).alias("doc_id"),
                       c(text_col).alias("text"))
    rows = _keyed(rows, "doc_id", "text")
    rows = rows.join(cut, rows["_d"].eqNullSafe(cut["_cd"]) & (rows["_h"] == cut["_ch"]), "left")
    rows = rows.withColumn("_l", F.split("_t", "\n")).withColumn(
        "_nb", F.filter(F.transform("_l", lambda x, i: F.when(_with_word(x), i)), lambda i: i.isNotNull()))
    out = F.transform("_cut", lambda s: F.get("_nb", s))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), out)
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get("_l", i)), "\n"))
    none = F.array().cast("array<int>")
    return rows.select(*[(text if x == text_col else F.col("row").getField(x)).alias(x) for x in columns],
                       F.size("_nb").alias("n_lines"), F.coalesce("_cut", none).alias("deleted"))
