"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

All of it is column expressions and joins.  A window that is similar enough to an item shares a shingle
with it, so windows are laid only where a document has a shingle of an item, so that both copies of the
shingle fall together, and are as long as the item.  Documents without such a shingle drop out inside
the scan, by a bitmap of bounded size.  The fingerprints of windows and items are compared by blocks:
fingerprints within the radius agree in at least one of ``radius + 1`` blocks.  Pairs within the radius
are then compared by weighted shingles, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import BROADCAST_ROWS, c, fresh, words
from flowloom.session import materialize

SHINGLE = 5
#: The bitmap has about this many bits per shingle, up to the largest number of 64-bit cells.
_BITS_PER_SHINGLE, _MOST_CELLS, _PROBES = 128, 1 << 17, 3


def _shingles(text: Column) -> tuple[Column, Column]:
    """(words, 64-bit hashes of five-word shingles); fewer words are one shingle, none give none."""
    w = words(F.lower(text))
    n = F.size("_w")
    many = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice("_w", i, SHINGLE)))
    none = F.array().cast("array<bigint>")
    return w, F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64("_w"))).otherwise(none)


def _fingerprint(hashes: Column) -> Column:
    """64-bit SimHash: bit b is set if more than half of the distinct hashes have it set."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda a, x: a + F.call_function("getbit", x, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)) \
            .otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
                       lambda a, b: a.bitwiseOR(bit(b)))


def _blocks(fingerprint: Column, count: int) -> Column:
    """Array of (block number, bits) that together hold every bit of the fingerprint once."""
    cuts = [64 * i // count for i in range(count + 1)]
    return F.array(*[F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(fingerprint, lo)
                              .bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("v"))
                     for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def _probe(h: Column, k: int, cells: int) -> tuple[Column, Column]:
    """(cell, bit) of the k-th probe; every probe reads other bits of the hash."""
    own = F.shiftrightunsigned(h, 20 * k)
    return (F.shiftrightunsigned(own, 6).bitwiseAND(F.lit(cells - 1)).cast("int"),
            own.bitwiseAND(F.lit(63)).cast("int"))


def _bitmap(shingles: DataFrame) -> tuple[Column, int]:
    """A constant array of 64-bit cells in which the bits of all shingles are set."""
    need = shingles.count() * _BITS_PER_SHINGLE // 64
    cells = min(_MOST_CELLS, 1 << max(4, need.bit_length()))
    probes = F.array(*[F.struct(*(x.alias(n) for x, n in zip(_probe(F.col("h"), k, cells), "cb")))
                       for k in range(_PROBES)])
    set_bits = (shingles.select(F.explode(probes).alias("p")).groupBy("p.c").agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p.b"))).alias("v")))
    values = ["0"] * cells
    for r in set_bits.collect():  # at most ``cells`` numbers
        values[r["c"]] = str(r["v"])
    return F.split(F.lit(",".join(values)), ",").cast("array<bigint>"), cells


def _in_bitmap(h: Column, bitmap: Column, cells: int) -> Column:
    out = None
    for k in range(_PROBES):
        cell, bit = _probe(h, k, cells)
        hit = F.call_function("getbit", F.get(bitmap, cell), bit) == 1
        out = hit if out is None else out & hit
    return out


def benchmark_items(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item with words: item_id, size (words), shingles (hash, weight), total, fingerprint.

    A shingle weighs ln(1 + items / items that have it), so passages that many items share count less.
    """
    w, h = _shingles(F.coalesce(c(text_col), F.lit("")))
    items = (benchmark.select(c(id_col).alias("item_id"), w.alias("_w")).withColumn("_h", h)
             .where(F.size("_w") > 0).select("item_id", F.size("_w").alias("size"), "_h"))
    items = materialize(items.withColumn("row", F.monotonically_increasing_id()), "items")
    number = items.count()
    each = items.select("row", F.explode(F.array_distinct("_h")).alias("h"))
    weight = each.groupBy("h").agg(F.log1p(F.lit(float(number)) / F.count(F.lit(1))).alias("w"))
    weighed = each.join(weight, "h").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("h", "w"))).alias("shingles"), F.sum("w").alias("total"))
    return materialize(items.join(weighed, "row").withColumn(
        "fingerprint", _fingerprint(F.array_distinct("_h"))).withColumn("most", F.log1p(F.lit(float(number)))),
        "weighed")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.75,
               radius: int = 19) -> DataFrame:
    """Pairs of documents and items: doc_id, text_hash, item_id, start, hamming, similarity.

    A pair comes out when a window of the document, as many words long as the item (or the whole text
    if that is shorter), has a fingerprint within ``radius`` of the item's and weighted similarity of at
    least ``similarity``: weight of the common shingles by weight of all, where a shingle outside the
    item weighs as one that no item has.  The window of highest similarity, then first, is given.
    Letters count in lower case.  Texts under five words are one shingle and match only items of the
    same words.  Null, empty and blank texts and items match nothing.  Equal rows (id and text) give
    each pair once; null ids take part; other columns are ignored; without items nothing comes out.
    """
    items = benchmark_items(benchmark, id_col=item_col, text_col=item_text_col)
    seeds = (items.select("size", F.posexplode("_h").alias("q", "h")).distinct())
    bitmap, cells = _bitmap(seeds.select("h").distinct())
    w, h = _shingles(F.coalesce(c(text_col), F.lit("")))
    rows = (docs.select(c(id_col).alias("doc_id"), F.xxhash64(c(text_col)).alias("text_hash"), w.alias("_w"))
            .withColumn("_h", h).withColumn("_n", F.size("_w")))
    hits = F.filter(F.transform("_h", lambda x, i: F.when(_in_bitmap(x, bitmap, cells), i)),
                    lambda i: i.isNotNull())
    # Texts without hits are left as nulls and dropped after the write: a filter here would be pushed
    # below the projections and evaluate the words anew for every shingle.
    rows = rows.withColumn("_at", hits).withColumn("_some", F.size("_at") > 0)
    rows = materialize(rows.select("doc_id", "text_hash", "_n", *[
        F.when(F.col("_some"), F.col(x)).alias(x) for x in ("_h", "_at")]), "hits").where("_h is not null")

    def small(df: DataFrame) -> DataFrame:
        """Broadcast if its rows, counted, are few; else it is dealt by the key."""
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    seen = (rows.select("doc_id", "text_hash", "_n", F.explode("_at").alias("i"), "_h")
            .select("doc_id", "text_hash", "_n", "i", F.get("_h", F.col("i")).alias("h")).join(small(seeds), "h"))
    start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("q"), F.col("_n") - F.col("size")))
    places = (seen.select("doc_id", "text_hash", F.struct("size", start.alias("start")).alias("p"))
              .groupBy("doc_id", "text_hash").agg(F.collect_set("p").alias("p"))
              .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "p"))
    same = rows["doc_id"].eqNullSafe(places["_d"]) & (rows["text_hash"] == places["_t"])
    windows = (rows.dropDuplicates(["doc_id", "text_hash"]).join(places, same)
               .select("doc_id", "text_hash", "_h", F.explode("p").alias("p")))
    length = F.greatest(F.lit(1), F.col("p.size") - (SHINGLE - 1))
    windows = windows.select("doc_id", "text_hash", "p.size", "p.start",
                             F.array_distinct(F.slice("_h", F.col("p.start") + 1, length)).alias("has"))
    windows = materialize(windows.withColumn("print", _fingerprint(F.col("has"))), "windows")

    def dealt(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("_b", F.explode(_blocks(F.col(name), radius + 1))) \
            .withColumn("_k", F.col("_b.b")).withColumn("_v", F.col("_b.v")).drop("_b")

    left = dealt(windows.select("print", "size").distinct(), "print")
    right = dealt(items.select("row", "size", "fingerprint"), "fingerprint")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint")))
    near = (left.join(right, ["size", "_k", "_v"]).withColumn("hamming", distance)
            .where(F.col("hamming") <= radius).select("print", "size", "row", "hamming").distinct())
    pairs = windows.join(near, ["print", "size"]).join(
        items.select("row", "item_id", "shingles", "total", "most"), "row")
    common = F.filter("shingles", lambda s: F.array_contains("has", s["h"]))
    pairs = pairs.withColumn("_common", common)
    shared = F.aggregate("_common", F.lit(0.0), lambda a, s: a + s["w"])
    other = (F.size("has") - F.size("_common")) * F.col("most")
    pairs = pairs.withColumn("similarity", shared / (F.col("total") + other))
    best = F.max_by(F.struct("start", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return (pairs.where(F.col("similarity") >= similarity - 1e-12)
            .groupBy("doc_id", "text_hash", "item_id").agg(best.alias("_x"))
            .select("doc_id", "text_hash", "item_id", "_x.start", "_x.hamming", "_x.similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold an item (see ``find_leaks``)."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    d, t = fresh(docs, "_d", "_t")
    bad = materialize(leaks.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct(), "leaks")
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    same = c(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(c(text_col)) == F.col(t))
    return docs.join(bad, same, "left_anti")
