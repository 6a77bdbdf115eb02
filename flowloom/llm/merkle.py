"""Merkle manifest of a dataset: one digest for all rows, and a proof for each.

A row's leaf is the SHA-256 of its fields.  The leaves of a source, in the order of their ids, are folded
three at a time into a subroot; the subroots, in the order of the sources, are folded the same way into
the root.  A proof lists, level by level, the digests before and after a row's own in its run.

The rank of a node within its group is written in base three.  Its digit columns are grouped away one
after the other, each grouping nesting the child structs of up to three nodes in their parent.  This
happens within blocks of 3 ** levels nodes, so a row never holds more; one exchange by (group, block)
serves all groupings of a block.  The digests of the blocks are the nodes of the next tier.  On the way
back each block row is grouped with the path above it, one nested transform pushes the path down, and
one explode emits a row per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.common import c, join_facts, numbered
from flowloom.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<before: string, after: string>"


def digest(value: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields in order: ``-`` for null, else the number of bytes, a colon and the value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[part(x) for x in fields]))


def _levels(n: Column) -> Column:
    """How often n nodes are folded by three until one is left."""
    return F.size(F.filter(F.array(*[F.lit(3 ** i) for i in range(40)]), lambda p: p < n))


def _roll(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks of up to 3 ** levels nodes: g, lv, b, h (digest) and the nested ``kids``.

    ``nodes`` has a group g, the group's levels lv, the rank r in the group, the digest h and a payload x.
    Above its last level a group has one node, whose digest goes up unchanged.
    """
    digits = [(F.floor(F.col("r") / F.lit(3 ** j)) % 3).cast("tinyint").alias(f"d{j}") for j in range(levels)]
    cur = nodes.select("g", "lv", F.floor(F.col("r") / F.lit(3 ** levels)).alias("b"), *digits, "h",
                       F.col("x").alias("kids")).repartition("g", "b")
    for j in range(levels):
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("d"), "h", "kids")))
        cur = cur.groupBy("g", "lv", "b", *[f"d{i}" for i in range(levels - 1, j, -1)]).agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["h"]), "")
        cur = cur.withColumn("h", F.when(F.col("lv") > j, digest(joined)).otherwise(F.col("kids")[0]["h"]))
    return cur


def _tree(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The block tables of all tiers, and per group its tier and root digest (g, tier, h)."""
    tiers, tops = [], None
    while True:
        blocks = materialize(_roll(nodes, levels), f"{name}-{len(tiers)}")
        done = blocks.where(F.col("lv") <= levels).select("g", F.lit(len(tiers)).alias("tier"), "h")
        tiers, tops = [*tiers, blocks], done if tops is None else tops.unionByName(done)
        if not blocks.where(F.col("lv") > levels).limit(1).count():
            return tiers, tops
        nodes = blocks.where(F.col("lv") > levels).select(
            "g", (F.col("lv") - levels).alias("lv"), F.col("b").alias("r"), "h", F.lit(None).cast("int").alias("x"))


def _spread(kids: Column, path: Column, rank: Column, lv: Column, j: int) -> Column:
    """The nodes below ``kids`` of level j, each with its rank and whole path, as one array."""
    def siblings(x: Column, i: Column) -> Column:
        def joined(part: Column) -> Column:
            return F.array_join(F.transform(part, lambda k: k["h"]), "")

        return F.struct(joined(F.slice(kids, 1, i)).alias("before"), joined(F.slice(kids, i + 2, 3)).alias("after"))

    def below(x: Column, i: Column) -> Column:
        own = F.when(lv > j, F.concat(F.array(siblings(x, i)), path)).otherwise(path)
        at = rank * 3 + x["d"]
        if j:
            return _spread(x["kids"], own, at, lv, j - 1)
        return F.struct(at.alias("r"), x["h"].alias("h"), x["kids"].alias("x"), own.alias("path"))

    out = F.transform(kids, below)
    return F.flatten(out) if j else out


def _paths(tiers: list[DataFrame], tops: DataFrame, levels: int, name: str) -> DataFrame:
    """Per node of the lowest tier: g, r, h, x, its path, and what ``tops`` says of its group.

    ``tops`` has a row per group: g, tier, path (above the group's root) and a struct ``of`` of facts.
    """
    nodes = None
    for t in range(len(tiers) - 1, -1, -1):
        above = tops.where(F.col("tier") == t).select("g", F.lit(0).cast("bigint").alias("b"), "path", "of")
        if nodes is not None:
            above = above.unionByName(nodes.select("g", F.col("r").alias("b"), "path", "of"))
        both = tiers[t].select("g", "b", "lv", "kids").unionByName(above, allowMissingColumns=True)
        merged = both.groupBy("g", "b").agg(*[F.first(x, ignorenulls=True).alias(x)
                                              for x in ("lv", "kids", "path", "of")])
        each = _spread(F.col("kids"), F.col("path"), F.col("b"), F.col("lv"), levels - 1)
        nodes = merged.select("g", "of", F.inline(each))
        if t:
            nodes = materialize(nodes.drop("h", "x"), f"{name}-paths-{t}")
    return nodes


def fold(path: Column, start: Column) -> Column:
    """The root that a path leads to from a leaf."""
    return F.aggregate(path, start, lambda h, p: digest(F.concat(p["before"], h, p["after"])))


def merkle_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
                    source_col: str = "source", claimed: dict[str, Column] | None = None,
                    levels: int = 6) -> DataFrame:
    """One row per input row: doc_id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    ``path`` is the proof: per level the hex digests before and after the row's own node, from the leaf's
    run to the root's.  ``proof_sha256`` digests all of them in order.  ``claimed`` maps fields to
    expressions over the input whose values are to be checked against the manifest; ``folded_root`` is
    computed from the leaf of the claimed values and the original path, and ``verified`` tells whether it
    equals the root.  ``levels`` sets the block size only, not the result.

    Leaves of a source ascend by id, null first; rows of one id by leaf; equal rows are leaves of their
    own.  A null source is a source, the first one; an empty text is a value, a null field is not.  A
    dataset of one row has an empty path.  An empty table gives no rows.  Columns that are not among the
    fields are ignored.  Texts are read once and never shuffled.
    """
    claimed = claimed or {}
    own = [c(f) for f in fields]
    rows = docs.select(c(id_col).alias("doc_id"), c(source_col).cast("string").alias("source"), leaf(own).alias("leaf"),
                       leaf([claimed.get(f, x) for f, x in zip(fields, own)]).alias("claim"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = [F.col(x).asc_nulls_first() for x in ("source", "doc_id", "leaf", "_row")]
    placed = numbered(rows, order, "_at")
    sources = placed.groupBy("source").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n"))
    sources = materialize(numbered(sources, [F.col("source").asc_nulls_first()], "g")
                          .withColumn("lv", _levels(F.col("_n"))).drop("_n"), "sources")

    nodes = join_facts(placed, sources, ["source"]).select(
        "g", "lv", (F.col("_at") - F.col("_start")).alias("r"), F.col("leaf").alias("h"),
        F.struct("doc_id", "source", "claim").alias("x"))
    tiers, subroots = _tree(nodes, levels, "leaf-blocks")
    count = sources.count()
    subroots = materialize(subroots, "subroots")
    upper, root = _tree(subroots.select(
        F.lit(0).cast("bigint").alias("g"), F.lit(len([i for i in range(40) if 3 ** i < count])).alias("lv"),
        F.col("g").alias("r"), "h", F.struct("tier").alias("x")), levels, "source-blocks")
    none = F.array().cast(f"array<{_STEP}>")
    tops = _paths(upper, root.select("g", "tier", none.alias("path"), F.struct(F.col("h").alias("root")).alias("of")),
                  levels, "source")
    tops = materialize(tops.select(F.col("r").alias("g"), "x.tier", "path",
                                   F.struct(F.col("h").alias("subroot"), "of.root").alias("of")), "tops")
    found = _paths(tiers, tops, levels, "leaf")
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    out = found.select("x.doc_id", "x.source", F.col("h").alias("leaf"), "of.subroot", "of.root", "path",
                       digest(proof).alias("proof_sha256"), fold(F.col("path"), F.col("x.claim")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
