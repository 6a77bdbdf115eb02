"""Best-fit packing of tokenised documents into sequences of a fixed length, by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is decided on their histogram alone: at most
as many counts as the capacity reach the driver, however many documents there are.  Pieces above one third
of the capacity can be at most two to a sequence; from the longest on, each is paired with the longest
remaining one that fits.  All shorter pieces, longest first, go where the gap left is smallest.  Equal
lengths are placed together, so the plan is a short list of stretches: so many pieces of one length, so
many to a sequence, from this sequence and offset on.  A sequence's gap at least halves each time a
stretch enters it, so there are at most about ``3 * capacity * log2(capacity)`` stretches.

Pieces get positions in the order of their length from a range exchange of narrow rows; a search among
the stretches then gives each its sequence and offset.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import c, numbered
from flowloom.session import materialize

CAPACITY = 1024
END = 2

#: Texts longer than this are tokenised in parts, and so many characters at a time.
PART = 1 << 20

#: Between these three characters every tokeniser of this kind starts a new word.
_BREAK = re.compile("[a-z] [a-z]")


def vocabulary() -> str:
    """Place of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Encoder:
    """Ids of texts by a vocabulary file.

    A byte-level vocabulary whose ids are the order of its merges is the rank table of byte pair encoding;
    such a one, and texts without the strings of its special tokens, take the faster of two libraries.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks = _ranks(spec)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.ranks is None:
            return self._whole(texts)
        out = [self.ranks.encode_to_numpy(t, disallowed_special=()) for t in texts]
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, np.uint32) for e in found]


def _ranks(spec: dict):
    """The rank table's encoder, or None where the vocabulary has another form."""
    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = (model["type"] == "BPE" and not any(model.get(k) for k in (
        "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        and spec["normalizer"] is None)
    vocab = model.get("vocab", {})
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model.get("merges", [])]
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    # the printable stand-ins of bytes: printable ones stand for themselves, the others follow from 256 on
    signs = sorted(ByteLevel.alphabet())
    other = [x for x in signs if ord(x) > 255]
    own = {ord(x): x for x in signs if ord(x) < 256}
    of = {x: b for b, x in own.items()} | dict(zip(other, (b for b in range(256) if b not in own)))
    ranks = {bytes(of[x] for x in token): i for token, i in vocab.items() if token not in
             {t["content"] for t in spec["added_tokens"]}}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def parts(text: str, size: int = PART) -> list[str]:
    """The text cut at blanks between letters, each part about ``size`` long; the tokens stay the same."""
    out, lo = [], 0
    while len(text) - lo > size:
        found = _BREAK.search(text, lo + size)
        if not found:
            break
        out.append(text[lo:found.start() + 1])
        lo = found.start() + 1
    return [*out, text[lo:]]


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Token ids of every text."""
    split = [parts(t) for t in texts]
    got = iter(_encoder(path)([p for s in split for p in s]))
    return [np.concatenate([next(got) for _ in s]) if len(s) > 1 else next(got) for s in split]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > PART:
            yield lo, i
            lo, total = i, 0
        total += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END, path: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids, ids_crc32, _row.

    A document is its token ids and ``end_id``.  Longer ones are cut into pieces of the full capacity, the
    first one takes the rest.  Written once; ``_row`` numbers the rows.
    """
    place = path or vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks([len(t) for t in texts]):
                rows, flat = [], []
                for i, ids in enumerate(encode(place, texts[lo:hi]), lo):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())))
                    flat.append(ids)
                own, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows))
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                tokens = pa.array(np.concatenate(flat).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(own)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.ListArray.from_arrays(pa.array(ends), tokens), pa.array(crc)],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    out = docs.select(c(id_col), F.coalesce(c(text_col).cast("string"), F.lit(""))).mapInArrow(run, schema)
    return materialize(out.withColumn("_row", F.monotonically_increasing_id()), "pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Stretches (length, rank, count, per sequence, sequence, offset), by length and rank.

    Pieces of a length are ranked from 0; piece ``rank + k`` of a stretch lies in sequence
    ``sequence + k // per`` at ``offset + k % per * length``.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    rank, out, bins = [0] * (capacity + 1), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(length: int, n: int, per: int, at: int, offset: int) -> None:
        out.append((length, rank[length], n, per, at, offset))
        rank[length] += n
        left[length] -= n

    put(capacity, left[capacity], 1, bins, 0)
    bins += rank[capacity]
    large = capacity // 3 + 1
    for length in range(capacity - 1, large - 1, -1):
        while left[length]:
            other = min(length, capacity - length)
            while other >= large and left[other] <= (other == length):
                other -= 1
            if other < large:
                n, gap = left[length], capacity - length
                put(length, n, 1, bins, 0)
            else:
                n = left[length] // 2 if other == length else min(left[length], left[other])
                gap = capacity - length - other
                put(length, n, 1, bins, 0)
                put(other, n, 1, bins, length)
            gaps[gap].append((bins, bins + n))
            bins += n
    for length in range(min(large, capacity) - 1, 0, -1):
        gap = length
        while left[length]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            per = gap // length
            if gap == capacity:  # no sequence has room: open new ones
                n = -(-left[length] // per)
                lo, hi, bins = bins, bins + n, bins + n
            else:
                lo, hi = gaps[gap].pop()
            n = min(hi - lo, left[length] // per)
            if n:
                put(length, n * per, per, lo, capacity - gap)
                gaps[gap - per * length].append((lo, lo + n))
            if n < hi - lo:
                rest = left[length]
                if rest:
                    put(length, rest, per, lo + n, capacity - gap)
                    gaps[gap - rest * length].append((lo + n, lo + n + 1))
                if lo + n + (rest > 0) < hi:
                    gaps[gap].append((lo + n + (rest > 0), hi))
    return np.array(sorted(x for x in out if x[2]), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``pieces`` (see :func:`token_pieces`) without their ids, with sequence_id and offset."""
    found = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = {r["length"]: r["count"] for r in found}
    stretches = plan(counts, capacity)
    # positions are in the order of length and rank, as the stretches are
    first = np.cumsum(stretches[:, 2]) - stretches[:, 2]
    sent = pieces.sparkSession.sparkContext.broadcast((first, stretches))  # bounded by the capacity

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(at: pd.Series) -> pd.DataFrame:
        first, s = sent.value
        at = at.to_numpy()
        i = np.searchsorted(first, at, "right") - 1
        k = at - first[i]
        return pd.DataFrame({"sequence_id": s[i, 4] + k // s[i, 3], "offset": s[i, 5] + k % s[i, 3] * s[i, 0]})

    placed = numbered(pieces.drop("ids"), [F.col("length"), F.col("_row")], "_at")
    return placed.withColumn("_x", place("_at")).select(
        *[x for x in pieces.columns if x != "ids"], "_x.sequence_id", "_x.offset")


def best_fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
             end_id: int = END, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placements, pieces): where every piece of every document lies, and the pieces with their ids.

    Placements are doc_id, piece, start, length, ids_crc32, _row, sequence_id and offset: a sequence holds
    its pieces without gaps from offset 0 and at most ``capacity`` tokens.  ``path`` names the vocabulary
    file, which every executor must reach.

    Null and empty texts are documents of ``end_id`` alone.  Very long texts are tokenised in parts cut at
    blanks between letters, with the same ids.  Repeated rows are packed one by one; null ids stay null;
    equal lengths are interchangeable and go by row number.  Other columns are ignored.  An empty table
    gives no pieces.
    """
    pieces = token_pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, path=path)
    return pack(pieces, capacity), pieces


def sequences(placements: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids, and per piece its doc_id, piece, start, length, offset."""
    whole = placements.join(pieces.select("_row", "ids"), "_row")
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    out = whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("_p"))
    return out.select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"),
                      F.transform("_p", lambda p: p.dropFields("ids")).alias("pieces"))
