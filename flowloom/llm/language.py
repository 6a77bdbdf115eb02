"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language tells whether a string occurs in that text.  A
document is parsed from left to right into the longest phrases that occur there; the language whose
text needs the fewest phrases per character wins.  The automata are dense transition tables over a
small alphabet, so that numpy parses many documents and all languages in step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.common import c

#: Characters of a text are parsed in blocks of this length; a phrase ends with its block.
BLOCK = 1024


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: 1 if it is a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), np.uint8, 0x110000)


class SuffixAutomaton:
    """All substrings of a sequence of small integers; ``step[state, symbol]`` or -1."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = 2 * len(seq) + 2
        step = np.full((n, symbols), -1, np.int32)
        rows = step.tolist()
        link, size = [-1] * n, [0] * n
        last, count = 0, 1
        for x in seq.tolist():
            at, count = count, count + 1
            size[at] = size[last] + 1
            p = last
            while p >= 0 and rows[p][x] < 0:
                rows[p][x] = at
                p = link[p]
            if p < 0:
                link[at] = 0
            else:
                q = rows[p][x]
                if size[p] + 1 == size[q]:
                    link[at] = q
                else:
                    copy, count = count, count + 1
                    size[copy], link[copy] = size[p] + 1, link[q]
                    rows[copy] = rows[q][:]
                    while p >= 0 and rows[p][x] == q:
                        rows[p][x] = copy
                        p = link[p]
                    link[q] = link[at] = copy
            last = at
        self.step = np.array(rows[:count], np.int32)


class Model:
    """Automata of all languages, stacked into one flat table.

    Cell (state, symbol) holds twice the row that follows, plus 1 where a new phrase begins.
    """

    def __init__(self, texts: dict[str, str], most_symbols: int = 64):
        self.langs = sorted(texts)
        joined = "".join(texts[x] for x in self.langs).lower()
        codes, counts = np.unique(_points(joined), return_counts=True)
        common = codes[np.argsort(-counts, kind="stable")][:most_symbols - 1]
        # symbol 0 stands for every character outside the table
        self.symbol = np.zeros(0x110000, np.uint8)
        self.symbol[common] = np.arange(1, len(common) + 1)
        for i in common.tolist():
            if len(up := chr(i).upper()) == 1:
                self.symbol[ord(up)] = self.symbol[i]
        self.width = len(common) + 1
        tables, self.roots, base = [], [], 0
        for x in self.langs:
            step = SuffixAutomaton(self.symbol[_points(texts[x].lower())], self.width).step
            fresh = np.where(step[0] >= 0, step[0], 0)
            cells = np.where(step >= 0, 2 * (step + base), 2 * (fresh + base)[None, :] + 1)
            tables.append(cells.astype(np.int32))
            self.roots.append(base)
            base += len(step)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Number of phrases, one row per text and one column per language."""
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        symbols = self.symbol[_points("".join(texts))]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        length = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        roots = np.array(self.roots, np.int32)
        for lo in range(0, len(order), 2048):
            s, n = start[lo:lo + 2048], length[lo:lo + 2048]
            state = np.repeat(roots[None, :], len(s), 0)
            found = np.ones((len(s), len(roots)), np.int32)
            alive = len(s)
            for t in range(int(n[0]) if len(n) else 0):
                while alive and n[alive - 1] <= t:
                    alive -= 1
                cell = state[:alive] * self.width
                cell += symbols[s[:alive] + t][:, None]
                cell = self.table[cell]
                found[:alive] += cell & 1
                state[:alive] = cell >> 1
            np.add.at(out, owner[lo:lo + 2048], found)
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def _model(texts: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(texts))


def training_texts(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, chars: int,
                   rows: int) -> tuple[tuple[str, str], ...]:
    """Per language the texts of the rows with the smallest id hashes, cut to ``chars`` in all.

    Rows are chosen by id and language alone; only the chosen ones' texts are gathered.
    """
    lang = c(lang_col).cast("string").alias("lang")
    by_hash = Window.partitionBy("lang").orderBy("_h", "_id")
    chosen = (labelled.where(c(lang_col).isNotNull() & c(text_col).isNotNull())
              .select(lang, c(id_col).alias("_id"), F.xxhash64(c(id_col)).alias("_h"))
              .withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= rows)
              .select("_id").distinct())
    kept = (labelled.select(lang, c(id_col).alias("_id"), F.substring(c(text_col), 1, chars).alias("text"))
            .where("lang is not null and length(trim(text)) > 0")
            .join(F.broadcast(chosen), "_id", "left_semi")  # at most ``rows`` ids per language
            .withColumn("_h", F.xxhash64("_id")).select("lang", "_h", "text").collect())
    texts: dict[str, list[str]] = {}
    for r in sorted(kept):
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((x, "\n".join(t)[:chars]) for x, t in sorted(texts.items()))


def language_id(docs: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id",
                text_col: str = "text", lang_col: str = "lang", chars: int = 40_000,
                rows: int = 100) -> DataFrame:
    """The language of every text: doc_id, lang_pred, score.

    ``labelled`` teaches; of each of its languages at most ``rows`` rows and ``chars`` characters are
    used (documented bounds of the training sample only; rows with a null language or a blank text
    teach nothing).  ``score`` is the softmax share of the winner over languages, where a phrase more
    per 100 characters weighs a factor e.  Equal phrase counts go to the first language by code point.
    Null texts and texts without a letter give ``und`` and score 0, and so does everything when no
    language was learned.  Every input row gives one row; repeated rows stay; other columns are ignored.
    """
    texts = training_texts(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col,
                           chars=chars, rows=rows)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = _model(texts), _letters()
        for b in batches:
            all_texts = [t or "" for t in b.column(1).to_pylist()]
            langs, scores = ["und"] * len(all_texts), np.zeros(len(all_texts))
            for lo in range(0, len(all_texts), 1000):
                part = all_texts[lo:lo + 1000]
                if not model.langs:
                    break
                rate = model.phrases(part) * (100 / np.maximum(1, [len(t) for t in part]))[:, None]
                best = rate.argmin(1)
                share = 1 / np.exp(rate.min(1, keepdims=True) - rate).sum(1)
                for i, t in enumerate(part):
                    if t and letters[_points(t)].any():
                        langs[lo + i], scores[lo + i] = model.langs[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(c(id_col), c(text_col).cast("string")).mapInArrow(run, schema)
