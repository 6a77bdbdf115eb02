"""Scaling and one-hot encoding: ``fit`` is one aggregate, ``transform`` only projects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.operators.contracts import align, required

_MAX_VOCAB = 1000


@dataclass(frozen=True)
class LinearScale:
    """``(x - shift) / scale`` per column."""

    shift: dict[str, float]
    scale: dict[str, float]

    def expr(self, name: str) -> Column:
        return (F.col(f"`{name}`") - F.lit(self.shift[name])) / F.lit(self.scale[name])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.shift})


def _one_row(df: DataFrame, columns: list[str], **kinds) -> dict:
    aggs = [fn(F.col(f"`{c}`").cast("double")).alias(f"{kind}:{i}")
            for kind, fn in kinds.items() for i, c in enumerate(columns)]
    return df.agg(*aggs).first().asDict()


def fit_minmax(df: DataFrame, columns: list[str]) -> LinearScale:
    """Scale to [0, 1] without clipping; a constant column becomes 0."""
    row = _one_row(df, columns, lo=F.min, hi=F.max)
    if row["lo:0"] is None:
        raise ValueError("no rows to fit the scaler on")
    lo = {c: row[f"lo:{i}"] for i, c in enumerate(columns)}
    hi = {c: row[f"hi:{i}"] for i, c in enumerate(columns)}
    return LinearScale(lo, {c: (hi[c] - lo[c]) or 1.0 for c in columns})


def fit_standard(df: DataFrame, columns: list[str]) -> LinearScale:
    """Z-score with the population deviation; a constant column is only centred."""
    row = _one_row(df, columns, mean=F.avg, sd=F.stddev_pop)
    return LinearScale({c: row[f"mean:{i}"] for i, c in enumerate(columns)},
                       {c: row[f"sd:{i}"] or 1.0 for i, c in enumerate(columns)})


def first_file(df: DataFrame, file: str = "source_file") -> DataFrame:
    """Rows of the alphabetically first file, the default scope of a fit."""
    name = df.agg(F.min(file)).first()[0]
    return df.where(F.col(file) == name)


def fit_vocab(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Distinct values per column; refuses columns that are no closed vocabulary."""
    out = {}
    for c in columns:
        rows = df.select(F.col(f"`{c}`").cast("string").alias("v")).distinct().limit(
            _MAX_VOCAB + 1).collect()
        if len(rows) > _MAX_VOCAB:
            raise ValueError(f"{c} has more than {_MAX_VOCAB} values")
        out[c] = [r.v for r in rows if r.v is not None]
    return out


def one_hot(df: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """Replace each column by ``{column}_{value}`` 0/1 columns; unseen values give zeros."""
    blocks = {f"{c}_{v}": F.when(F.col(f"`{c}`").cast("string") == v, 1.0).otherwise(0.0)
              for c, values in vocab.items() for v in sorted(values)}
    keep = [c for c in df.columns if c not in vocab]
    return df.select(*[F.col(f"`{c}`") for c in keep], *[e.alias(n) for n, e in blocks.items()])


def inject_absent(df: DataFrame, columns: list[str]) -> DataFrame:
    """A categorical column the input lacks counts as ``None`` everywhere."""
    return df.withColumns({c: F.lit("None") for c in columns if c not in df.columns})


def encode(df: DataFrame, categorical: list[str] | None = None, numeric: list[str] | None = None,
           vocab: dict[str, list[str]] | None = None, label: str = "label",
           fit_scope: str = "first_file") -> DataFrame:
    """Drop incomplete rows, scale the numeric columns, one-hot the categorical ones.

    ``vocab=None`` learns the vocabulary from the fit scope.
    """
    categorical = categorical or S.CATEGORICAL
    numeric = numeric or S.NUMERIC
    rows = inject_absent(df, categorical)
    rows = required(rows, [*categorical, *numeric, label])
    fit = first_file(rows) if fit_scope == "first_file" else rows
    scaled = fit_minmax(fit, numeric).transform(rows)
    vocab = vocab or fit_vocab(fit, categorical)
    return one_hot(scaled, {c: vocab[c] for c in categorical})


def union_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack tables on the columns of the first; missing columns are 0, extra ones dropped."""
    out = first
    for df in others:
        out = out.unionByName(align(df, first.columns))
    return out
