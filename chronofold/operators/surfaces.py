"""Places where a caller's own part is plugged in: a retriever, a trainer, a fetcher, and transformers that are fitted once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators import retrieval

#: (questions with query and terms, k) -> (query, key, rank).
Retriever = Callable[[DataFrame, int], DataFrame]
#: (training rows, feature columns, target column) -> a function that adds ``score`` to rows.
Trainer = Callable[[DataFrame, Sequence[str], str], Callable[[DataFrame], DataFrame]]
#: keys -> (key, content); keys without content are left out.
Fetcher = Callable[[DataFrame], DataFrame]


def cited_answers(questions: DataFrame, retriever: Retriever, passages: DataFrame, *, k: int, cited: Column, entity: Column, dated: Column, wide: int = 20) -> DataFrame:
    """(query, citation, key): the first k passages of a plugged retriever that pass the guards, numbered.

    ``passages`` has key and what the guards look at; the retriever is asked
    for at least ``wide`` rows.  A question without any passage left has no
    row, which is an abstention.
    """
    found = retriever(questions, max(wide, k)).select("query", "key", "rank").join(passages, "key")
    kept = retrieval.guarded(found, cited=cited, entity=entity, dated=dated).withColumnRenamed("rank", "before")
    return retrieval.ranked(kept, by="query", order=[F.col("before")], k=k).select("query", F.col("rank").alias("citation"), "key")


def cross_fitted(df: DataFrame, trainer: Trainer, *, features: Sequence[str], target: str, fold: str) -> DataFrame:
    """Each row with the score of a plugged trainer's model that has not seen its fold.  Folds are few; a null fold is an error."""
    folds = [r[0] for r in df.select(fold).distinct().collect()]
    if None in folds:
        raise ValueError("a row has no fold")
    out = None
    for held in sorted(folds):
        score = trainer(df.where(F.col(fold) != held), features, target)
        one = score(df.where(F.col(fold) == held))
        out = one if out is None else out.unionByName(one)
    return df.withColumn("score", F.lit(None).cast("double")) if out is None else out


def fetched(wanted: DataFrame, fetch: Fetcher, known: DataFrame, *, key: str) -> DataFrame:
    """Contents of the wanted keys: those that are known, and of the others what a plugged fetcher gives."""
    keys = wanted.select(key).distinct()
    return known.join(keys, key, "left_semi").unionByName(fetch(keys.join(known.select(key), key, "left_anti")))


@dataclass
class QuantileClipper(Estimator):
    """Fits quantiles of columns on training rows; the model clips any rows to them."""

    columns: Sequence[str]
    low: float = 0.01
    high: float = 0.99

    def __post_init__(self) -> None:
        super().__init__()

    def _fit(self, dataset: DataFrame) -> ClipModel:
        row = dataset.agg(*[F.percentile(c, F.array(F.lit(self.low), F.lit(self.high))).alias(c) for c in self.columns]).first()
        return ClipModel({c: tuple(row[c]) if row[c] else None for c in self.columns})


class ClipModel(Model):
    """Bounds by column; columns that had no value in training, and nulls, are left as they are."""

    def __init__(self, bounds: dict[str, tuple[float, float] | None]):
        super().__init__()
        self.bounds = bounds

    def _transform(self, dataset: DataFrame) -> DataFrame:
        clip = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(b[0])), F.lit(b[1]))) for c, b in self.bounds.items() if b}
        return dataset.withColumns(clip)
