"""Scorers that are Python models: a batch at a time, with failures kept apart from results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.functions.lexicons import LABELS

#: Makes a model in a worker: a function of texts that returns (positive, negative, neutral) shares for each.
Maker = Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]]


class ModelScorer:
    """A scorer from a model that is loaded once for each task. Batches that fail are scored text by text; texts that fail get
    the error's name in score_error and null scores; empty texts get nulls."""

    def __init__(self, make: Maker, batch: int = 32):
        self.make, self.batch = make, batch

    def __call__(self, rows: DataFrame, text: str = "text") -> DataFrame:
        make, size = self.make, self.batch

        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = make()

            def one(texts: list[str]) -> list[tuple]:
                try:
                    return [(*p, None) for p in model(texts)]
                except Exception as e:  # noqa: BLE001  the error is part of the result
                    return [(None, None, None, type(e).__name__)] if len(texts) == 1 else [x for t in texts for x in one([t])]

            for texts in batches:
                out = [(None, None, None, None)] * len(texts)
                full = [i for i, t in enumerate(texts) if t and t.strip()]
                for first in range(0, len(full), size):
                    at = full[first : first + size]
                    for i, p in zip(at, one([texts.iloc[i] for i in at]), strict=True):
                        out[i] = p
                yield pd.DataFrame(out, columns=[*LABELS, "error"])

        score = F.pandas_udf(scored, "positive double, negative double, neutral double, error string", F.PandasUDFType.SCALAR_ITER)
        rows = rows.withColumn("_s", score(F.col(text)))
        top = F.greatest(*(F.col(f"_s.{x}") for x in LABELS))
        label = F.when(F.col("_s.positive") == top, "positive").when(F.col("_s.negative") == top, "negative").when(F.col("_s.neutral") == top, "neutral")
        rows = rows.withColumns({"sentiment_label": label, "sentiment_score": top, "score_error": F.col("_s.error"), **{f"score_{x}": F.col(f"_s.{x}") for x in LABELS}})
        return rows.drop("_s")


def batch_summary(rows: DataFrame) -> DataFrame:
    """Counts of labels, failures, and the mean confidence; rows without a result count in none."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("sentiment_label") == x).alias(x) for x in LABELS), F.count("score_error").alias("failed"), F.avg("sentiment_score").alias("mean_confidence"))
