"""Evaluation of predictions against the truth: frames with the columns ``truth`` and ``predicted``."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.functions.columns import half_up
from finstrata.functions.tails import binomial_p, chi2_1_p, normal_p


def confusion(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(truth, predicted, n) for all pairs of known labels, zeros too."""
    known = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    return known.join(rows.groupBy("truth", "predicted").agg(F.count("*").alias("n")), ["truth", "predicted"], "left").na.fill(0)


def scores(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Precision, recall, F1 and support of each label, to four digits; 0 where they aren't defined."""
    t, p = F.col("truth"), F.col("predicted")
    one = rows.filter(t.isin(*labels) & p.isin(*labels)).agg(
        *(c.alias(f"{k}_{i}") for i, x in enumerate(labels) for k, c in (("tp", F.count_if((t == x) & (p == x))), ("fp", F.count_if((t != x) & (p == x))), ("fn", F.count_if((t == x) & (p != x)))))
    )
    each = one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), *(F.col(f"{k}_{i}").alias(k) for k in ("tp", "fp", "fn"))) for i, x in enumerate(labels)))).alias("x")).select("x.*")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    precision, recall = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return each.select("label", half_up(precision, 4).alias("precision"), half_up(recall, 4).alias("recall"), half_up(f1, 4).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def overall(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Accuracy, and the means of the labels' rounded scores."""
    macro = scores(rows, labels).agg(*(half_up(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    accuracy = rows.agg(F.count("*").alias("n"), half_up(F.coalesce(F.try_divide(F.count_if(F.col("truth") == F.col("predicted")).cast("double"), F.count("*")), F.lit(0.0)), 4).alias("accuracy"))
    return accuracy.join(F.broadcast(macro))


def comparison(rows: DataFrame, models: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """overall() of several predictions (columns), and how much each differs from the first."""
    every = reduce(DataFrame.unionByName, (overall(rows.select("truth", F.col(m).alias("predicted")), labels).withColumn("model", F.lit(m)) for m in models))
    first = every.filter(F.col("model") == models[0]).select(F.col("accuracy").alias("a"), F.col("macro_f1").alias("f"))
    return every.join(F.broadcast(first)).withColumn("accuracy_delta", half_up(F.col("accuracy") - F.col("a"), 4)).withColumn("macro_f1_delta", half_up(F.col("macro_f1") - F.col("f"), 4)).drop("a", "f")


def udf(f, kind: str = "double"):
    """A scalar function for the one row of an aggregate."""
    return F.udf(f, kind)


def mcnemar(rows: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """b (only the first is right), c (only the second), exact p, chi-square with continuity correction, its p."""
    a, b = F.col(first) == F.col("truth"), F.col(second) == F.col("truth")
    x = rows.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    gap = F.abs(F.col("b") - F.col("c")) - 1
    x = x.withColumn("discordant", F.col("b") + F.col("c")).withColumn("chi2", F.coalesce(F.try_divide((gap * gap).cast("double"), F.col("discordant")), F.lit(0.0)))
    return x.withColumn("exact_p", udf(binomial_p)("b", "discordant")).withColumn("chi2_p", F.when(F.col("discordant") > 0, udf(chi2_1_p)("chi2")).otherwise(1.0))


def kappa(rows: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """Cohen's kappa of two annotators: n, observed and expected agreement, kappa, its error, z and p."""
    cells = rows.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = left.join(right, left.a == right.b).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("by_chance"))
    x = total.join(F.broadcast(chance)).withColumn("po", F.col("same") / F.col("n")).withColumn("pe", F.col("by_chance") / (F.col("n") * F.col("n")))
    x = x.withColumn("kappa", F.coalesce(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), F.lit(1.0)))
    x = x.withColumn("se", F.try_divide(F.sqrt(F.col("po") * (1 - F.col("po")) / F.col("n")), 1 - F.col("pe")))
    x = x.withColumn("z", F.try_divide(F.col("kappa"), F.col("se")))
    return x.select("n", half_up(F.col("po"), 4).alias("observed"), half_up(F.col("pe"), 4).alias("expected"), half_up(F.col("kappa"), 4).alias("kappa"), half_up(F.col("se"), 4).alias("se"), half_up(F.col("z"), 4).alias("z"), udf(lambda z: None if z is None else normal_p(z))("z").alias("p_value"))


def class_agreement(rows: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """Of each label that the first annotator gives, how often the second one gives it too."""
    out = rows.groupBy(F.col(first).alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col(first) == F.col(second)).alias("agree"))
    return out.withColumn("agreement", half_up(F.col("agree") / F.col("n"), 4))


def bootstrap(rows: DataFrame, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """A percentile interval of the accuracy, from samples with replacement within each class.

    Of a class's n rows, k of them right, such a sample has a binomial number of right ones: rows are counted once, and each
    replicate draws a number for each class.
    """
    @F.pandas_udf("long")
    def drawn(truth: pd.Series, n: pd.Series, k: pd.Series, replicate: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        return pd.Series([np.random.default_rng([seed, r, zlib.crc32(str(t).encode())]).binomial(a, b / a) for t, a, b, r in zip(truth, n, k, replicate, strict=True)], dtype="int64")

    classes = rows.groupBy("truth").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("k"))
    each = classes.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn("right", drawn("truth", "n", "k", "replicate"))
    accuracy = each.groupBy("replicate").agg((F.sum("right") / F.sum("n")).alias("accuracy"))
    tail = (1 - level) / 2
    return accuracy.agg(F.avg("accuracy").alias("mean"), F.percentile("accuracy", tail).alias("low"), F.percentile("accuracy", 1 - tail).alias("high"), F.count("*").alias("replicates"))


def stratified_folds(rows: DataFrame, k: int, label: str, key: str, seed: int = 42) -> DataFrame:
    """A fold from 0 to k - 1 for each row, even within each label; the order is that of hashes."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("fold", ((order - 1) % k).cast("int"))


def flips(rows: DataFrame, full: str, variants: tuple[str, ...]) -> DataFrame:
    """For each variant of a label, the share of rows whose label differs from the full one's."""
    out = rows.agg(*(half_up(F.count_if(~F.col(v).eqNullSafe(F.col(full))) / F.count("*"), 4).alias(v) for v in variants))
    return out.unpivot([], list(variants), "variant", "flipped")
