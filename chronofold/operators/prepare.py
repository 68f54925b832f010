"""Training-set preparation: everything is fitted on the training rows and applied to all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.staging import written


def _fitted(train: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    return train.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in points])).alias(f"_{c}") for c in columns])


def impute_median(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the training median (0 where it has none) and add an indicator for each column."""
    fit = F.broadcast(_fitted(train, columns, [0.5]))
    out = df.join(fit)
    new = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    new |= {c: F.coalesce(F.col(c), F.col(f"_{c}")[0], F.lit(0.0)) for c in columns}
    return out.withColumns(new).drop(*[f"_{c}" for c in columns])


def clip_quantiles(df: DataFrame, train: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    fit = F.broadcast(_fitted(train, columns, [low, high]))
    new = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_{c}")[0]), F.col(f"_{c}")[1])) for c in columns}
    return df.join(fit).withColumns(new).drop(*[f"_{c}" for c in columns])


def scale_robust(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / IQR; an IQR of zero counts as one."""
    fit = F.broadcast(_fitted(train, columns, [0.25, 0.5, 0.75]))
    new = {}
    for c in columns:
        iqr = F.col(f"_{c}")[2] - F.col(f"_{c}")[0]
        new[c] = (F.col(c) - F.col(f"_{c}")[1]) / F.when(iqr == 0, 1.0).otherwise(iqr)
    return df.join(fit).withColumns(new).drop(*[f"_{c}" for c in columns])


def scale_standard(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a deviation of zero counts as one."""
    fit = F.broadcast(train.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m{c}"), F.stddev_pop(c).alias(f"_s{c}"))]))
    new = {c: (F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") == 0, 1.0).otherwise(F.col(f"_s{c}")) for c in columns}
    return df.join(fit).withColumns(new).drop(*[f"_{x}{c}" for c in columns for x in "ms"])


def loss_weights(df: DataFrame, mode: str, *, y: str, w: str, entity: str) -> DataFrame:
    """Weights with mean one: design, sqrt, balanced (classes weigh the same) or company_balanced (then by rows of the entity)."""
    if mode == "design":
        raw = df.withColumn("_raw", F.col(w))
    elif mode == "sqrt":
        raw = df.withColumn("_raw", F.sqrt(w))
    elif mode in ("balanced", "company_balanced"):
        base = df
        if mode == "company_balanced":
            sizes = df.groupBy(entity).agg(F.count("*").alias("_n"))
            base = df.join(sizes, entity).withColumn("_base", F.col(w) / F.col("_n"))
        else:
            base = df.withColumn("_base", F.col(w))
        sums = F.broadcast(base.groupBy(y).agg(F.sum("_base").alias("_c")))
        total = F.broadcast(base.agg(F.sum("_base").alias("_t")))
        raw = base.join(sums, y).join(total).withColumn("_raw", F.col("_base") * F.col("_t") / (2 * F.col("_c")))
    else:
        raise ValueError(f"unknown mode {mode}")
    mean = F.broadcast(raw.agg(F.avg("_raw").alias("_mean")))
    return raw.join(mean).withColumn("loss_weight", F.col("_raw") / F.col("_mean")).select(*df.columns, "loss_weight")


def calibrate_intercept(df: DataFrame, *, p: str, y: str, prior: float = 0.5, rounds: int = 60) -> float:
    """The offset by which logits must move for their mean probability to be (sum y + c) / (n + 2c).

    Scores are first counted by value rounded to six places, so each step of
    the bisection reads a table of bounded size instead of the rows.
    """
    counted = written(df.groupBy(F.round(p, 6).alias("p")).agg(F.count("*").alias("n"), F.sum(y).alias("s")).where("p IS NOT NULL"), "scores")
    total = counted.agg(F.sum("n"), F.sum("s")).first()
    target = (total[1] + prior) / (total[0] + 2 * prior)
    q = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    low, high = -20.0, 20.0
    logits = counted.select(F.ln(q / (1 - q)).alias("z"), "n")
    # a hundred candidate offsets a pass; three passes narrow forty to less than a ten-thousandth
    for _ in range(4):
        grid = [low + (high - low) * i / 100 for i in range(101)]
        means = logits.agg(*[(F.sum(F.col("n") / (1 + F.exp(-(F.col("z") + g)))) / total[0]).alias(f"g{i}") for i, g in enumerate(grid)]).first()
        k = max(i for i in range(101) if i == 0 or means[i] <= target)
        low, high = grid[min(k, 99)], grid[min(k, 99) + 1]
    return (low + high) / 2


def bootstrap_clusters(df: DataFrame, *, entity: str, value: str, w: str, replicates: int, seed: int = 7) -> DataFrame:
    """Weighted means of resampled entities, one row a replicate.

    Each entity's number of draws in a replicate is Poisson(1), from a hash of
    both, which needs no global draw and gives the same result on any layout.
    """
    per = df.groupBy(entity).agg(F.sum(F.col(w) * F.col(value)).alias("_s"), F.sum(w).alias("_w"))
    rows = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    key = F.concat_ws(":", F.col(entity).cast("string"), F.col("replicate").cast("string"), F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(key), 1, 10), 16, 10).cast("double") / float(1 << 40)
    import math

    draws, total = F.lit(0), 0.0
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        draws = draws + (u >= total).cast("int")
    return rows.withColumn("_d", draws).groupBy("replicate").agg(F.try_divide(F.sum(F.col("_d") * F.col("_s")), F.sum(F.col("_d") * F.col("_w"))).alias("mean"))
