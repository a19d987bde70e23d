"""Classification metrics from (actual, predicted) counts.

Everything past the first group-by works on at most labels x labels rows per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voucherflow.functions.literals import fixed_table


def pair_counts(pred: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    return pred.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_counts(pairs: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """tp, predicted and support per label over the union of true and predicted labels."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), hit.alias("tp")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("tp")))
    return pairs.select(*by, F.explode(sides).alias("e")).select(*by, "e.*").groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "guessed", "tp")])


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class(pairs: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    c = F.col
    return class_counts(pairs, by).select(
        *by, "label", _ratio(c("tp"), c("guessed")).alias("precision"), _ratio(c("tp"), c("support")).alias("recall"),
        _ratio(2 * c("tp"), c("guessed") + c("support")).alias("f1"), "support")


def overall(pairs: DataFrame, by: tuple[str, ...] = ("model",), trained: list[str] | None = None) -> DataFrame:
    """Accuracy and F1 averages.

    Three macro conventions side by side: labels seen on either side, labels present
    in the truth, and (when given) every trained label whether or not it occurs.
    """
    c = F.col
    classes = per_class(pairs, by)
    aggs = [F.sum("support").alias("n_samples"), F.avg("f1").alias("macro_f1_union"),
            F.avg(F.when(c("support") > 0, c("f1"))).alias("macro_f1_present"),
            (F.sum(c("f1") * c("support")) / F.sum("support")).alias("weighted_f1"),
            F.count_if(c("support") > 0).alias("classes_in_truth"),
            F.count_if((c("support") > 0) & (c("recall") >= 0.8)).alias("classes_recall_ge_0_8"),
            F.count_if((c("support") > 0) & (c("recall") == 0)).alias("classes_recall_eq_0"),
            F.sum(c("recall") * c("support")).alias("hits")]
    if trained:
        aggs.append((F.sum(F.when(c("label").isin(*trained), c("f1")).otherwise(0.0)) / len(trained)).alias("macro_f1_trained"))
    out = classes.groupBy(*by).agg(*aggs)
    return out.withColumn("correct", F.round("hits").cast("bigint")).withColumn("accuracy", c("correct") / c("n_samples")).drop("hits")


def confusion(pairs: DataFrame, labels: list[str], model: str) -> DataFrame:
    """Square table over a fixed label list, zeros filled."""
    names = fixed_table(pairs.sparkSession, "actual", [(x,) for x in labels])
    counts = pairs.filter(F.col("model") == model).groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
    return names.join(counts, "actual", "left").na.fill(0)


def agreement(pairs: DataFrame) -> DataFrame:
    """Observed and chance agreement of two label columns and Cohen's kappa, from pair counts."""
    c = F.col
    sides = class_counts(pairs, ()).withColumn("total", F.sum("support").over(W.partitionBy(F.lit(1))))
    sums = sides.agg(F.sum("tp").alias("agree"), F.sum("support").alias("n"),
                     F.sum(c("support").cast("double") / c("total") * (c("guessed").cast("double") / c("total"))).alias("chance"))
    return sums.select("n", "agree", (c("agree") / c("n")).alias("observed"), "chance",
                       ((c("agree") / c("n") - c("chance")) / (1 - c("chance"))).alias("kappa"))


def class_agreement(pairs: DataFrame) -> DataFrame:
    """Per label: observed and chance agreement of 'this label or not', and its kappa (null where chance alone gives full agreement)."""
    c = F.col
    sides = class_counts(pairs, ()).withColumn("total", F.sum("support").over(W.partitionBy(F.lit(1))))     # one row for each label
    p, q = c("support").cast("double") / c("total"), c("guessed").cast("double") / c("total")
    observed = 1.0 - (c("support") + c("guessed") - 2 * c("tp")).cast("double") / c("total")
    chance = p * q + (1.0 - p) * (1.0 - q)
    return sides.select("label", c("total").alias("n"), "tp", observed.alias("observed"), chance.alias("chance"), F.when(chance < 1.0, (observed - chance) / (1.0 - chance)).alias("kappa"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds of a proportion."""
    p, zz = hits / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return centre - half, centre + half


def calibration_bins(rows: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """Rows, mean score and accuracy per score bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("mean_score"),
                                            F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))


def calibration_error(rows: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    c = F.col
    return calibration_bins(rows, score, bins).agg(
        (F.sum(c("n_rows") * F.abs(c("mean_score") - c("accuracy"))) / F.sum("n_rows")).alias("ece"))
