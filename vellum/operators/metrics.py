"""Error rates of predictions, with and without masks, and character confusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.distance import bit_distance, edit_counts, edit_distance, masked_distance
from vellum.functions.text import tokens
from vellum.operators.ranking import CELL, before_cells, in_cells, numbered, same


class UnequalSides(ValueError):
    """Predictions and ground truths do not pair up."""


def paired(pred: DataFrame, gt: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Predictions with their ground truths by key; check: each row must have its counterpart."""
    if not check:
        return pred.join(gt, list(keys))
    both = pred.withColumn("_p", F.lit(True)).join(gt.withColumn("_g", F.lit(True)), list(keys), "full")
    return both.filter(F.when(F.col("_p").isNull() | F.col("_g").isNull(), F.raise_error(F.lit("a prediction or a ground truth has no counterpart"))).otherwise(True)).drop("_p", "_g")


def rate(errors: Column, total: Column) -> Column:
    """errors / total; null for an empty total."""
    return F.when(total > 0, errors / total)


def scored(df: DataFrame, pred: str = "pred", gt: str = "gt", words: bool = True) -> DataFrame:
    """Adds char_errors, gt_chars and cer; with words also word_errors, gt_words and wer."""
    df = df.withColumn("char_errors", edit_distance(F.col(pred), F.col(gt)).cast("long")).withColumn("gt_chars", F.length(gt).cast("long")).withColumn("cer", rate(F.col("char_errors"), F.col("gt_chars")))
    if words:
        df = df.withColumn("word_errors", bit_distance(tokens(F.col(pred)), tokens(F.col(gt)))).withColumn("gt_words", F.size(tokens(F.col(gt))).cast("long")).withColumn("wer", F.when(F.col("gt_chars") > 0, rate(F.col("word_errors"), F.col("gt_words"))))
    return df


def error_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of scored() rows: n, cer, ler (share of lines with errors), wer as means over lines, and micro averages over characters and words.

    Lines with an empty ground truth count in n_empty, not in the means.
    """
    aggs = [F.count("cer").alias("n"), F.count_if(F.col("cer").isNull()).alias("n_empty"), F.avg("cer").alias("cer"), F.avg(F.when(F.col("cer").isNotNull(), (F.col("char_errors") > 0).cast("double"))).alias("ler"), rate(F.sum("char_errors"), F.sum("gt_chars")).alias("cer_micro")]
    if "wer" in df.columns:
        aggs += [F.avg("wer").alias("wer"), rate(F.sum("word_errors"), F.sum("gt_words")).alias("wer_micro")]
    return df.groupBy(*by).agg(*aggs)


def batched(df: DataFrame, key: str, order: Sequence[str], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over batches of `size` rows, in order of the integer key and then `order`, of the batches' mean cer; the last batch may be small."""
    means = numbered(df, "_place", key, order, by).withColumn("batch", F.floor((F.col("_place") - 1) / size)).groupBy(*by, "batch").agg(F.avg("cer").alias("cer"))
    return means.groupBy(*by).agg(F.count(F.lit(1)).alias("n_batches"), F.avg("cer").alias("cer_batched"))


def mask_scored(df: DataFrame, pred: str = "pred", gt: str = "gt", masks: str = "masks") -> DataFrame:
    """scored() without words, and masked_errors: errors outside the masks of the ground truth."""
    return scored(df, pred, gt, words=False).withColumn("masked_errors", masked_distance(F.col(pred), F.col(gt), F.col(masks)))


def mask_rates(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of mask_scored() rows: mer (mean rate outside the masks) and mask_share (part of all errors that lies in masks)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("cer"), F.avg(rate(F.col("masked_errors"), F.col("gt_chars"))).alias("mer"), rate(F.sum("char_errors") - F.sum("masked_errors"), F.sum("char_errors")).alias("mask_share"))


def confusions(df: DataFrame, pred: str = "pred", gt: str = "gt", by: Sequence[str] = (), alphabet: str | None = None) -> DataFrame:
    """(by..., gt_char, pred_char, n, share): aligned characters, null for a missing side; share is of the gt_char's row.

    Characters outside the alphabet, if one is given, are not counted.  The table is sparse; pivot it last.  A line's pairs are counted before they leave its row.
    """
    rows = df.select(*by, F.explode(edit_counts(F.col(gt), F.col(pred))).alias("e")).select(*by, F.col("e.gt").alias("gt_char"), F.col("e.pred").alias("pred_char"), F.col("e.n").alias("n"))
    if alphabet is not None:
        known = list(alphabet)
        rows = rows.filter((F.col("gt_char").isNull() | F.col("gt_char").isin(known)) & (F.col("pred_char").isNull() | F.col("pred_char").isin(known)))
    counts = rows.groupBy(*by, "gt_char", "pred_char").agg(F.sum("n").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "gt_char")))


def mean_confusions(df: DataFrame, batch: str, pred: str = "pred", gt: str = "gt") -> DataFrame:
    """(gt_char, pred_char, share): the mean over batches of their row shares; an absent pair counts as 0."""
    shares = confusions(df, pred, gt, [batch])
    batches = df.select(F.count_distinct(batch)).scalar()
    return shares.groupBy("gt_char", "pred_char").agg((F.sum("share") / batches).alias("share"))


def epoch_losses(log: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """(epoch, n, loss): the mean loss of each epoch's batches; nulls do not count."""
    return log.groupBy(epoch).agg(F.count(loss).alias("n"), F.avg(loss).alias("loss"))


def epochs(log: DataFrame, by: Sequence[str] = (), epoch: str = "epoch", metric: str = "cer", patience: int = 50, rows: int | None = None, later: bool = False, worst: float | None = None) -> DataFrame:
    """A training log with the best value so far, its epoch, the epochs since and whether patience has run out; null values are never the best.

    later: of equal values the last epoch is the best one, else the first.  worst: larger values are never the best.
    A log of more than `rows` rows (ranking.ROWS) is cut into cells, whose own minima meet those of the cells before.
    """
    at = -F.col(epoch) if later else F.col(epoch)
    counts = F.col(metric).isNotNull() if worst is None else F.col(metric) <= worst
    value = F.when(counts, F.struct(F.col(metric).alias("value"), at.alias("at")))
    cut = in_cells(log, by, [epoch], rows)
    keys = [*by, CELL] if cut is not None else list(by)
    own = F.min(value).over(Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0))
    if cut is None:
        best = log.withColumn("_best", own)
    else:
        cells = before_cells(cut.groupBy(*keys).agg(F.min(value).alias("_least")), by, {"_before": F.min("_least")}).drop("_least")
        best = same(cut.withColumn("_own", own), cells, keys).withColumn("_best", F.least("_own", "_before")).drop(CELL, "_own", "_before")
    best = best.withColumns({f"best_{metric}": F.col("_best.value"), "best_epoch": -F.col("_best.at") if later else F.col("_best.at")}).drop("_best")
    return best.withColumn("since_best", F.col(epoch) - F.col("best_epoch")).withColumn("stop", F.col("since_best") >= patience)


def training(log: DataFrame, by: Sequence[str] = (), epoch: str = "epoch", metric: str = "cer", lr: float = 1e-3, max_epoch: Column | None = None, patience: int = 50, rows: int | None = None) -> DataFrame:
    """A log of epochs from 0 as a training run would have seen it: epochs() with the last best one on ties and 1 as the value to beat, lr, and `ran`.

    lr falls to a tenth at half and at three quarters of the epochs planned (max_epoch, a column; by default as many as the log has).  A run ends with the first epoch whose
    distance from the best one, or from -1 while there is none, is over the patience; ran is false for the epochs after it.
    """
    seen = log.groupBy(*by).agg(F.count(F.lit(1)).alias("_planned"))
    out = epochs(log, by, epoch, metric, patience, rows, later=True, worst=1.0).withColumn("best_epoch", F.coalesce("best_epoch", F.lit(-1)))
    out = out.withColumns({f"best_{metric}": F.coalesce(f"best_{metric}", F.lit(1.0)), "since_best": F.col(epoch) - F.col("best_epoch")}).withColumn("stop", F.col("since_best") > patience)
    ends = out.filter("stop").groupBy(*by).agg(F.min(epoch).alias("_end"))
    out = same(same(out, seen, by), ends, by, "left")
    planned = F.col("_planned") if max_epoch is None else max_epoch
    passed = sum((F.col(epoch) >= F.floor(planned * part)).cast("int") for part in (0.5, 0.75))
    out = out.withColumns({"lr": F.lit(lr) * F.pow(F.lit(0.1), passed), "ran": F.col("_end").isNull() | (F.col(epoch) <= F.col("_end"))})
    return out.drop("_planned", "_end")
