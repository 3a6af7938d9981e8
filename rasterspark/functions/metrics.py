"""Segmentation metrics and losses as aggregate and ratio Columns, and a registry to pick them by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import IGNORE

CONFUSION = ("true_negative", "false_positive", "false_negative", "true_positive")
COUNTS = (*CONFUSION, "scored_pixel_count", "ignored_pixel_count", "covered_pixel_count")
RATIOS = ("accuracy", "precision", "recall", "f1", "iou", "background_iou", "macro_iou", "dice")


def confusion(truth: Column, mask: Column, ignore: int = IGNORE) -> list[Column]:
    """Counts over covered pixels; ignored pixels have the ignore label."""
    cells = {"true_negative": (0, 0), "false_positive": (0, 1), "false_negative": (1, 0), "true_positive": (1, 1)}
    out = [F.count_if((truth == t) & (mask == m)).alias(k) for k, (t, m) in cells.items()]
    return [*out, F.count_if(truth != ignore).alias("scored_pixel_count"), F.count_if(truth == ignore).alias("ignored_pixel_count"), F.count(F.lit(1)).alias("covered_pixel_count")]


def ratios() -> list[Column]:
    """The eight ratios of summed counts; null where a denominator is 0. Sum counts first, never average ratios."""
    tn, fp, fn, tp = (F.col(c) for c in CONFUSION)
    iou, background = F.try_divide(tp, tp + fp + fn), F.try_divide(tn, tn + fp + fn)
    f1 = F.try_divide(2 * tp, 2 * tp + fp + fn)
    values = (F.try_divide(tp + tn, tp + tn + fp + fn), F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), f1, iou, background, (iou + background) / 2, f1)
    return [v.alias(name) for name, v in zip(RATIOS, values, strict=True)]


def smoothed_bce(logit: Column, truth: Column, smoothing: float, ignore: int = IGNORE) -> Column:
    """Mean binary cross-entropy of logits with smoothed labels, ignored pixels left out."""
    y = truth * (1.0 - smoothing) + smoothing / 2
    loss = F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))
    return F.avg(F.when(truth != ignore, loss))


def smoothed_nll(log_probs: Column, truth: Column, smoothing: float, ignore: int = IGNORE) -> Column:
    """Mean multiclass cross-entropy of log probabilities with smoothed labels."""
    picked = F.try_element_at(log_probs, truth + 1)
    mean = F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / F.size(log_probs)
    return F.avg(F.when(truth != ignore, -(1 - smoothing) * picked - smoothing * mean))


def plain_accuracy(truth: Column, mask: Column) -> Column:
    return F.try_divide(F.count_if((truth == mask) & (truth != IGNORE)), F.count_if(truth != IGNORE))


def log_softmax(logits: Column) -> Column:
    """Log probabilities of an array of logits, its greatest taken off first."""
    def shifted(z):
        total = F.log(F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x)))
        return F.element_at(F.transform(F.array(total), lambda t: F.transform(z, lambda x: x - t)), 1)

    off = F.transform(F.array(F.array_max(logits)), lambda m: F.transform(logits, lambda x: x.cast("double") - m))
    return F.element_at(F.transform(off, shifted), 1)


def focal(logit: Column, truth: Column, gamma: float = 2.0, ignore: int = IGNORE) -> Column:
    """Mean binary focal loss: cross-entropy weighed by the power gamma of what the right class lacks."""
    loss = F.greatest(logit, F.lit(0.0)) - logit * truth + F.log1p(F.exp(-F.abs(logit)))
    return F.avg(F.when(truth != ignore, F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss))


def overlap_loss(logit: Column, truth: Column, false_positive: float, false_negative: float, ignore: int = IGNORE) -> Column:
    """1 - I / (I + a * false positives + b * false negatives) of soft counts, 0 where no pixel is true."""
    p = F.when(truth != ignore, 1 / (1 + F.exp(-logit)))
    hit, given, true = F.sum(p * truth), F.sum(p), F.sum(F.when(truth != ignore, truth))
    below = hit + false_positive * (given - hit) + false_negative * (true - hit)
    return F.when(true > 0, 1 - F.try_divide(hit, F.greatest(below, F.lit(1e-7)))).otherwise(0.0)


def lovasz_hinge(rows, keys: list[str], logit: str, truth: str, ignore: int = IGNORE):
    """keys and loss: the Lovasz hinge of each group of rows (an image): errors in falling order, each weighed by what it
    takes off the Jaccard index of the truth."""
    from pyspark.sql import Window

    sign = 2.0 * F.col(truth) - 1.0
    known = rows.where(F.col(truth) != ignore).withColumn("_e", 1.0 - F.col(logit) * sign)
    order = Window.partitionBy(*keys).orderBy(F.desc("_e"), F.desc(truth))
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    known = known.withColumns({"_hit": F.sum(truth).over(upto), "_k": F.row_number().over(order), "_true": F.sum(truth).over(whole)})
    # of the k largest errors `hit` are true: intersection true - hit, union true + k - hit
    jaccard = 1.0 - (F.col("_true") - F.col("_hit")) / (F.col("_true") + F.col("_k") - F.col("_hit"))
    known = known.withColumn("_j", jaccard)
    step = F.col("_j") - F.coalesce(F.lag("_j").over(order), F.lit(0.0))
    return known.withColumn("_l", F.greatest(F.col("_e"), F.lit(0.0)) * step).groupBy(*keys).agg(F.sum("_l").alias("loss"))


#: Losses and metrics by name: each takes (prediction, truth, **options) and returns an aggregate. Predictions are logits:
#: a number, or an array of one for each class for cross_entropy.
REGISTRY = {
    "bce": lambda p, t, smoothing=0.0: smoothed_bce(p, t, smoothing),
    "cross_entropy": lambda p, t, smoothing=0.0: smoothed_nll(log_softmax(p), t, smoothing),
    "focal": lambda p, t, gamma=2.0: focal(p, t, gamma),
    "dice": lambda p, t: overlap_loss(p, t, 0.5, 0.5),
    "jaccard": lambda p, t: overlap_loss(p, t, 1.0, 1.0),
    "tversky": lambda p, t, alpha=0.5, beta=0.5: overlap_loss(p, t, alpha, beta),
    "focal_dice": lambda p, t, gamma=2.0: focal(p, t, gamma) + overlap_loss(p, t, 0.5, 0.5),
    "accuracy": lambda p, t: plain_accuracy(t, p),
}


def by_name(name: str):
    if name not in REGISTRY:
        raise KeyError(f"{name!r} is none of {sorted(REGISTRY)}")
    return REGISTRY[name]
