"""Evaluation metrics and losses as one-pass aggregates over scored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwise.functions.columns import argmax0, sigmoid

TASK_WEIGHTS_FOCAL = {"purchase": 3.0, "churn": 2.5, "next_event": 3.0, "channel": 1.0,
                      "engagement": 1.5, "inactivity": 1.0, "action": 2.0, "period": 2.0}
TASK_WEIGHTS_BCE = {"purchase": 1.0, "churn": 1.0, "next_event": 0.5, "channel": 0.5,
                    "engagement": 0.1, "inactivity": 0.1, "action": 0.2, "period": 0.2}
FOCAL_ALPHA, FOCAL_GAMMA = 0.25, 2.0


def _acc(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0)) * F.lit(100.0)


def evaluate(scored: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """6 accuracies (%) and 2 MAEs; binary threshold sigmoid > 0.5."""
    def binary(p, y):
        return F.when(sigmoid(p) > 0.5, 1.0).otherwise(0.0) == F.col(y)

    aggs = [
        F.count(F.lit(1)).alias("n"),
        _acc(binary("p_purchase", "target_purchase")).alias("purchase_acc"),
        _acc(binary("p_churn", "target_churn")).alias("churn_acc"),
        _acc(argmax0("p_next_event") == F.col("target_next_event")).alias("next_event_acc"),
        _acc(argmax0("p_channel") == F.col("target_channel")).alias("channel_acc"),
        _acc(argmax0("p_action") == F.col("target_recommended_action")).alias("action_acc"),
        _acc(argmax0("p_active_period") == F.col("target_active_period")).alias("period_acc"),
        F.avg(F.abs(F.col("p_engagement") - F.col("target_engagement"))).alias("engagement_mae"),
        F.avg(F.abs(F.col("p_inactivity") - F.col("target_inactivity"))).alias("inactivity_mae"),
    ]
    g = scored.groupBy(*group_by) if group_by else scored
    out = g.agg(*aggs)
    fill = {c: 0.0 for c in ["purchase_acc", "churn_acc", "next_event_acc", "channel_acc",
                             "action_acc", "period_acc", "engagement_mae", "inactivity_mae"]}
    return out.fillna(fill)


def composite_score(metrics: DataFrame) -> DataFrame:
    """Validation score (lower is better); churn and channel are not included."""
    s = (F.lit(0.3) * (100 - F.col("next_event_acc")) / 100
         + F.lit(0.2) * (100 - F.col("purchase_acc")) / 100
         + F.lit(0.15) * (100 - F.col("period_acc")) / 100
         + F.lit(0.15) * (100 - F.col("action_acc")) / 100
         + F.lit(0.1) * F.col("engagement_mae") + F.lit(0.1) * F.col("inactivity_mae"))
    return metrics.withColumn("val_score", s)


def bce_terms(x: str, y: str) -> Column:
    """Numerically stable binary cross-entropy with logits, per row."""
    xc, yc = F.col(x), F.col(y)
    return F.greatest(xc, F.lit(0.0)) - xc * yc + F.log1p(F.exp(-F.abs(xc)))


def focal_terms(x: str, y: str, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    bce = bce_terms(x, y)
    return F.lit(alpha) * F.pow(F.lit(1.0) - F.exp(-bce), F.lit(gamma)) * bce


def log_softmax_terms(logits: str, num_classes: int) -> list[Column]:
    """log p_c for c < C as plain (codegen) expressions of the array elements."""
    el = [F.col(logits)[c] for c in range(num_classes)]
    m = F.greatest(*el) if num_classes > 1 else el[0]
    lse = m + F.log(sum((F.exp(x - m) for x in el[1:]), F.exp(el[0] - m)))
    return [x - lse for x in el]


def class_weight_vector(target: str, num_classes: int) -> Column:
    """Aggregate expression: the clamped class weights as an array of C values
    (absent class -> 1.0; labels >= C count in the total only)."""
    counts = F.array(*[F.count_if(F.col(target) == c) for c in range(num_classes)])
    total = F.count(F.lit(1))
    return F.transform(counts, lambda n: F.when(n == 0, F.lit(1.0)).otherwise(
        F.least(F.greatest(total / (F.lit(float(num_classes)) * n), F.lit(0.1)), F.lit(10.0))))


# The loss expressions below are written as SQL text: the same plan as the
# DataFrame-function form, but one JVM parse per expression instead of
# thousands of driver round trips for ~100 aggregate columns.

def with_log_softmax(df: DataFrame, logits: str, num_classes: int, out: str) -> DataFrame:
    """Project log p_c once per row: max, then log-sum-exp, then the C terms,
    as separate columns so expression size stays linear in C."""
    el = [f"`{logits}`[{c}]" for c in range(num_classes)]
    mx = f"greatest({', '.join(el)})" if num_classes > 1 else el[0]
    lse = f"`{out}_m` + ln({' + '.join(f'exp({x} - `{out}_m`)' for x in el)})"
    terms = ", ".join(f"{x} - `{out}_lse`" for x in el)
    return (df.withColumn(f"{out}_m", F.expr(mx))
            .withColumn(f"{out}_lse", F.expr(lse))
            .withColumn(out, F.expr(f"array({terms})")))


def ce_partials(name: str, lp_col: str, target: str, num_classes: int) -> list[Column]:
    """Per-class partial sums of one pass: n_c, sum of -log p_y over rows of
    class c, and sum of log p_c over all rows (``lp_col``: log-softmax array)."""
    out = []
    for c in range(num_classes):
        out.append(F.expr(f"count_if(`{target}` = {c})").alias(f"_{name}_n{c}"))
        out.append(F.expr(f"sum(CASE WHEN `{target}` = {c} THEN -`{lp_col}`[{c}] END)").alias(f"_{name}_nll{c}"))
        out.append(F.expr(f"sum(`{lp_col}`[{c}])").alias(f"_{name}_lp{c}"))
    return out


def ce_from_partials(name: str, num_classes: int, smoothing: float, weighted: bool) -> Column:
    """PyTorch mean CE with class weights and label smoothing from the partials:
    (1-e) * sum_c w_c NLL_c / sum_c w_c n_c + e/C * (-sum_c w_c LP_c) / sum_c w_c n_c,
    with w_c = clamp(N / (C n_c), 0.1, 10), 1.0 for an absent class."""
    C = num_classes
    n = [f"_{name}_n{c}" for c in range(C)]
    if weighted:
        w = [f"(CASE WHEN {x} = 0 THEN 1.0D ELSE least(greatest(_n / ({float(C)}D * {x}), 0.1D), 10.0D) END)"
             for x in n]
    else:
        w = ["1.0D"] * C
    sw = " + ".join(f"{w[c]} * {n[c]}" for c in range(C))
    nll = " + ".join(f"{w[c]} * coalesce(_{name}_nll{c}, 0.0D)" for c in range(C))
    smooth = " + ".join(f"{w[c]} * _{name}_lp{c}" for c in range(C))
    return F.expr(f"{1.0 - smoothing}D * ({nll}) / ({sw}) + {smoothing / C}D * (-({smooth})) / ({sw})")


def ce_loss_frame(df: DataFrame, logits: str, target: str, num_classes: int, smoothing: float = 0.0,
                  weighted: bool = False) -> DataFrame:
    """One-row frame with the loss of one head (class weights from the same rows)."""
    agg = with_log_softmax(df, logits, num_classes, "_lp").agg(
        F.count(F.lit(1)).alias("_n"), *ce_partials("h", "_lp", target, num_classes))
    return agg.select(ce_from_partials("h", num_classes, smoothing, weighted).alias("loss"))


HEADS = {  # name: (logits, target, classes, smoothing, weighted)
    "next_event": ("p_next_event", "target_next_event", 7, 0.1, True),
    "channel": ("p_channel", "target_channel", 3, 0.05, True),
    "action": ("p_action", "target_recommended_action", 20, 0.1, False),
    "period": ("p_active_period", "target_active_period", 4, 0.1, True),
}


def losses(scored: DataFrame) -> DataFrame:
    """All head losses of both training set-ups plus the two weighted totals,
    in ONE aggregate pass: class weights depend only on class counts, so the
    weighted sums are recombined from per-class partial sums afterwards."""
    aggs = [
        F.count(F.lit(1)).alias("_n"),
        F.avg(focal_terms("p_purchase", "target_purchase")).alias("focal_purchase"),
        F.avg(focal_terms("p_churn", "target_churn")).alias("focal_churn"),
        F.avg(bce_terms("p_purchase", "target_purchase")).alias("bce_purchase"),
        F.avg(bce_terms("p_churn", "target_churn")).alias("bce_churn"),
        F.avg(F.pow(F.col("p_engagement") - F.col("target_engagement"), 2)).alias("mse_engagement"),
        F.avg(F.pow(F.col("p_inactivity") - F.col("target_inactivity"), 2)).alias("mse_inactivity"),
    ]
    x = scored
    for h, (lg, t, c, _, _) in HEADS.items():
        x = with_log_softmax(x, lg, c, f"_lp_{h}")
        aggs += ce_partials(h, f"_lp_{h}", t, c)
    part = x.agg(*aggs)
    ce = []
    for h, (_, _, c, eps, weighted) in HEADS.items():
        ce.append(ce_from_partials(h, c, eps, weighted).alias(f"ce_{h}"))
        ce.append(ce_from_partials(h, c, 0.0, False).alias(f"ce_{h}_plain"))
    base = part.select("focal_purchase", "focal_churn", "bce_purchase", "bce_churn", "mse_engagement",
                       "mse_inactivity", *ce)
    fw, bw = TASK_WEIGHTS_FOCAL, TASK_WEIGHTS_BCE
    total_focal = (fw["purchase"] * F.col("focal_purchase") + fw["churn"] * F.col("focal_churn")
                   + fw["next_event"] * F.col("ce_next_event") + fw["channel"] * F.col("ce_channel")
                   + fw["engagement"] * F.col("mse_engagement") + fw["inactivity"] * F.col("mse_inactivity")
                   + fw["action"] * F.col("ce_action") + fw["period"] * F.col("ce_period"))
    total_bce = (bw["purchase"] * F.col("bce_purchase") + bw["churn"] * F.col("bce_churn")
                 + bw["next_event"] * F.col("ce_next_event_plain") + bw["channel"] * F.col("ce_channel_plain")
                 + bw["engagement"] * F.col("mse_engagement") + bw["inactivity"] * F.col("mse_inactivity")
                 + bw["action"] * F.col("ce_action_plain") + bw["period"] * F.col("ce_period_plain"))
    return base.select("*", total_focal.alias("total_focal"), total_bce.alias("total_bce"))
