"""The eight prediction heads fitted together, one pass over the rows a step.

One linear model with 38 outputs (2 logits, 7 + 3 + 20 + 4 class margins, 2
values) on the window features: 6 standardised numbers and one slot per level
of the last event's name, channel and hour. The loss is the weighted total of
``metrics.losses`` (focal binaries, class-weighted and smoothed cross-entropies,
squared errors), so ``total_focal`` of the fitted rows' predictions is the
loss that the fit reports.

A pass sums loss and gradient of all heads: every partition adds up its rows in
numpy and hands on one row per parameter, and Spark sums those by parameter
(a distributed sum, not one task). Only parameters reach the driver: their
number depends on the levels, not on the rows. Between passes the driver takes
an L-BFGS step; a step that does not lower the loss enough is halved. The
validation loss comes out of the same pass; after ``patience`` steps without a
new best the fit stops, and the best step's parameters are kept.

Counts of rows, levels and classes, means and deviations come from one
aggregate before. Class weights are those of the training rows.

Defined results: null features count as 0 (numbers) or as the level "other", as
do levels that training rows do not have; rows with a null target, or a class
outside its head's, add nothing to that head but smoothing, as in
``metrics.losses``; without training rows the fit raises; without validation
rows the training loss decides when to stop.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwise.operators.metrics import FOCAL_ALPHA, FOCAL_GAMMA, HEADS, TASK_WEIGHTS_FOCAL
from seqwise.operators.windows import LAST_EVENT_FEATURES, NUMERIC_FEATURES, TARGETS

BINARY = {"purchase": ("p_purchase", "target_purchase"), "churn": ("p_churn", "target_churn")}
VALUES = {"engagement": ("p_engagement", "target_engagement"), "inactivity": ("p_inactivity", "target_inactivity")}
MAX_LEVELS = 1_000  # of one level column: more would make the gradient rows wide
MEMORY = 8          # step pairs that L-BFGS remembers
LEAST_DROP = 1e-4   # of the predicted drop that a step has to reach


def output_slices() -> dict[str, slice]:
    """Head -> its columns among the outputs."""
    at, out = 0, {}
    for h, size in [*((h, 1) for h in BINARY), *((h, v[2]) for h, v in HEADS.items()), *((h, 1) for h in VALUES)]:
        out[h] = slice(at, at + size)
        at += size
    return out


OUTPUTS = output_slices()
N_OUT = max(s.stop for s in OUTPUTS.values())


@dataclass
class Design:
    """What a row's features and loss weights are computed with."""
    mean: np.ndarray
    scale: np.ndarray
    levels: list[list[int]]
    n: int                             # training rows
    counts: dict[str, np.ndarray]      # classes of each class head
    valid: dict[str, int]              # rows with a target, of the other heads

    @property
    def width(self) -> int:
        return 1 + len(self.mean) + sum(len(x) + 1 for x in self.levels)

    def class_weights(self, head: str) -> np.ndarray:
        n = self.counts[head].astype(float)
        if not HEADS[head][4]:
            return np.ones(len(n))
        return np.where(n == 0, 1.0, np.clip(self.n / (len(n) * np.maximum(n, 1)), 0.1, 10.0))

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows x width: intercept, standardised numbers, level slots."""
        x = np.zeros((batch.num_rows, self.width))
        x[:, 0] = 1.0
        for i, c in enumerate(NUMERIC_FEATURES):
            x[:, 1 + i] = (_numbers(batch, c, 0.0) - self.mean[i]) / self.scale[i]
        at, rows = 1 + len(self.mean), np.arange(batch.num_rows)
        for c, known in zip(LAST_EVENT_FEATURES, self.levels, strict=True):
            v, ids = _numbers(batch, c, np.nan), np.array(known, dtype=float)
            slot = np.minimum(np.searchsorted(ids, v), max(len(ids) - 1, 0))
            hit = ids[slot] == v if len(ids) else np.zeros(len(v), dtype=bool)
            x[rows, at + np.where(hit, slot + 1, 0)] = 1.0
            at += len(known) + 1
        return x


@dataclass
class JointModel:
    design: Design
    weights: np.ndarray                # width x outputs
    train_loss: float
    history: list[dict] = field(default_factory=list)  # step, train_loss, val_loss


def _numbers(batch: pa.RecordBatch, name: str, missing: float) -> np.ndarray:
    v = batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(np.isnan(v), missing, v)


def make_design(train: DataFrame) -> Design:
    """One aggregate: moments, levels, class counts."""
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC_FEATURES]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(x).alias(f"m{i}") for i, x in enumerate(zero)]
    aggs += [F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(zero)]
    aggs += [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(LAST_EVENT_FEATURES)]
    for h, (_, t, size, _, _) in HEADS.items():
        aggs += [F.count_if(F.col(t) == c).alias(f"{h}{c}") for c in range(size)]
    aggs += [F.count(t).alias(h) for h, (_, t) in [*BINARY.items(), *VALUES.items()]]
    r = train.agg(*aggs).first()
    if not r.n:
        raise ValueError("no training rows")
    levels = []
    for i, c in enumerate(LAST_EVENT_FEATURES):
        if r[f"d{i}"] > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
        levels.append(sorted(int(x[0]) for x in train.where(F.col(c).isNotNull()).select(c).distinct().collect()))
    scale = np.array([r[f"s{i}"] for i in range(len(zero))])
    return Design(np.array([r[f"m{i}"] for i in range(len(zero))]), np.where(scale > 0, scale, 1.0), levels, r.n,
                  {h: np.array([r[f"{h}{c}"] for c in range(v[2])]) for h, v in HEADS.items()},
                  {h: r[h] for h in [*BINARY, *VALUES]})


def head_terms(design: Design, head: str, z: np.ndarray, y: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Sum of a head's loss over rows, the sum of weights that divides it, and
    the gradient of the first by the outputs."""
    if head in HEADS:
        _, _, size, eps, _ = HEADS[head]
        w = design.class_weights(head)
        z = z - z.max(axis=1, keepdims=True)
        lp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        p = np.exp(lp)
        own = np.flatnonzero((y >= 0) & (y < size))
        cls = y[own].astype(int)
        loss = -(1 - eps) * (w[cls] * lp[own, cls]).sum() - eps / size * (lp @ w).sum()
        grad = eps / size * (p * w.sum() - w)
        grad[own] += (1 - eps) * w[cls][:, None] * p[own]
        grad[own, cls] -= (1 - eps) * w[cls]
        return loss, w[cls].sum(), grad
    known = ~np.isnan(y)
    z, t = z[:, 0], np.where(known, y, 0.0)
    if head in VALUES:
        off = np.where(known, z - t, 0.0)
        return (off ** 2).sum(), known.sum(), 2 * off[:, None]
    bce = np.maximum(z, 0) - z * t + np.log1p(np.exp(-np.abs(z)))
    miss = -np.expm1(-bce)             # one minus the probability of the target
    slope = miss ** FOCAL_GAMMA + FOCAL_GAMMA * miss ** (FOCAL_GAMMA - 1) * np.exp(-bce) * bce
    sigma = 0.5 * (1 + np.tanh(z / 2))
    loss = np.where(known, FOCAL_ALPHA * miss ** FOCAL_GAMMA * bce, 0.0).sum()
    return loss, known.sum(), np.where(known, FOCAL_ALPHA * slope * (sigma - t), 0.0)[:, None]


def _divisor(design: Design, head: str) -> float:
    if head in HEADS:
        return float((design.class_weights(head) * design.counts[head]).sum())
    return float(design.valid[head])


TARGET_OF = {h: v[1] for h, v in [*BINARY.items(), *HEADS.items(), *VALUES.items()]}


def _partials(design: Design, weights: np.ndarray):
    """Per partition one row (at, part) per parameter, after it the heads'
    training loss, validation loss and validation weight."""
    def run(batches):
        grad, extra, seen = np.zeros_like(weights), np.zeros((len(OUTPUTS), 3)), False
        for b in batches:
            if not b.num_rows:
                continue
            seen = True
            val = b.column("_val").to_numpy(zero_copy_only=False).astype(bool)
            x = design.matrix(b)
            z = x @ weights
            dz = np.zeros_like(z)
            for i, (head, cols) in enumerate(OUTPUTS.items()):
                y = _numbers(b, TARGET_OF[head], np.nan)
                loss, _, g = head_terms(design, head, z[~val][:, cols], y[~val])
                extra[i, 0] += loss
                scale = _divisor(design, head)
                dz[np.ix_(~val, np.arange(cols.start, cols.stop))] = \
                    g * (TASK_WEIGHTS_FOCAL[head] / scale if scale else 0.0)
                loss, total, _ = head_terms(design, head, z[val][:, cols], y[val])
                extra[i, 1:] += loss, total
            grad += x.T @ dz
        if seen:
            flat = np.concatenate([grad.ravel(), extra.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)],
                                             names=["at", "part"])
    return run


def one_pass(rows: DataFrame, design: Design, weights: np.ndarray) -> tuple[float, float | None, np.ndarray]:
    """(training loss, validation loss or None, gradient) of all heads."""
    size = weights.size + 3 * len(OUTPUTS)
    sums = rows.mapInArrow(_partials(design, weights), "at int, part double").groupBy("at").agg(F.sum("part").alias("s"))
    flat = np.zeros(size)
    for at, s in sums.collect():       # as many rows as parameters
        flat[at] = s
    extra = flat[weights.size:].reshape(-1, 3)
    train, val = 0.0, 0.0
    for i, head in enumerate(OUTPUTS):
        if (d := _divisor(design, head)):
            train += TASK_WEIGHTS_FOCAL[head] * extra[i, 0] / d
        if extra[i, 2]:
            val += TASK_WEIGHTS_FOCAL[head] * extra[i, 1] / extra[i, 2]
    return train, val if extra[:, 2].any() else None, flat[:weights.size].reshape(weights.shape)


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """L-BFGS: minus the gradient, scaled by the remembered curvature."""
    q, left = grad.copy(), []
    for s, y in reversed(pairs):
        a = (s * q).sum() / (s * y).sum()
        q -= a * y
        left.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s * y).sum() / (y * y).sum()
    for (s, y), a in zip(pairs, reversed(left), strict=True):
        q += s * (a - (y * q).sum() / (s * y).sum())
    return -q


def fit_jointly(rows: DataFrame, is_val: Column, steps: int = 50, patience: int = 7, reg: float = 1e-4) -> JointModel:
    """Fit all heads on the rows where ``is_val`` is false; ``reg`` times half
    the squared weights (without intercepts) is added to what is minimised, not
    to the losses reported."""
    rows = rows.select(*NUMERIC_FEATURES, *LAST_EVENT_FEATURES, *TARGETS, F.coalesce(is_val, F.lit(False)).alias("_val"))
    # Read once a step: computed once (memory and disk; recomputed from lineage
    # if an executor is lost) and released after the fit.
    rows = rows.persist()
    try:
        return _fit(rows, steps, patience, reg)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, steps: int, patience: int, reg: float) -> JointModel:
    design = make_design(rows.where(~F.col("_val")))
    shrink = np.full((design.width, 1), reg)
    shrink[0] = 0.0

    def at(w):
        train, val, grad = one_pass(rows, design, w)
        return train, val, train + 0.5 * float((shrink * w * w).sum()), grad + shrink * w
    w = np.zeros((design.width, N_OUT))
    train, val, goal, grad = at(w)
    history = [{"step": 0, "train_loss": train, "val_loss": val}]
    best, pairs, waited = (train if val is None else val, w, train), [], 0
    for step in range(1, steps + 1):
        d = _direction(grad, pairs)
        slope = float((d * grad).sum())
        if slope >= 0:                 # the focal losses are not convex
            d, pairs = -grad, []
            slope = -float((grad * grad).sum())
        length = 1.0 if pairs else min(1.0, 1.0 / max(float(np.sqrt((grad * grad).sum())), 1e-12))
        for _ in range(20):
            new = w + length * d
            train, val, reached, g = at(new)
            if reached <= goal + LEAST_DROP * length * slope:
                break
            length /= 2
        else:
            break                      # no lower loss in this direction
        s, y = new - w, g - grad
        if (s * y).sum() > 1e-12 * (y * y).sum():
            pairs = [*pairs, (s, y)][-MEMORY:]
        done = goal - reached <= 1e-9 * max(1.0, abs(goal))
        w, goal, grad = new, reached, g
        history.append({"step": step, "train_loss": train, "val_loss": val})
        score = train if val is None else val
        waited = 0 if score < best[0] else waited + 1
        if score < best[0]:
            best = (score, w, train)
        if done or waited >= patience:
            break
    return JointModel(design, best[1], best[2], history)


def predict_jointly(model: JointModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the eight raw outputs per row, as plain column expressions."""
    d, w = model.design, model.weights
    # Standardisation goes into the weights: w'x + b of the raw numbers.
    num = w[1:1 + len(d.mean)] / d.scale[:, None]
    base = w[0] - d.mean @ num
    # One lookup a level column: the weights of its level, of all outputs.
    at, looked = 1 + len(d.mean), []
    for c, known in zip(LAST_EVENT_FEATURES, d.levels, strict=True):
        tables = F.create_map(*[x for i, k in enumerate(known)
                                for x in (F.lit(k), F.lit([float(v) for v in w[at + 1 + i]]))]) if known else None
        other = F.lit([float(v) for v in w[at]])
        looked.append(F.coalesce(F.try_element_at(tables, F.col(c).cast("int")), other) if known else other)
        at += len(known) + 1
    x = df.select("*", *[v.alias(f"_level_{i}") for i, v in enumerate(looked)])

    def output(j: int) -> str:
        terms = [f"{float(base[j])!r}D"] + [f"{float(num[i, j])!r}D * coalesce(CAST({c} AS DOUBLE), 0D)"
                                     for i, c in enumerate(NUMERIC_FEATURES)]
        return " + ".join(terms + [f"_level_{i}[{j}]" for i in range(len(looked))])
    cols = []
    for h, s in OUTPUTS.items():
        name = (BINARY | VALUES)[h][0] if h not in HEADS else HEADS[h][0]
        each = [output(j) for j in range(s.start, s.stop)]
        cols.append(F.expr(f"array({', '.join(each)})" if h in HEADS else each[0]).alias(name))
    return x.select(*keep, *cols)
