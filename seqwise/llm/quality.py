"""Quality classifier: a factorisation machine over hashed words, structure
statistics and the text's length.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pair
term is computed in linear time: half of (sum v_i x_i)^2 - sum (v_i x_i)^2.
Features: the words of the whole text, hashed into ``WORD_SLOTS`` slots and
scaled to unit length; per structure statistic one slot out of ``BINS``.
Labels, language, source and id are never features.

Fitting: on at most ``MAX_TRAIN_ROWS`` labelled rows (the first by hash of the
id, documented bound), features once extracted into the shared folder. The rows
lie in ``SHARDS`` fixed shards; in each round every shard trains from the
common model in a task of its own and the driver averages the shard models
(fixed size, ``PARAMS`` numbers). Scoring is one pass over whole texts in
place, without a shuffle, with the model broadcast at its fixed size.

Defined results: null and empty texts are scored (no words, all-zero
statistics); null ids count as the empty text for hold-out; labels other than
0 and 1 and labels of unknown documents are ignored, repeated labels all count;
with no usable label of either kind every score is ``NO_LABELS_SCORE``;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwise.llm.common import small_batches, write_once
from seqwise.llm.words import shingles, word_hashes, word_spans

WORD_SLOTS = 1 << 13
BINS = 16
STATISTICS = ["upper", "symbols", "digits", "other", "word_length", "word_length_spread", "distinct_words",
              "distinct_triples", "line_words", "repeated_lines", "marks", "ends", "length", "longest_run"]
SLOTS = WORD_SLOTS + BINS * len(STATISTICS)
FACTORS = 8
PARAMS = 1 + SLOTS * (1 + FACTORS)

MAX_TRAIN_ROWS = 20_000
SHARDS, ROUNDS, EPOCHS = 6, 3, 2
RATE, DECAY, BATCH = 0.05, 1e-5, 32
HOLD_OUT = 5
THRESHOLD = 0.3
NO_LABELS_SCORE = 0.5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def statistics(text: bytes, words: np.ndarray) -> np.ndarray:
    """The structure statistics of a whole text, each between 0 and 1."""
    raw = np.frombuffer(text, dtype=np.uint8)
    n, m = len(raw), len(words)
    if not m:
        return np.zeros(len(STATISTICS))
    count = np.bincount(raw, minlength=256)
    letters = max(int(count[65:91].sum() + count[97:123].sum()), 1)
    starts, ends = word_spans(raw)
    sizes = ends - starts
    marks = int(count[[33, 63]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.unique(words, return_counts=True)[1]
    triples = shingles(words, 3)
    runs = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
    last = raw[ends - 1]
    symbols = int(count[[35, 36, 37, 38, 42, 60, 62, 124, 64, 94, 95, 126, 123, 125]].sum())
    return np.clip([
        count[65:91].sum() / letters, 4 * symbols / n, 4 * count[48:58].sum() / n, count[128:].sum() / n,
        sizes.mean() / 16, sizes.std() / 16, len(counts) / m, len(np.unique(triples)) / len(triples),
        m / len(lines) / 64, 1 - len(set(lines)) / len(lines), 8 * marks / m,
        4 * np.isin(last, (33, 46, 63)).mean(), np.log2(n + 1) / 18, np.diff(runs).max() / 16,
    ], 0, 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text."""
    raw = (text or "").encode()
    words = word_hashes(raw)
    slots, counts = np.unique((words >> np.uint64(64 - 13)).astype(np.int64), return_counts=True)
    values = np.sqrt(counts)
    if len(values):
        values = values / np.sqrt((values ** 2).sum())
    bins = np.minimum((statistics(raw, words) * BINS).astype(np.int64), BINS - 1)
    extra = WORD_SLOTS + BINS * np.arange(len(STATISTICS)) + bins
    return np.concatenate([slots, extra]), np.concatenate([values, np.full(len(extra), 0.5)])


class Model:
    """w0, linear weights and factors, as one flat array."""

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = flat
        self.w = flat[1:1 + SLOTS]
        self.v = flat[1 + SLOTS:].reshape(SLOTS, FACTORS)

    @classmethod
    def start(cls, positive: float, seed: int = 7) -> Model:
        flat = np.zeros(PARAMS)
        flat[0] = np.log(positive / (1 - positive))
        flat[1 + SLOTS:] = np.random.default_rng(seed).normal(0, 0.05, SLOTS * FACTORS)
        return cls(flat)

    def margin(self, slots: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Linear-time value of the machine, and the factor sums."""
        vx = self.v[slots] * x[:, None]
        sums = vx.sum(axis=0)
        return self.flat[0] + self.w[slots] @ x + 0.5 * (sums @ sums - (vx * vx).sum()), sums

    def score(self, slots: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(slots, x)[0], -30, 30))))


def train(model: Model, rows: list, epochs: int, seed: int) -> Model:
    """Adagrad on the log loss, rows in a shuffled order fixed by ``seed``."""
    m = Model(model.flat.copy())
    g0, gw, gv = 1e-3, np.full(SLOTS, 1e-3), np.full((SLOTS, FACTORS), 1e-3)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, x, y = rows[i]
            z, sums = m.margin(slots, x)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            dw = d * x + DECAY * m.w[slots]
            dv = d * (x[:, None] * sums - m.v[slots] * (x * x)[:, None]) + DECAY * m.v[slots]
            g0 += d * d
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            m.flat[0] -= RATE * d / np.sqrt(g0)
            m.w[slots] -= RATE * dw / np.sqrt(gw[slots])
            m.v[slots] -= RATE * dv / np.sqrt(gv[slots])
    return m


def _featurize(batches):
    for b in batches:
        found = [features(t.as_py()) for t in b.column("_text")]
        yield pa.RecordBatch.from_arrays(
            [b.column("_shard"), b.column("_order"), b.column("_label"),
             pa.array([s for s, _ in found], pa.list_(pa.int64())),
             pa.array([x for _, x in found], pa.list_(pa.float64()))],
            names=["_shard", "_order", "_label", "slots", "x"])


def training_rows(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str,
                  max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled, not held-out documents with features.

    The bounded set of ids goes to the documents, not the texts to the labels."""
    order = F.md5(F.col(id_col).cast("string"))
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"),
                            order.alias("_order"))
              .where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
              .orderBy("_order", "_label").limit(max_rows))
    texts = small_batches(docs).select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select(
        F.pmod(F.xxhash64("_order"), F.lit(SHARDS)).cast("int").alias("_shard"), "_order", "_label", "_text")
    return write_once(rows.mapInArrow(
        _featurize, "_shard int, _order string, _label int, slots array<long>, x array<double>"), "train")


def _trainer(flat: np.ndarray, epochs: int, round_: int):
    def run(key, table):
        t = table.sort_by([("_order", "ascending"), ("_label", "ascending")])
        rows = [(np.asarray(s), np.asarray(x), y) for s, x, y in zip(
            (v.values.to_numpy() for v in t["slots"]), (v.values.to_numpy() for v in t["x"]),
            t["_label"].to_pylist(), strict=True)]
        shard = key[0].as_py()
        m = train(Model(flat), rows, epochs, seed=1000 * round_ + shard)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(rows)], pa.int64()),
                         "flat": pa.array([m.flat.tobytes()], pa.binary())})
    return run


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, rounds: int = ROUNDS) -> Model | None:
    """The fitted model; None without a usable label of each kind."""
    rows = training_rows(docs, labels, text_col, id_col, label_col, max_rows)
    n, good = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    if not n or not 0 < good < n:
        return None
    model = Model.start(good / n)
    for r in range(rounds):
        parts = rows.groupBy("_shard").applyInArrow(
            _trainer(model.flat, EPOCHS, r), "shard int, n long, flat binary").collect()  # SHARDS models
        parts.sort(key=lambda p: p.shard)
        weights = np.array([p.n for p in parts], dtype=float)
        model = Model(np.average([np.frombuffer(p.flat) for p in parts], axis=0, weights=weights))
    return model


def _scorer(shared):
    def run(batches):
        model = Model(shared.value) if shared else None
        for b in batches:
            names = [c for c in b.schema.names if c != "_text"]
            scores = [model.score(*features(t.as_py())) if model else NO_LABELS_SCORE for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(scores, pa.float64())],
                                             names=[*names, "_score"])
    return run


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text",
                    score_col: str = "score") -> DataFrame:
    """``docs`` plus its score, in one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model.flat) if model else None
    # carried under other names, so that no column of docs can clash
    slim = small_batches(docs).select(*[F.col(f"`{c}`").alias(f"_doc_{i}") for i, c in enumerate(docs.columns)],
                       F.col(text_col).alias("_text"))
    kept = ", ".join(f"{n} {t}" for n, t in slim.dtypes if n != "_text")
    out = slim.mapInArrow(_scorer(shared), f"{kept}, _score double")
    return out.select(*[F.col(f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)],
                      F.col("_score").alias(score_col))
