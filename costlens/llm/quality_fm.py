"""Quality classifier: a factorisation machine over words, structure and metadata.

Every pair of features interacts through the product of low-rank factors.  By
``sum_i<j <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2`` a text
is scored in time linear in its distinct features.

Features are hashed words, statistics of the text's structure, and its recorded
length; label, language, source and id never are.  The machine is fitted on at most
``TRAIN_ROWS`` labelled rows of each class (the smallest hashes of the ids), weighted
back to the classes' shares, and scores every text whole.

Defined results: null and empty texts have no words and get the score of their empty
features; a missing length counts as the text's own; rows without id are not held
out; repeated rows get equal scores; without labels of both classes every score is
the smoothed share of good labels; an empty table gives no rows; only the named
columns are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_FEATURES = 2**12
RANK = 8
TRAIN_ROWS = 2500
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 250, 0.05, 1e-4, 7
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))
_MARK = np.isin(_BYTES, list(b"!?"))
_BREAK = _BYTES == 10
STRUCTURE = 14


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def features(text: str, recorded: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's non-zero word features, and its structure."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    letters = max(int(count[_UPPER].sum() + count[_LOWER].sum()), 1)
    hashes = np.fromiter(map(crc32, words), np.uint32, n)
    buckets = np.bincount(hashes % WORD_FEATURES)
    places = np.flatnonzero(buckets)
    values = np.log1p(buckets[places])
    values = values / max(float(np.sqrt((values**2).sum())), 1e-9)
    distinct, repeats = np.unique(hashes, return_counts=True) if n else (hashes, np.zeros(1))
    pairs = hashes[:-1].astype(np.uint64) << np.uint64(32) | hashes[1:]
    lines = [x for x in data.split(b"\n") if x.strip()]
    structure = np.array(
        [
            np.log1p(n),
            np.log1p(len(text) if recorded is None else max(recorded, 0)),
            len(data) / max(n, 1),
            count[_UPPER].sum() / letters,
            count[_DIGIT].sum() / size,
            count[_SYMBOL].sum() / size,
            count[_MARK].sum() / size,
            count[_BREAK].sum() / max(n, 1),
            len(distinct) / max(n, 1),
            repeats.max() / max(n, 1),
            len(np.unique(pairs)) / max(len(pairs), 1),
            len(set(lines)) / max(len(lines), 1),
            count[128:].sum() / size,
            float(n < 10),
        ]
    )
    return places, np.concatenate([values, structure])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        """Probability of a good text, in time linear in its features."""
        at = np.concatenate([places, WORD_FEATURES + np.arange(STRUCTURE)])
        x = values.copy()
        x[-STRUCTURE:] = np.clip((x[-STRUCTURE:] - self.mean) / self.scale, -4, 4)
        v = self.factors[at]
        inner = x @ v
        pairs = 0.5 * float((inner**2).sum() - ((v**2).sum(1) * x**2).sum())
        z = self.bias + float(x @ self.weights[at]) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray) -> Machine:
    """Adagrad on the weighted logistic loss."""
    dims = WORD_FEATURES + STRUCTURE
    share = float((weights * labels).sum() + 1) / float(weights.sum() + 2)
    machine = Machine(
        float(np.log(share / (1 - share))), np.zeros(dims), np.zeros((dims, RANK)), np.zeros(STRUCTURE), np.ones(STRUCTURE)
    )
    if len(set(labels.tolist())) < 2:
        return machine
    dense = np.stack([values[-STRUCTURE:] for _, values in rows])
    machine.mean, machine.scale = dense.mean(0), dense.std(0) + 1e-6
    x = np.zeros((len(rows), dims), np.float32)
    for i, (places, values) in enumerate(rows):
        x[i, places] = values[:-STRUCTURE]
    x[:, WORD_FEATURES:] = np.clip((dense - machine.mean) / machine.scale, -4, 4)
    random = np.random.default_rng(SEED)
    v = random.normal(0, 0.01, (dims, RANK)).astype(np.float32)
    w, b = np.zeros(dims, np.float32), np.float32(machine.bias)
    gv, gw, gb = np.full_like(v, 1e-6), np.full_like(w, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            some = order[start : start + BATCH]
            xs = x[some]
            inner = xs @ v
            squares = xs**2
            z = b + xs @ w + 0.5 * ((inner**2).sum(1) - squares @ (v**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * weights[some]
            error = (error / weights[some].sum()).astype(np.float32)
            dw = xs.T @ error + DECAY * w
            dv = xs.T @ (error[:, None] * inner) - (squares.T @ error)[:, None] * v + DECAY * v
            db = float(error.sum())
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, b = w - RATE * dw / np.sqrt(gw), v - RATE * dv / np.sqrt(gv), b - RATE * db / np.sqrt(gb)
    machine.bias, machine.weights, machine.factors = float(b), w.astype(float), v.astype(float)
    return machine


def _texts(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    length = F.col(length_col).cast("long") if length_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), length.alias("length"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = "n_chars",
    label_col: str = "quality",
) -> Machine:
    """A machine fitted on a bounded sample of the labelled documents that aren't held out."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picks = [
        usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
        for label in (0, 1)
    ]
    sample = F.broadcast(picks[0].union(picks[1]))  # 2 * TRAIN_ROWS rows at most
    texts = _texts(docs, id_col, text_col, length_col).join(sample, "doc_id")

    def each(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [features(r["text"] or "", r["length"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["doc_id"] for r in rows], pa.int64()),
                    pa.array([r["label"] for r in rows], pa.int32()),
                    pa.array([p for p, _ in found], pa.list_(pa.int32())),
                    pa.array([x for _, x in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "label", "places", "values"],
            )

    found = texts.mapInArrow(each, "doc_id bigint, label int, places array<int>, values array<double>")
    rows = sorted(found.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["label"], r["values"]))
    y = np.array([r["label"] for r in rows], np.float32)
    used = {label: max(int((y == label).sum()), 1) for label in (0, 1)}
    weight = np.array([known.get(r["label"], 0) / used[r["label"]] for r in rows], np.float32)
    return fit([(np.array(r["places"], np.int64), np.array(r["values"])) for r in rows], y, weight)


def score(
    docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """Per document its score and whether it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # WORD_FEATURES * (RANK + 1) numbers

    def each(batches):
        model = shared.value
        for batch in batches:
            ids, texts, lengths = batch.columns
            scores = [
                model.score(*features(t.as_py() or "", n.as_py())) for t, n in zip(texts, lengths, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = _texts(docs, id_col, text_col, length_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(each, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
