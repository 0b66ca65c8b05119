"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs cost linear time, as their sum is half of
|sum v_i x_i|^2 - sum |v_i x_i|^2. It is trained on the driver from a bounded sample of labelled rows and scores every whole
text on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordIds, mapped, released, staged, text_bytes

#: Most labelled rows and most of their features (8 bytes each) that are used for training, hash buckets of words, rank of the
#: interactions.
TRAIN_ROWS, TRAIN_FEATURES, BUCKETS, RANK = 6000, 8_000_000, 1 << 14, 8
ACCEPT = 0.3
EPOCHS, RATE, L2, SEED = 8, 0.08, 1e-5, 7
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 ASCII punctuation, 6 beyond ASCII
_CLASS[33:127] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
STATS = 16


def _stats(raw: bytes, words: list[bytes], n_chars: int) -> list[float]:
    """Structure of a text and its metadata (n_chars), each about 0 to 1."""
    n, count = max(1, len(raw)), max(1, len(words))
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7) / n if raw else np.zeros(7)
    letters = by[1] + by[2]
    repeats = sum(map(eq, words, words[1:])) / count
    lines = raw.split(b"\n")
    return [
        1.0, by[1] / letters if letters else 0.0, by[3], by[5], min(1.0, by[5] * 8), by[4], by[6],
        repeats, min(1.0, 4 * repeats), len(set(words)) / count, raw.count(b"|") / count, raw.count(b"!") / count,
        1 - len(set(lines)) / len(lines), min(1.0, n / count / 16), np.log1p(count) / 12, np.log1p(max(0, n_chars)) / 16,
    ]


def features(text: str | None, n_chars: int | None, ids: WordIds, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's features: STATS of structure, then hashed words with damped counts of norm 1. Without
    n_chars the text's own length counts."""
    raw = text_bytes(text)
    words = raw.translate(LOWER).split()
    stats = _stats(raw, words, len(text or "") if n_chars is None else n_chars)
    if not words:
        return np.arange(STATS), np.array(stats)
    w = np.array([ids[x] for x in words], np.uint64) & np.uint64(buckets - 1)
    index, n = np.unique(w.astype(np.int64), return_counts=True)
    value = np.log1p(n)
    value /= np.sqrt((value * value).sum())
    return np.concatenate([np.arange(STATS), index + STATS]), np.concatenate([stats, value])


@dataclass
class Machine:
    """bias, linear weights and factors of a factorisation machine."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray):
        """Scores before the sigmoid, and sums of v x, of rows that begin at `starts` in the joined features."""
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + pairs, total

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        z, _ = self.parts(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int = BUCKETS + STATS, rank: int = RANK, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """A machine by AdaGrad on the log loss, in an order that the seed fixes. Without rows of both labels every
    score is the labels' mean, or a half."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    mean = labels.mean() if len(labels) else 0.5
    if not len(labels) or mean in (0.0, 1.0):
        m.v[:] = 0
        m.bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
        return m
    m.bias = float(np.log(mean / (1 - mean)))
    gw, gv = np.full(size, 1e-2), np.full((size, rank), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 32):
            some = order[at : at + 32]
            lengths = np.array([len(rows[i][0]) for i in some])
            index, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            z, total = m.parts(index, value, np.cumsum(lengths) - lengths)
            error = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some), lengths)
            m.bias -= RATE * float(error @ (1 / np.repeat(lengths, lengths)))
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, error * value) + L2 * m.w[used]
            each = (error * value)[:, None] * (np.repeat(total, lengths, axis=0) - m.v[index] * value[:, None])
            dv = np.stack([np.bincount(back, each[:, f]) for f in range(m.v.shape[1])], 1) + L2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
    return m


def held_out():
    """Whether a row's labels are kept from training: crc32 of doc_id as text is 0 modulo 5; a null doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _inputs(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", "text", n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES) -> Machine:
    """A machine for the label, from the at most `most` labelled rows not held out whose hashed doc_id is smallest, as long as
    they have no more than most_features features together. Rows without a text of their own in docs, and labels other than 0 and 1,
    don't count; of several texts of one doc_id the one of the smallest hash does."""
    order = F.xxhash64("doc_id")
    chosen = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(order, "doc_id").limit(most)

    def start():
        ids = WordIds()

        def run(rows: dict[str, list]) -> dict[str, list]:
            f = [features(t, n, ids) for t, n in zip(rows["text"], rows["n_chars"])]
            return {"doc_id": rows["doc_id"], "label": rows["label"], "i": [i.astype(np.int32) for i, _ in f], "x": [x.astype(np.float32) for _, x in f]}

        return run

    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.struct(F.xxhash64("text", "n_chars").alias("h"), "text", "n_chars").alias("row"))  # at most `most` rows are sent
    rows = rows.groupBy("doc_id", "label").agg(F.min("row").alias("row")).select("doc_id", "label", "row.text", "row.n_chars")
    made = staged(mapped(rows, start, "doc_id long, label int, i array<int>, x array<float>"), "training")
    taken, left = [], most_features
    for r in made.select("doc_id", F.size("i").alias("k")).orderBy(order, "doc_id").collect():  # at most `most` rows
        left -= r["k"]
        if left < 0:
            break
        taken.append((r["doc_id"],))
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long")
    got = made.join(F.broadcast(ids), "doc_id").toArrow()
    released(made)
    got = got.take(np.argsort(np.array(got.column("doc_id")))) if got.num_rows else got
    f = [(np.array(i.values), np.array(x.values, np.float64)) for i, x in zip(got.column("i"), got.column("x"))]
    return fit(f, np.array(got.column("label"), np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with `score`: 0 to 1, higher where label 1 is likelier. Null and empty texts are scored by their structure.
    A column of this name is replaced; all others stay, and so do repeated rows."""
    schema = [f"`{c}` {t}" for c, t in docs.dtypes if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))  # fixed size: BUCKETS + STATS rows

    def start():
        bias, w, v = shared.value
        m, ids = Machine(bias, w.astype(np.float64), v.astype(np.float64)), WordIds()

        def run(rows: dict[str, list]) -> dict[str, list]:
            n = rows.get("n_chars") or [None] * len(rows["text"])
            out = m.scores([features(t, k, ids) for t, k in zip(rows["text"], n)])
            return rows | {"score": out}

        return run

    return mapped(docs.drop("score"), start, ", ".join([*schema, "score double"]), rows=64)


def quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) of every row of docs (doc_id, text and n_chars if it has it)."""
    out = score(_inputs(docs), train(docs, labels, most=most))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """docs without those that the classifier gives less than `least`."""
    return score(docs, train(docs, labels)).where(F.col("score") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
