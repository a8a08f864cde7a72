"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): pairwise interactions of low
rank in time linear in the features, by the sum-of-squares identity. Features of a text: its words and word shapes
hashed into a fixed number of slots (each kind with norm 1), structure statistics and text sizes in fixed bins.

The fit uses a bounded sample of labelled rows, SAMPLE at most: those with the least hash of the id. An id may have
several texts; of the sample's distinct (id, label, features) those with the least hashes are fitted, 2 * SAMPLE at
most. Both bounds go by hashes of the rows, not by their order: fitting is deterministic. Every row is scored, and
whole words and whole texts go into its features.

Defined results: null and empty texts get the score of a text without words; labels that are null are left out,
several labels of one id all count; without labels of both kinds the score is the share of label 1 (1 if there is
none at all); repeated rows each get a row, and equal texts equal scores; very long words are hashed whole; an empty
table gives an empty table; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, held_out

SAMPLE, SLOTS, RANK = 8_000, 1 << 16, 8
#: Longer words are not remembered, so that a cache of words stays small.
REMEMBER = 64
THRESHOLD = 0.7
_SHAPE = re.compile(r"(.)\1+", re.S)


def _hashed(kind: str, word: str) -> int:
    return zlib.crc32(f"{kind}{word}".encode()) % SLOTS


_slot = lru_cache(maxsize=10_000)(_hashed)  # of bins, which are few


def _of_word(word: str) -> tuple[int, int]:
    """Slots of a word and of its shape: letters by case, digits, other characters themselves; runs once."""
    shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _hashed("w", word), _hashed("s", _SHAPE.sub(r"\1", shape))


_of_short = lru_cache(maxsize=200_000)(_of_word)


def _word(word: str) -> tuple[int, int]:
    return _of_short(word) if len(word) <= REMEMBER else _of_word(word)


def _bins(name: str, value: float, steps: int, top: float) -> int:
    return _slot("b", f"{name}{min(steps, int(value / top * steps)) if value > 0 else -1}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values."""
    text = text or ""
    words = Counter(text.split())
    total = sum(words.values())
    slots: Counter = Counter()
    shapes: Counter = Counter()
    for word, n in words.items():
        w, s = _word(word)
        slots[w] += n
        shapes[s] += n
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(n * len(w) for w, n in words.items())
    symbols = sum(map(text.count, "#*$%&|<>"))
    upper = sum(n for w, n in words.items() if w.isupper())
    digits = sum(n for w, n in words.items() if any(c.isdigit() for c in w))
    bits = [
        _bins("symbols", symbols / max(1, letters), 12, 0.3),
        _bins("upper", upper / max(1, total), 12, 1),
        _bins("digits", digits / max(1, total), 8, 1),
        _bins("length", letters / max(1, total), 12, 12),
        _bins("distinct", len(words) / max(1, total), 12, 1),
        _bins("most", max(words.values(), default=0) / max(1, total), 12, 1),
        _bins("lines", 1 - len(set(lines)) / max(1, len(lines)), 12, 1),
        _bins("line", np.log2(1 + total / max(1, len(lines))), 10, 12),
        _bins("marks", sum(map(text.count, "!?")) / max(1, total), 10, 1),
        _bins("stops", sum(map(text.count, ".,;:")) / max(1, total), 10, 1),
        _bins("words", np.log2(1 + total), 16, 16),
        _bins("bytes", np.log2(1 + len(text.encode())), 20, 20),
    ]
    index, value = [], []
    for counted, weight in ((slots, 1.0), (shapes, 1.5)):
        own = np.fromiter(counted.values(), np.float64, len(counted))
        index += counted.keys()
        value.append(own / max(1e-9, np.sqrt((own * own).sum())) * weight)
    index += bits
    value.append(np.full(len(bits), 0.5))
    return np.array(index, np.int64), np.concatenate(value)


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Every row has features, those in bins at least."""
        if not rows:
            return np.zeros(0)
        index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        xv = self.v[index] * value[:, None]
        s = np.add.reduceat(xv, starts)
        q = np.add.reduceat(xv * xv, starts)
        z = self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * (s * s - q).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Logistic loss, AdaGrad over mini-batches in a fixed order."""
    share = float(labels.mean()) if len(labels) else 1.0
    if share in (0.0, 1.0):
        return Machine(60.0 if share else -60.0, np.zeros(SLOTS), np.zeros((SLOTS, RANK)))
    rng = np.random.default_rng(5)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SLOTS), rng.normal(0, 0.05, (SLOTS, RANK)))
    gw, gv, g0 = np.full(SLOTS, 1e-2), np.full((SLOTS, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            error = m.scores(part) - labels[order[at : at + batch]]
            index, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            lengths = [len(r[0]) for r in part]
            starts = np.cumsum([0, *lengths[:-1]])
            vx = m.v[index] * value[:, None]
            sums = np.repeat(np.add.reduceat(vx, starts), lengths, axis=0)
            e = np.repeat(error, lengths) / len(part)
            used, where = np.unique(index, return_inverse=True)
            dw = np.bincount(where, e * value, len(used)) + decay * m.w[used]
            own = (e * value)[:, None] * (sums - vx)
            dv = np.stack([np.bincount(where, own[:, f], len(used)) for f in range(RANK)], 1) + decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            d0 = float(error.mean())
            g0 += d0 * d0
            m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """Fits on labelled rows that are not held out."""
    key = F.col(id_col)
    some = labels.where(F.col(label_col).isNotNull() & key.isNotNull() & ~held_out(key))
    some = some.select(key.alias("_id"), F.col(label_col).cast("int").alias("_y"))
    chosen = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    schema = "y int, id string, slots binary, weights binary"  # packed, so that the driver holds a few MB
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary())], schema=fields)

    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # sample rows at most
    rows = joined.select("_y", F.col("_id").cast("string").alias("_key"), "_text").mapInArrow(run, schema)
    order = F.xxhash64("id", "y", "slots", "weights")
    rows = rows.distinct().orderBy(order, "id", "y").limit(2 * sample).collect()  # the top of each task, merged
    rows.sort(key=lambda r: (zlib.crc32(r.id.encode()), r.id, r.y, r.slots, r.weights))
    return fit([(np.frombuffer(r.slots, np.int32), np.frombuffer(r.weights, np.float32)) for r in rows], np.array([r.y for r in rows], float))


def score(docs: DataFrame, machine: Machine, extra: list[Column], text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns of extra and the score of every row."""
    rows = docs.select(*extra, F.col(text_col).alias(free_name(docs.columns, "_text")))
    schema = rows.select(*rows.columns[:-1], F.lit(0.0).alias(out)).schema
    fields = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found: list[float] = []
            for at in range(0, len(texts), 64):
                found += own.scores([features(t.as_py()) for t in texts[at : at + 64]]).tolist()
            columns = [*batch.columns[:-1], pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    machine = train(docs, labels, id_col=id_col, text_col=text_col)
    key = F.col(id_col)
    return score(docs, machine, [key, held_out(key).alias("held_out")], text_col).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with the columns of docs."""
    machine = train(docs, labels, id_col=id_col, text_col=text_col)
    columns = [F.col(c) for c in docs.columns]
    name = free_name(docs.columns, "_score")
    scored = score(docs, machine, columns, text_col, name)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
