"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.tokens import slices, word_hashes
from navspark.session import stage

PASSAGE = 100
SAMPLE = 8192
HIDDEN = 16
GATE = 8
EPOCHS = 60
FEATURES = 18


def _counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and their number).

    A passage is a run of ``size`` words of one text with the bytes up to the next run; a text without
    words is one passage. Features are shares of byte classes, word lengths and repetitions.
    """
    n = len(offsets) - 1
    words, rows = word_hashes(data, offsets)
    per_text = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1 if len(data) else starts
    number = np.maximum(1, -(-per_text // size))
    first = np.concatenate(([0], np.cumsum(number)))
    inner = np.arange(first[-1]) - np.repeat(first[:-1], number)
    text_word = np.concatenate(([0], np.cumsum(per_text)))
    word_at = np.minimum(np.repeat(text_word[:-1], number) + inner * size, np.repeat(text_word[1:], number))
    word_bounds = np.append(word_at, len(words))
    has = np.repeat(per_text, number) > 0
    byte_at = np.repeat(offsets[:-1], number).astype(np.int64)
    if len(starts):
        byte_at = np.where(has & (inner > 0), starts[np.minimum(word_at, len(starts) - 1)], byte_at)
    bounds = np.append(byte_at, len(data))
    length = np.maximum(1, np.diff(bounds)).astype(float)
    lower, upper, digit = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    stop = np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    high = data >= 128
    other = ~(lower | upper | digit | stop | high | blank)
    n_words = np.maximum(1, np.diff(word_bounds)).astype(float)
    width = (ends - starts).astype(float)
    owner = np.searchsorted(word_bounds, np.arange(len(words)), side="right") - 1
    again = np.zeros(len(words), bool)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((words, owner))
    copy = np.zeros(len(words), bool)
    if len(words) > 1:
        copy[1:] = (words[order][1:] == words[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd_end = ~((tail >= 97) & (tail <= 122) | (tail >= 65) & (tail <= 90) | (tail >= 128) | np.isin(tail, np.frombuffer(b".,;:!?)", np.uint8)))
    mean = _counts(width, word_bounds) / n_words
    spread = np.sqrt(np.maximum(0, _counts(width**2, word_bounds) / n_words - mean**2))
    grid = np.stack(
        [
            *[_counts(f, bounds) / length for f in (lower, upper, digit, stop, high, other, data == 10, data == 124)],
            np.log1p(np.diff(word_bounds)), mean / 10, spread / 10,
            *[_counts(f, word_bounds) / n_words for f in (width <= 3, width >= 13, again, odd_end)],
            _counts(copy, word_bounds) / n_words,
            np.log1p(np.repeat(per_text, number)) / 5, np.log1p(_counts(other, bounds)) / 5,
        ],
        axis=1,
    )
    return grid.astype(np.float32), np.stack([first[:-1], number], axis=1)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, data, offsets in slices(texts):
        grid, bags = passages(data, offsets)
        yield at, len(offsets) - 1, grid, bags


class Attention:
    """Passage encoder, gated attention and classifier, fitted together from labels of whole documents."""

    def __init__(self, grid: np.ndarray, bags: np.ndarray, labels: np.ndarray, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.scale = grid.mean(axis=0), grid.std(axis=0) + 1e-3
        small = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "W": small(grid.shape[1], HIDDEN), "b": np.zeros(HIDDEN), "V": small(HIDDEN, GATE), "U": small(HIDDEN, GATE),
            "w": small(GATE), "c": small(HIDDEN), "d": np.zeros(1),
        }
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.p["d"][0] = np.log(share / (1 - share))
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(labels))
            for at in range(0, len(order), 256):
                some = order[at : at + 256]
                number = bags[some, 1]
                rows = np.repeat(bags[some, 0] - np.cumsum(number) + number, number) + np.arange(number.sum())
                step += 1
                for k, g in self._gradient(grid[rows], number, labels[some]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, grid: np.ndarray, number: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((grid - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        at = np.concatenate(([0], np.cumsum(number)[:-1]))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, at), number))
        a /= np.repeat(np.add.reduceat(a, at), number)
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return x, h, v, u, a, at, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))

    def _gradient(self, grid: np.ndarray, number: np.ndarray, labels: np.ndarray) -> dict:
        p = self.p
        x, h, v, u, a, at, z, score = self._forward(grid, number)
        off = (score - labels) / len(labels)
        dz = np.repeat(off[:, None] * p["c"], number, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at), number))
        dg = de[:, None] * p["w"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        dh = a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h * h)
        out = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ de, "c": z.T @ off, "d": off.sum(keepdims=True)}
        return {k: g + 1e-4 * p[k] * (k in "WVUwc") for k, g in out.items()}

    def score(self, grid: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self._forward(grid, number)[-1]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention | None:
    """Fit on at most ``sample`` labelled documents, chosen by the hash of their ids.

    Labels other than 0 and 1 and null ids teach nothing; of several labels of a document the
    largest counts. Without any label there is no model.
    """
    sound = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    chosen = sound.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, grid, bags in _runs(batch.column(2)):
                flat = [grid[a : a + k].ravel() for a, k in bags]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(at, n) for i in (0, 1)], pa.array(flat, pa.list_(pa.float32()))], ["id", "label", "grid"]
                )

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample has a fixed size, so it may be sent to every task.
    rows = texts.join(F.broadcast(stage(chosen, "chosen")), "_id").select(F.col("_id").cast("long"), "_label", "_text")
    found = rows.mapInArrow(encode, "id long, label double, grid array<float>").orderBy("id", F.xxhash64("grid")).toArrow()
    if not found.num_rows:
        return None
    grids = found["grid"].combine_chunks()
    grid = np.asarray(grids.flatten()).reshape(-1, FEATURES).astype(float)
    number = np.diff(np.asarray(grids.offsets)) // FEATURES
    bags = np.stack([np.concatenate(([0], np.cumsum(number)[:-1])), number], axis=1)
    return Attention(grid, bags, np.asarray(found["label"]))


def score(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the model's probability of label 1, from the whole text.

    Null and empty texts are one empty passage and scored like any other. Without a model every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at, n, grid, bags in _runs(batch.column(1)):
                values = fitted.score(grid.astype(float), bags[:, 1]) if fitted else np.full(n, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(values)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(rate, "doc_id long, score double")
