"""Training of a gene's parameters from scored samples: gradients of whole batches are sums in Spark, the steps follow one another in state.

A step depends on the one before it (it is clipped), so the steps of one type are a sequence; what is sequential is a row of 24 numbers for each batch and type, and
a stream keeps the state between micro-batches, so that training goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..streaming.streams import batches_of

SLICES = 9
#: Parameters: nine merge weights, temperature, the thresholds of black and white.
PARAMETERS = SLICES + 3
# Fixed values of the rules: start, bounds, and the sizes of a sample's pushes.
START = [0.5] * SLICES + [1.0, 0.65, 0.35]
LOW, HIGH = [0.0] * SLICES + [0.1, 0.5, 0.1], [1.0] * SLICES + [2.0, 0.9, 0.5]
BATCH, GATE, NEUTRAL, FOCUSED = 10, 0.1, 0.5, 0.1
RATE, MOMENTUM, PENALTY, IMPORTANT, DECAY, MOST = 0.01, 0.9, 0.5, 0.001, 0.99, 1.0
ALPHA, TEMPERATURE, THRESHOLD = 0.1, 0.02, 0.01


def batch_gradients(samples: DataFrame, by: str, *order: str) -> DataFrame:
    """samples (by, total, perceptual, variances: nine numbers, order) -> batch, by, n, gradient, importance (PARAMETERS numbers each).

    Samples over the gate stand in one order, and each BATCH of them is a batch of all types; what is left over at the end isn't one yet. A type's gradient in a
    batch is the mean push of its samples, its importance the mean squared push. Samples with a null type, score or variances push nothing, but fill batches."""
    b = batches_of(samples.where(F.round("total", 9) >= GATE), BATCH, *order)
    full = b.groupBy("batch").agg(F.count("*").alias("__size")).where(F.col("__size") == BATCH).select("batch")
    away, seen = F.col("total") - NEUTRAL, F.col("perceptual") - NEUTRAL
    push = [away * F.when(F.col("variances")[t] > FOCUSED, ALPHA).otherwise(-ALPHA) for t in range(SLICES)]
    push += [away * TEMPERATURE, seen * THRESHOLD, -seen * THRESHOLD]
    square = [p * p for p in push[: SLICES + 1]] + [F.pow(F.col("perceptual") * THRESHOLD, 2)] * 2
    known = b.where(F.col(by).isNotNull() & F.col("perceptual").isNotNull() & (F.size("variances") == SLICES)).join(full, "batch")
    mean = lambda c: F.avg(c)
    return known.groupBy("batch", by).agg(F.count("*").alias("n"), F.array(*map(mean, push)).alias("gradient"), F.array(*map(mean, square)).alias("importance"))


def step(state: dict[str, np.ndarray], gradient: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
    """One step: the penalty for leaving the anchor where importance is high, momentum, the clip, the move within bounds; then the importance decays
    and grows, and the anchor is where the weights are now."""
    weights, velocity, fisher, anchor = (state[k] for k in ("weights", "velocity", "importance", "anchor"))
    pull = np.where(fisher > IMPORTANT, PENALTY * fisher * (weights - anchor), 0.0)
    velocity = MOMENTUM * velocity + (1 - MOMENTUM) * (gradient - pull)
    size = float(np.sqrt((velocity**2).sum()))
    move = velocity * (MOST / size) if size > MOST else velocity
    weights = np.clip(weights + RATE * move, LOW, HIGH)
    if weights[-2] <= weights[-1]:  # black stays above white
        middle = (weights[-2] + weights[-1]) / 2
        weights[-2:] = middle + 0.1, middle - 0.1
    return {"weights": weights, "velocity": velocity, "importance": DECAY * fisher + importance, "anchor": weights.copy()}


def fresh_state() -> dict[str, np.ndarray]:
    start = np.array(START)
    return {"weights": start, "velocity": np.zeros(PARAMETERS), "importance": np.zeros(PARAMETERS), "anchor": start.copy()}


def trained(gradients: DataFrame, by: str) -> DataFrame:
    """by, steps, weights: all batches of each type in order. A type's rows (one a batch) are a task's; for a table without end take training_stream()."""

    def one(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        state = fresh_state()
        d = d.sort_values("batch")
        for g, i in zip(d["gradient"], d["importance"], strict=True):
            state = step(state, np.asarray(g), np.asarray(i))
        return pd.DataFrame({by: [key[0]], "steps": [len(d)], "weights": [np.round(state["weights"], 9).tolist()]})

    kind = dict(gradients.dtypes)[by]
    return gradients.groupBy(by).applyInPandas(one, f"{by} {kind}, steps int, weights array<double>")


class _Trainer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gene", "steps int, " + ", ".join(f"{k} array<double>" for k in fresh_state()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = list(fresh_state())
        steps, state = 0, fresh_state()
        if self.state.exists():
            steps, *values = self.state.get()
            state = {k: np.array(v, float) for k, v in zip(names, values, strict=True)}
        d = pd.concat(list(rows)).sort_values("batch")
        for g, i in zip(d["gradient"], d["importance"], strict=True):
            state, steps = step(state, np.asarray(g), np.asarray(i)), steps + 1
        self.state.update((steps, *(state[k].tolist() for k in names)))
        yield pd.DataFrame({"key": [key[0]], "steps": [steps], "weights": [np.round(state["weights"], 9).tolist()]})

    def close(self) -> None:
        pass


def training_stream(gradients: DataFrame, by: str) -> DataFrame:
    """Streaming: key, steps, weights after each micro-batch of batch gradients (in order over micro-batches); weights, velocity, importance and anchor are in
    the state store."""
    kind = dict(gradients.dtypes)[by]
    rows = gradients.select(F.col(by).alias("key"), "batch", "gradient", "importance")
    return rows.groupBy("key").transformWithStateInPandas(_Trainer(), f"key {kind}, steps int, weights array<double>", "update", "None")
