"""Data-parallel training: one Spark job per step adds up gradients, the driver updates the parameters."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import seeded_uniform
from gridloom.operators.optimizers import Optimizer, initial
from gridloom.session import scratch_path

Parameters = dict[str, np.ndarray]


class Model:
    """A differentiable model with closed-form gradients on a batch (x, y)."""

    def parameters(self, seed: int) -> Parameters:
        raise NotImplementedError

    def forward(self, p: Parameters, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def gradients(self, p: Parameters, x: np.ndarray, y: np.ndarray) -> tuple[float, float, Parameters]:
        """Summed loss, number of right answers, summed gradients."""
        raise NotImplementedError


class Linear(Model):
    """``x W' + b`` with squared error (weight one half) or softmax/sigmoid cross entropy."""

    def __init__(self, inputs: int, outputs: int, loss: str = "squared", start: str = "xavier", value: float = 0.0):
        self.inputs, self.outputs, self.loss, self.start, self.value = inputs, outputs, loss, start, value

    def parameters(self, seed):
        return {"weight": initial(self.start, (self.outputs, self.inputs), seed, self.value), "bias": np.zeros(self.outputs)}

    def forward(self, p, x):
        return x @ p["weight"].T + p["bias"]

    def gradients(self, p, x, y):
        out = self.forward(p, x)
        loss, right, delta = output_loss(self.loss, out, y)
        return loss, right, {"weight": delta.T @ x, "bias": delta.sum(axis=0)}


class Mlp(Model):
    """One hidden layer with rectified units."""

    def __init__(self, inputs: int, hidden: int, outputs: int, loss: str = "softmax"):
        self.inputs, self.hidden, self.outputs, self.loss = inputs, hidden, outputs, loss

    def parameters(self, seed):
        return {
            "weight1": initial("xavier", (self.hidden, self.inputs), seed), "bias1": np.zeros(self.hidden),
            "weight2": initial("xavier", (self.outputs, self.hidden), seed + 1), "bias2": np.zeros(self.outputs),
        }

    def forward(self, p, x):
        return np.maximum(x @ p["weight1"].T + p["bias1"], 0.0) @ p["weight2"].T + p["bias2"]

    def gradients(self, p, x, y):
        inner = x @ p["weight1"].T + p["bias1"]
        active = np.maximum(inner, 0.0)
        loss, right, delta = output_loss(self.loss, active @ p["weight2"].T + p["bias2"], y)
        back = (delta @ p["weight2"]) * (inner > 0)
        return loss, right, {
            "weight1": back.T @ x, "bias1": back.sum(axis=0), "weight2": delta.T @ active, "bias2": delta.sum(axis=0),
        }


def output_loss(kind: str, out: np.ndarray, y: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Summed loss, right answers and the derivative with respect to the outputs."""
    if kind == "squared":
        target = y.reshape(len(out), -1)
        diff = out - target
        cells = out.shape[1]
        return float(0.5 * (diff**2).sum() / cells), 0.0, diff / cells
    if kind == "sigmoid":
        target = y.reshape(len(out), -1)
        loss = np.maximum(out, 0) - out * target + np.log1p(np.exp(-np.abs(out)))
        return float(loss.sum()), float(((out >= 0) == (target > 0.5)).sum()), 1 / (1 + np.exp(-out)) - target
    label = y.astype(int).ravel()
    top = out.max(axis=1, keepdims=True)
    power = np.exp(out - top)
    mass = power.sum(axis=1, keepdims=True)
    rows = np.arange(len(out))
    loss = (np.log(mass) + top).ravel() - out[rows, label]
    probs = power / mass
    probs[rows, label] -= 1.0
    return float(loss.sum()), float((out.argmax(axis=1) == label).sum()), probs


@dataclass
class Trial:
    """One model in training; several trials share every pass over the data."""

    model: Model
    optimizer: Optimizer
    seed: int = 0
    parameters: Parameters = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    failed: str | None = None

    def __post_init__(self):
        self.parameters = self.parameters or self.model.parameters(self.seed)


class Diverged(RuntimeError):
    """The loss is not a number."""


def gradient_sums(df: DataFrame, features: str, label: str, work: list[tuple[Model, Parameters]], depth: int = 2):
    """For every (model, parameters): rows, loss, right answers and gradients summed over all rows.

    Each task returns one row with its partial sums; they are added in a tree, so the driver receives a few. A table
    without rows has sums of zero.
    """
    shared = df.sparkSession.sparkContext.broadcast(work)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for rows in batches:
            if not rows.num_rows:
                continue
            x, y = _matrix(rows.column(0)), _matrix(rows.column(1))
            new = [(len(x), *m.gradients(p, x, y)) for m, p in shared.value]
            sums = new if sums is None else _add(sums, new)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(sums)], pa.binary())], names=["sums"])

    parts = df.select(features, label).mapInArrow(partial, "sums binary")
    found = parts.rdd.map(lambda row: pickle.loads(bytes(row["sums"]))).treeAggregate(None, _add_known, _add_known, depth)
    return found or [(0, 0.0, 0, {name: np.zeros_like(value) for name, value in p.items()}) for _, p in work]


def _matrix(column: pa.Array) -> np.ndarray:
    """A number per row as a vector, an array per row as a matrix."""
    if pa.types.is_list(column.type):
        return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)
    return np.asarray(column, dtype=float)


def _add(a, b):
    return [
        (na + nb, la + lb, ra + rb, {k: ga[k] + gb[k] for k in ga})
        for (na, la, ra, ga), (nb, lb, rb, gb) in zip(a, b, strict=True)
    ]


def _add_known(a, b):
    """Sums of two parts, of which either may have none."""
    return b if a is None else a if b is None else _add(a, b)


def evaluate_model(df: DataFrame, features: str, label: str, work: list[tuple[Model, Parameters]]) -> list[tuple[float, float]]:
    """(loss, accuracy) per model; NaN for a table without rows."""
    return [(loss / n, right / n) if n else (math.nan, math.nan) for n, loss, right, _ in gradient_sums(df, features, label, work)]


def fit(
    df: DataFrame, features: str, label: str, trials: list[Trial], epochs: int, key: str | None = None, slices: int = 1,
    validate: DataFrame | None = None, seed: int = 0, listeners: list[Callable[[str, dict], None]] | None = None,
    stop_on_divergence: bool = True,
) -> list[Trial]:
    """Train all trials over ``epochs`` passes.

    With ``slices`` > 1 the rows are written once, split by a hash of ``key``, and every step reads one slice (a
    mini-batch); otherwise each step uses all rows, kept in memory or on disk. ``listeners`` are called with
    an event name (begin, step, epoch, end) and its details. A slice without rows is no step, so an empty table leaves the
    parameters and the history as they were.
    """
    tell = listeners or []
    if slices > 1:
        path = scratch_path(df.sparkSession, "slices")
        part = F.floor(seeded_uniform(seed, key) * slices).cast("int")
        # As many write tasks as shuffle partitions, whatever the number of slices.
        rows = df.select(F.col(features).alias(features), F.col(label).alias(label), part.alias("slice"), F.xxhash64(key).alias("_h"))
        rows.repartition("slice", "_h").drop("_h").write.partitionBy("slice").parquet(path)
        # A table without rows leaves no file to read a schema from.
        stored = df.sparkSession.read.schema(rows.drop("_h").schema).parquet(path)
        batches = [stored.filter(F.col("slice") == i) for i in range(slices)]
        held = None
    else:
        held = df.select(features, label).persist(StorageLevel.MEMORY_AND_DISK)
        batches = [held]
    for listen in tell:
        listen("begin", {"trials": trials})
    try:
        for epoch in range(epochs):
            for number, batch in enumerate(batches):
                live = [t for t in trials if t.failed is None]
                if not live:
                    return trials
                sums = gradient_sums(batch, features, label, [(t.model, t.parameters) for t in live])
                if not sums[0][0]:
                    continue
                for trial, (rows, loss, right, gradients) in zip(live, sums, strict=True):
                    record = {"epoch": epoch, "step": number, "loss": loss / rows, "accuracy": right / rows, "rows": rows}
                    if np.isnan(loss):
                        trial.failed = "the loss is not a number"
                        if stop_on_divergence:
                            raise Diverged(trial.failed)
                        continue
                    if not trial.history and all(not np.any(g) for g in gradients.values()):
                        raise ValueError("all gradients are zero in the first step")
                    trial.history.append(record)
                    for name, gradient in gradients.items():
                        trial.parameters[name] = trial.optimizer.step(name, trial.parameters[name], gradient / rows)
                for listen in tell:
                    listen("step", {"epoch": epoch, "step": number, "trials": live})
            if validate is not None:
                live = [t for t in trials if t.failed is None]
                checked = evaluate_model(validate, features, label, [(t.model, t.parameters) for t in live])
                for trial, (loss, accuracy) in zip(live, checked, strict=True):
                    if trial.history:
                        trial.history[-1].update(validate_loss=loss, validate_accuracy=accuracy)
            for listen in tell:
                listen("epoch", {"epoch": epoch, "trials": trials})
        for listen in tell:
            listen("end", {"trials": trials})
        return trials
    finally:
        if held is not None:
            held.unpersist()


def parameter_table(spark, trial: Trial, epoch: int) -> DataFrame:
    """Parameters as rows (epoch, name, position, value, loss, accuracy), ready to be written as a checkpoint."""
    last = trial.history[-1] if trial.history else {"loss": None, "accuracy": None}
    rows = [
        (epoch, name, i, float(v), last.get("validate_loss", last["loss"]), last.get("validate_accuracy", last["accuracy"]))
        for name, values in trial.parameters.items()
        for i, v in enumerate(np.asarray(values).ravel())
    ]
    return spark.createDataFrame(rows, "epoch int, name string, position int, value double, loss double, accuracy double")


def load_parameters(table: DataFrame, epoch: int, shapes: dict[str, tuple[int, ...]]) -> Parameters:
    """Parameters of one epoch from a parameter table; their number is bounded by the model's shapes."""
    size = sum(int(np.prod(s)) for s in shapes.values())
    rows = table.filter(F.col("epoch") == epoch).select("name", "position", "value").limit(size + 1).collect()
    if len(rows) != size:
        raise ValueError(f"expected {size} parameters, found {len(rows)}")
    out = {name: np.zeros(int(np.prod(shape))) for name, shape in shapes.items()}
    for row in rows:
        out[row["name"]][row["position"]] = row["value"]
    return {name: out[name].reshape(shape) for name, shape in shapes.items()}


def save_every_epoch(spark, path: str, trial: Trial) -> Callable[[str, dict], None]:
    """A listener that writes the parameters of ``trial`` after each epoch under ``path/epoch=<n>``."""

    def listen(event: str, details: dict) -> None:
        if event == "epoch":
            table = parameter_table(spark, trial, details["epoch"]).drop("epoch")
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={details['epoch']}")

    return listen


def draw_settings(space: dict[str, tuple], trials: int, seed: int) -> list[dict]:
    """Random hyper-parameters: ("bool",), ("choice", values), ("int", low, high), ("float", low, high) or ("log", low, high)."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        drawn = {}
        for name, (kind, *limits) in space.items():
            if kind == "bool":
                drawn[name] = bool(rng.integers(2))
            elif kind == "choice":
                drawn[name] = limits[0][int(rng.integers(len(limits[0])))]
            elif kind == "int":
                drawn[name] = int(rng.integers(limits[0], limits[1] + 1))
            elif kind == "float":
                drawn[name] = float(rng.uniform(*limits))
            else:
                drawn[name] = float(np.exp(rng.uniform(np.log(limits[0]), np.log(limits[1]))))
        out.append(drawn)
    return out


def search(
    train: DataFrame, validate: DataFrame, features: str, label: str, space: dict[str, tuple], build: Callable[[dict], Trial],
    trials: int, epochs: int, seed: int = 0,
) -> tuple[Trial, pd.DataFrame]:
    """Random search: all trials learn in the same passes, the lowest validation loss wins and is trained again."""
    settings = draw_settings(space, trials, seed)
    fitted = fit(train, features, label, [build(s) for s in settings], epochs, stop_on_divergence=False)
    sound = [i for i, t in enumerate(fitted) if t.failed is None]
    scores = evaluate_model(validate, features, label, [(fitted[i].model, fitted[i].parameters) for i in sound])
    report = pd.DataFrame([{**settings[i], "trial": i, "loss": s[0], "accuracy": s[1]} for i, s in zip(sound, scores, strict=True)])
    best = int(report.sort_values(["loss", "trial"]).iloc[0]["trial"])
    return fit(train, features, label, [build(settings[best])], epochs)[0], report
