"""Batch scoring: a model is set up once per task and applied to Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import arrays as A


class Scorer:
    """User hook with four steps. ``schema`` lists the columns that ``post`` adds."""

    schema = "prediction double"

    def setup(self) -> None:
        """Called once per task, before the first batch."""

    def check(self, rows: pd.DataFrame) -> pd.Series | None:
        """Guarded scoring: an error text per row that must not reach the model, null for good rows."""
        return None

    def pre(self, rows: pd.DataFrame):
        """Rows to model input."""
        return rows

    def score(self, batch):
        """Model input to model output for a whole batch."""
        raise NotImplementedError

    def post(self, output, rows: pd.DataFrame) -> pd.DataFrame:
        """Model output to result columns, one row per input row."""
        raise NotImplementedError


TIMES = "rows_in_batch long, pre_nanos long, score_nanos long, post_nanos long, total_nanos long"


def score(df: DataFrame, scorer: Scorer, keep: list[str], batch_size: int | None = None, timing: bool = False,
          guard: bool = False) -> DataFrame:
    """Apply ``scorer`` to every row and append its columns to ``keep``.

    ``batch_size`` cuts Arrow batches further (1 scores row by row). ``timing`` adds the nanoseconds of each step
    of the row's batch. ``guard`` adds ``status`` and ``error``: rows refused by ``check`` are bad requests, and when
    a batch fails in the model its rows are scored one by one and the failing ones marked; without it the job fails.
    """
    model = df.sparkSession.sparkContext.broadcast(scorer)
    extra = [c.strip().split(" ")[0] for c in scorer.schema.split(",")]
    kept = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in keep)
    schema = f"{kept}, {scorer.schema}" + (f", {TIMES}" if timing else "") + (", status string, error string" if guard else "")

    def run(m: Scorer, rows: pd.DataFrame) -> pd.DataFrame:
        marks = [time.perf_counter_ns()]
        batch = m.pre(rows)
        marks.append(time.perf_counter_ns())
        output = m.score(batch)
        marks.append(time.perf_counter_ns())
        result = m.post(output, rows)
        marks.append(time.perf_counter_ns())
        result = result[extra].set_axis(rows.index)
        if timing:
            result["rows_in_batch"] = len(rows)
            for i, name in enumerate(("pre_nanos", "score_nanos", "post_nanos")):
                result[name] = marks[i + 1] - marks[i]
            result["total_nanos"] = marks[-1] - marks[0]
        return result

    def guarded(m: Scorer, rows: pd.DataFrame) -> pd.DataFrame:
        found = m.check(rows)
        error = pd.Series(None, index=rows.index, dtype=object) if found is None else found.astype(object).set_axis(rows.index)
        status = pd.Series("ok", index=rows.index).mask(error.notna(), "bad request")
        sound = rows[error.isna()]
        try:
            parts = [run(m, sound)] if len(sound) else []
        except Exception:
            parts = []
            for place in range(len(sound)):
                try:
                    parts.append(run(m, sound.iloc[place : place + 1]))
                except Exception as problem:
                    index = sound.index[place]
                    status[index], error[index] = "engine error", f"{type(problem).__name__}: {problem}"
        names = extra + ([c.split(" ")[0] for c in TIMES.split(", ")] if timing else [])
        result = pd.concat(parts) if parts else pd.DataFrame(columns=names)
        return result.reindex(rows.index).assign(status=status, error=error)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        m.setup()
        for whole in batches:
            step = batch_size or max(len(whole), 1)
            for start in range(0, len(whole), step):
                rows = whole.iloc[start : start + step].reset_index(drop=True)
                result = guarded(m, rows) if guard else run(m, rows)
                yield pd.concat([rows[keep], result], axis=1)

    return df.mapInPandas(apply, schema)


class LinearScorer(Scorer):
    """Class scores ``x W' + b`` with the best class and its probability."""

    schema = "class long, probability double"

    def __init__(self, weights: np.ndarray, bias: np.ndarray, column: str):
        self.weights, self.bias, self.column = weights, bias, column

    def pre(self, rows):
        return np.stack(rows[self.column].to_numpy()).astype(float)

    def score(self, batch):
        logits = batch @ self.weights.T + self.bias
        power = np.exp(logits - logits.max(axis=1, keepdims=True))
        return power / power.sum(axis=1, keepdims=True)

    def post(self, output, rows):
        best = output.argmax(axis=1)
        return pd.DataFrame({"class": best, "probability": output[np.arange(len(best)), best]})


def linear_probabilities(features: list[Column], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """Class probabilities of a softmax regression as plain expressions, for a few features and classes."""
    logits = []
    for row, offset in zip(weights, bias, strict=True):
        total = F.lit(float(offset))
        for w, x in zip(row, features, strict=True):
            total = total + F.lit(float(w)) * x
        logits.append(total)
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    mass = sum(powers[1:], powers[0])
    return [p / mass for p in powers]


def best_class(names: list[str], probabilities: list[Column]) -> Column:
    """(prob, class) of the most probable class, the first one among equals."""
    ranked = [F.struct(p.alias("prob"), F.lit(-i).alias("i"), F.lit(n).alias("class")) for i, (n, p) in enumerate(zip(names, probabilities, strict=True))]
    return F.greatest(*ranked) if len(ranked) > 1 else ranked[0]


def answer_span(tokens: Column, start_scores: Column, end_scores: Column) -> Column:
    """Tokens from the best start to the best end position, both included; null when the end comes first."""
    start, end = A.arg_max(start_scores), A.arg_max(end_scores)
    return F.when(end >= start, F.slice(tokens, start + 1, end - start + 1))
