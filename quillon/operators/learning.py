"""Sequence models over window tables: training with early stopping, prediction, gradients and Euler steps.

Models are small numpy cells whose weights go to every partition of windows. A training step
adds gradients over partitions, so a task holds a batch of windows and the driver only
weights and sums; prediction and importance run over partitions alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import table

KINDS = ("gru", "cfc", "ltc")


@dataclass(frozen=True)
class TrainingSettings:
    """steps: parts that the training windows are dealt to; an epoch takes a step on each."""

    hidden: int = 8
    epochs: int = 30
    steps: int = 4
    rate: float = 0.01
    patience: int = 5
    min_delta: float = 0.0
    seed: int = 7

    def __post_init__(self):
        if min(self.hidden, self.epochs, self.steps, self.patience) < 1 or self.rate <= 0 or self.min_delta < 0:
            raise ValueError("sizes, epochs, patience and rate must be positive")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class SequenceModel:
    """A recurrent cell and a linear head on its last state.

    gru: gated recurrent unit. cfc: closed-form continuous-time cell, a time gate between two candidates.
    ltc: liquid time-constant cell, one fused Euler step for each input.
    """

    kind: str
    params: dict[str, np.ndarray]
    history: list[dict] = field(default_factory=list)

    @staticmethod
    def create(kind: str, n_features: int, hidden: int, seed: int = 7, sparsity: float = 0.0) -> SequenceModel:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        if not 0 <= sparsity < 1:
            raise ValueError("sparsity lies in [0, 1)")
        random = np.random.default_rng(seed)
        gates = {"gru": 3, "cfc": 3, "ltc": 1}[kind]
        scale = 1 / np.sqrt(n_features + hidden)
        p = {f"w{g}": random.normal(0, scale, (n_features + hidden, hidden)) for g in range(gates)} | {f"b{g}": np.zeros(hidden) for g in range(gates)}
        for g in range(gates):
            p[f"w{g}"] *= random.random(p[f"w{g}"].shape) >= sparsity
        if kind == "ltc":
            p |= {"tau": np.ones(hidden), "a": random.normal(0, 1, hidden)}
        return SequenceModel(kind, p | {"v": random.normal(0, scale, hidden), "c": np.zeros(1)})

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, z = self.params, np.hstack([x, h])
        if self.kind == "gru":
            u, r = _sigmoid(z @ p["w0"] + p["b0"]), _sigmoid(z @ p["w1"] + p["b1"])
            y = np.hstack([x, r * h])
            n = np.tanh(y @ p["w2"] + p["b2"])
            return u * h + (1 - u) * n, (z, y, u, r, n, h)
        if self.kind == "cfc":
            t = _sigmoid(z @ p["w0"] + p["b0"])
            a, b = np.tanh(z @ p["w1"] + p["b1"]), np.tanh(z @ p["w2"] + p["b2"])
            return t * a + (1 - t) * b, (z, t, a, b)
        f = _sigmoid(z @ p["w0"] + p["b0"])
        down = 1 + np.abs(p["tau"]) + f
        return (h + f * p["a"]) / down, (z, f, h, down)

    def _back(self, saved: tuple, dh: np.ndarray, g: dict, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the input and of the state before; those of the parameters are added to g."""
        p = self.params

        def through(i: int, z: np.ndarray, d: np.ndarray) -> np.ndarray:
            g[f"w{i}"] += z.T @ d
            g[f"b{i}"] += d.sum(0)
            return d @ p[f"w{i}"].T

        if self.kind == "gru":
            z, y, u, r, n, h = saved
            dy = through(2, y, dh * (1 - u) * (1 - n * n))
            drh = dy[:, m:]
            dz = through(0, z, dh * (h - n) * u * (1 - u)) + through(1, z, drh * h * r * (1 - r))
            return dz[:, :m] + dy[:, :m], dz[:, m:] + dh * u + drh * r
        if self.kind == "cfc":
            z, t, a, b = saved
            dz = through(0, z, dh * (a - b) * t * (1 - t)) + through(1, z, dh * t * (1 - a * a)) + through(2, z, dh * (1 - t) * (1 - b * b))
            return dz[:, :m], dz[:, m:]
        z, f, h, down = saved
        top = h + f * p["a"]
        g["a"] += (dh * f / down).sum(0)
        g["tau"] += (-dh * top / down**2).sum(0) * np.sign(p["tau"])
        dz = through(0, z, dh * (p["a"] / down - top / down**2) * f * (1 - f))
        return dz[:, :m], dz[:, m:] + dh / down

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple], np.ndarray]:
        h, saved = np.zeros((len(x), len(self.params["v"]))), []
        for t in range(x.shape[1]):
            h, s = self._step(x[:, t], h)
            saved.append(s)
        return h @ self.params["v"] + self.params["c"][0], saved, h

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def backward(self, x: np.ndarray, saved: list[tuple], h: np.ndarray, d_out: np.ndarray) -> tuple[dict, np.ndarray]:
        g = {k: np.zeros_like(v) for k, v in self.params.items()}
        g["v"], g["c"] = h.T @ d_out, np.array([d_out.sum()])
        dh, dx = d_out[:, None] * self.params["v"], np.zeros_like(x)
        for t in range(x.shape[1] - 1, -1, -1):
            dx[:, t], dh = self._back(saved[t], dh, g, x.shape[2])
        return g, dx

    def n_parameters(self) -> int:
        return sum(p.size for p in self.params.values())

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params.values()])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, p in self.params.items():
            self.params[k], at = values[at : at + p.size].reshape(p.shape), at + p.size

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "params": {k: v.tolist() for k, v in self.params.items()}, "history": self.history})

    @staticmethod
    def from_json(text: str) -> SequenceModel:
        d = json.loads(text)
        return SequenceModel(d["kind"], {k: np.array(v) for k, v in d["params"].items()}, d["history"])


def _array(windows: pd.Series) -> np.ndarray:
    return np.array([np.stack(w) for w in windows], dtype=float)


@dataclass
class _Run:
    """A model in training: Adam's moments and the best weights so far."""

    model: SequenceModel
    settings: TrainingSettings
    taken: int = 0
    best: float = np.inf
    stale: int = 0

    def __post_init__(self):
        n = self.model.n_parameters()
        self.mean, self.square, self.kept = np.zeros(n), np.zeros(n), self.model.flat()

    def step(self, gradient: np.ndarray) -> None:
        self.taken += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient**2
        moved = (self.mean / (1 - 0.9**self.taken)) / (np.sqrt(self.square / (1 - 0.999**self.taken)) + 1e-8)
        self.model.set_flat(self.model.flat() - self.settings.rate * moved)

    def end_epoch(self, epoch: int, train: float, valid: float) -> None:
        if not np.isfinite([train, valid]).all():
            raise ValueError(f"loss isn't finite in epoch {epoch}")
        self.model.history.append({"epoch": epoch, "train_loss": train, "valid_loss": valid})
        if valid < self.best - self.settings.min_delta:
            self.best, self.kept, self.stale = valid, self.model.flat(), 0
        else:
            self.stale += 1


def squared_error_sums(windows: DataFrame, models: dict[str, SequenceModel], gradients: bool, window: str = "window", label: str = "label") -> dict[str, tuple[int, float, np.ndarray]]:
    """model: number of windows, sum of squared errors, and its gradient by parameter (empty without `gradients`).

    A partition gives a row for each model and parameter; Spark adds them, so the driver gets as many rows as there are parameters.
    """
    sent = {k: m.to_json() for k, m in models.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {k: SequenceModel.from_json(t) for k, t in sent.items()}
        sums = {k: np.zeros(2 + gradients * m.n_parameters()) for k, m in own.items()}
        for b in batches:
            if not len(b):
                continue
            x, y = _array(b[window]), b[label].to_numpy(float)
            for name, m in own.items():
                out, saved, h = m.forward(x)
                error = out - y
                sums[name][:2] += len(b), (error**2).sum()
                if gradients:
                    g, _ = m.backward(x, saved, h, 2 * error)
                    sums[name][2:] += np.concatenate([g[k].ravel() for k in m.params])
        for name, total in sums.items():
            yield pd.DataFrame({"model": name, "place": np.arange(len(total)), "total": total})

    added = windows.select(window, label).mapInPandas(run, "model string, place long, total double").groupBy("model", "place").agg(F.sum("total").alias("total"))
    found = {k: np.zeros(2 + gradients * m.n_parameters()) for k, m in models.items()}
    for r in added.collect():
        found[r.model][r.place] = r.total
    return {k: (int(v[0]), float(v[1]), v[2:]) for k, v in found.items()}


def train_models(windows: DataFrame, kinds: Sequence[str], settings: TrainingSettings, window: str = "window", label: str = "label", split: str = "split") -> DataFrame:
    """model, checkpoint (JSON), n_parameters of each kind, by Adam on mean squared error. The test split never enters.

    Training windows are dealt to `steps` parts by a hash of their values and written once, in the shared folder; each
    step adds the gradients of one part over its partitions, for all kinds in one job. A kind stops when validation hasn't
    improved by min_delta for `patience` epochs; its best weights are kept. Empty splits, values that aren't
    finite and losses that aren't are errors.
    """
    rows = windows.where(F.col(split).isin("train", "valid") & F.col(label).isNotNull()).select(F.col(window).alias("window"), F.col(label).cast("double").alias("label"), (F.col(split) == "train").alias("training"))
    part = F.when(F.col("training"), F.pmod(F.xxhash64("window", "label"), F.lit(settings.steps))).otherwise(-1).cast("int")
    rows = table(rows.select("window", "label", part.alias("part")), "windows", ["part"])
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    finite = good(F.col("label")) & F.forall(F.flatten("window"), good)
    shape = rows.agg(F.count_if(F.col("part") >= 0), F.count_if(F.col("part") < 0), F.count_if(~F.coalesce(finite, F.lit(False))), F.max(F.size(F.element_at("window", 1)))).first()
    if not shape[0] or not shape[1]:
        raise ValueError("training and validation need rows")
    if shape[2]:
        raise ValueError("training data must be finite")
    runs = {k: _Run(SequenceModel.create(k, shape[3], settings.hidden, settings.seed), settings) for k in kinds}
    for epoch in range(settings.epochs):
        going = {k: r.model for k, r in runs.items() if r.stale < settings.patience}
        if not going:
            break
        seen, loss = dict.fromkeys(going, 0), dict.fromkeys(going, 0.0)
        for i in range(settings.steps):
            for k, (n, error, gradient) in squared_error_sums(rows.where(F.col("part") == i), going, True).items():
                seen[k], loss[k] = seen[k] + n, loss[k] + error
                if n:
                    runs[k].step(gradient / n)
        for k, (n, error, _) in squared_error_sums(rows.where("part < 0"), going, False).items():
            runs[k].end_epoch(epoch, loss[k] / seen[k], error / n)
    for r in runs.values():
        r.model.set_flat(r.kept)
    made = [(k, r.model.to_json(), r.model.n_parameters()) for k, r in runs.items()]
    return windows.sparkSession.createDataFrame(made, "model string, checkpoint string, n_parameters long")


def loaded(models: DataFrame) -> dict[str, SequenceModel]:
    """The models of train_models: a row each."""
    return {r.model: SequenceModel.from_json(r.checkpoint) for r in models.collect()}


def history(models: DataFrame) -> DataFrame:
    """model, epoch, train_loss, valid_loss."""
    parsed = F.from_json("checkpoint", "history array<struct<epoch:long,train_loss:double,valid_loss:double>>")
    return models.select("model", F.explode(parsed["history"]).alias("h")).select("model", "h.*")


def predict(windows: DataFrame, models: dict[str, SequenceModel], keys: Sequence[str], window: str = "window") -> DataFrame:
    """keys, model, prediction for all windows; labels aren't needed."""
    sent = windows.sparkSession.sparkContext.broadcast({k: m.to_json() for k, m in models.items()})
    types = dict(windows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {k: SequenceModel.from_json(t) for k, t in sent.value.items()}
        for b in batches:
            for name, m in own.items():
                if len(b):
                    yield b[list(keys)].assign(model=name, prediction=m.predict(_array(b[window])))

    return windows.select(*keys, window).mapInPandas(run, ", ".join([f"{k} {types[k]}" for k in keys] + ["model string", "prediction double"]))


def gradient_importance(windows: DataFrame, models: dict[str, SequenceModel], names: Sequence[str], window: str = "window") -> DataFrame:
    """model, feature, importance: mean absolute gradient of the output by feature over all windows and steps, normalised.

    Partitions send sums, a row for each model and feature.
    """
    sent = windows.sparkSession.sparkContext.broadcast({k: m.to_json() for k, m in models.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = {k: SequenceModel.from_json(t) for k, t in sent.value.items()}
        for b in batches:
            if not len(b):
                continue
            x = _array(b[window])
            for name, m in own.items():
                _, saved, h = m.forward(x)
                dx = m.backward(x, saved, h, np.ones(len(x)))[1]
                yield pd.DataFrame({"model": name, "feature": list(names), "total": np.abs(dx).sum((0, 1)), "n": x.shape[0] * x.shape[1]})

    sums = windows.select(window).mapInPandas(run, "model string, feature string, total double, n long").groupBy("model", "feature").agg((F.sum("total") / F.sum("n")).alias("gradient"))
    from pyspark.sql import Window

    whole = F.sum("gradient").over(Window.partitionBy("model"))
    return sums.withColumn("importance", F.try_divide(F.col("gradient"), F.when(whole > 0, whole)))


def wiring_density(edges: DataFrame, units: int, inputs: int) -> DataFrame:
    """edges: model, kind (recurrent or sensory). Share of possible connections that are there."""
    return edges.groupBy("model").agg((F.count(F.lit(1)) / F.lit(float(units * units + inputs * units))).alias("density"))


def euler(start: Column, times: Sequence[float], slope) -> Column:
    """The states of dx/dt = slope(t, x) at `times`, by explicit Euler steps; a column expression for scalar states."""
    if len(times) < 2 or any(b <= a for a, b in zip(times, times[1:])):
        raise ValueError("times must increase")
    steps = F.array(*[F.struct(F.lit(float(a)).alias("t"), F.lit(float(b - a)).alias("dt")) for a, b in zip(times, times[1:])])

    def step(states: Column, s: Column) -> Column:
        x = F.element_at(states, -1)
        return F.concat(states, F.array(x + s["dt"] * slope(s["t"], x)))

    return F.aggregate(steps, F.array(start.cast("double")), step)


def rolling_train_predict(windows: DataFrame, ends: Sequence[str], settings: TrainingSettings, kind: str = "gru", keys: Sequence[str] = ("stock_code", "date"), valid_share: float = 0.2) -> DataFrame:
    """Predictions of each period after an end date by a model that saw only windows up to it."""
    out = None
    for a, b in zip(ends, [*ends[1:], None]):
        past = windows.where(F.col("date") <= F.lit(a).cast("date"))
        held = F.pmod(F.xxhash64(*keys), F.lit(1000)) < int(1000 * valid_share)
        models = loaded(train_models(past.withColumn("split", F.when(held, "valid").otherwise("train")), [kind], settings))
        after = windows.where(F.col("date") > F.lit(a).cast("date")) if b is None else windows.where((F.col("date") > F.lit(a).cast("date")) & (F.col("date") <= F.lit(b).cast("date")))
        part = predict(after, models, keys)
        out = part if out is None else out.unionByName(part)
    return out
