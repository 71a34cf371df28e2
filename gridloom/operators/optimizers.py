"""Optimizers and initialisers for parameter vectors held on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Schedule = Callable[[int], float]


class Optimizer:
    """Shared part: gradient rescaling, clipping and weight decay, one update count per parameter.

    The gradient is rescaled and clipped first; the decay term is added afterwards.
    """

    def __init__(self, rate: float | Schedule = 0.01, rescale: float = 1.0, clip: float | None = None, decay: float = 0.0):
        self.rate = rate if callable(rate) else (lambda step, value=float(rate): value)
        self.rescale, self.clip, self.decay = rescale, clip, decay
        self.counts: dict[str, int] = {}
        self.state: dict[tuple[str, str], np.ndarray] = {}

    def memory(self, name: str, slot: str, like: np.ndarray) -> np.ndarray:
        return self.state.setdefault((name, slot), np.zeros_like(like))

    def step(self, name: str, weight: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        count = self.counts[name] = self.counts.get(name, 0) + 1
        g = gradient * self.rescale
        if self.clip is not None:
            g = np.clip(g, -self.clip, self.clip)
        return self.update(name, weight, g + self.decay * weight, self.rate(count), count)

    def update(self, name: str, w: np.ndarray, g: np.ndarray, rate: float, count: int) -> np.ndarray:
        raise NotImplementedError


class Sgd(Optimizer):
    def __init__(self, rate=0.01, momentum: float = 0.0, **options):
        super().__init__(rate, **options)
        self.momentum = momentum

    def update(self, name, w, g, rate, count):
        if not self.momentum:
            return w - rate * g
        m = self.memory(name, "m", w)
        m *= self.momentum
        m -= rate * g
        return w + m


class Nag(Optimizer):
    def __init__(self, rate=0.01, momentum: float = 0.9, **options):
        super().__init__(rate, **options)
        self.momentum = momentum

    def update(self, name, w, g, rate, count):
        m = self.memory(name, "m", w)
        m *= self.momentum
        m += g
        return w - rate * (g + self.momentum * m)


class Adam(Optimizer):
    def __init__(self, rate=0.001, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8, **options):
        super().__init__(rate, **options)
        self.beta1, self.beta2, self.epsilon = beta1, beta2, epsilon

    def update(self, name, w, g, rate, count):
        m, v = self.memory(name, "m", w), self.memory(name, "v", w)
        m += (1 - self.beta1) * (g - m)
        v += (1 - self.beta2) * (g * g - v)
        corrected = rate * math.sqrt(1 - self.beta2**count) / (1 - self.beta1**count)
        return w - corrected * m / (np.sqrt(v) + self.epsilon)


class Adagrad(Optimizer):
    def __init__(self, rate=0.001, epsilon: float = 1e-8, **options):
        super().__init__(rate, **options)
        self.epsilon = epsilon

    def update(self, name, w, g, rate, count):
        h = self.memory(name, "h", w)
        h += g * g
        return w - rate * g / np.sqrt(h + self.epsilon)


class RmsProp(Optimizer):
    def __init__(self, rate=0.001, rho: float = 0.9, momentum: float = 0.9, epsilon: float = 1e-8, centred: bool = False, **options):
        super().__init__(rate, **options)
        self.rho, self.momentum, self.epsilon, self.centred = rho, momentum, epsilon, centred

    def update(self, name, w, g, rate, count):
        n = self.memory(name, "n", w)
        n += (1 - self.rho) * (g * g - n)
        if not self.centred:
            return w - rate * g / np.sqrt(n + self.epsilon)
        k, d = self.memory(name, "k", w), self.memory(name, "d", w)
        k += (1 - self.rho) * (g - k)
        d *= self.momentum
        d -= rate * g / np.sqrt(n - k * k + self.epsilon)
        return w + d


class Adadelta(Optimizer):
    def __init__(self, rho: float = 0.9, epsilon: float = 1e-8, **options):
        super().__init__(1.0, **options)
        self.rho, self.epsilon = rho, epsilon

    def update(self, name, w, g, rate, count):
        a, d = self.memory(name, "a", w), self.memory(name, "d", w)
        a += (1 - self.rho) * (g * g - a)
        change = np.sqrt(d + self.epsilon) / np.sqrt(a + self.epsilon) * g
        d += (1 - self.rho) * (change * change - d)
        return w - change


def initial(kind: str, shape: tuple[int, ...], seed: int, value: float = 0.0, sigma: float = 0.01, scale: float = 0.07,
            magnitude: float = 3.0, fan: str = "avg") -> np.ndarray:
    """Constant, normal, truncated normal, uniform or Xavier starting values."""
    draw = np.random.default_rng(seed)
    if kind == "constant":
        return np.full(shape, float(value))
    if kind == "normal":
        return draw.normal(0.0, sigma, shape)
    if kind == "truncated":
        out = draw.normal(0.0, 1.0, shape)
        while (far := np.abs(out) > 2).any():
            out[far] = draw.normal(0.0, 1.0, int(far.sum()))
        return out * sigma
    if kind == "uniform":
        return draw.uniform(-scale, scale, shape)
    if kind == "xavier":
        fan_out, fan_in = shape[0], int(np.prod(shape[1:])) if len(shape) > 1 else shape[0]
        width = {"avg": (fan_in + fan_out) / 2, "in": fan_in, "out": fan_out}[fan]
        limit = math.sqrt(magnitude / width)
        return draw.uniform(-limit, limit, shape)
    raise ValueError(f"unknown initialiser {kind}")
