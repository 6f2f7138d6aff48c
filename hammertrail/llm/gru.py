"""A bidirectional gated recurrent network in numpy, with backpropagation through time.

Sequences lie as (time, batch, channel) arrays in single precision. The gates' inputs are given ready; the caller
computes them from whatever it reads and takes their gradients back.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Gru:
    """One direction: update, reset and candidate gates over ``size`` units."""

    def __init__(self, size: int, random: np.random.Generator):
        self.size = size
        self.params = {
            "recurrent": (random.normal(size=(size, 3 * size)) / np.sqrt(size)).astype(np.float32),
            "candidate_bias": np.zeros(size, np.float32),
        }

    def forward(self, inputs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, batch, size) for gate inputs (time, batch, 3 * size); ``keep`` remembers what training needs."""
        n, u, bias = self.size, self.params["recurrent"], self.params["candidate_bias"]
        state = np.zeros((inputs.shape[1], n), np.float32)
        states, memory = np.empty((*inputs.shape[:2], n), np.float32), []
        for t in range(len(inputs)):
            inner = state @ u
            gates = inputs[t, :, : 2 * n] + inner[:, : 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :n], gates[:, n:]
            hidden = inner[:, 2 * n :] + bias
            candidate = np.tanh(inputs[t, :, 2 * n :] + reset * hidden)
            if keep:
                memory.append((state, update, reset, hidden, candidate))
            state = candidate + update * (state - candidate)
            states[t] = state
        return states, memory

    def backward(self, grad_states: np.ndarray, memory: list) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the gate inputs and of the parameters, from the gradients of all states."""
        n, u = self.size, self.params["recurrent"]
        grad_inputs = np.empty((*grad_states.shape[:2], 3 * n), np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.params.items()}
        carried = np.zeros_like(grad_states[0])
        for t in range(len(grad_states) - 1, -1, -1):
            state, update, reset, hidden, candidate = memory[t]
            g = grad_states[t] + carried
            g_candidate = g * (1 - update) * (1 - candidate * candidate)
            g_hidden = g_candidate * reset
            g_update = g * (state - candidate) * update * (1 - update)
            g_reset = g_candidate * hidden * reset * (1 - reset)
            inner = np.concatenate([g_update, g_reset, g_hidden], axis=1)
            grad_inputs[t] = np.concatenate([g_update, g_reset, g_candidate], axis=1)
            grads["recurrent"] += state.T @ inner
            grads["candidate_bias"] += g_hidden.sum(axis=0)
            carried = g * update + inner @ u.T
        return grad_inputs, grads


    def read(self, table: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """The states of ``forward`` for gate inputs ``table[ids]``, one (batch, size) array per step.

        For scoring: each gate is a contiguous array of its own, and sigmoids are written as (1 + tanh(x / 2)) / 2 with
        the halves taken into the weights.
        """
        n, u, bias = self.size, self.params["recurrent"], self.params["candidate_bias"]
        of_update, of_reset, of_candidate = (np.ascontiguousarray(table[:, k * n : (k + 1) * n] * f) for k, f in enumerate((0.5, 0.5, 1)))
        by_update, by_reset, by_candidate = (np.ascontiguousarray(u[:, k * n : (k + 1) * n] * np.float32(0.5)) for k in range(3))
        half_bias = np.broadcast_to(bias * np.float32(0.5), (ids.shape[1], n)).copy()
        state, states, half = np.zeros((ids.shape[1], n), np.float32), [], np.float32(0.5)
        for row in ids:
            reset = state @ by_reset
            reset += of_reset.take(row, axis=0)
            np.tanh(reset, out=reset)
            hidden = state @ by_candidate
            hidden += half_bias
            reset *= hidden
            hidden += reset
            hidden += of_candidate.take(row, axis=0)
            np.tanh(hidden, out=hidden)
            update = state @ by_update
            update += of_update.take(row, axis=0)
            np.tanh(update, out=update)
            gap = state - hidden
            gap *= half
            update *= gap
            hidden += gap
            hidden += update
            state = hidden
            states.append(state)
        return states


class BiGru:
    """Two directions; their states stand side by side."""

    def __init__(self, size: int, random: np.random.Generator):
        self.size, self.ahead, self.back = size, Gru(size, random), Gru(size, random)

    @property
    def params(self) -> dict[str, np.ndarray]:
        return {f"{d}.{k}": v for d, net in (("ahead", self.ahead), ("back", self.back)) for k, v in net.params.items()}

    def forward(self, inputs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """States (time, batch, 2 * size) for gate inputs (time, batch, 6 * size)."""
        cut = 3 * self.size
        ahead, m1 = self.ahead.forward(inputs[:, :, :cut], keep)
        back, m2 = self.back.forward(inputs[::-1, :, cut:], keep)
        return np.concatenate([ahead, back[::-1]], axis=2), (m1, m2)

    def read(self, table: np.ndarray, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """States of both directions per step, for gate inputs ``table[ids]`` with ids (time, batch)."""
        cut = 3 * self.size
        return self.ahead.read(table[:, :cut], ids), self.back.read(table[:, cut:], ids[::-1])[::-1]

    def backward(self, grad_states: np.ndarray, memory: tuple) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        g1, p1 = self.ahead.backward(grad_states[:, :, : self.size], memory[0])
        g2, p2 = self.back.backward(grad_states[::-1, :, self.size :], memory[1])
        grads = {f"ahead.{k}": v for k, v in p1.items()} | {f"back.{k}": v for k, v in p2.items()}
        return np.concatenate([g1, g2[::-1]], axis=2), grads


class Adam:
    """Adam steps on a dictionary of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.count = params, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in params.items()}
        self.second = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.count += 1
        for k, g in grads.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            scale = self.rate / (1 - 0.9**self.count)
            self.params[k] -= (scale * self.first[k] / (np.sqrt(self.second[k] / (1 - 0.99**self.count)) + 1e-8)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
