"""A small character model: bidirectional LSTM with CRF transitions, trained and run with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters with an input of their own: printable ASCII, line ends, other letters, anything else.
PRINTABLE = 95
NEWLINE, LETTER, OTHER = PRINTABLE, PRINTABLE + 1, PRINTABLE + 2
N_INPUTS = PRINTABLE + 3
HIDDEN = 8


def inputs(text: str) -> np.ndarray:
    """Input numbers of the characters of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(points < 0xC0, OTHER, LETTER).astype(np.uint8)
    ascii_ = (points >= 32) & (points < 127)
    out[ascii_] = points[ascii_] - 32
    out[(points == 10) | (points == 13)] = NEWLINE
    return out


@dataclass
class Model:
    """Weights: per direction inputs (N_INPUTS x 4H) and recurrence (H x 4H); outputs (2H x tags), bias, transitions."""

    inputs: list[np.ndarray]
    recurrence: list[np.ndarray]
    outputs: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrence, self.outputs, self.bias, self.transitions]


def new_model(tags: int, seed: int, hidden: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    tables = [draw(N_INPUTS, 4 * hidden) for _ in range(2)]
    for t in tables:
        t[:, hidden : 2 * hidden] += 1  # remember at first
    return Model(tables, [draw(hidden, 4 * hidden) for _ in range(2)], draw(2 * hidden, tags), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32))


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in the place of tanh: a quarter of its cost; gates are squash / 2 + 1 / 2."""
    return x / (1 + np.abs(x))


def _slope(a: np.ndarray) -> np.ndarray:
    """Derivative of `squash` where it gives ``a``."""
    b = 1 - np.abs(a)
    return b * b


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of the tags ``y`` (batch x length) of inputs ``x``, and its gradients."""
    batch, length = x.shape
    hidden = model.recurrence[0].shape[0]
    runs = []
    for d in range(2):
        order = range(length) if d == 0 else range(length - 1, -1, -1)
        h, c, steps = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32), []
        states = np.empty((length, batch, hidden), np.float32)
        for t in order:
            z = model.inputs[d][x[:, t]] + h @ model.recurrence[d]
            a = squash(z)
            gates, g = 0.5 * a[:, : 3 * hidden] + 0.5, a[:, 3 * hidden :]
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            before, h_before = c, h
            c = f * c + i * g
            tc = squash(c)
            h = o * tc
            states[t] = h
            steps.append((t, i, f, o, g, before, tc, h_before, _slope(a)))
        runs.append((states, steps))
    features = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    scores = features @ model.outputs + model.bias
    # Forward and backward sums of the chain.
    trans, tags = model.transitions, model.bias.size
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, length):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in range(length - 2, -1, -1):
        beta[t] = _logsumexp(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[-1], 1)
    rows = np.arange(batch)
    gold = sum(scores[t, rows, y[:, t]] for t in range(length)) + sum(trans[y[:, t - 1], y[:, t]] for t in range(1, length))
    loss = float((total - gold).mean())
    d_scores = np.exp(alpha + beta - total[None, :, None])
    d_trans = np.zeros_like(trans)
    for t in range(1, length):
        d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(d_trans, (y[:, t - 1], y[:, t]), -1)
    d_scores[np.arange(length)[:, None], rows[None, :], y.T] -= 1
    d_scores /= batch
    d_trans /= batch
    flat = d_scores.reshape(-1, tags)
    d_outputs, d_bias = features.reshape(-1, 2 * hidden).T @ flat, flat.sum(0)
    d_features = d_scores @ model.outputs.T
    d_inputs, d_recurrence = [], []
    for d in range(2):
        d_in, d_rec = np.zeros_like(model.inputs[d]), np.zeros_like(model.recurrence[d])
        dh_next, dc_next = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        for t, i, f, o, g, before, tc, h_before, slope in reversed(runs[d][1]):
            dh = d_features[t][:, d * hidden : (d + 1) * hidden] + dh_next
            dc = dh * o * _slope(tc) + dc_next
            dz = np.concatenate([dc * g * 0.5, dc * before * 0.5, dh * tc * 0.5, dc * i], axis=1) * slope
            np.add.at(d_in, x[:, t], dz)
            d_rec += h_before.T @ dz
            dh_next, dc_next = dz @ model.recurrence[d].T, dc * f
        d_inputs.append(d_in)
        d_recurrence.append(d_rec)
    return loss, [*d_inputs, *d_recurrence, d_outputs, d_bias, d_trans]


def train(x: np.ndarray, y: np.ndarray, tags: int, epochs: int, seed: int, batch: int = 64, rate: float = 0.02, hidden: int = HIDDEN) -> Model:
    """A model fitted to tagged windows by Adam, in an order drawn from ``seed``."""
    model, rng = new_model(tags, seed, hidden), np.random.default_rng(seed + 1)
    first = [np.zeros_like(a) for a in model.arrays()]
    second = [np.zeros_like(a) for a in model.arrays()]
    step, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            _, grads = gradients(model, x[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            pace = rate * (1 - 0.95 * step / steps)
            for a, g, m, v in zip(model.arrays(), grads, first, second):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def emissions(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tag scores (length x tags x windows) of windows ``x`` (length x windows), longest window first.

    Only the windows that reach a place are worked on there; scores beyond a window's length are not set.
    """
    length, n = x.shape
    hidden, tags = model.recurrence[0].shape[0], model.bias.size
    out = np.empty((length, tags, n), np.float32)
    active = np.searchsorted(-lengths, -np.arange(length), side="left")  # windows longer than t
    places = x.astype(np.intp)
    room = [np.empty((4 * hidden, n), np.float32) for _ in range(3)]
    small = [np.empty((hidden, n), np.float32) for _ in range(2)]
    for d in range(2):
        table = np.ascontiguousarray(model.inputs[d].T)
        weights = np.ascontiguousarray(model.recurrence[d].T)
        read = np.ascontiguousarray(model.outputs[d * hidden : (d + 1) * hidden].T)
        state = [np.zeros((hidden, n), np.float32) for _ in range(2)]
        k = -1
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            if int(active[t]) != k:
                # Arrays of exactly the active windows, so that every operation runs over one block.
                k = int(active[t])
                z, y, w = (np.ndarray((4 * hidden, k), np.float32, buffer=r) for r in room)
                sc, sh = (np.ndarray((hidden, k), np.float32, buffer=r) for r in small)
                grown = [np.zeros((hidden, k), np.float32) for _ in range(2)]
                for g, s in zip(grown, state):
                    both = min(k, s.shape[1])
                    g[:, :both] = s[:, :both]
                state = grown
                h, c = state
            if not k:
                continue
            np.take(table, places[t, :k], axis=1, out=z, mode="clip")
            np.matmul(weights, h, out=y)
            z += y
            np.abs(z, out=w)
            w += 1
            z /= w
            gates = z[: 3 * hidden]
            gates *= 0.5
            gates += 0.5
            c *= z[hidden : 2 * hidden]
            np.multiply(z[:hidden], z[3 * hidden :], out=sc)
            c += sc
            np.abs(c, out=sc)
            sc += 1
            np.divide(c, sc, out=sh)
            np.multiply(sh, z[2 * hidden : 3 * hidden], out=h)
            if d == 0:
                out[t, :, :k] = read @ h + model.bias[:, None]
            else:
                out[t, :, :k] += read @ h
    return out


def viterbi(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Best tags of each window from scores (length x tags x windows), longest window first."""
    length, tags, n = scores.shape
    active = np.searchsorted(-lengths, -np.arange(length), side="left")
    best, back = scores[0].copy(), np.zeros((length, tags, n), np.int8)
    for t in range(1, length):
        k = int(active[t])
        ways = best[:, None, :k] + transitions[:, :, None]
        back[t, :, :k] = ways.argmax(0)
        best[:, :k] = ways.max(0) + scores[t, :, :k]
    last, out = best.argmax(0), []
    for w in range(n):
        path = np.empty(int(lengths[w]), np.int64)
        tag = int(last[w])
        steps = back[: len(path), :, w].tolist()
        for t in range(len(path) - 1, -1, -1):
            path[t] = tag
            tag = steps[t][tag]
        out.append(path)
    return out


def quiet(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """True for windows whose best path is tag 0 throughout, by a bound: no other tag gains anything anywhere.

    A path with other tags changes at most two transitions for every run and one within it for each place;
    each is at best the greatest transition.
    """
    gain = 2 * max(0.0, float(transitions.max() - transitions[0, 0]))
    over = scores[:, 1:].max(axis=1) - scores[:, 0] + gain
    over[np.arange(len(over))[:, None] >= lengths[None, :]] = -1
    return over.max(axis=0) < 0
