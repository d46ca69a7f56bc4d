"""A character-level bidirectional LSTM with CRF transitions in numpy: training and decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
# Tag 0 is outside; 1 + 2 k begins a span of kind k and 2 + 2 k goes on with it.
TAGS = 1 + 2 * len(KINDS)
NEVER = np.float32(-1e4)
EMBEDDED, HIDDEN = 12, 20
STEPS, BATCH, RATE = 320, 48, 0.012

# Letters are told apart without case, digits are all alike, signs are themselves, and the rest is one class.
_SIGNS = " \n\t@.+-()[]{}<>_%:/\"'=,;#$*&|!?"
PADDING, OTHER, LETTER, DIGIT = 0, 1, 2, 3
_TABLE = np.full(256, OTHER, np.uint8)
_TABLE[0xC0:] = LETTER
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _TABLE[ord(_c)] = _TABLE[ord(_c.upper())] = 4 + _i
_TABLE[ord("0"):ord("9") + 1] = DIGIT
for _i, _c in enumerate(_SIGNS):
    _TABLE[ord(_c)] = 30 + _i
CLASSES = 30 + len(_SIGNS)


def classes(text: str) -> np.ndarray:
    """Class of every code point; those over 255 count as letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 256, _TABLE[np.minimum(codes, 255)], LETTER).astype(np.uint8)


def allowed() -> np.ndarray:
    """0 where one tag may follow another, ``NEVER`` where a span would go on that has not begun."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = NEVER
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _lstm(z: np.ndarray, mask: np.ndarray, recurrent: np.ndarray, keep: bool):
    """States of all steps from ``z`` (steps, rows, 4 hidden); ``keep`` also returns what the gradient needs."""
    steps, rows, _ = z.shape
    h = c = np.zeros((rows, HIDDEN), np.float32)
    out, kept = np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        a = z[t] + h @ recurrent
        gates = _sigmoid(a[:, :3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(a[:, 3 * HIDDEN:])
        before = (h, c)
        m = mask[t][:, None]
        c = (f * c + i * g) * m
        squashed = np.tanh(c)
        h = o * squashed * m
        out[t] = h
        if keep:
            kept.append((i, f, o, g, squashed, *before, m))
    return out, kept


def _lstm_gradient(d_out: np.ndarray, kept: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by ``z`` and by the recurrent weights."""
    steps, rows, _ = d_out.shape
    d_z, d_recurrent = np.empty((steps, rows, 4 * HIDDEN), np.float32), np.zeros_like(recurrent)
    d_h, d_c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, squashed, h, c, m = kept[t]
        d_h = (d_h + d_out[t]) * m
        d_c = (d_c + d_h * o * (1 - squashed * squashed)) * m
        d_a = d_z[t]
        d_a[:, :HIDDEN] = d_c * g * i * (1 - i)
        d_a[:, HIDDEN:2 * HIDDEN] = d_c * c * f * (1 - f)
        d_a[:, 2 * HIDDEN:3 * HIDDEN] = d_h * squashed * o * (1 - o)
        d_a[:, 3 * HIDDEN:] = d_c * i * (1 - g * g)
        d_recurrent += h.T @ d_a
        d_h, d_c = d_a @ recurrent.T, d_c * f
    return d_z, d_recurrent


def crf_gradient(scores: np.ndarray, mask: np.ndarray, tags: np.ndarray, transitions: np.ndarray):
    """Negative log-likelihood of ``tags``, and its gradients by ``scores`` (steps, rows, tags) and transitions.

    Rows may be padded at their end; ``transitions`` includes what is never allowed.
    """
    steps, rows, _ = scores.shape
    alpha = np.empty_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        new = _log_sum(alpha[t - 1][:, :, None] + transitions, 1) + scores[t]
        alpha[t] = np.where(mask[t][:, None] > 0, new, alpha[t - 1])
    total = _log_sum(alpha[-1], 1)
    beta = np.zeros_like(scores[0])
    d_scores, d_transitions = np.zeros_like(scores), np.zeros_like(transitions)
    k = np.arange(rows)
    for t in range(steps - 1, -1, -1):
        m = mask[t]
        d_scores[t] = np.exp(alpha[t] + beta - total[:, None]) * m[:, None]
        d_scores[t, k, tags[t]] -= m
        if t:
            ahead = scores[t] + beta
            pair = np.exp(alpha[t - 1][:, :, None] + transitions + ahead[:, None, :] - total[:, None, None])
            d_transitions += (pair * m[:, None, None]).sum(0)
            np.subtract.at(d_transitions, (tags[t - 1], tags[t]), m)
            beta = np.where(m[:, None] > 0, _log_sum(transitions + ahead[:, None, :], 2), beta)
    own = (np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] * mask).sum(0)
    own = own + (transitions[tags[:-1], tags[1:]] * mask[1:]).sum(0)
    return float((total - own).sum()), d_scores, d_transitions


@dataclass
class CharTagger:
    """Weights of the network. Every row of class numbers is tagged on its own; padding is at its end."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def untrained(seed: int) -> CharTagger:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        own = {"embedding": drawn(CLASSES, EMBEDDED, scale=0.5), "out": drawn(2 * HIDDEN, TAGS, scale=0.2),
               "out_bias": np.zeros(TAGS, np.float32), "transitions": np.zeros((TAGS, TAGS), np.float32)}
        for side in ("ahead", "back"):
            own[f"{side}_in"] = drawn(EMBEDDED, 4 * HIDDEN, scale=0.3)
            own[f"{side}_state"] = drawn(HIDDEN, 4 * HIDDEN, scale=0.2)
            own[f"{side}_bias"] = np.repeat(np.asarray([0, 1, 0, 0], np.float32), HIDDEN)
        return CharTagger(own)

    def _scores(self, rows: np.ndarray, keep: bool = False):
        w, steps = self.weights, rows.T
        mask = (steps != PADDING).astype(np.float32)
        sides, kept = [], {}
        for side in ("ahead", "back"):
            turned = slice(None) if side == "ahead" else slice(None, None, -1)
            table = w["embedding"] @ w[f"{side}_in"] + w[f"{side}_bias"]  # one row of inputs for every class
            states, kept[side] = _lstm(table[steps[turned]], mask[turned], w[f"{side}_state"], keep)
            sides.append(states[turned])
        both = np.concatenate(sides, 2)
        return both @ w["out"] + w["out_bias"], mask, both, kept

    def loss_gradient(self, rows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of ``tags`` and its gradient by all weights."""
        w, steps = self.weights, rows.T
        scores, mask, both, kept = self._scores(rows, keep=True)
        loss, d_scores, d_transitions = crf_gradient(scores, mask, tags.T, w["transitions"] + allowed())
        flat = d_scores.reshape(-1, TAGS)
        grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ flat, "out_bias": flat.sum(0), "transitions": d_transitions,
                 "embedding": np.zeros_like(w["embedding"])}
        d_both = d_scores @ w["out"].T
        for n, side in enumerate(("ahead", "back")):
            turned = slice(None) if side == "ahead" else slice(None, None, -1)
            d_z, grads[f"{side}_state"] = _lstm_gradient(d_both[turned][:, :, n * HIDDEN:(n + 1) * HIDDEN], kept[side], w[f"{side}_state"])
            d_table = np.zeros((CLASSES, 4 * HIDDEN), np.float32)
            np.add.at(d_table, steps[turned].ravel(), d_z.reshape(-1, 4 * HIDDEN))
            grads[f"{side}_bias"] = d_table.sum(0)
            grads[f"{side}_in"] = w["embedding"].T @ d_table
            grads["embedding"] += d_table @ w[f"{side}_in"].T
        return loss, grads

    def fit(self, rows: np.ndarray, tags: np.ndarray, seed: int, steps: int = STEPS) -> None:
        """Adam over batches drawn without repetition until all rows have been seen."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        order, at = rng.permutation(len(rows)), 0
        for step in range(1, steps + 1):
            if at >= len(order):
                order, at = rng.permutation(len(rows)), 0
            own = order[at:at + BATCH]
            at += BATCH
            _, grads = self.loss_gradient(rows[own], tags[own])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / len(own)
            rate = RATE * min(1.0, 1.5 - 1.5 * step / (steps + 1))
            for k, g in grads.items():
                g = g / len(own) * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of every row, and how far the score of each tag lies above that of being outside."""
        scores, mask, _, _ = self._scores(rows)
        transitions = self.weights["transitions"] + allowed()
        steps, n, _ = scores.shape
        best, choice = scores[0], np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + transitions
            choice[t] = paths.argmax(1)
            best = np.where(mask[t][:, None] > 0, paths.max(1) + scores[t], best)
            choice[t][mask[t] == 0] = np.arange(TAGS)
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = choice[t][np.arange(n), tags[t]]
        tags = np.where(mask > 0, tags, 0)
        margin = (np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] - scores[:, :, 0]) * mask
        return tags.T, margin.T
