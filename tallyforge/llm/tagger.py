"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, scores and decoding."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
# Tag 0 is outside; each kind has a tag for its first and for its further characters.
TAGS = 1 + 2 * len(KINDS)
LETTERS = 100


def codes(text: str) -> np.ndarray:
    """Small numbers for characters: printable ASCII each, other letters and the rest as two more."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.where((points >= 32) & (points < 127), points - 30, 1)
    return np.where(points > 160, LETTERS - 2, out).astype(np.int16)


def _allowed() -> np.ndarray:
    """Transitions that keep spans whole: a further character follows its own kind only."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, hidden: int = 16, embed: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        shape = {"E": (LETTERS, embed), "O": (2 * hidden, TAGS), "o": (TAGS,), "T": (TAGS, TAGS)}
        for d in "fb":
            shape |= {f"W{d}": (embed + hidden, 4 * hidden), f"c{d}": (4 * hidden,)}
        self.hidden = hidden
        self.p = {k: (r.normal(0, 0.15, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        for d in "fb":
            self.p[f"c{d}"][hidden : 2 * hidden] = 1
        self.p["o"][0] = 1

    def _pass(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (time, batch, hidden) of one direction over embedded characters (time, batch, embed)."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden), np.float32)
        c, w, bias = h, self.p[f"W{d}"], self.p[f"c{d}"]
        from_x = x @ w[: x.shape[2]] + bias
        states, kept = np.empty((*x.shape[:2], n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = from_x[t] + h @ w[x.shape[2] :]
            gates = 1 / (1 + np.exp(-z[:, : 3 * n]))
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            before, last = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            states[t] = h = o * squashed
            if keep:
                kept.append((t, i, f, o, g, before, last, squashed))
        return states, kept

    def scores(self, letters: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, tags) of windows of character codes (batch, time)."""
        x = self.p["E"][letters.T]
        both = np.concatenate([self._pass(x, d, False)[0] for d in "fb"], 2)
        return (both @ self.p["O"] + self.p["o"]).transpose(1, 0, 2)

    def _back(self, x, d, kept, dstates):
        n, e = self.hidden, x.shape[2]
        w = self.p[f"W{d}"]
        dw, dbias, dx = np.zeros_like(w), np.zeros_like(self.p[f"c{d}"]), np.zeros_like(x)
        dh = dc = np.zeros((x.shape[1], n), np.float32)
        for t, i, f, o, g, before, last, squashed in reversed(kept):
            dh = dh + dstates[t]
            dc = dc + dh * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], 1)
            dw[:e] += x[t].T @ dz
            dw[e:] += last.T @ dz
            dbias += dz.sum(0)
            dx[t] = dz @ w[:e].T
            dh, dc = dz @ w[e:].T, dc * f
        return dw, dbias, dx

    def gradients(self, letters: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags under the CRF, and its gradients."""
        x = self.p["E"][letters.T]
        passes = {d: self._pass(x, d, True) for d in "fb"}
        both = np.concatenate([passes[d][0] for d in "fb"], 2)
        emit = both @ self.p["O"] + self.p["o"]
        steps, size = emit.shape[:2]
        move = np.where(ALLOWED, self.p["T"], -1e4).astype(np.float32)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = emit[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(move[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        demit = np.exp(alpha + beta - total[None, :, None])
        dmove = np.zeros_like(move)
        for t in range(1, steps):
            joint = alpha[t - 1][:, :, None] + move + (emit[t] + beta[t])[:, None, :] - total[:, None, None]
            dmove += np.exp(joint).sum(0)
        gold, rows = tags.T, np.arange(size)
        score = sum(emit[t, rows, gold[t]] for t in range(steps)) + sum(move[gold[t - 1], gold[t]] for t in range(1, steps))
        for t in range(steps):
            demit[t, rows, gold[t]] -= 1
        np.subtract.at(dmove, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        demit /= size
        grads = {"o": demit.sum((0, 1)), "O": both.reshape(-1, both.shape[2]).T @ demit.reshape(-1, TAGS), "T": dmove * ALLOWED / size}
        dboth = demit @ self.p["O"].T
        dx = 0
        for k, d in enumerate("fb"):
            part = dboth[:, :, k * self.hidden : (k + 1) * self.hidden]
            grads[f"W{d}"], grads[f"c{d}"], more = self._back(x, d, passes[d][1], part)
            dx = dx + more
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], letters.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((total - score).mean()), grads

    def train(self, letters: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 48, rate: float = 0.015, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            order, found = r.permutation(len(letters)), []
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                loss, grads = self.gradients(letters[chosen], tags[chosen])
                found.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * (1 - 0.9 * epoch / epochs) * min(1.0, 5.0 / max(norm, 1e-9))
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(found)))
        return losses

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """Best tags of one stretch from its scores (time, tags), spans whole."""
        move = np.where(ALLOWED, self.p["T"], -1e4)
        best = emit[0].copy()
        best[2::2] = -1e4
        came = np.zeros(emit.shape, np.int8)
        for t in range(1, len(emit)):
            each = best[:, None] + move
            came[t] = each.argmax(0)
            best = each.max(0) + emit[t]
        tags = np.empty(len(emit), np.int8)
        tags[-1] = best.argmax()
        for t in range(len(emit) - 1, 0, -1):
            tags[t - 1] = came[t, tags[t]]
        return tags
