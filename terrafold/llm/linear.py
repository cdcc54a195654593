"""Small models for numpy: linear support vector machines and ordinal regression on bounded samples."""

from __future__ import annotations

import numpy as np


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights, the last one the intercept, of a linear SVM with squared hinge loss; y is -1 or 1, classes count alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    v, rate = w.copy(), 1.0 / (2 * c * float((share[:, None] * x * x).sum()) + 1.0)
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (v - 2 * c * ((share * slack * y) @ x))
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


def rounded(margin: np.ndarray) -> np.ndarray:
    """Margins without their last digits, which depend on the other rows of a product, so that equal rows are predicted alike
    and exact ties are ties."""
    return np.round(margin.astype(float), 4)


class OneVersusOne:
    """An SVM for each pair of classes; the class that wins most, by margin where equal, is predicted."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y.tolist()))
        self.pairs = [(i, j) for i in range(len(self.classes)) for j in range(i + 1, len(self.classes))]
        self.w = []
        for i, j in self.pairs:
            both = (y == self.classes[i]) | (y == self.classes[j])
            self.w.append(svm(x[both], np.where(y[both] == self.classes[i], 1, -1).astype(x.dtype)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and how sure each is: the logistic of the least margin over another class."""
        n = len(x)
        votes, least = np.zeros((n, len(self.classes))), np.full((n, len(self.classes)), 8.0)
        for (i, j), w in zip(self.pairs, self.w, strict=True):
            m = rounded(x @ w[:-1] + w[-1])
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = np.argmax(votes + (np.tanh(least) + 1) / 4, axis=1) if n else np.zeros(0, int)
        margin = least[np.arange(n), best]
        return best, 1 / (1 + np.exp(-4 * margin))


class OneVersusRest:
    """An SVM for each class against all others, fitted together; the class of the largest margin is predicted. Its cost and
    its size grow with the number of classes, not with that of their pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150):
        self.classes = sorted(set(y.tolist()))
        place = {a: i for i, a in enumerate(self.classes)}
        own = np.array([place[a] for a in y.tolist()])
        target = np.full((len(x), len(self.classes)), -1, x.dtype)
        target[np.arange(len(x)), own] = 1
        n = np.bincount(own, minlength=len(self.classes))
        share = np.where(target > 0, 0.5 / n, 0.5 / np.maximum(1, len(x) - n)).astype(x.dtype)
        square = (x * x).sum(1) + 1
        self.w, self.b = np.zeros((x.shape[1], len(n)), x.dtype), np.zeros(len(n), x.dtype)
        v, u, rate = self.w.copy(), self.b.copy(), 1.0 / (2 * c * (share * square[:, None]).sum(0) + 1.0).astype(x.dtype)
        for t in range(1, steps + 1):
            pull = 2 * c * share * target * np.maximum(0, 1 - target * (x @ v + u))
            w, b = v - rate * (v - x.T @ pull), u - rate * (u - pull.sum(0))
            go = (t - 1) / (t + 2)
            v, u, self.w, self.b = w + go * (w - self.w), b + go * (b - self.b), w, b

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and how sure each is: the logistic of its margin over all others."""
        margin = rounded(x @ self.w + self.b)
        best = np.argmax(margin, axis=1) if len(x) else np.zeros(0, int)
        sure = margin[np.arange(len(x)), best] if len(self.classes) > 1 else np.full(len(x), 8.0)
        return best, 1 / (1 + np.exp(-4 * sure.astype(float)))


class Rows:
    """Sparse rows: of each row the columns and values, end to end."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]):
        self.n = np.array([len(c) for c in columns])
        self.columns = np.concatenate([*columns, np.zeros(0, np.int32)]).astype(np.int32)
        self.values = np.concatenate([*values, np.zeros(0, np.float32)]).astype(np.float32)
        self.row = np.repeat(np.arange(len(columns), dtype=np.int32), self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], minlength=len(self.n))

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.row], minlength=width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ordinal_loss(x: Rows, grade: np.ndarray, w: np.ndarray, base: np.ndarray, gaps: np.ndarray, ridge: float) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The mean negative log-likelihood of grades with a ridge on the weights, and its gradient.

    P(grade > k) = logistic(w x - threshold k); the thresholds are base, and each later one is the one before plus the
    exponential of a gap, so they ascend.
    """
    n = max(1, len(grade))
    theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
    score = x.dot(w)
    tail = sigmoid(score[:, None] - theta)
    full = np.hstack([np.ones((len(score), 1)), tail, np.zeros((len(score), 1))])
    own = np.maximum(full[np.arange(len(grade)), grade] - full[np.arange(len(grade)), grade + 1], 1e-9)
    slope = np.hstack([np.zeros((len(score), 1)), tail * (1 - tail), np.zeros((len(score), 1))])
    up, low = slope[np.arange(len(grade)), grade], slope[np.arange(len(grade)), grade + 1]
    g_theta = np.zeros(len(theta) + 2)
    np.add.at(g_theta, grade, up / own / n)
    np.add.at(g_theta, grade + 1, -low / own / n)
    g_theta = g_theta[1:-1]
    g_gaps = np.array([g_theta[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
    loss = -np.log(own).sum() / n + ridge / 2 * float(w @ w)
    return loss, (x.back(-(up - low) / own / n, len(w)) + ridge * w, np.array([g_theta.sum()]), g_gaps)


def ordinal(x: Rows, grade: np.ndarray, grades: int, width: int, ridge: float = 1e-5, steps: int = 100, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds that make the grades likely (ordinal_loss), by Adam."""
    w, base, gaps = np.zeros(width), np.zeros(1), np.zeros(max(0, grades - 2))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, base, gaps)]
    for t in range(1, steps + 1):
        _, grads = ordinal_loss(x, grade, w, base, gaps, ridge)
        for p, g, (m, v) in zip((w, base, gaps), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, np.concatenate([base, base + np.cumsum(np.exp(gaps))])
