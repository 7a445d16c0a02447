"""Small numpy pieces that the learned operators share."""

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps over a dictionary of arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.01):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            m, s = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.weights[k] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)


def calibrate(logits: np.ndarray, labels: np.ndarray, steps: int = 200, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps, with his smoothed targets and a slight pull to slope 1; `counts` rows are alike."""
    n = np.ones(len(labels)) if counts is None else counts
    pos, neg = (n * labels).sum(), (n * (1 - labels)).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * logits + b)
        w, e = n * (p * (1 - p) + 1e-9), n * (p - target)
        grad = np.array([(e * logits).sum() + 0.1 * (a - 1), e.sum()])
        hess = np.array([[(w * logits * logits).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(a, 1e-3), b


def threshold_for_recall(probabilities: np.ndarray, labels: np.ndarray, recall: float) -> float:
    """The highest threshold at which at least `recall` of the positives reach it."""
    own = np.sort(probabilities[labels == 1])
    return float(own[min(len(own) - 1, int(np.floor((1 - recall) * len(own)) ))]) if len(own) else 0.5
