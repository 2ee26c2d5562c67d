"""Small logistic models, fitted by Newton's method on bounded samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardised inputs, an L2 penalty and case weights; ``logit`` gives log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w = np.ones(len(x)) if weight is None else weight
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        self.beta = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * self.beta)
            size = np.abs(step).max()
            self.beta += step * min(1.0, 5 / max(size, 1e-12))
            if size < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
