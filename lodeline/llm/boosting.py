"""Gradient-boosted trees for two classes, with histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Full binary trees: a feature and a threshold per inner node, a value per leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        at_row = np.arange(len(rows))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            place = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                place = 2 * place + 1 + (rows[at_row, features[place]] > thresholds[place])
            out += leaves[place - (len(leaves) - 1)]
        return out


def train(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 1.0) -> Forest:
    """Trees on the logistic loss; a split is the best over the quantiles of all features."""
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    mean = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    odds = np.full(len(rows), start)
    inner = (1 << depth) - 1
    features, thresholds = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = labels - chance, chance * (1 - chance)
        place = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            own = place - first
            gains = np.full((width, rows.shape[1], BINS), -np.inf)
            for f in range(rows.shape[1]):
                cell = own * BINS + binned[:, f]
                g = np.bincount(cell, slope, width * BINS).reshape(width, BINS)
                h = np.bincount(cell, bend, width * BINS).reshape(width, BINS)
                left_g, left_h = g.cumsum(axis=1), h.cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                gains[:, f, : len(cuts[f])] = gain[:, : len(cuts[f])]
            best = gains.reshape(width, -1).argmax(axis=1)
            split_feature, split_bin = best // BINS, best % BINS
            worth = gains.reshape(width, -1)[np.arange(width), best] > 1e-6
            for n in range(width):
                if worth[n]:
                    features[t, first + n] = split_feature[n]
                    thresholds[t, first + n] = cuts[split_feature[n]][split_bin[n]]
            goes_right = rows[np.arange(len(rows)), features[t, place]] > thresholds[t, place]
            place = 2 * place + 1 + goes_right
        leaf = place - inner
        g = np.bincount(leaf, slope, inner + 1)
        h = np.bincount(leaf, bend, inner + 1)
        leaves[t] = rate * g / (h + ridge)
        odds += leaves[t][leaf]
    return Forest(features, thresholds, leaves, start)
