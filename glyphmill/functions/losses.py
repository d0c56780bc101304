"""Offline mask metrics: dice and cross entropy losses, and the error of a predicted overlap; of arrays in numpy, and of array columns as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def dice(logits: np.ndarray, truth: np.ndarray, smooth: float = 1.0) -> float:
    """1 less twice the overlap over the sum."""
    p = probability(logits)
    return float(1 - (2 * (p * truth).sum() + smooth) / (p.sum() + truth.sum() + smooth))


def cross_entropy(logits: np.ndarray, truth: np.ndarray) -> float:
    return float(np.mean(np.maximum(logits, 0) - logits * truth + np.log1p(np.exp(-np.abs(logits)))))


def overlap_error(predicted: float, logits: np.ndarray, truth: np.ndarray) -> float:
    """Squared error of a predicted overlap against that of the mask the logits stand for, which is 0 for two empty masks."""
    mask, truth = logits > 0, truth > 0
    return float((predicted - (mask & truth).sum() / max((mask | truth).sum(), 1)) ** 2)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dice_of(logits: Column, truth: Column, smooth: float = 1.0) -> Column:
    """``dice`` of two array columns of doubles."""
    p = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    return 1 - (2 * _total(F.zip_with(p, truth, lambda a, b: a * b)) + smooth) / (_total(p) + _total(truth) + smooth)


def cross_entropy_of(logits: Column, truth: Column) -> Column:
    """``cross_entropy`` of two array columns of doubles."""
    each = F.zip_with(logits, truth, lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))
    return _total(each) / F.size(logits)


def overlap_error_of(predicted: Column, logits: Column, truth: Column) -> Column:
    """``overlap_error`` of two array columns of doubles."""
    both = _total(F.zip_with(logits, truth, lambda x, t: ((x > 0) & (t > 0)).cast("double")))
    either = _total(F.zip_with(logits, truth, lambda x, t: ((x > 0) | (t > 0)).cast("double")))
    return F.pow(predicted - both / F.greatest(either, F.lit(1.0)), F.lit(2.0))
