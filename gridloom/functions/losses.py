"""Losses and hits per record as Column expressions; the caller aggregates them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import arrays as A
from gridloom.functions.numeric import softplus


def l1(pred: Column, label: Column, weight: float = 1.0) -> Column:
    return F.lit(weight) * F.abs(label - pred)


def l2(pred: Column, label: Column, weight: float = 0.5) -> Column:
    return F.lit(weight) * (label - pred) * (label - pred)


def hinge(pred: Column, label: Column, margin: float = 1.0, weight: float = 1.0) -> Column:
    return F.lit(weight) * F.greatest(F.lit(margin) - label * pred, F.lit(0.0))


def sigmoid_cross_entropy(pred: Column, label: Column, logits: bool = True, epsilon: float = 1e-12) -> Column:
    """Binary cross entropy, on logits in the stable form or on probabilities."""
    if logits:
        return softplus(pred) - pred * label
    return -(label * F.ln(pred + F.lit(epsilon)) + (1 - label) * F.ln(1 - pred + F.lit(epsilon)))


def softmax_cross_entropy(scores: Column, label: Column, logits: bool = True) -> Column:
    """Cross entropy with a class number as label."""
    logp = A.log_softmax(scores) if logits else scores
    return -A.pick(logp, label)


def softmax_cross_entropy_dense(scores: Column, target: Column, logits: bool = True) -> Column:
    """Cross entropy with a probability per class as label."""
    logp = A.log_softmax(scores) if logits else scores
    return -A.dot(logp, target)


def masked_softmax_cross_entropy(steps: Column, labels: Column, length: Column, logits: bool = True) -> Column:
    """Mean over the full (padded) sequence; steps at or past ``length`` count as zero."""
    losses = F.zip_with(steps, labels, lambda s, y: softmax_cross_entropy(s, y, logits))
    return A.mean(A.sequence_mask(losses, length))


def is_right(scores: Column, label: Column) -> Column:
    return (A.arg_max(scores) == label).cast("int")


def is_right_one_hot(scores: Column, label: Column) -> Column:
    """The greatest score stands where the greatest entry of the label array does (the first on ties); null if either is null."""
    return (A.arg_max(scores) == A.arg_max(label)).cast("int")


def is_right_binary(pred: Column, label: Column, threshold: float = 0.0) -> Column:
    return ((pred >= F.lit(threshold)).cast("int") == label).cast("int")


def in_top_k(scores: Column, label: Column, k: int) -> Column:
    """Whether the label is among the k best classes; k is cut to the number of classes."""
    return F.array_contains(F.slice(A.arg_sort(scores, ascending=False), 1, k), label.cast("int")).cast("int")


def weight_penalty(value: Column, l1_lambda: float = 0.0, l2_lambda: float = 0.0) -> Column:
    """Summed L1, L2 or elastic-net penalty over a parameter table (an aggregate)."""
    return F.lit(l1_lambda) * F.sum(F.abs(value)) + F.lit(l2_lambda) * F.sum(value * value)
