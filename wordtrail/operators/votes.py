"""Combining predictions: votes, soft votes, cascades and pairwise deciders.

Everything is a column expression over one row's predictions, so any number of models costs a
single projection. :func:`apply_models` turns fitted MLlib models into such columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wordtrail.functions.arrays import (add_arrays, best_label, best_position, let, sum_columns,
                                        value_counts)
from wordtrail.functions.hashing import _col


def apply_models(df: DataFrame, models: Sequence, prefix: str = "pred_",
                 names: Sequence | None = None) -> DataFrame:
    """Run fitted models and keep only ``<prefix><name>`` (int) and ``prob_<name>`` (array)."""
    for name, model in zip(names or range(len(models)), models):
        before = df.columns
        scored = model.transform(df)
        added = [F.col(model.getPredictionCol()).cast("int").alias(f"{prefix}{name}")]
        if model.hasParam("probabilityCol"):
            added.append(vector_to_array(model.getProbabilityCol()).alias(f"prob_{name}"))
        df = scored.select(*before, *added)
    return df


def mean_vote(*predictions: Column | str) -> Column:
    """Mean of the predictions, half rounded up."""
    return F.round(sum_columns(*predictions) / len(predictions)).cast("int")


def hard_vote(predictions: Column | str) -> Column:
    """Most frequent label of an array, ties to the smallest, 0 for an empty array."""
    ranked = F.transform(value_counts(_col(predictions)), lambda c: F.struct(-c.n, c.label))
    return F.coalesce(F.array_min(ranked).getField("label"), F.lit(0))


def weighted_hard_vote(predictions: Column | str, weight: float = 1.0) -> Column:
    """``struct<label, weight>`` of the most frequent label and its weighted count."""
    ranked = F.transform(value_counts(_col(predictions)),
                         lambda c: F.struct((-c.n * F.lit(weight)).alias("negative"), c.label.alias("label")))
    return let(F.array_min(ranked), lambda best: F.struct(
        best.label.cast("double").alias("label"), (-best.negative).cast("double").alias("weight")))


def committee_vote(predictions: Sequence[Column | str], weight: float = 1.0) -> Column:
    """Weighted hard vote of several models with the same labels."""
    return weighted_hard_vote(F.array(*[_col(p).cast("int") for p in predictions]), weight)


def vote_of_votes(votes: Column | str, labels: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> Column:
    """Label with the largest sum of weights over ``array<struct<label, weight>>``.

    Label 0 is ignored, ties go to the smallest label, a single vote passes through unchanged.
    """
    votes = _col(votes)

    def score(label: Column) -> Column:
        mine = F.filter(votes, lambda v: v.label == label)
        total = F.aggregate(mine, F.lit(0.0), lambda s, v: s + v.weight)
        return F.struct((-total).alias("negative"), label.alias("label"))

    totals = F.transform(F.array(*[F.lit(float(l)) for l in labels]), score)
    return F.when(F.size(votes) == 1, F.get(votes, F.lit(0)).label).otherwise(F.array_min(totals).label)


def mode_vote(values: Column | str) -> Column:
    """Most frequent value, the one seen first on ties, 0 for an empty or null array."""
    ranked = F.transform(value_counts(_col(values)), lambda c: F.struct(-c.n, c["first"], c.label))
    return F.coalesce(F.array_min(ranked).getField("label"), F.lit(0))


def own_class_vote(probabilities: Sequence[Column | str], labels: Sequence) -> Column:
    """One-vs-rest: the label whose model is surest of its own class (last vector slot)."""
    own = F.array(*[F.try_element_at(_col(p), F.lit(-1)) for p in probabilities])
    return best_label(F.array(*[F.lit(l) for l in labels]), own)


def own_label_vote(metadata: Sequence[Column | str], skipped: Sequence[str] = ("sentence", "0")) -> Column:
    """One-vs-rest over label-to-probability maps: each map's first key outside the skip list is
    its class."""
    labels, sure = [], []
    for m in metadata:
        m = _col(m)
        label = F.get(F.filter(F.map_keys(m), lambda k: ~k.isin(list(skipped))), F.lit(0))
        labels.append(label.try_cast("double"))
        sure.append(F.try_element_at(m, label).try_cast("double"))
    return best_label(F.array(*labels), F.array(*sure))


def map_soft_vote(metadata: Sequence[Column | str], labels: Sequence[str]) -> Column:
    """Label with the largest probability sum over label-to-probability maps; the labels are
    compared in string order and the first one wins ties."""
    ordered = sorted(labels)
    sums = add_arrays(*[F.array(*[F.try_element_at(_col(m), F.lit(l)).try_cast("double") for l in ordered])
                        for m in metadata])
    return best_label(F.array(*[F.lit(l) for l in ordered]), sums).try_cast("int")


def soft_vote(*probabilities: Column | str) -> Column:
    """0-based class with the largest probability sum."""
    return best_position(add_arrays(*probabilities))


def cascade(predictions: Sequence[Column | str], classes: Sequence) -> Column:
    """Model j claims the rows it gives class j; what no model claims gets the extra last class."""
    out = None
    for prediction, label in zip(predictions, classes):
        hit = _col(prediction) == label
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(classes[len(predictions)]))


def first_valid(predictions: Sequence[Column | str], classes: Sequence,
                valid: Sequence[int] = (1, 2, 3, 4, 5, 6)) -> Column:
    """First prediction that is a valid score; the last model's other rows get the extra class."""
    last = len(predictions) - 1
    columns = [_col(p) for p in predictions[:-1]]
    final = _col(predictions[last])
    columns.append(F.when(final == classes[last], final).otherwise(F.lit(classes[last + 1])))
    return F.coalesce(*[F.when(c.isin(list(valid)), c) for c in columns])


def refine_neighbours(start: Column | str, pairs: Sequence[tuple], decisions: Sequence[Column | str]) -> Column:
    """Neighbouring classes decided again: pairs in ascending order, each with its own decision
    column. A row that stands in the pair and is given its lower class stays there; every row
    left over takes the decision of the last pair."""
    start = _col(start)
    order = sorted(range(len(pairs)), key=lambda i: tuple(pairs[i]))
    out = None
    for i in order[:-1]:
        low = pairs[i][0]
        frozen = start.isin(list(pairs[i])) & (_col(decisions[i]) == low)
        out = F.when(frozen, _col(decisions[i])) if out is None else out.when(frozen, _col(decisions[i]))
    final = _col(decisions[order[-1]])
    return final if out is None else out.otherwise(final)


def pair_label(prediction: Column | str, pair: tuple) -> Column:
    """0/1 of a pair model to the pair's members."""
    return F.when(_col(prediction) == 1, F.lit(pair[1])).otherwise(F.lit(pair[0]))


def pair_code(label: Column | str, pair: tuple) -> Column:
    """A pair's member back to 0/1."""
    return F.when(_col(label) == pair[1], F.lit(1)).otherwise(F.lit(0))


def pairwise_vote(predictions: Sequence[Column | str], pairs: Sequence[tuple]) -> Column:
    """Hard vote over the winners of all pair models."""
    return hard_vote(F.array(*[pair_label(p, pair) for p, pair in zip(predictions, pairs)]))


def pairs_for(reference: Column | str, pairs: Sequence[tuple[int, int]]) -> Column:
    """Sorted pairs that share a digit with the reference key; 0 and 123456 ask for all."""
    key = _col(reference).cast("string")
    table = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in sorted(set(pairs))])
    involved = F.filter(table, lambda p: F.exists(p, lambda d: F.contains(key, d.cast("string"))))
    return F.when(key.isin("0", "123456"), table).otherwise(involved)


def vote_share(label: Column | str, votes: Column | str, target, models: int = 100) -> Column:
    """Share of the models that voted for the target; the other side's share otherwise."""
    share = _col(votes) / models
    return F.when(_col(label) == target, share).otherwise(1 - share)


def allowed_labels(binary: Sequence[Column | str], labels: Sequence[int],
                   universe: Sequence[int] = (1, 2, 3, 4, 5)) -> Column:
    """Labels not ruled out by their own binary model (0); all of them when none is left."""
    every = F.array(*[F.lit(l) for l in universe])
    excluded = F.array_compact(F.array(*[F.when(_col(b).cast("int") == 0, F.lit(l))
                                         for b, l in zip(binary, labels)]))
    left = F.array_except(every, excluded)
    return F.when(F.size(left) > 0, left).otherwise(every)


def vote_within(allowed: Column | str, predictions: Column | str) -> Column:
    """Hard vote over the allowed predictions; over the allowed labels when none is."""
    allowed = _col(allowed)
    kept = F.filter(_col(predictions), lambda p: F.array_contains(allowed, p))
    return hard_vote(F.when(F.size(kept) > 0, kept).otherwise(allowed))
