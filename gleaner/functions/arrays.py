"""Array arithmetic: divergences over kept entries, schedules, frame counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not once for each element that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.log(total(F.transform(logits, lambda x: F.exp(x - top)))))


def softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda whole: F.transform(logits, lambda x: F.exp(x - whole)))


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of two arrays of probabilities; terms with p = 0 are 0."""
    terms = F.zip_with(p, q, lambda a, b: F.when(a <= 0, 0.0).otherwise(a * (F.log(a) - F.log(b))))
    return total(terms)


def top_with_rest(p: Column, q: Column, k: int) -> Column:
    """Divergence over the k largest entries of p, each its own bin, and one bin for all others.

    Rounding may carry the kept mass above 1; the rest is then an empty bin.
    """
    pairs = F.array_sort(F.arrays_zip((F.transform(p, lambda x: -x)).alias("n"), p.alias("p"), q.alias("q")))

    def over(kept: Column) -> Column:
        ps, qs = F.transform(kept, lambda e: e.p), F.transform(kept, lambda e: e.q)
        rest_p, rest_q = F.greatest(F.lit(0.0), 1.0 - total(ps)), F.greatest(F.lit(1e-12), 1.0 - total(qs))
        tail = let(rest_p, lambda r: F.when(r <= 1e-12, 0.0).otherwise(r * (F.log(r) - F.log(rest_q))))
        return divergence(ps, qs) + tail

    return let(F.slice(pairs, 1, k), over)


def schedule(step: Column, total: int, warm_up: int, cool_down: float, peak: float) -> Column:
    """Linear warm-up, flat, then 1 - sqrt of the share of the cool-down that is over."""
    begin = total * (1 - cool_down)
    return (
        F.when(step < warm_up, peak * (step + 1) / warm_up)
        .when(step < begin, F.lit(peak))
        .otherwise(peak * (1 - F.sqrt(F.least(F.lit(1.0), (step - begin) / (total - begin)))))
    )


def frames(samples: Column, hop: int = 160, halvings: int = 3) -> Column:
    """Frames after a hop and some halvings that round up."""
    n = F.floor(samples / hop)
    for _ in range(halvings):
        n = F.floor((n - 1) / 2) + 1
    return n


def ragged(flat: Column, offsets: Column) -> Column:
    """The lists that ``offsets`` (one more than there are lists, from 0) cut a flat array into."""
    return F.transform(F.sequence(F.lit(1), F.size(offsets) - 1), lambda i: F.slice(flat, F.get(offsets, i - 1) + 1, F.get(offsets, i) - F.get(offsets, i - 1)))


def offsets(lists: Column) -> Column:
    """Where each of the lists begins in their flat array, and its whole length at the end."""
    start = F.array(F.lit(0))
    return F.aggregate(lists, start, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.size(x)))


def dense_divergence(p: Column, q: Column, k: int, blank: int) -> Column:
    """Divergence over the blank bin, the k largest other entries of p, and one bin for the rest.

    The blank has its bin whatever its size, so a frame that is nearly all blank keeps its own term.
    """
    at = lambda xs: F.get(xs, F.lit(blank))
    others = lambda xs: F.filter(xs, lambda x, i: i != blank)
    pairs = F.array_sort(F.arrays_zip(F.transform(others(p), lambda x: -x).alias("n"), others(p).alias("p"), others(q).alias("q")))

    def over(kept: Column) -> Column:
        ps, qs = F.transform(kept, lambda e: e.p), F.transform(kept, lambda e: e.q)
        rest = lambda xs, one: F.greatest(F.lit(1e-12), 1.0 - total(xs) - one)
        return divergence(F.concat(F.array(at(p)), ps, F.array(rest(ps, at(p)))), F.concat(F.array(at(q)), qs, F.array(rest(qs, at(q)))))

    return let(F.slice(pairs, 1, k), over)


def two_bin_divergence(p: Column, q: Column) -> Column:
    """Divergence of two probabilities of one bin against all else."""
    term = lambda a, b: F.when(a <= 0, 0.0).otherwise(a * (F.log(a) - F.log(b)))
    return term(p, q) + term(1 - p, 1 - q)
