"""Operations on arrays of scores and depths as Catalyst expressions, with the tie and NaN rules of each use.

A NaN counts as the lowest value, which is the opposite of Spark's order; each function says which index wins a tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = 65535


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda, other expressions are computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def first_best(scores: Column) -> Column:
    """struct(cls, score): the best class, lowest index on ties; NaN never wins. Null for no finite score."""
    clean = F.transform(scores, lambda s: F.when(~F.isnan(s), s))
    best = F.array_max(clean)
    return F.when(best.isNotNull(), F.struct((F.array_position(clean, best) - 1).cast("int").alias("cls"), best.alias("score")))


def last_best(scores: Column) -> Column:
    """struct(cls, score): the best class, highest index on ties; NaN counts as -infinity."""
    low = F.lit(float("-inf")).cast("float")
    clean = F.transform(scores, lambda s: F.when(F.isnan(s), low).otherwise(s))
    best = F.array_max(clean)
    return F.struct((F.size(clean) - F.array_position(F.reverse(clean), best)).cast("int").alias("cls"), best.alias("score"))


def softmax(logits: Column) -> Column:
    """Probabilities in double precision; a vector that is a distribution already (within 0.1) is passed through."""
    wide = F.transform(logits, lambda v: v.cast("double"))

    def soft(row: Column) -> Column:
        values, exps = row["values"], F.transform(row["values"], lambda v: F.exp(v - row["top"]))
        normal = let(F.struct(exps.alias("exps"), _total(exps).alias("mass")), lambda e: F.transform(e["exps"], lambda x: x / e["mass"]))
        inside = F.forall(values, lambda v: (v >= 0) & (v <= 1))
        return F.when(inside & (F.abs(row["total"] - 1) <= 0.1), values).otherwise(normal)

    return let(wide, lambda w: let(F.struct(w.alias("values"), F.array_max(w).alias("top"), _total(w).alias("total")), soft))


def _ranked(probs: Column) -> Column:
    return F.array_sort(F.transform(probs, lambda p, i: F.struct(F.isnan(p).alias("nan"), (-p).alias("key"), i.alias("idx"), p.alias("p"))))


def top1(probs: Column) -> Column:
    """struct(idx, p): the best probability, highest index on ties, NaN lowest."""
    best = F.array_max(F.transform(probs, lambda p, i: F.struct((~F.isnan(p)).alias("ok"), F.when(F.isnan(p), F.lit(0.0)).otherwise(p).alias("key"), i.alias("idx"))))
    return F.when(F.size(probs) > 0, F.struct(best["idx"].alias("idx"), F.get(probs, best["idx"]).alias("p")))


def top_k(probs: Column, k: int = 5) -> Column:
    """array of struct(idx, p), best first: lowest index on ties, NaN last."""
    return F.transform(F.slice(_ranked(probs), 1, k), lambda r: F.struct(r["idx"].alias("idx"), r["p"].alias("p")))


def class_ids(mask: Column) -> Column:
    """The classes in a semantic mask, ascending, without the ignored ones."""
    return F.array_sort(F.array_distinct(F.filter(mask, lambda c: c != IGNORE)))


def filter_classes(mask: Column, classes: list[int] | None, names: int) -> Column:
    """Pixels of classes that are not asked for become IGNORE; nothing is done without a list or with one name at most."""
    if classes is None or names <= 1:
        return mask
    kept = [F.lit(c) for c in classes]
    return F.transform(mask, lambda c: F.when(c.isin(kept) if kept else F.lit(False), c).otherwise(F.lit(IGNORE)))


def valid_depth(depth: Column) -> Column:
    return F.filter(depth, lambda d: (d > 0) & ~F.isnan(d))


def depth_range(depth: Column) -> Column:
    """struct(lo, hi): smallest and largest valid depth, widened by 1e-6 if equal, (0, 1) if none is valid."""
    ok = valid_depth(depth)
    lo, hi = F.array_min(ok), F.array_max(ok)
    zero, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    return F.when(F.size(ok) == 0, F.struct(zero.alias("lo"), one.alias("hi"))).when(hi > lo, F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(F.struct(lo.alias("lo"), (lo + F.lit(1e-6).cast("float")).alias("hi")))


def percentiles(values: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """struct(lo, hi): the elements at round(p * (n - 1)) of the sorted values; null for none."""
    ordered = F.array_sort(values)
    at = lambda p: F.get(ordered, F.round(F.lit(p) * (F.size(values) - 1)).cast("int"))
    return F.when(F.size(values) > 0, F.struct(at(low).alias("lo"), at(high).alias("hi")))


def argmax_planes(planes: Column) -> Column:
    """The class map of an array of planes of one size: per pixel the first best class; one plane alone means score > 0."""
    first = F.get(planes, F.lit(0))
    pixels = F.sequence(F.lit(0), F.size(first) - 1)
    best = lambda i: first_best(F.transform(planes, lambda p: F.get(p, i)))["cls"]
    return F.when(F.size(planes) == 1, F.transform(first, lambda v: (v > 0).cast("int"))).otherwise(F.transform(pixels, lambda i: F.coalesce(best(i), F.lit(0))))
