"""Vector expressions over array<double> columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: Column) -> Column:
    """Sum of an array, left to right; 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def ip(a, b) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(ip(v, v))


def scale(v, by) -> Column:
    return F.transform(_c(v), lambda x: x * by)


def unit(v) -> Column:
    """v at length 1; a zero vector stays zero."""
    # the length stands beside each value, so that it is worked out once a vector
    return F.zip_with(_c(v), F.array_repeat(norm(v), F.size(_c(v))), lambda x, n: F.when(n > 0, x / n).otherwise(0.0))


def cosine(a, b) -> Column:
    """Cosine kernel; 0 if either vector is zero."""
    return F.coalesce(F.try_divide(ip(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_squared(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def lp(a, b, p: float) -> Column:
    """Minkowski distance of order p."""
    return F.power(total(F.zip_with(_c(a), _c(b), lambda x, y: F.power(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def l1(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def linf(a, b) -> Column:
    return F.coalesce(F.array_max(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))), F.lit(0.0))


def ip_metric(a, b) -> Column:
    """Distance induced by the inner product."""
    return F.sqrt(F.greatest(ip(a, a) + ip(b, b) - 2 * ip(a, b), F.lit(0.0)))


def nnz(v) -> Column:
    return F.size(F.filter(_c(v), lambda x: x != 0))


def max_abs(v) -> Column:
    return F.array_max(F.transform(_c(v), F.abs))


def top_coords(v, n: int) -> Column:
    """The n coordinates of largest |value|, as structs (mag, coord, val); ties by coordinate."""
    s = F.transform(_c(v), lambda x, i: F.struct((-F.abs(x)).alias("neg"), i.alias("coord"), x.alias("val")))
    return F.transform(F.slice(F.array_sort(s), 1, n), lambda s: F.struct((-s["neg"]).alias("mag"), s["coord"].alias("coord"), s["val"].alias("val")))


def passes(q, p, theta) -> Column:
    """ip >= theta, with the length bound tested first (a slack covers rounding)."""
    return (norm(q) * norm(p) * (1 + 1e-12) >= theta) & (ip(q, p) >= theta)


def lsh_query(v) -> Column:
    """[0; q / |q|]."""
    return F.concat(F.array(F.lit(0.0)), unit(v))


def lsh_probe(v, longest) -> Column:
    """[sqrt(1 - |p / M|^2); p / M] for the largest probe length M."""
    s = F.transform(_c(v), lambda x: F.when(longest > 0, x / longest).otherwise(0.0))
    return F.concat(F.array(F.sqrt(F.greatest(F.lit(0.0), 1 - ip(s, s)))), s)


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(x)))


# closed ranges as struct(lo, hi); an empty range has lo > hi
def rng(lo, hi) -> Column:
    return F.struct(_c(lo).alias("lo"), _c(hi).alias("hi"))


def range_width(r: Column) -> Column:
    return F.greatest(r["hi"] - r["lo"], F.lit(0.0))


def range_mid(r: Column) -> Column:
    return (r["hi"] + r["lo"]) / 2


def range_union(a: Column, b: Column) -> Column:
    return rng(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))


def range_intersect(a: Column, b: Column) -> Column:
    return rng(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def range_scale(r: Column, by) -> Column:
    x, y = r["lo"] * by, r["hi"] * by
    return rng(F.least(x, y), F.greatest(x, y))


def range_contains(r: Column, x) -> Column:
    return (x >= r["lo"]) & (x <= r["hi"])


# balls (centre, radius) and boxes (lo[], hi[])
def ball_min_distance(centre, radius, x) -> Column:
    return F.greatest(l2(centre, x) - radius, F.lit(0.0))


def ball_max_distance(centre, radius, x) -> Column:
    return l2(centre, x) + radius


def box_min_distance(lo, hi, x) -> Column:
    gap = F.zip_with(F.zip_with(_c(lo), _c(x), lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with(_c(x), _c(hi), lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda a, b: a + b)
    return F.sqrt(total(F.transform(gap, lambda g: g * g)))


def box_max_distance(lo, hi, x) -> Column:
    far = F.zip_with(F.zip_with(_c(lo), _c(x), lambda a, b: F.abs(b - a)), F.zip_with(_c(hi), _c(x), lambda a, b: F.abs(a - b)), lambda a, b: F.greatest(a, b))
    return F.sqrt(total(F.transform(far, lambda g: g * g)))


def box_contains(lo, hi, x) -> Column:
    return F.forall(F.zip_with(F.zip_with(_c(lo), _c(x), lambda a, b: a <= b), F.zip_with(_c(x), _c(hi), lambda a, b: a <= b), lambda a, b: a & b), lambda t: t)


# two balls
def balls_min_distance(c1, r1, c2, r2) -> Column:
    return F.greatest(l2(c1, c2) - r1 - r2, F.lit(0.0))


def balls_max_distance(c1, r1, c2, r2) -> Column:
    return l2(c1, c2) + r1 + r2


def ball_union(c1, r1, c2, r2) -> Column:
    """struct(centre, radius) of the smallest ball around two: one of them if it holds the other."""
    d = l2(c1, c2)
    r = (d + r1 + r2) / 2
    at = F.coalesce(F.try_divide(r - r1, d), F.lit(0.0))
    mid = F.zip_with(F.zip_with(_c(c1), _c(c2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.array_repeat(at, F.size(_c(c1))), lambda s, t: s["a"] + (s["b"] - s["a"]) * t)
    ball = lambda c, x: F.struct(_c(c).alias("centre"), x.alias("radius"))
    return F.when(d + r2 <= r1, ball(c1, r1)).when(d + r1 <= r2, ball(c2, r2)).otherwise(ball(mid, r))


# two boxes
def _ranges(lo1, hi1, lo2, hi2) -> Column:
    pair = lambda a, b: F.zip_with(_c(a), _c(b), lambda x, y: F.struct(x.alias("lo"), y.alias("hi")))
    return F.zip_with(pair(lo1, hi1), pair(lo2, hi2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def boxes_min_distance(lo1, hi1, lo2, hi2) -> Column:
    gap = F.transform(_ranges(lo1, hi1, lo2, hi2), lambda s: F.greatest(s["b"]["lo"] - s["a"]["hi"], s["a"]["lo"] - s["b"]["hi"], F.lit(0.0)))
    return F.sqrt(total(F.transform(gap, lambda g: g * g)))


def boxes_max_distance(lo1, hi1, lo2, hi2) -> Column:
    far = F.transform(_ranges(lo1, hi1, lo2, hi2), lambda s: F.greatest(F.abs(s["b"]["hi"] - s["a"]["lo"]), F.abs(s["a"]["hi"] - s["b"]["lo"])))
    return F.sqrt(total(F.transform(far, lambda g: g * g)))


def box_union(lo1, hi1, lo2, hi2) -> Column:
    """struct(lo, hi) of the smallest box around two; a point expands a box as a box of its own."""
    return F.struct(F.zip_with(_c(lo1), _c(lo2), lambda a, b: F.least(a, b)).alias("lo"), F.zip_with(_c(hi1), _c(hi2), lambda a, b: F.greatest(a, b)).alias("hi"))


# boxes in a space that repeats itself: period[] is its length along each axis, 0 for an axis that does not repeat
def _wrapped(lo, hi, period) -> Column:
    """Gaps between 0 and the intervals [lo, hi], and their farthest ends, by the shortest way round: struct(near, far)."""
    def axis(s, length):
        lo, hi, p = s["lo"], s["hi"], F.abs(length)
        flat_near, flat_far = F.greatest(lo, -hi, F.lit(0.0)), F.greatest(F.abs(lo), F.abs(hi))
        start = F.pmod(lo, F.when(p > 0, p).otherwise(F.lit(1.0)))
        end = start + (hi - lo)
        near = F.when((start <= 0) | (end >= p), F.lit(0.0)).otherwise(F.least(start, p - end))
        # the farthest place is half way round if the interval covers it
        far = F.when(((start <= p / 2) & (end >= p / 2)) | (end >= p * 1.5), p / 2).otherwise(F.greatest(F.least(start, p - start), F.least(F.abs(end), F.abs(p - end))))
        return F.struct(F.when(p > 0, near).otherwise(flat_near).alias("near"), F.when(p > 0, far).otherwise(flat_far).alias("far"))

    both = F.zip_with(_c(lo), _c(hi), lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    return F.zip_with(both, _c(period), axis)


def periodic_min_distance(lo, hi, x, period) -> Column:
    """Shortest distance from a point to a box."""
    away = _wrapped(F.zip_with(_c(lo), _c(x), lambda a, b: a - b), F.zip_with(_c(hi), _c(x), lambda a, b: a - b), period)
    return F.sqrt(total(F.transform(away, lambda s: s["near"] * s["near"])))


def periodic_max_distance(lo, hi, x, period) -> Column:
    """Distance from a point to the farthest place of a box."""
    away = _wrapped(F.zip_with(_c(lo), _c(x), lambda a, b: a - b), F.zip_with(_c(hi), _c(x), lambda a, b: a - b), period)
    return F.sqrt(total(F.transform(away, lambda s: s["far"] * s["far"])))


def periodic_boxes_min_distance(lo1, hi1, lo2, hi2, period) -> Column:
    """Shortest distance between two boxes: that of 0 from the box of all differences."""
    away = _wrapped(F.zip_with(_c(lo2), _c(hi1), lambda a, b: a - b), F.zip_with(_c(hi2), _c(lo1), lambda a, b: a - b), period)
    return F.sqrt(total(F.transform(away, lambda s: s["near"] * s["near"])))


def periodic_boxes_max_distance(lo1, hi1, lo2, hi2, period) -> Column:
    away = _wrapped(F.zip_with(_c(lo2), _c(hi1), lambda a, b: a - b), F.zip_with(_c(hi2), _c(lo1), lambda a, b: a - b), period)
    return F.sqrt(total(F.transform(away, lambda s: s["far"] * s["far"])))


def periodic_distance(a, b, period) -> Column:
    """Distance of two points by the shortest way round."""
    return periodic_min_distance(a, a, b, period)
