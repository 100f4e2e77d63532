"""Array-column helpers: softmax, ranking, bits, token arrays.

Scores are kept in their wide form (one ``ARRAY<DOUBLE>`` per row) so that
softmax, argmax and ranking are per-row expressions with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tetrad import dims


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def softmax(z: str | Column) -> Column:
    """exp(z - max) / sum(exp(z - max)) over one array.

    Written as nested ``aggregate`` calls so the max and the sum are
    computed once per row (an outer helper column referenced inside a
    lambda would be re-evaluated for every element)."""
    z = _c(z)
    neg_inf = F.lit(float("-inf")).cast("double")

    def with_max(m):
        e = F.transform(z, lambda x: F.exp(x - m))
        return F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x,
                           lambda s: F.transform(z, lambda x: F.exp(x - m) / s))

    return F.aggregate(z, neg_inf, lambda a, x: F.greatest(a, x), with_max)


def ranking_idx(p: str | Column) -> Column:
    """Class indices in descending score order; ties keep the lower index
    first, like a stable sort (W2)."""
    keyed = F.transform(_c(p), lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.array_sort(keyed), lambda s: s["idx"])


def idx_to_name(idx: Column) -> Column:
    """Class index -> lower-case name."""
    return F.element_at(dims.class_name_array(), idx + 1)


def double_softmax_ce(p: str | Column, target: Column) -> Column:
    """Cross-entropy applied to probabilities (A12): the model already returns
    softmax, and the loss applies it again: ln(sum(exp(p))) - p[target]."""
    p = _c(p)
    return F.log(array_sum(F.transform(p, F.exp))) - F.element_at(p, target + 1)


def plain_ce(p: str | Column, target: Column) -> Column:
    """-ln p[target]."""
    return -F.log(F.element_at(_c(p), target + 1))


def idx_to_bits(idx: str | Column) -> Column:
    """Class index -> 4-character bit string, e.g. 5 -> '0101' (F9)."""
    return F.lpad(F.bin(_c(idx)), 4, "0")


def bits_to_idx(b0: Column, b1: Column, b2: Column, b3: Column) -> Column:
    """Four bits -> class index, first bit most significant."""
    return (b0 * 8 + b1 * 4 + b2 * 2 + b3).cast("int")


def pad_to(ids: str | Column, length: Column, pad_id: int = 0) -> Column:
    """Right-pad an id array to ``length``."""
    ids = _c(ids)
    n = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), n))


def attention_mask(padded: str | Column, pad_id: int = 0) -> Column:
    """``id != pad`` per position."""
    return F.transform(_c(padded), lambda x: x != pad_id)


def mask_prompt(ids: str | Column, prompt_len: Column,
                ignore: int = dims.IGNORE_INDEX) -> Column:
    """Labels for next-token training: first ``prompt_len`` positions set to
    the ignore index (F6)."""
    return F.transform(_c(ids), lambda x, i: F.when(i < prompt_len, F.lit(ignore).cast("bigint"))
                       .otherwise(x.cast("bigint")))


def non_pad_length(ids: str | Column, pad_id: int = 0) -> Column:
    """Count of ids different from the pad id."""
    return F.size(F.filter(_c(ids), lambda x: x != pad_id))


def shift_left(a: str | Column) -> Column:
    """labels[1:] - targets for next-token prediction (F8)."""
    a = _c(a)
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def join_ints(a: str | Column, sep: str = " ") -> Column:
    """Engine-neutral text form of an int array, for oracle comparison."""
    return F.array_join(F.transform(_c(a), lambda x: x.cast("string")), sep)
