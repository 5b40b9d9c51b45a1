"""Token-level divergence math.

Two forms with the same results. ``token_stats`` runs numpy over the flat Arrow buffers
and hands back only scalars, so vocabulary-size vectors never return to the JVM: the form
for real vocabularies. The higher-order-function forms stay in the JVM and suit short
vectors and single quantities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuneframe.functions.text import let
from tuneframe.schemas import TOKEN_STATS

# ---------------------------------------------------------------- JVM forms


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def usable(student: Column, teacher: Column, token_id: Column) -> Column:
    """Whether a token's vectors are there, not empty, of one width and without NULL, with the token inside."""
    sized = (F.size(student) > 0) & (F.size(student) == F.size(teacher))
    inside = (token_id >= 0) & (token_id < F.size(student))
    holes = F.exists(student, lambda x: x.isNull()) | F.exists(teacher, lambda x: x.isNull())
    return F.coalesce(sized & inside & ~holes, F.lit(False))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: x.cast("double") / F.lit(float(temperature)))

    def shifted(values):
        top = F.array_max(values)
        return let(
            top + F.log(_sum(F.transform(values, lambda x: F.exp(x - top)))),
            lambda norm: F.transform(values, lambda x: x - norm),
        )

    return let(scaled, shifted)


def selected(values: Column, token_id: Column) -> Column:
    """Entry of a 0-based token id."""
    return F.element_at(values, (token_id + 1).cast("int"))


def entropy(logps: Column) -> Column:
    return -_sum(F.transform(logps, lambda lp: F.exp(lp) * lp))


def _kl(p: Column, q: Column) -> Column:
    """KL(p || q) of two log-prob arrays."""
    return _sum(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)))


def divergence(student: Column, teacher: Column, alpha: float = 0.0) -> Column:
    """Per-token divergence of two log-prob arrays.

    alpha 0: KL(teacher || student); alpha 1: KL(student || teacher); in between the
    generalised Jensen-Shannon divergence with teacher weight alpha.
    """
    if alpha == 0:
        return _kl(teacher, student)
    if alpha == 1:
        return _kl(student, teacher)

    def mix(s, t):
        top = F.greatest(s, t)
        return top + F.log((1 - alpha) * F.exp(s - top) + alpha * F.exp(t - top))

    return let(
        F.zip_with(student, teacher, mix),
        lambda m: alpha * _kl(teacher, m) + (1 - alpha) * _kl(student, m),
    )


def k3(log_p: Column, log_q: Column) -> Column:
    """Estimate of KL(p || q) from the chosen token only; never negative."""
    return (log_p - log_q) + F.exp(log_q - log_p) - 1


def capped_ratio(new_logp: Column, old_logp: Column, cap: float) -> Column:
    """At most ``cap``; NaN stays NaN (``least`` takes it for the largest number)."""
    ratio = F.exp(new_logp - old_logp)
    return F.when(F.isnan(ratio), ratio).otherwise(F.least(ratio, F.lit(float(cap))))


# ---------------------------------------------------------------- Arrow form


def _usable(student: pa.Array, teacher: pa.Array, token: pa.Array) -> np.ndarray:
    """Rows whose vectors are there, not empty, of one width and without NULL, with the token inside."""
    def widths(lists):
        return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def whole(lists):
        holes = np.zeros(len(lists), bool)
        if lists.flatten().null_count:
            holes = np.array([x is not None and None in x for x in lists.to_pylist()])
        return ~holes

    s, t = widths(student), widths(teacher)
    at = token.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    return (s > 0) & (s == t) & (at >= 0) & (at < s) & whole(student) & whole(teacher)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, widths) of a list array with non-empty, non-null entries."""
    widths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.cumsum(widths) - widths, widths


def _log_softmax(lists: pa.Array, temperature: float):
    values, starts, widths = _flat(lists)
    values = values / temperature
    values -= np.repeat(np.maximum.reduceat(values, starts), widths)
    values -= np.repeat(np.log(np.add.reduceat(np.exp(values), starts)), widths)
    return values, starts


def token_stats(
    student_logits: Column, teacher_logits: Column, token_id: Column, alpha: float = 0.0, temperature: float = 1.0
) -> Column:
    """struct<student_logp, teacher_logp, entropy, divergence> of one token.

    NULL where a vector is missing, empty or holds NULL, where the two differ in width, or where the token
    lies outside: such a row never reads its neighbour's numbers. :func:`usable` is the same rule in
    built-in expressions.
    """

    @F.arrow_udf(TOKEN_STATS)
    def stats(student: pa.Array, teacher: pa.Array, token: pa.Array) -> pa.Array:
        good = _usable(student, teacher, token)
        if not good.all():
            kept = np.flatnonzero(good)
            place = np.where(good, np.cumsum(good) - 1, -1)
            one = stats_of(student.take(pa.array(kept)), teacher.take(pa.array(kept)), token.take(pa.array(kept)))
            return one.take(pa.array(place, mask=~good))
        return stats_of(student, teacher, token)

    def stats_of(student: pa.Array, teacher: pa.Array, token: pa.Array) -> pa.Array:
        if not len(token):
            return pa.StructArray.from_arrays([pa.array([], pa.float64()) for _ in TOKEN_STATS.names], TOKEN_STATS.names)
        s, starts = _log_softmax(student, temperature)
        t, _ = _log_softmax(teacher, temperature)
        at = starts + token.to_numpy(zero_copy_only=False).astype(np.int64)
        p = np.exp(s)
        if alpha == 0:
            terms = np.exp(t) * (t - s)
        elif alpha == 1:
            terms = p * (s - t)
        else:
            mix = np.logaddexp(s + np.log(1 - alpha), t + np.log(alpha))
            terms = alpha * np.exp(t) * (t - mix) + (1 - alpha) * p * (s - mix)
        columns = [s[at], t[at], -np.add.reduceat(p * s, starts), np.add.reduceat(terms, starts)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], TOKEN_STATS.names)

    return stats(student_logits, teacher_logits, token_id)


# ---------------------------------------------------------------- blocks of a vocabulary

# Of one block, relative to its largest scaled logit (``top``): the sum of exp, the same weighted by the logit, and weighted by the
# difference to the other side. ``width`` is null where the block cannot be used.
_SIDES = ["s_top", "s_sum", "s_own", "s_gap", "t_top", "t_sum", "t_gap"]
BLOCK_STATE = T.StructType([T.StructField("width", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in _SIDES)])


def _good_blocks(student: pa.Array, teacher: pa.Array) -> np.ndarray:
    return _usable(student, teacher, pa.array(np.zeros(len(student), np.int64)))


def block_state(student: Column, teacher: Column, temperature: float = 1.0) -> Column:
    """What one block of both vectors adds to a token's sums; :func:`merged` puts blocks together."""

    @F.arrow_udf(BLOCK_STATE)
    def state(student: pa.Array, teacher: pa.Array) -> pa.Array:
        good = _good_blocks(student, teacher)
        kept = pa.array(np.flatnonzero(good))
        columns = [np.zeros(len(good)) for _ in _SIDES]
        widths = np.zeros(len(good), np.int32)
        if len(kept):
            s, starts, own = _flat(student.take(kept))
            t, _, _ = _flat(teacher.take(kept))
            s, t = s / temperature, t / temperature

            def side(x, y):
                top = np.maximum.reduceat(x, starts)
                # A block of -inf only has no weight, whatever it is measured against.
                weight = np.exp(x - np.repeat(np.where(np.isneginf(top), 0.0, top), own))
                return top, *(np.add.reduceat(v, starts) for v in (weight, weight * x, weight * (x - y)))

            (s_top, s_sum, s_own, s_gap), (t_top, t_sum, _, t_gap) = side(s, t), side(t, s)
            for column, values in zip(columns, (s_top, s_sum, s_own, s_gap, t_top, t_sum, t_gap)):
                column[good] = values
            widths[good] = own
        parts = [pa.array(widths, mask=~good), *(pa.array(c, mask=~good) for c in columns)]
        return pa.StructArray.from_arrays(parts, ["width", *_SIDES])

    return state(student, teacher)


def merged(states: Column) -> Column:
    """struct<s_norm, t_norm, entropy, forward_kl, reverse_kl> from the array of a token's block states.

    Sums are rescaled to the largest logit of all blocks. The norms are the logarithms of the softmax denominators.
    """

    def total(name: str, top: str) -> Column:
        return let(
            F.array_max(F.transform(states, lambda x: x[top])),
            lambda best: F.aggregate(states, F.lit(0.0), lambda acc, x: acc + F.when(x[top] == float("-inf"), 0.0).otherwise(x[name] * F.exp(x[top] - best))),
        )

    def best(top: str) -> Column:
        return F.array_max(F.transform(states, lambda x: x[top]))

    sums = F.struct(
        best("s_top").alias("s_best"), best("t_top").alias("t_best"), total("s_sum", "s_top").alias("s_sum"), total("s_own", "s_top").alias("s_own"),
        total("s_gap", "s_top").alias("s_gap"), total("t_sum", "t_top").alias("t_sum"), total("t_gap", "t_top").alias("t_gap"),
    )

    def finish(x: Column) -> Column:
        s_norm, t_norm = x["s_best"] + F.log(x["s_sum"]), x["t_best"] + F.log(x["t_sum"])
        return F.struct(
            s_norm.alias("s_norm"),
            t_norm.alias("t_norm"),
            (s_norm - x["s_own"] / x["s_sum"]).alias("entropy"),
            (x["t_gap"] / x["t_sum"] - t_norm + s_norm).alias("forward_kl"),
            (x["s_gap"] / x["s_sum"] - s_norm + t_norm).alias("reverse_kl"),
        )

    return let(sums, finish)


def block_jsd(student: Column, teacher: Column, s_norm: Column, t_norm: Column, alpha: float, temperature: float = 1.0) -> Column:
    """What one block adds to the generalised Jensen-Shannon divergence, once both norms are known."""

    @F.arrow_udf("double")
    def term(student: pa.Array, teacher: pa.Array, s_norm: pa.Array, t_norm: pa.Array) -> pa.Array:
        good = _good_blocks(student, teacher) & s_norm.is_valid().to_numpy(zero_copy_only=False) & t_norm.is_valid().to_numpy(zero_copy_only=False)
        kept = pa.array(np.flatnonzero(good))
        out = np.zeros(len(good))
        if len(kept):
            s, starts, own = _flat(student.take(kept))
            t, _, _ = _flat(teacher.take(kept))
            s = s / temperature - np.repeat(s_norm.take(kept).to_numpy(), own)
            t = t / temperature - np.repeat(t_norm.take(kept).to_numpy(), own)
            mix = np.logaddexp(s + np.log(1 - alpha), t + np.log(alpha))
            out[good] = np.add.reduceat(alpha * np.exp(t) * (t - mix) + (1 - alpha) * np.exp(s) * (s - mix), starts)
        return pa.array(out, mask=~good)

    return term(student, teacher, s_norm, t_norm)
