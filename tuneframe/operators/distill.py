"""Analytics over token tables of a student and a teacher.

Token key: ``run_id, seq_id, pos``. Vocabulary-size vectors are reduced to scalars right
after the join that needs both sides; every later step works on scalar columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneframe.constants import IMPORTANCE_CAP, SKIP_FIRST_TOKENS
from tuneframe.functions import tokens as K
from tuneframe.session import written

KEY = ["run_id", "seq_id", "pos"]
SKETCH_K = 400


def pair_student_teacher(student: DataFrame, teacher: DataFrame, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Same completion token scored by both models.

    Tables saved with ``sources.save_token_table`` are bucketed on the key and join
    without a shuffle of the vectors.
    """
    return student.join(teacher, list(keys))


def token_metrics(
    pairs: DataFrame, alpha: float = 0.0, temperature: float = 1.0, engine: str = "arrow"
) -> DataFrame:
    """Replace ``student_logits, teacher_logits`` by ``student_logp, teacher_logp, entropy,
    divergence``. ``engine="sql"`` keeps the math in the JVM, for short vectors. Both give NULL for
    a token whose vectors or id cannot be used (:func:`tokens.usable`)."""
    if engine == "arrow":
        stats = K.token_stats(
            F.col("student_logits"), F.col("teacher_logits"), F.col("token_id"), alpha, temperature
        )
        return pairs.withColumn("_s", stats).drop("student_logits", "teacher_logits").select(
            *[c for c in pairs.columns if c not in ("student_logits", "teacher_logits")], "_s.*"
        )
    rest = [c for c in pairs.columns if c not in ("student_logits", "teacher_logits")]
    good = K.usable(F.col("student_logits"), F.col("teacher_logits"), F.col("token_id"))
    logps = pairs.select(
        *rest,
        K.log_softmax(F.when(good, F.col("student_logits")), temperature).alias("_s"),
        K.log_softmax(F.when(good, F.col("teacher_logits")), temperature).alias("_t"),
    )
    return logps.select(
        *rest,
        K.selected(F.col("_s"), F.col("token_id")).alias("student_logp"),
        K.selected(F.col("_t"), F.col("token_id")).alias("teacher_logp"),
        K.entropy(F.col("_s")).alias("entropy"),
        K.divergence(F.col("_s"), F.col("_t"), alpha).alias("divergence"),
    )


def token_metrics_blocks(
    student: DataFrame,
    teacher: DataFrame,
    size: int,
    keys: Sequence[str] = tuple(KEY),
    alpha: float = 0.0,
    temperature: float = 1.0,
    block: str = "block",
) -> DataFrame:
    """:func:`token_metrics` for vectors that are cut into blocks of ``size`` (:func:`vector_blocks`), one row per token.

    ``student`` holds the keys, ``block``, ``student_logits``, ``token_id`` and what else is to be kept of a token; ``teacher`` holds the keys, ``block``
    and ``teacher_logits``. Equal blocks of both sides meet; a block becomes eight numbers, and only those meet by token, so no task and
    no row ever holds a whole vector. The Jensen-Shannon form (0 < alpha < 1) reads the blocks a second time, when the norms are known.

    NULL metrics where blocks of the two sides differ in number or width, hold NULL, or the token lies outside. A token without any block
    on one side has no row.
    """
    keys = list(keys)
    carried = [c for c in student.columns if c not in (*keys, block, "student_logits")]
    pairs = student.join(teacher.select(*keys, block, "teacher_logits"), [*keys, block], "full_outer")
    inside = F.floor(F.col("token_id") / size) == F.col(block)

    def chosen(column: str) -> Column:
        return F.max(F.when(inside & (F.col("token_id") >= 0), F.try_element_at(column, (F.col("token_id") % size + 1).cast("int")).cast("double")))

    state = K.block_state(F.col("student_logits"), F.col("teacher_logits"), temperature)
    tokens = (
        pairs.withColumn("_state", state)
        .groupBy(*keys)
        .agg(
            *[F.any_value(c, True).alias(c) for c in carried],
            F.collect_list("_state").alias("_states"),
            F.count(F.when(F.col("_state.width").isNull(), 1)).alias("_bad"),
            F.count("student_logits").alias("_s_blocks"),
            F.count("teacher_logits").alias("_t_blocks"),
            chosen("student_logits").alias("_s"),
            chosen("teacher_logits").alias("_t"),
        )
        .where((F.col("_s_blocks") > 0) & (F.col("_t_blocks") > 0))
    )
    good = (F.col("_bad") == 0) & F.col("_s").isNotNull() & F.col("_t").isNotNull()
    tokens = tokens.withColumn("_m", F.when(good, K.merged(F.col("_states"))))
    scale = F.lit(float(temperature))
    logps = [
        (F.col("_s") / scale - F.col("_m.s_norm")).alias("student_logp"),
        (F.col("_t") / scale - F.col("_m.t_norm")).alias("teacher_logp"),
        F.col("_m.entropy").alias("entropy"),
    ]
    if alpha in (0, 1):
        return tokens.select(*keys, *carried, *logps, F.col("_m.reverse_kl" if alpha else "_m.forward_kl").alias("divergence"))
    tokens = tokens.select(*keys, *carried, *logps, F.col("_m.s_norm").alias("_sn"), F.col("_m.t_norm").alias("_tn"))
    tokens = written(tokens, "token-norms")
    terms = pairs.select(*keys, "student_logits", "teacher_logits").join(tokens.select(*keys, "_sn", "_tn"), keys)
    term = K.block_jsd(F.col("student_logits"), F.col("teacher_logits"), F.col("_sn"), F.col("_tn"), alpha, temperature)
    sums = terms.select(*keys, term.alias("_term")).groupBy(*keys).agg(F.sum("_term").alias("divergence"))
    return tokens.drop("_sn", "_tn").join(sums, keys)


def shift_and_keep(tokens: DataFrame, lengths: DataFrame, sequence: Sequence[str], keep: str = "n_completion") -> DataFrame:
    """Drop the last position of each sequence and keep the ``keep`` positions before it;
    ``pos`` restarts at 0. ``lengths`` has one row per sequence: ``n_positions`` and ``keep``."""
    first = F.greatest(F.col("n_positions") - 1 - F.col(keep), F.lit(0))
    return (
        tokens.join(lengths, list(sequence))
        .where((F.col("pos") < F.col("n_positions") - 1) & (F.col("pos") >= first))
        .withColumn("pos", F.col("pos") - first)
        .drop("n_positions", keep)
    )


def skip_first_tokens(n: int = SKIP_FIRST_TOKENS, pos: str = "pos", mask: str = "mask") -> Column:
    """Loss mask without the first ``n`` completion tokens."""
    return F.when(F.col(pos) >= n, F.col(mask)).otherwise(0)


# ------------------------------------------------------------------ entropy mask


def exact_quantile(
    rows: DataFrame, value: str, q: float, groups: Sequence[str], name: str = "threshold", cells_per_octave: int = 4096
) -> DataFrame:
    """Exact linearly interpolated quantile of ``value`` per group, for groups of any size.

    A histogram finds the one or two cells that hold the wanted ranks; only their rows are
    looked at again, equal values collapsed first. Cells are logarithmic, since token
    entropies crowd near zero: each spans a factor of ``2 ** (1 / cells_per_octave)``. No task
    sorts a whole group. Groups without a value yield no row. ``rows`` is read twice: hand in a written table of scalars
    (``session.written``) when it is expensive to compute.
    """
    groups = list(groups)
    # Rises with the value over all doubles: log2 of their size lies within +-1100.
    height = F.signum(value) * (F.log2(F.abs(value)) + 1100) * cells_per_octave
    cell = F.when(F.col(value) == 0, 0).otherwise(F.floor(height)).cast("bigint")
    rows = rows.where(F.col(value).isNotNull()).select(*groups, value, cell.alias("_cell"))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.lit(float(q)) * (F.col("_total") - 1)
    cells = (
        rows.groupBy(*groups, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(by_group))
        .withColumn("_low", F.floor(rank).cast("bigint"))
        .withColumn("_high", F.ceil(rank).cast("bigint"))
        .withColumn("_part", rank - F.floor(rank))
    )

    def covers(position: str, first: str = "_before", count: str = "_n") -> Column:
        return (F.col(first) <= F.col(position)) & (F.col(position) < F.col(first) + F.col(count))

    wanted = cells.where(covers("_low") | covers("_high")).drop("_n", "_total")
    known = ["_before", "_low", "_high", "_part"]
    inside = Window.partitionBy(*groups, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        rows.join(wanted, [*groups, "_cell"])
        .groupBy(*groups, "_cell", value)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in known])
        .withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    )
    low = F.max(F.when(covers("_low", "_first"), F.col(value)))
    high = F.max(F.when(covers("_high", "_first"), F.col(value)))
    return ranked.groupBy(*groups).agg((low + (high - low) * F.max("_part")).alias(name))


def entropy_quantile(tokens: DataFrame, q: float, groups: Sequence[str], mask: str = "mask") -> DataFrame:
    """Quantile of the unmasked entropies per group."""
    return exact_quantile(tokens.where(F.col(mask) == 1), "entropy", q, groups)


def high_entropy_mask(
    tokens: DataFrame, q: float, groups: Sequence[str], mask: str = "mask", name: str = "entropy_mask"
) -> DataFrame:
    """Add a boolean: unmasked and at or above the group's entropy quantile ``q``. All false
    in a group without unmasked tokens."""
    thresholds = entropy_quantile(tokens, q, groups, mask)
    flag = (F.col("entropy") >= F.col("threshold")) & (F.col(mask) == 1)
    return (
        tokens.join(thresholds, list(groups), "left")
        .withColumn(name, F.coalesce(flag, F.lit(False)))
        .drop("threshold")
    )


def entropy_sketches(tokens: DataFrame, groups: Sequence[str], mask: str = "mask", k: int = SKETCH_K, value: str = "entropy") -> DataFrame:
    """``groups, sketch, n``: a small mergeable summary of the unmasked entropies of each group, the opt-in approximation of
    :func:`entropy_quantile`. NULL and NaN are left out; a group without values has no row.

    A KLL sketch of size ``k`` takes a few times ``k`` numbers however many tokens there are, is built before the shuffle, and
    can be stored: sketches of steps merge into sketches of runs (:func:`merge_sketches`) without a look at the tokens. A quantile's rank is off by
    at most :func:`sketch_rank_error` in 99 of 100 cases. Up to ``k`` values it is exact (but not interpolated).
    """
    rows = tokens.where((F.col(mask) == 1) & F.col(value).isNotNull() & ~F.isnan(value))
    return rows.groupBy(*groups).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups from stored ones."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantile(sketches: DataFrame, q: float, name: str = "threshold") -> DataFrame:
    """Replace ``sketch`` by its quantile ``q``: one of the values, at a rank near ``q * n``."""
    return sketches.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).drop("sketch")


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Share of the values by which a quantile's rank may be off, at 99 % confidence: 2.296 / k^0.9021."""
    return 2.296 / k**0.9021


# ------------------------------------------------------------------ loss


def importance_ratio(tokens: DataFrame, cap: float = IMPORTANCE_CAP) -> DataFrame:
    return tokens.withColumn("ratio", K.capped_ratio(F.col("old_logp"), F.col("sampling_logp"), cap))


def _clamped(total: Column) -> Column:
    return F.greatest(total, F.lit(1))


def sequence_means(
    tokens: DataFrame,
    sequence: Sequence[str],
    mask: str = "mask",
    entropy_mask: str | None = None,
    importance: bool = False,
) -> DataFrame:
    """Per sequence: masked mean of the divergence, and the importance weight.

    The weight is one number per sequence, so multiplying the mean by it equals weighting
    every token; no join back to the tokens is needed.
    """
    weight = F.col(mask).cast("double")
    loss = F.col("divergence") * weight
    if entropy_mask is not None:
        loss = loss * F.col(entropy_mask).cast("double")
    count = _clamped(F.sum(mask))
    aggregates = [(F.sum(loss) / count).alias("loss"), F.sum(mask).cast("bigint").alias("n_tokens")]
    if importance:
        aggregates.append((F.sum(F.col("ratio") * weight) / count).alias("importance_weight"))
    means = tokens.groupBy(*sequence).agg(*aggregates)
    if importance:
        means = means.withColumn("loss", F.col("loss") * F.col("importance_weight"))
    return means


def sequence_loss(sequences: DataFrame, groups: Sequence[str], accumulation_steps: int | None = None) -> DataFrame:
    """Mean over sequences of :func:`sequence_means`, divided by the accumulation steps."""
    steps = accumulation_steps if accumulation_steps and accumulation_steps > 0 else 1
    return sequences.groupBy(*groups).agg(
        (F.avg("loss") / steps).alias("loss"), F.count(F.lit(1)).alias("n_sequences")
    )


def masked_batch_mean(
    tokens: DataFrame, values: Sequence[str], groups: Sequence[str], mask: str = "mask", single_column: bool = False
) -> DataFrame:
    """Token-weighted mean of each column over the mask, at least one token in the
    denominator. With one value per sequence (``single_column``) the plain mean."""
    if single_column:
        return tokens.groupBy(*groups).agg(*[F.avg(v).alias(v) for v in values])
    count = _clamped(F.sum(mask))
    return tokens.groupBy(*groups).agg(*[(F.sum(F.col(v) * F.col(mask)) / count).alias(v) for v in values])


def kl_approx(tokens: DataFrame, name: str = "kl_approx") -> DataFrame:
    return tokens.withColumn(name, K.k3(F.col("student_logp"), F.col("teacher_logp")))


def kl_to_base(tokens: DataFrame, name: str = "kl_to_base") -> DataFrame:
    """Token estimate of the distance to a frozen base model with column ``ref_logp``."""
    return tokens.withColumn(name, K.k3(F.col("student_logp"), F.col("ref_logp")))


def _nan_aware(value: Column) -> Column:
    """Mergeable state of a column: how many values, how many of them NaN, and sum and extremes of the others."""
    number = F.when(~F.isnan(value), value)
    return F.struct(
        F.count(value).alias("n"), F.count(F.when(F.isnan(value), 1)).alias("nans"), F.sum(number).alias("total"),
        F.min(number).alias("low"), F.max(number).alias("high"),
    )


def skip_nan_mean(batches: DataFrame, values: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Mean of per-batch metrics over the batches that have a number: NULL and NaN are skipped. NULL if none has one."""
    return batches.groupBy(*groups).agg(*[F.avg(F.nanvl(v, F.lit(None).cast("double"))).alias(v) for v in values])


def kl_approx_mean(tokens: DataFrame, batch: Sequence[str], groups: Sequence[str], mask: str = "mask") -> DataFrame:
    """Token mean per batch with an unclamped denominator (NULL for an all-masked batch),
    then the mean over the batches that have one. A batch with a NaN token, masked or not, has none."""
    total = F.sum(mask)
    per_batch = tokens.groupBy(*batch).agg(
        F.try_divide(F.sum(F.col("kl_approx") * F.col(mask)), total).alias("kl_approx")
    )
    return skip_nan_mean(per_batch, ["kl_approx"], groups)


def importance_stats(tokens: DataFrame, batch: Sequence[str], groups: Sequence[str], mask: str = "mask") -> DataFrame:
    """Ratio and log-prob difference on unmasked tokens, per batch and then over batches.
    A batch without unmasked tokens counts with 0, as a producer would log it.

    A NaN on an unmasked token makes its batch's numbers NaN. Over batches the ratio's skip NaN, and are NULL if all are; the
    difference's do not, so one such batch shows.
    """
    kept = F.col(mask) == 1
    per_batch = tokens.groupBy(*batch).agg(
        _nan_aware(F.when(kept, F.col("ratio"))).alias("_r"),
        _nan_aware(F.when(kept, F.abs(F.col("old_logp") - F.col("sampling_logp")))).alias("_g"),
    )

    def of(state: str, value: Column) -> Column:
        return F.when(F.col(f"{state}.nans") > 0, F.lit(float("nan"))).when(F.col(f"{state}.n") == 0, 0.0).otherwise(value)

    def mean(state: str) -> Column:
        return F.try_divide(f"{state}.total", f"{state}.n")

    per_batch = per_batch.select(
        *batch,
        of("_r", F.col("_r.low")).alias("ratio_min"),
        of("_r", mean("_r")).alias("ratio_mean"),
        of("_r", F.col("_r.high")).alias("ratio_max"),
        of("_g", mean("_g")).alias("logp_difference_mean"),
        of("_g", F.col("_g.high")).alias("logp_difference_max"),
    )

    def number(name: str) -> Column:
        return F.nanvl(name, F.lit(None).cast("double"))

    return per_batch.groupBy(*groups).agg(
        F.min(number("ratio_min")).alias("ratio_min"),
        F.avg(number("ratio_mean")).alias("ratio_mean"),
        F.max(number("ratio_max")).alias("ratio_max"),
        F.avg("logp_difference_mean").alias("logp_difference_mean"),
        F.max("logp_difference_max").alias("logp_difference_max"),
    )


# ------------------------------------------------------------------ reference blend


def blend_vectors(model: DataFrame, reference: DataFrame, alpha: float, key: str = "key", value: str = "value") -> DataFrame:
    """``alpha * model + (1 - alpha) * reference`` per key."""
    theirs = reference.select(key, F.col(value).alias("_ref"))
    return model.join(theirs, key).select(
        key, F.zip_with(value, "_ref", lambda m, r: alpha * m.cast("double") + (1 - alpha) * r.cast("double")).alias(value)
    )


def vector_blocks(vectors: DataFrame, size: int, value: str = "value") -> DataFrame:
    """Cut long vectors: a row per ``block`` of at most ``size`` values. Joins and sums work per block."""
    last = F.floor((F.size(value) - 1) / size).cast("int")
    pieces = F.when(F.size(value) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(value, i * size + 1, size)))
    others = [c for c in vectors.columns if c != value]
    return vectors.select(*others, F.posexplode(pieces).alias("block", value))


def _weighted_sums(parts: DataFrame, key: str) -> DataFrame:
    """Sum of ``weight * value`` per (key, block). Blocks are added up per batch before the shuffle, so what
    meets in one task is a block per batch, however many steps a key has."""
    schema = f"`{key}` {parts.schema[key].dataType.simpleString()}, block int, value array<double>"

    def add(keys, blocks, weights, values) -> pa.Table:
        sums: dict = {}
        for name, block, weight, value in zip(keys, blocks, weights, values):
            own = np.asarray(value, np.float64) * weight
            have = sums.get((name, block))
            if have is None:
                sums[name, block] = own
            elif len(have) == len(own):
                have += own
            else:
                raise ValueError(f"vectors of {name!r} differ in length")
        return list(sums), list(sums.values())

    def rows(kind, names, sums):
        columns = [pa.array([n for n, _ in names], kind), pa.array([b for _, b in names], pa.int32()), pa.array(sums, pa.list_(pa.float64()))]
        return columns, [key, "block", "value"]

    def of(table):
        values = [x.values.to_numpy(zero_copy_only=False) for x in table.column(3)]
        return add(*(table.column(i).to_pylist() for i in range(3)), values)

    def per_batch(batches):
        for batch in batches:
            columns, names = rows(batch.column(0).type, *of(batch))
            yield pa.RecordBatch.from_arrays(columns, names)

    def per_block(part):
        columns, names = rows(part.column(0).type, *of(pa.table([part.column(0), part.column(1), pa.array([1.0] * part.num_rows), part.column(2)], ["k", "b", "w", "v"])))
        return pa.table(columns, names)

    partial = parts.select(key, "block", "weight", "value").mapInArrow(per_batch, schema)
    return partial.groupBy(key, "block").applyInArrow(per_block, schema)


def blend_history(
    steps: DataFrame, reference: DataFrame, alpha: float, every: int, key: str = "key", block_size: int = 4096
) -> DataFrame:
    """Reference vector after following ``(key, step, value)`` at every step divisible by
    ``every``, starting from ``(key, value)``. Returns (key, block, value), blocks of ``block_size``.

    The recurrence unrolls to a weighted sum, ``alpha (1-alpha)^(k-i)`` for the i-th of k
    synchronised steps, so it is a sum per block of values. Neither single values nor whole vectors
    become rows, and ranks are computed on step numbers without the vectors.
    """
    synced = steps.where(F.col("step") % every == 0)
    order = synced.select(key, "step").withColumn(
        "_later", F.row_number().over(Window.partitionBy(key).orderBy(F.col("step").desc())) - 1
    )
    counts = order.groupBy(key).agg(F.count(F.lit(1)).alias("_k"))
    keep = F.lit(1.0 - alpha)
    parts = synced.join(order, [key, "step"]).select(key, F.col("value").cast("array<double>").alias("value"), (F.lit(float(alpha)) * F.pow(keep, F.col("_later"))).alias("weight"))
    start = reference.join(counts, key, "left").select(key, F.col("value").cast("array<double>").alias("value"), F.pow(keep, F.coalesce("_k", F.lit(0))).alias("weight"))
    return _weighted_sums(vector_blocks(parts.unionByName(start), block_size), key)
