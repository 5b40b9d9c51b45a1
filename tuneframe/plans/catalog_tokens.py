"""Queries for token-level distillation analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe.functions import tokens as K
from tuneframe.operators import distill
from tuneframe.plans import derived as D
from tuneframe.plans.derived import r6, r6_sql, with_tables
from tuneframe.plans.registry import Tables, query
from tuneframe.session import run_folder, written
from tuneframe.sources import writers

KEY = "run_id, seq_id, pos"
VALUES = with_tables("token_values")
SEQUENCE = ["run_id", "batch_id", "seq_id"]


def _pairs(t: Tables):
    return distill.pair_student_teacher(D.student_tokens(t), D.teacher_tokens(t))


def _metrics(t: Tables, alpha: float = 0.0, engine: str = "arrow"):
    return distill.token_metrics(_pairs(t), alpha, engine=engine)


def _written_metrics(t: Tables):
    """Scalars of every token, written once: the vectors are joined and reduced a single time
    however often the scalars are read."""
    return written(_metrics(t), "token-metrics")


@query(
    "pair_student_teacher",
    with_tables("tokens")
    + f"SELECT {KEY}, token_id, mask, {r6_sql('list_sum(sl)')} AS student_sum, {r6_sql('tl[1] - sl[1]')} AS first_gap FROM tokens",
)
def pair_student_teacher(t: Tables):
    total = F.aggregate("student_logits", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    gap = F.col("teacher_logits")[0].cast("double") - F.col("student_logits")[0].cast("double")
    return _pairs(t).select(
        *distill.KEY, "token_id", "mask", r6(total).alias("student_sum"), r6(gap).alias("first_gap")
    )


@query(
    "pair_student_teacher_bucketed",
    with_tables("tokens")
    + f"SELECT {KEY}, token_id, mask, {r6_sql('list_sum(sl)')} AS student_sum, {r6_sql('tl[1] - sl[1]')} AS first_gap FROM tokens",
)
def pair_student_teacher_bucketed(t: Tables):
    """Both token tables saved in buckets of the key: the join reads bucket by bucket, without an exchange or a sort."""
    saved = []
    for name, tokens in (("student", D.student_tokens(t)), ("teacher", D.teacher_tokens(t))):
        path = run_folder(t.spark, f"{name}-tokens")
        table = f"{name}_tokens_{path[-32:]}"
        writers.save_token_table(tokens.repartition(8, *distill.KEY), table, 8, path=path)
        saved.append(t.spark.table(table))
    total = F.aggregate("student_logits", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    gap = F.col("teacher_logits")[0].cast("double") - F.col("student_logits")[0].cast("double")
    return distill.pair_student_teacher(*saved).select(*distill.KEY, "token_id", "mask", r6(total).alias("student_sum"), r6(gap).alias("first_gap"))


@query(
    "log_softmax",
    with_tables("tokens")
    + f"SELECT {KEY}, {r6_sql('s[1]')} AS first_logp, {r6_sql('list_max(s)')} AS top_logp, "
    f"{r6_sql('list_sum(list_transform(s, lambda x: exp(x)))')} AS mass FROM tokens",
)
def log_softmax(t: Tables):
    logps = D.student_tokens(t).select(*distill.KEY, K.log_softmax(F.col("student_logits")).alias("s"))
    mass = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.exp(x))
    return logps.select(
        *distill.KEY,
        r6(F.col("s")[0]).alias("first_logp"),
        r6(F.array_max("s")).alias("top_logp"),
        r6(mass).alias("mass"),
    )


@query(
    "selected_logp",
    VALUES + f"SELECT {KEY}, {r6_sql('student_logp')} AS student_logp, {r6_sql('teacher_logp')} AS teacher_logp FROM token_values",
)
def selected_logp(t: Tables):
    return _metrics(t).select(
        *distill.KEY, r6("student_logp").alias("student_logp"), r6("teacher_logp").alias("teacher_logp")
    )


@query("token_entropy", VALUES + f"SELECT {KEY}, {r6_sql('entropy')} AS entropy FROM token_values")
def token_entropy(t: Tables):
    return _metrics(t).select(*distill.KEY, r6("entropy").alias("entropy"))


@query(
    "shift_and_keep",
    "WITH p AS (SELECT *, vec_id // 8 AS seq_id, vec_id % 8 AS pos FROM embeddings), "
    "n AS (SELECT seq_id, count(*) AS n_positions, count(*) // 2 AS n_completion FROM p GROUP BY 1) "
    "SELECT seq_id, pos - greatest(n_positions - 1 - n_completion, 0) AS pos, label FROM p JOIN n USING (seq_id) "
    "WHERE pos < n_positions - 1 AND pos >= greatest(n_positions - 1 - n_completion, 0)",
)
def shift_and_keep(t: Tables):
    """Half of each sequence's positions are completion."""
    tokens = D.student_tokens(t).select("seq_id", "pos", "label")
    lengths = tokens.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_positions"), F.floor(F.count(F.lit(1)) / 2).alias("n_completion")
    )
    return distill.shift_and_keep(tokens, lengths, ["seq_id"])


def _divergence_query(name: str, alpha: float, expression: str, engine: str):
    @query(name, VALUES + f"SELECT {KEY}, {r6_sql(expression)} AS divergence FROM token_values")
    def run(t: Tables):
        return _metrics(t, alpha, engine).select(*distill.KEY, r6("divergence").alias("divergence"))


_divergence_query("forward_kl", 0.0, "forward_kl", "arrow")
_divergence_query("reverse_kl", 1.0, "reverse_kl", "arrow")
_divergence_query("forward_kl_sql", 0.0, "forward_kl", "sql")


JSD_SQL = r6_sql(
    "list_sum(list_transform(list_zip(s, t), lambda z: 0.25 * exp(z[2]) * (z[2] - ln(0.75 * exp(z[1]) + 0.25 * exp(z[2]))) "
    "+ 0.75 * exp(z[1]) * (z[1] - ln(0.75 * exp(z[1]) + 0.25 * exp(z[2])))))"
)


@query("generalized_jsd", with_tables("tokens") + f"SELECT {KEY}, {JSD_SQL} AS divergence FROM tokens")
def generalized_jsd(t: Tables):
    return _metrics(t, 0.25).select(*distill.KEY, r6("divergence").alias("divergence"))


# ------------------------------------------------------------------ vocabularies in blocks

BLOCK = 10


def _blocks(t: Tables):
    student = distill.vector_blocks(D.student_tokens(t), BLOCK, "student_logits")
    return student, distill.vector_blocks(D.teacher_tokens(t), BLOCK, "teacher_logits")


@query(
    "block_token_metrics",
    VALUES
    + f"SELECT {KEY}, token_id, label, {r6_sql('student_logp')} AS student_logp, {r6_sql('teacher_logp')} AS teacher_logp, "
    f"{r6_sql('entropy')} AS entropy, {r6_sql('forward_kl')} AS divergence FROM token_values",
)
def block_token_metrics(t: Tables):
    """Log-probs, entropy and divergence without a row that holds a whole vector."""
    metrics = distill.token_metrics_blocks(*_blocks(t), BLOCK)
    numbers = [r6(c).alias(c) for c in ("student_logp", "teacher_logp", "entropy", "divergence")]
    return metrics.select(*distill.KEY, "token_id", "label", *numbers)


@query("block_reverse_kl", VALUES + f"SELECT {KEY}, {r6_sql('reverse_kl')} AS divergence FROM token_values")
def block_reverse_kl(t: Tables):
    return distill.token_metrics_blocks(*_blocks(t), BLOCK, alpha=1.0).select(*distill.KEY, r6("divergence").alias("divergence"))


@query("block_jsd", with_tables("tokens") + f"SELECT {KEY}, {JSD_SQL} AS divergence FROM tokens")
def block_jsd(t: Tables):
    return distill.token_metrics_blocks(*_blocks(t), BLOCK, alpha=0.25).select(*distill.KEY, r6("divergence").alias("divergence"))


@query(
    "skip_first_tokens",
    "SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, CASE WHEN vec_id % 8 >= 3 AND vec_id % 8 <= (vec_id // 8) % 8 "
    "THEN 1 ELSE 0 END AS loss_mask FROM embeddings",
)
def skip_first_tokens(t: Tables):
    return D.student_tokens(t).select("seq_id", "pos", distill.skip_first_tokens().alias("loss_mask"))


# ------------------------------------------------------------------ entropy

THRESHOLD_SQL = (
    ", th AS (SELECT run_id, batch_id, quantile_cont(entropy, 0.8) AS threshold FROM token_values WHERE mask = 1 "
    "GROUP BY run_id, batch_id) "
)


@query(
    "entropy_quantile",
    VALUES + THRESHOLD_SQL + f"SELECT run_id, batch_id, {r6_sql('threshold')} AS threshold FROM th",
)
def entropy_quantile(t: Tables):
    out = distill.entropy_quantile(_written_metrics(t), 0.8, ["run_id", "batch_id"])
    return out.withColumn("threshold", r6("threshold"))


@query(
    "entropy_sketch",
    VALUES + "SELECT run_id, count(*) AS n, count(DISTINCT batch_id) AS n_sketches, true AS near FROM token_values WHERE mask = 1 GROUP BY run_id",
)
def entropy_sketch(t: Tables):
    """Quantiles of whole runs from the stored sketches of their steps; ``near`` says that the rank is within the stated error."""
    tokens, k, q = _written_metrics(t), 64, 0.8
    sketches = written(distill.entropy_sketches(tokens, ["run_id", "batch_id"], k=k), "entropy-sketches")
    found = distill.sketch_quantile(distill.merge_sketches(sketches, ["run_id"]), q)
    steps = sketches.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sketches"))
    ranked = tokens.where("mask = 1").join(found, "run_id").groupBy("run_id", "n").agg(
        F.count(F.when(F.col("entropy") < F.col("threshold"), 1)).alias("below"), F.count(F.when(F.col("entropy") <= F.col("threshold"), 1)).alias("upto")
    )
    slack = F.lit(2 * distill.sketch_rank_error(k)) * F.col("n") + 1
    near = (F.col("below") - slack <= q * F.col("n")) & (F.col("upto") + slack >= q * F.col("n"))
    return ranked.join(steps, "run_id").select("run_id", "n", "n_sketches", near.alias("near"))


# Thresholds are compared at nine decimals so that both engines break ties alike.
@query(
    "high_entropy_mask",
    VALUES.replace(" AS entropy,", " AS raw_entropy, round(-list_sum(list_transform(s, lambda x: exp(x) * x)), 9) AS entropy,")
    + THRESHOLD_SQL
    + f"SELECT {KEY}, mask = 1 AND coalesce(v.entropy >= round(th.threshold, 9), false) AS entropy_mask FROM token_values v "
    "LEFT JOIN th USING (run_id, batch_id)",
)
def high_entropy_mask(t: Tables):
    tokens = _written_metrics(t).withColumn("entropy", F.round("entropy", 9))
    return distill.high_entropy_mask(tokens, 0.8, ["run_id", "batch_id"]).select(*distill.KEY, "entropy_mask")


# ------------------------------------------------------------------ per-token estimates

# The frozen base model's log-prob is derived from both; old and sampling log-probs are
# the student's and the teacher's.
REF_SQL = "(0.5 * student_logp + 0.5 * teacher_logp - 0.1)"


def _with_ref(t: Tables):
    return _metrics(t).withColumn("ref_logp", 0.5 * F.col("student_logp") + 0.5 * F.col("teacher_logp") - 0.1)


@query(
    "kl_to_base",
    VALUES + f"SELECT {KEY}, {r6_sql(f'exp({REF_SQL} - student_logp) - ({REF_SQL} - student_logp) - 1')} AS kl_to_base FROM token_values",
)
def kl_to_base(t: Tables):
    return distill.kl_to_base(_with_ref(t)).select(*distill.KEY, r6("kl_to_base").alias("kl_to_base"))


@query(
    "kl_approx",
    VALUES + f"SELECT {KEY}, {r6_sql('(student_logp - teacher_logp) + exp(teacher_logp - student_logp) - 1')} AS kl_approx FROM token_values",
)
def kl_approx(t: Tables):
    return distill.kl_approx(_metrics(t)).select(*distill.KEY, r6("kl_approx").alias("kl_approx"))


def _with_ratio(t: Tables):
    tokens = _metrics(t).withColumns({"old_logp": F.col("student_logp"), "sampling_logp": F.col("teacher_logp")})
    return distill.importance_ratio(tokens, cap=1.1)


RATIO_SQL = "least(exp(student_logp - teacher_logp), 1.1)"


@query("importance_ratio", VALUES + f"SELECT {KEY}, {r6_sql(RATIO_SQL)} AS ratio FROM token_values")
def importance_ratio(t: Tables):
    return _with_ratio(t).select(*distill.KEY, r6("ratio").alias("ratio"))


@query(
    "sequence_importance_weight",
    VALUES
    + f"SELECT run_id, batch_id, seq_id, {r6_sql(f'sum({RATIO_SQL} * mask) / greatest(sum(mask), 1)')} AS importance_weight, "
    f"{r6_sql(f'(sum({RATIO_SQL} * mask) / greatest(sum(mask), 1)) * (sum(forward_kl * mask) / greatest(sum(mask), 1))')} AS loss "
    "FROM token_values GROUP BY run_id, batch_id, seq_id",
)
def sequence_importance_weight(t: Tables):
    means = distill.sequence_means(_with_ratio(t), SEQUENCE, importance=True)
    return means.select(*SEQUENCE, r6("importance_weight").alias("importance_weight"), r6("loss").alias("loss"))


@query(
    "sequence_loss",
    VALUES
    + ", q AS (SELECT run_id, batch_id, seq_id, sum(CASE WHEN pos >= 3 THEN forward_kl * mask ELSE 0 END) / "
    "greatest(sum(CASE WHEN pos >= 3 THEN mask ELSE 0 END), 1) AS loss FROM token_values GROUP BY ALL) "
    f"SELECT run_id, batch_id, {r6_sql('avg(loss) / 4')} AS loss, count(*) AS n_sequences FROM q GROUP BY run_id, batch_id",
)
def sequence_loss(t: Tables):
    tokens = _metrics(t).withColumn("mask", distill.skip_first_tokens())
    losses = distill.sequence_loss(distill.sequence_means(tokens, SEQUENCE), ["run_id", "batch_id"], 4)
    return losses.withColumn("loss", r6("loss"))


@query(
    "masked_batch_mean",
    VALUES
    + f"SELECT run_id, batch_id, {r6_sql('sum(entropy * mask) / greatest(sum(mask), 1)')} AS entropy, "
    f"{r6_sql('sum(forward_kl * mask) / greatest(sum(mask), 1)')} AS divergence FROM token_values GROUP BY run_id, batch_id",
)
def masked_batch_mean(t: Tables):
    means = distill.masked_batch_mean(_metrics(t), ["entropy", "divergence"], ["run_id", "batch_id"])
    return means.select(
        "run_id", "batch_id", r6("entropy").alias("entropy"), r6("divergence").alias("divergence")
    )


@query(
    "kl_approx_mean",
    VALUES
    + ", b AS (SELECT run_id, batch_id, sum(((student_logp - teacher_logp) + exp(teacher_logp - student_logp) - 1) * m) / "
    "nullif(sum(m), 0) AS v FROM (SELECT *, CASE WHEN pos >= 3 THEN mask ELSE 0 END AS m FROM token_values) "
    f"GROUP BY run_id, batch_id) SELECT run_id, {r6_sql('avg(v)')} AS kl_approx FROM b GROUP BY run_id",
)
def kl_approx_mean(t: Tables):
    tokens = distill.kl_approx(_metrics(t)).withColumn("mask", distill.skip_first_tokens())
    means = distill.kl_approx_mean(tokens, ["run_id", "batch_id"], ["run_id"])
    return means.withColumn("kl_approx", r6("kl_approx"))


@query(
    "importance_stats",
    VALUES
    + f", b AS (SELECT run_id, batch_id, coalesce(min(r), 0) AS rmin, coalesce(avg(r), 0) AS rmean, coalesce(max(r), 0) AS rmax, "
    "coalesce(avg(g), 0) AS gmean, coalesce(max(g), 0) AS gmax FROM (SELECT run_id, batch_id, "
    f"CASE WHEN mask = 1 THEN {RATIO_SQL} END AS r, CASE WHEN mask = 1 THEN abs(student_logp - teacher_logp) END AS g "
    "FROM token_values) GROUP BY run_id, batch_id) "
    f"SELECT run_id, {r6_sql('min(rmin)')} AS ratio_min, {r6_sql('avg(rmean)')} AS ratio_mean, {r6_sql('max(rmax)')} AS ratio_max, "
    f"{r6_sql('avg(gmean)')} AS logp_difference_mean, {r6_sql('max(gmax)')} AS logp_difference_max FROM b GROUP BY run_id",
)
def importance_stats(t: Tables):
    stats = distill.importance_stats(_with_ratio(t), ["run_id", "batch_id"], ["run_id"])
    return stats.select("run_id", *[r6(c).alias(c) for c in stats.columns if c != "run_id"])


# ------------------------------------------------------------------ batches with NaN

# Every 37th token has no usable student log-prob, which spoils the batches of some runs' steps but not all of them.
NAN_VALUES = (
    VALUES + ", bad AS (SELECT * REPLACE (CASE WHEN (seq_id * 8 + pos) % 37 = 5 THEN 'nan'::DOUBLE ELSE student_logp END AS student_logp) FROM token_values), "
    "step AS (SELECT *, seq_id // 4 AS step_id, abs(student_logp - teacher_logp) AS gap, CASE WHEN isnan(student_logp) THEN student_logp "
    f"ELSE {RATIO_SQL} END AS ratio FROM bad) "
)


def _with_nan(t: Tables):
    bad = (F.col("seq_id") * 8 + F.col("pos")) % 37 == 5
    return _metrics(t).withColumns({
        "student_logp": F.when(bad, F.lit(float("nan"))).otherwise(F.col("student_logp")),
        "step_id": F.floor(F.col("seq_id") / 4).cast("bigint"),
    })


def _number(column):
    return F.nanvl(column, F.lit(None).cast("double"))


@query(
    "importance_ratio_nan",
    NAN_VALUES + f"SELECT {KEY}, isnan(ratio) AS is_nan, CASE WHEN NOT isnan(ratio) THEN {r6_sql('ratio')} END AS ratio FROM step",
)
def importance_ratio_nan(t: Tables):
    tokens = _with_nan(t).withColumns({"old_logp": F.col("student_logp"), "sampling_logp": F.col("teacher_logp")})
    tokens = distill.importance_ratio(tokens, cap=1.1)
    return tokens.select(*distill.KEY, F.isnan("ratio").alias("is_nan"), r6(_number("ratio")).alias("ratio"))


@query(
    "kl_approx_mean_nan",
    NAN_VALUES + ", b AS (SELECT run_id, step_id, bool_or(isnan(student_logp)) AS spoilt, sum(((student_logp - teacher_logp) + exp(teacher_logp - student_logp) - 1) * mask) / "
    f"nullif(sum(mask), 0) AS v FROM step GROUP BY ALL) SELECT run_id, {r6_sql('avg(v) FILTER (NOT spoilt)')} AS kl_approx FROM b GROUP BY run_id",
)
def kl_approx_mean_nan(t: Tables):
    """Steps with a NaN token, masked or not, are skipped."""
    means = distill.kl_approx_mean(distill.kl_approx(_with_nan(t)), ["run_id", "step_id"], ["run_id"])
    return means.withColumn("kl_approx", r6("kl_approx"))


@query(
    "importance_stats_nan",
    NAN_VALUES + ", b AS (SELECT run_id, step_id, coalesce(bool_or(isnan(ratio)) FILTER (mask = 1), false) AS spoilt, "
    "coalesce(min(ratio) FILTER (mask = 1), 0) AS rmin, coalesce(avg(ratio) FILTER (mask = 1), 0) AS rmean, coalesce(max(ratio) FILTER (mask = 1), 0) AS rmax, "
    "coalesce(max(gap) FILTER (mask = 1), 0) AS gmax FROM step GROUP BY ALL) "
    f"SELECT run_id, {r6_sql('min(rmin) FILTER (NOT spoilt)')} AS ratio_min, {r6_sql('avg(rmean) FILTER (NOT spoilt)')} AS ratio_mean, "
    f"{r6_sql('max(rmax) FILTER (NOT spoilt)')} AS ratio_max, bool_or(spoilt) AS difference_is_nan, "
    f"CASE WHEN NOT bool_or(spoilt) THEN {r6_sql('max(gmax)')} END AS logp_difference_max FROM b GROUP BY run_id",
)
def importance_stats_nan(t: Tables):
    """The ratio's numbers skip steps with NaN, the difference's show them."""
    tokens = _with_nan(t).withColumns({"old_logp": F.col("student_logp"), "sampling_logp": F.col("teacher_logp")})
    stats = distill.importance_stats(distill.importance_ratio(tokens, cap=1.1), ["run_id", "step_id"], ["run_id"])
    shown = F.isnan("logp_difference_mean") & F.isnan("logp_difference_max")
    return stats.select(
        "run_id", *[r6(c).alias(c) for c in ("ratio_min", "ratio_mean", "ratio_max")], shown.alias("difference_is_nan"),
        r6(_number("logp_difference_max")).alias("logp_difference_max"),
    )


# ------------------------------------------------------------------ vectors


@query(
    "blend_vectors",
    "SELECT vec_id, i::INT AS i, " + r6_sql("0.25 * e[i + 1] + 0.75 * r[i + 1]") + " AS value FROM (SELECT vec_id, "
    "CAST(embedding AS DOUBLE[]) AS e, list_reverse(CAST(embedding AS DOUBLE[])) AS r FROM embeddings), range(64) t(i)",
)
def blend_vectors(t: Tables):
    model = t.embeddings.select("vec_id", F.col("embedding").alias("value"))
    reference = t.embeddings.select("vec_id", F.reverse("embedding").alias("value"))
    blended = distill.blend_vectors(model, reference, 0.25, key="vec_id")
    return blended.select("vec_id", F.posexplode("value").alias("i", "value")).withColumn("value", r6("value"))


# Each label is a parameter, its vectors in id order are the training steps.
@query(
    "blend_history",
    "WITH v AS (SELECT label, vec_id AS step, i::INT AS i, CAST(embedding AS DOUBLE[])[i + 1] AS x FROM embeddings, range(64) t(i)), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY step DESC) - 1 AS later, "
    "count(*) OVER (PARTITION BY label, i) AS k FROM v WHERE step % 2 = 0), "
    "w AS (SELECT label, i, sum(0.5 * power(0.5, later) * x) AS x FROM s GROUP BY label, i) "
    "SELECT l.label, l.i, " + r6_sql("coalesce(w.x, 0) + power(0.5, coalesce(k.k, 0)) * 1.0") + " AS value FROM "
    "(SELECT DISTINCT label, i FROM v) l LEFT JOIN w USING (label, i) LEFT JOIN (SELECT DISTINCT label, i, k FROM s) k USING (label, i)",
)
def blend_history(t: Tables):
    steps = t.embeddings.select("label", F.col("vec_id").alias("step"), F.col("embedding").alias("value"))
    start = t.embeddings.select("label").distinct().withColumn("value", F.array_repeat(F.lit(1.0), D.VOCAB))
    followed = distill.blend_history(steps, start, 0.5, 2, key="label", block_size=24)
    values = followed.select("label", "block", F.posexplode("value").alias("i", "value"))
    return values.select("label", (F.col("block") * 24 + F.col("i")).alias("i"), r6("value").alias("value"))


@query(
    "token_guard",
    "SELECT vec_id, vec_id % 7 BETWEEN 1 AND 6 AS arrow_null, vec_id % 7 BETWEEN 1 AND 6 AS sql_null FROM embeddings",
)
def token_guard(t: Tables):
    """Token ids outside, vectors of two widths, empty, missing or with a hole: no numbers, and none for the neighbours to lose."""
    vector, kind = F.col("embedding"), F.col("vec_id") % 7
    rows = t.embeddings.select(
        "vec_id",
        F.when(kind == 1, F.size(vector)).when(kind == 5, -1).otherwise(0).alias("token_id"),
        F.when(kind == 3, F.slice(vector, 1, 0)).otherwise(vector).alias("student_logits"),
        F.when(kind == 2, F.slice(vector, 1, 3)).when(kind == 6, F.transform(vector, lambda x, i: F.when(i != 1, x)))
        .when(kind != 4, vector).alias("teacher_logits"),
    )
    both = [
        distill.token_metrics(rows, engine=engine).select("vec_id", F.col("student_logp").isNull().alias(f"{engine}_null"))
        for engine in ("arrow", "sql")
    ]
    return both[0].join(both[1], "vec_id")
