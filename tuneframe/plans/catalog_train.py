"""Queries for ordering, batch plans and completion statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tuneframe.functions import arrays
from tuneframe.functions.text import non_empty_lines
from tuneframe.operators import batches, completions, ordering
from tuneframe.plans import derived as D
from tuneframe.plans.derived import r6, r6_sql, with_tables
from tuneframe.plans.registry import Tables, query

SEED = 42
PLAN = batches.batch_plan(per_device_batch=4, accumulation_steps=2, num_generations=2, num_iterations=3)

SHUFFLED_SQL = (
    "shuffled AS (SELECT p_partkey AS row_idx, p_name, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1 "
    "AS pos FROM part)"
)
# Generation batch 8, two generations, six repeats: chunks of four rows, 48 plan rows each.
PLAN_SQL = (
    f"{SHUFFLED_SQL}, sampled AS (SELECT row_idx, pos // 4 AS chunk, r AS repeat, g AS generation, "
    "(pos // 4) * 48 + r * 8 + (pos % 4) * 2 + g AS ordinal FROM shuffled, range(6) a(r), range(2) b(g) "
    "WHERE pos < (SELECT count(*) - count(*) % 4 FROM part))"
)


def _part(t: Tables):
    return t.part.select(F.col("p_partkey").alias("row_idx"), "p_name")


@query("seeded_shuffle", f"WITH {SHUFFLED_SQL} SELECT row_idx, p_name, pos FROM shuffled")
def seeded_shuffle(t: Tables):
    return ordering.seeded_shuffle(_part(t), SEED)


@query(
    "eval_sampler",
    "SELECT doc_id AS row_idx, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM labels",
)
def eval_sampler(t: Tables):
    """Labelled documents have gaps in their ids; positions do not."""
    rows = t.labels.select(F.col("doc_id").alias("row_idx"))
    return batches.eval_sampler(ordering.position_by_id(rows)).select("row_idx", "ordinal")


def _sampled(t: Tables):
    rows = _part(t)
    return batches.repeat_sampler(ordering.seeded_shuffle(rows, SEED), PLAN, counted=rows)


@query("repeat_sampler", f"WITH {PLAN_SQL} SELECT row_idx, chunk, repeat, generation, ordinal FROM sampled")
def repeat_sampler(t: Tables):
    return _sampled(t).select(
        "row_idx", "chunk", F.col("repeat").cast("bigint"), F.col("generation").cast("bigint"), "ordinal"
    )


@query(
    "sampler_summary",
    "SELECT count(*) AS n_rows, count(*) % 4 AS n_dropped, (count(*) - count(*) % 4) * 12 AS n_plan_rows FROM customer",
)
def sampler_summary(t: Tables):
    return batches.sampler_summary(t.customer, PLAN)


@query(
    "generation_batches",
    f"WITH {PLAN_SQL} SELECT ordinal // 8 AS batch_id, count(*) AS n, count(DISTINCT row_idx) AS n_prompts, "
    "min(ordinal) AS first_ordinal FROM sampled GROUP BY 1",
)
def generation_batches(t: Tables):
    batched = batches.generation_batches(_sampled(t), 4, PLAN.steps_per_generation)
    n_rows = batches.sampler_summary(t.part, PLAN).first()["n_plan_rows"]
    return batches.by_batch(batched, n_rows).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("row_idx").alias("n_prompts"),
        F.min("ordinal").alias("first_ordinal"),
    )


@query(
    "microbatch_slices",
    "WITH o AS (SELECT unnest(range((count(*) - count(*) % 8) * 12)) AS ordinal FROM part), b AS (SELECT *, ordinal // 8 AS batch_id FROM o) "
    "SELECT ordinal, batch_id, batch_id % 2 AS process, (row_number() OVER (PARTITION BY batch_id ORDER BY "
    "md5('42:' || batch_id || ':' || ordinal), ordinal) - 1) // 4 AS slice FROM b",
)
def microbatch_slices(t: Tables):
    """Two processes: generation batches of sixteen, of which each process takes eight in slices of four."""
    plan = batches.batch_plan(per_device_batch=4, accumulation_steps=2, num_generations=2, num_iterations=3, num_processes=2)
    n_rows = batches.sampler_summary(t.part, plan).select("n_plan_rows").scalar()
    return batches.microbatch_slices(n_rows, plan, SEED, t.spark)


@query(
    "step_schedule",
    "SELECT o_orderkey AS step, o_orderkey // 6 AS generation_id, o_orderkey % 2 AS slice, o_orderkey % 6 = 0 AS regenerate FROM orders",
)
def step_schedule(t: Tables):
    return batches.step_schedule(t.orders.select(F.col("o_orderkey").alias("step")), PLAN)


@query(
    "dedup_expand",
    f"SELECT doc_id, len({D.lines_sql('text')})::INT AS n_lines, md5(text || '#') AS digest FROM documents",
)
def dedup_expand(t: Tables):
    """Line counts and digests worked out once per distinct text, spread to all copies."""
    def work(distinct):
        return distinct.select(
            "key_id",
            F.size(non_empty_lines(F.col("key"))).alias("n_lines"),
            F.md5(F.concat("key", F.lit("#"))).alias("digest"),
        )

    return ordering.dedup_expand(t.documents.select("doc_id", "text"), F.col("text"), work, keep=["doc_id"])


@query(
    "latest_n_examples",
    "SELECT user_id % 12 AS run_id, event_id, props FROM events QUALIFY row_number() OVER "
    "(PARTITION BY user_id % 12 ORDER BY event_id DESC) <= 32",
)
def latest_n_examples(t: Tables):
    rows = t.events.select((F.col("user_id") % 12).alias("run_id"), "event_id", "props")
    return ordering.latest_n(rows, 32, "event_id", ["run_id"])


@query(
    "latest_n_large",
    "SELECT l_returnflag AS run_id, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER "
    "(PARTITION BY l_returnflag ORDER BY l_orderkey * 8 + l_linenumber DESC) <= 5000",
)
def latest_n_large(t: Tables):
    """Far more rows of a group than Spark itself would limit before a shuffle."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("run_id"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    return ordering.latest_n(rows, 5000, "at", ["run_id"]).drop("at")


@query(
    "drop_duplicate_prompts",
    "SELECT lang AS run_id, doc_id % 3 AS step, min(doc_id) AS ordinal, md5(text) AS prompt_digest, length(text)::INT AS n_chars FROM documents GROUP BY lang, doc_id % 3, text",
)
def drop_duplicate_prompts(t: Tables):
    """Whole texts as prompts, exact copies among them: each stays once in each run and step."""
    rows = t.documents.select(F.col("lang").alias("run_id"), (F.col("doc_id") % 3).alias("step"), F.col("doc_id").alias("ordinal"), F.col("text").alias("prompt"))
    kept = ordering.drop_duplicate_prompts(rows, "ordinal")
    return kept.select("run_id", "step", "ordinal", F.md5("prompt").alias("prompt_digest"), F.length("prompt").alias("n_chars"))


# ------------------------------------------------------------------ completions


def _digest(ids) -> F.Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


@query(
    "eos_mask",
    with_tables("completions")
    + "SELECT example_id, len(ids)::INT AS n_kept, len(raw_ids)::INT AS n_ids, md5(array_to_string(ids, ',')) AS digest "
    "FROM completions",
)
def eos_mask(t: Tables):
    kept = arrays.cut_after_eos(F.col("raw_ids"), D.EOS)
    return D.completions(t).select(
        "example_id", F.size(kept).alias("n_kept"), F.size("raw_ids").alias("n_ids"), _digest(kept).alias("digest")
    )


@query(
    "truncate_prompt",
    with_tables("completions")
    + "SELECT example_id, md5(array_to_string(CASE WHEN len(raw_ids) > 128 THEN raw_ids[len(raw_ids) - 127:] ELSE raw_ids END, ',')) "
    "AS left_digest, md5(array_to_string(raw_ids[1:128], ',')) AS right_digest FROM completions",
)
def truncate_prompt(t: Tables):
    """The prompt-length limit, with either end giving way."""
    ids = F.col("raw_ids")
    return D.completions(t).select(
        "example_id",
        _digest(arrays.truncate(ids, 128, "left")).alias("left_digest"),
        _digest(arrays.truncate(ids, 128, "right")).alias("right_digest"),
    )


@query(
    "truncated_mask",
    with_tables("completions")
    + "SELECT example_id, len(ids)::BIGINT AS n_ids, CASE WHEN ids[-1] IN (3, 0) THEN len(ids) ELSE 0 END::BIGINT AS n_unmasked "
    "FROM completions",
)
def truncated_mask(t: Tables):
    rows = D.cut_completions(t)
    mask = arrays.truncated_mask(arrays.ones(F.col("completion_ids")), F.col("completion_ids"), D.EOS, D.PAD)
    return rows.select(
        "example_id",
        F.size("completion_ids").cast("bigint").alias("n_ids"),
        F.size(F.filter(mask, lambda m: m == 1)).cast("bigint").alias("n_unmasked"),
    )


@query(
    "padded_batches",
    with_tables("completions")
    + ", w AS (SELECT *, max(len(prompt_ids)) OVER (PARTITION BY batch_id) AS p, max(len(ids)) OVER (PARTITION BY batch_id) AS c, "
    "(ids[-1] IN (3, 0)) AS ended FROM completions) SELECT example_id, batch_id, (p + c)::INT AS width, "
    "md5(array_to_string(list_concat(list_transform(range(p - len(prompt_ids)), lambda x: 0), prompt_ids, ids, "
    "list_transform(range(c - len(ids)), lambda x: 0)), ',')) AS input_digest, "
    "md5(array_to_string(list_concat(list_transform(range(p - len(prompt_ids)), lambda x: 0), list_transform(prompt_ids, lambda x: 1), "
    "list_transform(ids, lambda x: CASE WHEN ended THEN 1 ELSE 0 END), list_transform(range(c - len(ids)), lambda x: 0)), ',')) "
    "AS mask_digest FROM w",
)
def padded_batches(t: Tables):
    rows = D.cut_completions(t).select("example_id", "batch_id", "prompt_ids", "completion_ids")
    out = batches.padded_batches(rows, "batch_id", "prompt_ids", "completion_ids", D.PAD, D.EOS, mask_truncated=True)
    return out.select(
        "example_id",
        "batch_id",
        F.size("input_ids").alias("width"),
        _digest(F.col("input_ids")).alias("input_digest"),
        _digest(F.col("attention_mask")).alias("mask_digest"),
    )


KEYS = "run_id, mode, step, batch_id"
SIZES_SQL = (
    with_tables("completions")
    + f", sizes AS (SELECT {KEYS}, len(ids) AS n, ids[-1] NOT IN (3, 0) AS cut FROM completions) "
)


@query(
    "completion_lengths",
    SIZES_SQL + f"SELECT {KEYS}, {r6_sql('avg(n)')} AS mean_length, min(n)::INT AS min_length, max(n)::INT AS max_length, "
    f"count(*) AS n_sequences FROM sizes GROUP BY {KEYS}",
)
def completion_lengths(t: Tables):
    out = completions.completion_lengths(D.cut_completions(t), D.EOS, D.PAD)
    return out.withColumn("mean_length", r6("mean_length"))


@query(
    "clipped_ratio",
    SIZES_SQL + f"SELECT {KEYS}, {r6_sql('avg(cut::INT)')} AS clipped_ratio, count(*) - count(cut) AS n_empty, "
    f"count(*) AS n_sequences FROM sizes GROUP BY {KEYS}",
)
def clipped_ratio(t: Tables):
    out = completions.clipped_ratio(D.cut_completions(t), D.EOS, D.PAD)
    return out.withColumn("clipped_ratio", r6("clipped_ratio"))


@query(
    "terminated_lengths",
    SIZES_SQL
    + f"SELECT {KEYS}, {r6_sql('coalesce(avg(n) FILTER (NOT cut), 0)')} AS mean_terminated_length, "
    "coalesce(min(n) FILTER (NOT cut), 0)::INT AS min_terminated_length, "
    f"coalesce(max(n) FILTER (NOT cut), 0)::INT AS max_terminated_length FROM sizes GROUP BY {KEYS}",
)
def terminated_lengths(t: Tables):
    out = completions.terminated_lengths(D.cut_completions(t), D.EOS, D.PAD)
    return out.withColumn("mean_terminated_length", r6("mean_terminated_length"))


@query(
    "token_totals",
    with_tables("completions")
    + ", s AS (SELECT run_id, mode, step, sum(len(prompt_ids))::BIGINT AS prompt_tokens, sum(len(ids))::BIGINT AS completion_tokens "
    "FROM completions GROUP BY run_id, mode, step) SELECT *, sum(CASE WHEN mode = 'train' THEN prompt_tokens + completion_tokens "
    "ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step, mode <> 'train' ROWS UNBOUNDED PRECEDING)::BIGINT AS num_tokens FROM s",
)
def token_totals(t: Tables):
    return completions.token_totals(D.cut_completions(t))


@query(
    "mean_reward",
    "SELECT l_orderkey AS batch_id, " + r6_sql("coalesce(avg(l_discount) FILTER (l_returnflag <> 'N'), 0)")
    + " AS mean_reward FROM lineitem GROUP BY 1",
)
def mean_reward(t: Tables):
    """Line items as tokens: the discount is the reward, returned ones count."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_discount").alias("reward"),
        F.when(F.col("l_returnflag") != "N", 1).otherwise(0).alias("mask"),
    )
    return completions.mean_reward(rows, ["batch_id"]).withColumn("mean_reward", r6("mean_reward"))
