"""Explicit schemas; no reader in this package infers one."""

from pyspark.sql import types as T

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
TOOL_STEPS = T.ArrayType(
    T.StructType([T.StructField("Action", T.StringType()), T.StructField("Action_Input", T.StringType())])
)

TOOLUSE_RAW = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("golden_answer", TOOL_STEPS),
        T.StructField("golden_response", T.ArrayType(T.StringType())),
    ]
)

# train_indices stays VARIANT per element so that 1, 1.0, "1" and true remain distinguishable.
FEWSHOT_MANIFEST = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField(
            "tasks",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("train_indices", T.VariantType()),
                        T.StructField("rationale", T.StringType()),
                    ]
                ),
            ),
        ),
    ]
)

TASK_COLUMNS = {
    "copa": ["premise", "choice1", "choice2", "question", "idx", "label"],
    "cb": ["premise", "hypothesis", "idx", "label"],
    "wsc": ["text", "span1_index", "span2_index", "span1_text", "span2_text", "idx", "label"],
}

TOOL_CALLS = T.StructType(
    [
        T.StructField(
            "calls",
            T.ArrayType(
                T.StructType([T.StructField("action", T.StringType()), T.StructField("input", T.StringType())])
            ),
        ),
        T.StructField("ok", T.BooleanType()),
    ]
)
TOKEN_STATS = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in ("student_logp", "teacher_logp", "entropy", "divergence")]
)
