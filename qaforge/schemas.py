"""Fixed row shapes shared by the readers, operators and streams."""

from pyspark.sql import types as T

QA = T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])

QA_SHORT = T.StructType([T.StructField("Q", T.StringType()), T.StructField("A", T.StringType())])

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

CHAT = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])

CHAT_LOG = T.StructType(
    [
        T.StructField("user_prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("rating_msg", T.StringType()),
    ]
)

ENSEMBLE_LOG = T.StructType(
    [
        T.StructField("user_query", T.StringType()),
        T.StructField("model_responses", T.ArrayType(T.StringType())),
        T.StructField("quality_scores", T.MapType(T.StringType(), T.DoubleType())),
    ]
)

COLUMNS_META = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("default", T.StringType()),
    ]
)

DIFF_REPORT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("table", "issue", "column_or_pk", "details", "db1_info", "db2_info")
    ]
)
