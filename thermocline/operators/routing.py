"""Questions to labels, intents and answers; chat statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.columns import n_rows
from . import analytics, joins



def classify_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.withColumn("label", t.question_label(F.col(text)))


def analytical_flag(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.withColumn("is_analytical", t.is_analytical(F.col(text)))


def detect_intent(questions: DataFrame, text: str = "text") -> DataFrame:
    return questions.withColumn("intent", t.question_intent(F.col(text)))


def sql_guard(statements: DataFrame, text: str = "text") -> DataFrame:
    return statements.withColumn("allowed", t.sql_allowed(F.col(text)))


def route_counts(questions: DataFrame, text: str = "text") -> DataFrame:
    """Questions per label, analytical flag and intent."""
    return questions.groupBy(
        t.question_label(F.col(text)).alias("label"), t.is_analytical(F.col(text)).alias("is_analytical"),
        t.question_intent(F.col(text)).alias("intent"),
    ).agg(n_rows().alias("questions"))


def _labels_of(spark: SparkSession, text: str) -> tuple[str, bool, str]:
    """The same column rules applied to one text."""
    one = F.lit(text)
    row = spark.range(1).select(t.question_label(one), t.is_analytical(one), t.question_intent(one)).first()
    return tuple(row)


TEMPLATES: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {
    "avg_by_depth": lambda s: analytics.avg_by_depth(s["measurements"]),
    "regional_comparison": lambda s: analytics.regional_comparison(s["measurements"]),
    "depth_ranges": lambda s: analytics.depth_ranges(s["measurements"]),
    "float_summary": lambda s: joins.float_summary(s["floats"], s["profiles"], s["measurements"]),
    "temporal_trends": lambda s: analytics.temporal_trends(s["measurements"]),
    "bgc_analysis": lambda s: analytics.bgc_zones(s["measurements"]),
}


def ask(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> tuple[str, DataFrame | None]:
    """Intent of a plain-language question and the query that answers it; no query for chat or free questions."""
    label, analytical, intent = _labels_of(spark, text)
    if label == "chat" or not analytical or intent not in TEMPLATES:
        return intent, None
    return intent, TEMPLATES[intent](tables)


def run_sql(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A guarded SELECT over the given tables."""
    low = statement.lower()
    if any(word in low for word in t.FORBIDDEN_SQL) or not low.strip().startswith("select"):
        raise ValueError("only plain SELECT statements are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def retrieval_metadata(hits: DataFrame, question: str = "question_id") -> DataFrame:
    """Per question: ids in rank order, distinct floats, how many, and whether there are table rows.

    A question has as many hits as the search returns (20), so the lists are short.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id")))
    sql = F.bool_or("has_sql") if "has_sql" in hits.columns else F.lit(False)
    return hits.groupBy(question).agg(
        ranked.alias("_r"), F.array_sort(F.collect_set("float_id")).alias("_f"), F.count("id").alias("data_count"),
        sql.alias("has_sql_results"),
    ).select(
        question, F.array_join(F.transform("_r", lambda x: x["id"].cast("string")), ",").alias("ids"),
        F.array_join(F.transform("_f", lambda x: x.cast("string")), ",").alias("float_ids"),
        F.size("_f").alias("float_count"), "data_count", "has_sql_results",
    )


def chat_statistics(log: DataFrame, is_error: Column, by=(), role: str = "role", user: str = "user",
                    ai: str = "assistant") -> DataFrame:
    """Messages, those of the user and of the assistant, errors, and the success rate in percent."""
    answer = F.col(role) == ai
    return log.groupBy(*by).agg(
        n_rows().alias("total"), F.count_if(F.col(role) == user).alias("user_messages"),
        F.count_if(answer).alias("ai_messages"), F.count_if(answer & is_error).alias("errors"),
    ).filter("total > 0").withColumn(
        "success_rate",
        (F.col("ai_messages") - F.col("errors")) * 100.0 / F.greatest(F.col("ai_messages"), F.lit(1)),
    )
