"""Grades of answers, parsed from a model's replies without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def faithfulness_prompt(contexts: Column, response: Column) -> Column:
    return F.concat(F.lit('Does the context support the response? Reply as JSON with "score" (0 to 1), "feedback" and "passing".\nContext:\n'), F.array_join(contexts, "\n\n"), F.lit("\nResponse: "), response)


def relevancy_prompt(query: Column, response: Column) -> Column:
    return F.concat(F.lit('Does the response answer the question? Reply as JSON with "score" (0 to 1), "feedback" and "passing".\nQuestion: '), query, F.lit("\nResponse: "), response)


def _fields(v: Column) -> tuple[Column, Column, Column]:
    kind = lambda key: F.regexp_replace(F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")), F.lit("")), r"\(.*", "")
    score = F.when(kind("score").isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$.score", "double"))
    feedback = F.when(kind("feedback") == "STRING", F.try_variant_get(v, "$.feedback", "string"))
    passing = F.when(kind("passing") == "BOOLEAN", F.try_variant_get(v, "$.passing", "boolean"))
    return F.coalesce(score, F.lit(0.0)), F.coalesce(feedback, F.lit("")), F.coalesce(passing, F.lit(False))


def _result(score: Column, feedback: Column, passing: Column) -> Column:
    return F.struct(score.alias("score"), feedback.alias("feedback"), passing.alias("passing"))


def parse_faithfulness(reply: Column) -> Column:
    """struct<score, feedback, passing> of the first brace to the next closing one; else of "score: n", which passes from 0.7; else zero.

    Nested braces so cut an object short, and it doesn't parse.
    """
    v = F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), F.lit("")))
    number = F.nullif(F.regexp_extract(reply, r"(?i)score\s*[:=]\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    loose = F.coalesce(number, F.lit(0.0))
    return F.when(v.isNotNull(), _result(*_fields(v))).otherwise(_result(loose, F.coalesce(reply, F.lit("")), loose >= 0.7))


def parse_relevancy(reply: Column) -> Column:
    """struct<score, feedback, passing> of the first opening to the last closing brace; a reply that doesn't parse fails with 0."""
    first = F.locate("{", reply)
    last = F.length(reply) - F.locate("}", F.reverse(reply)) + 1
    inner = F.when((first > 0) & (F.locate("}", reply) > 0) & (last > first), F.substring(reply, first, last - first + 1))
    v = F.try_parse_json(inner)
    return F.when(v.isNotNull(), _result(*_fields(v))).otherwise(_result(F.lit(0.0), F.coalesce(reply, F.lit("")), F.lit(False)))
