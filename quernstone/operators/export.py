"""Training rows and their export as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTRUCTION = "Answer the question from the context given."
SELECTION = "Choose the children that help to answer the question."

SELECTOR_TRIPLET = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("parent_context", T.StringType()), T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("selected_indices", T.ArrayType(T.IntegerType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def dataset_triplets(rows: DataFrame, context: str, question: str, answer: str, *keep: str) -> DataFrame:
    """(instruction, input, output) of contexts, questions and answers."""
    text = F.concat(F.lit("Context: "), F.col(context), F.lit("\n\nQuestion: "), F.col(question))
    return rows.select(*keep, F.lit(INSTRUCTION).alias("instruction"), text.alias("input"), F.col(answer).alias("output"))


def conversation_triplets(turns: DataFrame) -> DataFrame:
    """A triplet for each user turn that an assistant's turn follows; the context is the turn before the user's, if any."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("_next"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("_before"))
    return dataset_triplets(rows.where("role = 'user' and _role = 'assistant'"), "_before", "text", "_next", "conv_id", "turn")


def to_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def from_jsonl(spark: SparkSession, path: str, schema: T.StructType = SELECTOR_TRIPLET) -> DataFrame:
    """Rows of a JSON-lines file or folder; a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def synthetic_triplets(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Selector triplets of model replies: JSON arrays, maybe in code fences; those without a query or choices go."""
    bare = F.regexp_replace(F.trim(F.col(reply)), r"^```(?:json)?\s*|\s*```$", "")
    rows = replies.select(F.explode(F.from_json(bare, T.ArrayType(SELECTOR_TRIPLET))).alias("t")).select("t.*")
    return rows.where((F.coalesce(F.col("query"), F.lit("")) != "") & (F.size("choices") > 0))
