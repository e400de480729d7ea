"""Post-processing of scored rows: cut-offs, keywords, and biased re-scoring with decay in time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import filters, vectors

_BIAS, _CONCEPT, _CONTEXT = re.compile(r"@BIAS:\{([^}]+)\}"), re.compile(r"\[\[([^\]]+)\]\]"), re.compile(r"@CTX:\[([^\]]+)\]")
#: Days after which decay stops.
MOST_DAYS = 180
DECAY = 0.98


def similarity_cutoff(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Rows that score ``least`` or more; rows without a score go."""
    return df.where(F.col(score) >= F.lit(least))


def keyword_filter(df: DataFrame, required: list[str] | None = None, excluded: list[str] | None = None, text: str = "text") -> DataFrame:
    return df.where(filters.keywords(F.col(text), required, excluded))


@dataclass
class Bias:
    """What a query's directives ask for."""

    weights: dict[str, float] = field(default_factory=dict)
    concepts: list[str] = field(default_factory=list)
    intents: list[str] = field(default_factory=list)

    @staticmethod
    def parse(query: str) -> Bias:
        """``@BIAS:{genre:weight,…}`` (the first), every ``[[concept]]``, and the values of ``@CTX:[KEY:value|…]`` (the first).

        Pairs without exactly one colon, and weights that are no numbers, are skipped.
        """
        out = Bias()
        if m := _BIAS.search(query):
            for pair in m[1].split(","):
                key, *rest = (p.strip() for p in pair.split(":"))
                if len(rest) == 1:
                    try:
                        out.weights[key] = float(rest[0])
                    except ValueError:
                        continue
        out.concepts = [m.strip() for m in _CONCEPT.findall(query)]
        if m := _CONTEXT.search(query):
            for pair in m[1].split("|"):
                _, *rest = (p.strip() for p in pair.split(":"))
                if len(rest) == 1:
                    out.intents.append(rest[0])
        return out

    @staticmethod
    def strip(query: str) -> str:
        """The query without its directives; concepts stay as plain words."""
        return re.sub(r"\s+", " ", _CONCEPT.sub(r"\1", _CONTEXT.sub("", _BIAS.sub("", query)))).strip()


def age_in_days(timestamp: Column, now: Column) -> Column:
    """Whole days from ``timestamp`` to ``now``, from 0 to the most that count."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(timestamp.cast("timestamp"))
    return F.least(F.greatest(F.floor(micros / F.lit(86_400_000_000)), F.lit(0)), F.lit(MOST_DAYS))


def boost(bias: Bias, *, text: Column | None = None, genre: Column | None = None, confidence: Column | None = None, importance: Column | None = None, timestamp: Column | None = None, now: Column | None = None, tags: Column | None = None, intent: Column | None = None, embedding: Column | None = None, concept_vectors: list[list[float]] | None = None) -> Column:
    """The factor of a row.

    1, plus 4 for each unit of cosine above 0.7 to a concept's vector, plus 0.25
    for each concept in the text or else among the tags, plus 0.6 for each intent
    in the text or else 0.8 where it is the row's intent, plus half the genre's
    weight, 0.4 of the confidence and half the importance; all times 0.98 for each
    day of age.  What a row lacks adds nothing.
    """
    zero = F.lit(0.0)
    low = F.lower(text) if text is not None else F.lit(None).cast("string")
    total = F.lit(1.0)
    for v in concept_vectors or []:
        if embedding is not None:
            c = vectors.cosine_to(embedding, v)
            total = total + F.coalesce(F.when(c > 0.7, (c - 0.7) * 4.0), zero)
    for concept in bias.concepts:
        in_tags = F.exists(tags, lambda t: F.lower(t) == concept.lower()) if tags is not None else F.lit(False)
        total = total + F.when(F.coalesce(F.contains(low, F.lit(concept.lower())), F.lit(False)) | F.coalesce(in_tags, F.lit(False)), 0.25).otherwise(zero)
    for wish in bias.intents:
        own = F.coalesce(F.lower(intent) == wish.lower(), F.lit(False)) if intent is not None else F.lit(False)
        total = total + F.when(F.coalesce(F.contains(low, F.lit(wish.lower())), F.lit(False)), 0.6).when(own, 0.8).otherwise(zero)
    if genre is not None and bias.weights:
        weight = F.lit(None).cast("double")
        for key, w in bias.weights.items():
            weight = F.when(genre == key, F.lit(w)).otherwise(weight)
        total = total + F.coalesce(weight * 0.5, zero)
    for column, share in ((confidence, 0.4), (importance, 0.5)):
        if column is not None:
            total = total + F.coalesce(column.cast("double") * share, zero)
    if timestamp is not None:
        total = total * F.coalesce(F.pow(F.lit(DECAY), age_in_days(timestamp, now if now is not None else F.current_timestamp())), F.lit(1.0))
    return total


def rescore(df: DataFrame, factor: Column, score: str = "score", id_col: str | None = None) -> DataFrame:
    """Scores times their factor, best first where an id breaks ties; a null score stays null."""
    out = df.withColumn(score, F.col(score) * factor)
    return out if id_col is None else out.orderBy(F.col(score).desc_nulls_last(), id_col)
