"""The node table: one wide nested row for a document or a chunk of one.

Identity is by content: ``node_id`` is the SHA-256 of the content alone, and
``node_hash`` that of the id and the metadata in a canonical form, so an edit of
metadata is a new version of the same node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import text as TX

METADATA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("genre", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("confidence", T.FloatType()), T.StructField("importance", T.FloatType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

NODES = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("node_hash", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.IntegerType())),
    T.StructField("metadata", METADATA), T.StructField("excl_embed", T.ArrayType(T.StringType())), T.StructField("excl_llm", T.ArrayType(T.StringType())),
    T.StructField("ref_doc_id", T.StringType()), T.StructField("ord", T.IntegerType()),
])

EDGES = T.StructType([
    T.StructField("src_id", T.StringType()), T.StructField("rel", T.StringType()), T.StructField("ord", T.IntegerType()),
    T.StructField("dst_id", T.StringType()), T.StructField("dst_type", T.StringType()), T.StructField("dst_hash", T.StringType()),
])

#: Kinds of content.
TEXT, BINARY, IMAGE, PURGED = "text", "binary", "image", "purged"


def canonical_json(value: Column) -> Column:
    """JSON text with sorted object keys, of JSON text in any layout."""
    return F.to_json(F.parse_json(value))


def node_id(text: Column, content: Column | None = None) -> Column:
    """64 hexadecimal digits of the content."""
    return F.sha2(text.cast("binary") if content is None else F.coalesce(text.cast("binary"), content), 256)


def metadata_json(meta: Column) -> Column:
    """Metadata as canonical text: fixed keys in alphabetical order, ``extra`` by key, so the order of insertion is lost."""
    extra = F.transform(F.array_sort(F.map_keys(meta["extra"])), lambda k: F.concat(F.to_json(F.array(k)), F.lit(":"), F.coalesce(canonical_json(F.element_at(meta["extra"], k)), F.lit("null"))))
    part = lambda name: F.coalesce(F.to_json(F.array(meta[name].cast("string"))), F.lit("[null]"))
    return F.concat_ws("|", part("confidence"), F.coalesce(F.array_join(extra, ","), F.lit("")), part("file_path"), part("genre"), part("importance"), part("timestamp"), part("url"))


def node_hash(id_: Column, meta: Column) -> Column:
    return F.sha2(F.concat(id_, metadata_json(meta)).cast("binary"), 256)


def metadata(**fields: Column | None) -> Column:
    """A metadata struct with the given fields and nulls elsewhere; ``extra`` maps keys to JSON text."""
    unknown = set(fields) - set(METADATA.fieldNames())
    if unknown:
        raise ValueError(f"no such metadata: {sorted(unknown)}")
    return F.struct(*[(F.lit(None) if fields.get(f.name) is None else fields[f.name]).cast(f.dataType).alias(f.name) for f in METADATA.fields])


def with_identity(df: DataFrame) -> DataFrame:
    """``node_id`` and ``node_hash`` from the content and metadata; a purged node keeps its id."""
    fresh = F.when((F.col("kind") == PURGED) & F.col("node_id").isNotNull(), F.col("node_id")).otherwise(node_id(F.col("text"), F.col("bytes")))
    return df.withColumn("node_id", fresh).withColumn("node_hash", node_hash(F.col("node_id"), F.col("metadata")))


def text_nodes(df: DataFrame, text: Column, meta: Column, ref_doc_id: Column | None = None) -> DataFrame:
    """A node row for each row of ``df``, whose content is ``text``."""
    none = F.lit(None)
    rows = df.select(
        none.cast("string").alias("node_id"), none.cast("string").alias("node_hash"), F.lit(TEXT).alias("kind"), text.alias("text"), none.cast("binary").alias("bytes"),
        none.cast("array<int>").alias("tokens"), meta.alias("metadata"), F.array().cast("array<string>").alias("excl_embed"), F.array().cast("array<string>").alias("excl_llm"),
        (none if ref_doc_id is None else ref_doc_id).cast("string").alias("ref_doc_id"), none.cast("int").alias("ord"),
    )
    return with_identity(rows)


def content(kind: Column, text: Column, data: Column | None = None) -> Column:
    """What readers see of a node: its text, a note for other kinds, null where purged."""
    size = F.octet_length(data) if data is not None else F.lit(0)
    return F.when(kind == TEXT, text).when(kind == BINARY, F.format_string("<Binary data: %d bytes>", size)).when(kind == IMAGE, F.lit("<Image data>"))


def cache_tokens(df: DataFrame, tokenizer: TX.Tokenizer) -> DataFrame:
    """``tokens`` of the text nodes, by which a purged one can be read again."""
    return df.withColumn("tokens", F.when(F.col("kind") == TEXT, TX.encoded(F.col("text"), tokenizer)))


def readable(df: DataFrame, tokenizer: TX.Tokenizer | None = None, out: str = "content", strict: bool = False) -> DataFrame:
    """``df`` with what readers see of each node; a purged node's text comes from its cached tokens.

    Without a tokenizer, or without tokens, a purged node has none: null, or an
    error where ``strict``.
    """
    if tokenizer is None:
        lost = F.raise_error(F.concat(F.lit("content was purged: "), F.col("node_id"))).cast("string") if strict else F.lit(None).cast("string")
    else:
        missing = F.raise_error(F.concat(F.lit("purged without tokens: "), F.col("node_id"))).cast("string") if strict else F.lit(None).cast("string")
        lost = F.when(F.col("tokens").isNotNull(), TX.decoded(F.when(F.col("kind") == PURGED, F.col("tokens")), tokenizer)).otherwise(missing)
    return df.withColumn(out, F.when(F.col("kind") == PURGED, lost).otherwise(content(F.col("kind"), F.col("text"), F.col("bytes"))))


def purge(df: DataFrame, which: Column) -> DataFrame:
    """Drops the text of the text nodes that ``which`` picks, and keeps cached tokens; other kinds stay."""
    hit = which & (F.col("kind") == TEXT)
    return df.withColumns({"text": F.when(~F.coalesce(hit, F.lit(False)), F.col("text")), "kind": F.when(hit, PURGED).otherwise(F.col("kind"))})


def render_metadata(meta: Column, excluded: Column | None = None, template: str = "{key}: {value}", separator: str = "\n") -> Column:
    """Metadata as text: url, file_path, genre, confidence and importance with two decimals, timestamp, then ``extra`` by key.

    Absent values and excluded keys are left out.  Strings of ``extra`` are shown
    raw and other values as compact JSON.
    """
    shown = F.array().cast("array<string>") if excluded is None else F.coalesce(excluded, F.array().cast("array<string>"))

    def line(key: Column, value: Column) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{key}"), key), F.lit("{value}"), value)

    def fixed(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & ~F.array_contains(shown, name), line(F.lit(name), value))

    two = lambda name: F.when(meta[name].isNotNull(), F.format_string("%.2f", meta[name].cast("double")))
    stamp = F.date_format(meta["timestamp"], "yyyy-MM-dd'T'HH:mm:ssXXX")
    fixed_lines = F.array(fixed("url", meta["url"]), fixed("file_path", meta["file_path"]), fixed("genre", meta["genre"]), fixed("confidence", two("confidence")), fixed("importance", two("importance")), fixed("timestamp", stamp))
    keys = F.filter(F.array_sort(F.coalesce(F.map_keys(meta["extra"]), F.array().cast("array<string>"))), lambda k: ~F.array_contains(shown, k))

    def raw(k: Column) -> Column:
        v = F.element_at(meta["extra"], k)
        return F.coalesce(F.when(F.schema_of_variant(F.try_parse_json(v)) == "STRING", F.variant_get(F.try_parse_json(v), "$", "string")), canonical_json(v), F.lit("null"))

    lines = F.concat(F.filter(fixed_lines, lambda x: x.isNotNull()), F.transform(keys, lambda k: line(k, raw(k))))
    return F.array_join(lines, separator)
