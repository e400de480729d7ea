"""Files, JSON, Markdown, PDF and web pages as node tables."""

from __future__ import annotations

import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.config import WebConfig


def files(spark: SparkSession, folder: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """(path, content) of the files of a folder; extensions are compared case and all, and exclude files without one."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")
    if not extensions:
        return df
    return df.where(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1).isin(*extensions))


def directory(spark: SparkSession, folder: str, recursive: bool = True, extensions: list[str] | None = None) -> DataFrame:
    """A text node for each file.  A file that isn't UTF-8 fails the read."""
    df = files(spark, folder, recursive, extensions)
    return S.text_nodes(df, F.decode("content", "utf-8"), S.metadata(file_path=F.col("path")))


def json_values(text: DataFrame, column: str = "value") -> DataFrame:
    """The elements of each text's top array, or its one value, as ``pos`` and ``v`` (JSON text)."""
    parsed = text.withColumn("_v", F.parse_json(column))
    is_array = F.schema_of_variant("_v").startswith("ARRAY")
    items = F.when(is_array, F.variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    return parsed.select(*text.columns, F.posexplode(items).alias("pos", "_e")).withColumn("v", F.to_json("_e")).drop("_e")


def json_text(v: Column) -> Column:
    """What a JSON value says: its text, else its content, if they are strings; a bare string; else the value itself."""
    p = F.parse_json(v)

    def string(path: str) -> Column:
        part = F.try_variant_get(p, path, "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(p, path, "string"))

    is_object = F.schema_of_variant(p).startswith("OBJECT")
    return F.coalesce(F.when(is_object, string("$.text")), F.when(is_object, string("$.content")), string("$"), v)


def json_extra(v: Column) -> Column:
    """The other keys of an object and their values as JSON text."""
    fields = F.try_variant_get(F.parse_json(v), "$", "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: ~k.isin("text", "content"))
    return F.transform_values(rest, lambda _, x: F.to_json(x))


def json_file(spark: SparkSession, path: str) -> DataFrame:
    """A node for each element of a file's top array, or one for the file."""
    texts = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    rows = json_values(texts)
    return S.text_nodes(rows, json_text(F.col("v")), S.metadata(file_path=F.col("_path"), extra=json_extra(F.col("v"))))


def sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, section, header, body, n_lines): a section at every line that begins with "#", and what precedes the first.

    The header's line stays in the body, a preamble has an empty header, and
    sections of blanks alone go.  Lines that begin so in code count too.
    """
    lines = df.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    w = W.partitionBy(id_col).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.sum(F.col("t").startswith("#").cast("int")).over(w).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("line", "t")))
    grouped = marked.groupBy(id_col, "section").agg(ordered.alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    head = F.get(F.col("_l"), F.lit(0))["t"]
    header = F.when(F.col("section") > 0, F.trim(F.regexp_replace(head, "^#+", ""))).otherwise(F.lit(""))
    return grouped.select(id_col, "section", header.alias("header"), body.alias("body"), F.size("_l").alias("n_lines")).where(~F.col("body").rlike(r"^\s*$"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = sections(texts, "path", "value")
    quoted = F.regexp_replace(F.to_json(F.array("header")), r"^\[|\]$", "")
    return S.text_nodes(rows, F.col("body"), S.metadata(file_path=F.col("path"), extra=F.create_map(F.lit("header"), quoted)))


def pdf(spark: SparkSession, folder: str, pages_of: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """A node for each page that isn't blank, with its number from 1 as a string; blank pages use up numbers.

    ``pages_of`` gives a file's page texts; by default the pypdf library, if it
    is installed where tasks run.
    """
    extract = pages_of or _pypdf_pages

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(p, str(i + 1), t) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, t in enumerate(extract(c)) if t.strip()]
            yield pa.record_batch([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], names=["path", "page", "text"])

    rows = files(spark, folder, True, ["pdf"]).mapInArrow(run, "path string, page string, text string")
    label = F.create_map(F.lit("page_label"), F.concat(F.lit('"'), F.col("page"), F.lit('"')))
    return S.text_nodes(rows, F.col("text"), S.metadata(file_path=F.col("path"), extra=label))


def _pypdf_pages(content: bytes) -> list[str]:
    import io

    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


class _Markdown(HTMLParser):
    """The text of an element as simple Markdown."""

    _block = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "header", "footer", "nav", "pre", "figure"}
    _hidden = {"script", "style", "head", "noscript", "template", "svg"}
    _void = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "param", "track"}

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.mark, self.value = _selector(selector)
        self.out: list[str] = []
        self.depth = self.hidden = 0
        self.done = False
        self.links: list[str] = []

    def _matches(self, tag: str, attrs: dict) -> bool:
        if self.tag and tag != self.tag:
            return False
        return not self.mark or (self.value in (attrs.get("class") or "").split() if self.mark == "." else attrs.get("id") == self.value)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.done:
            return
        if not self.depth:
            if self._matches(tag, a):
                self.depth = 1
            return
        if tag not in self._void:
            self.depth += 1
        if tag in self._hidden:
            self.hidden += 1
        elif not self.hidden:
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.out.append("\n\n" + "#" * int(tag[1]) + " ")
            elif tag == "li":
                self.out.append("\n- ")
            elif tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag == "a":
                self.out.append("[")
                self.links.append(a.get("href") or "")
            elif tag == "br":
                self.out.append("\n")
            elif tag in self._block:
                self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if not self.depth or self.done or tag in self._void:
            return
        if tag in self._hidden:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden:
            if tag in ("b", "strong"):
                self.out.append("**")
            elif tag in ("i", "em"):
                self.out.append("*")
            elif tag == "code":
                self.out.append("`")
            elif tag == "a" and self.links:
                self.out.append(f"]({self.links.pop()})")
            elif tag in self._block or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.out.append("\n\n")
        self.depth -= 1
        self.done = not self.depth

    def handle_data(self, data: str) -> None:
        if self.depth and not self.done and not self.hidden:
            self.out.append(data)


def _selector(selector: str) -> tuple[str, str, str]:
    for mark in "#.":
        if mark in selector:
            tag, _, value = selector.partition(mark)
            return tag.lower(), mark, value
    return selector.lower(), "", ""


def to_markdown(html: str, selector: str = "body") -> str:
    """The first element that a selector (tag, tag.class, #id) picks, as Markdown; empty where none matches."""
    import re

    parser = _Markdown(selector)
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+", " ", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


def html_to_markdown(df: DataFrame, html: str, out: str = "markdown", selector: str = "body") -> DataFrame:
    keep = [c for c in df.columns if c != html]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 200):
                s = b.slice(k, 200)
                done = [None if h is None else to_markdown(h, selector) for h in s.column(html).to_pylist()]
                yield pa.record_batch([*[s.column(c) for c in keep], pa.array(done, pa.string())], names=[*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*keep, html).mapInArrow(run, f"{schema}, `{out}` string")


def fetch(url: str, config: WebConfig) -> str:
    time.sleep((config.delay_ms + random.random() * config.jitter_ms) / 1000)
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": config.user_agent})) as reply:
        return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")


def web(spark: SparkSession, urls: list[str], selector: str = "body", config: WebConfig = WebConfig(), get: Callable[[str, WebConfig], str] = fetch) -> DataFrame:
    """A node for each address; ``concurrency`` tasks fetch side by side, each with its delay."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for u in b.column(0).to_pylist():
                yield pa.record_batch([[u], [get(u, config)]], names=["url", "html"])

    rows = spark.createDataFrame([(u,) for u in urls], "url string").repartition(config.concurrency).mapInArrow(run, "url string, html string")
    return S.text_nodes(html_to_markdown(rows, "html", "text", selector), F.col("text"), S.metadata(url=F.col("url")))


def exam(spark: SparkSession, path: str) -> DataFrame:
    """Exam questions, as one JSON value for the file or else one for each line (lines that don't parse go), rendered as text."""
    texts = spark.read.text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    whole = F.try_parse_json("value")
    values = json_values(texts.where(whole.isNotNull())).select("_path", "v")
    lines = texts.where(whole.isNull()).select("_path", F.explode(F.split("value", "\n")).alias("v")).where(F.try_parse_json("v").isNotNull())
    rows = values.unionByName(lines.withColumn("v", F.to_json(F.parse_json("v"))))
    p = F.parse_json("v")
    field = lambda key: F.coalesce(F.try_variant_get(p, f"$.{key}", "string"), F.lit(""))
    options = F.coalesce(F.try_variant_get(p, "$.options", "array<string>"), F.map_values(F.try_variant_get(p, "$.options", "map<string,string>")), F.array().cast("array<string>"))
    text = F.concat(F.lit("QUESTION\n"), field("question"), F.lit("\nOPTIONS\n"), F.array_join(options, "\n"), F.lit("\nEXPLANATION\n"), field("explanation"))
    extra = F.transform_values(F.try_variant_get(p, "$", "map<string,variant>"), lambda _, x: F.to_json(x))
    return S.text_nodes(rows, text, S.metadata(file_path=F.col("_path"), extra=extra))
