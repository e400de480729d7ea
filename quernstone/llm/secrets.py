"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern, hashed, and counted over the whole corpus by
distinct repositories and distinct owners.  A value that many owners or many
repositories hold is a copied example.  Of the others, one that looks random is
a credential that may be live; one that doesn't is a weak placeholder.

Everything is DataFrame expressions.  Spark's regular expressions give matches
without places, so a text is also split by the same expression: the pieces'
and matches' lengths, added up, are the places.  Only texts in which some
expression matches are split.  Matches become rows, numbered, and a window adds
their lengths up, so a text of many matches costs in proportion.  Hashes are grouped with partial aggregation, so a
value that a third of all rows hold sends one row for each task; the result
comes back to candidates through a join that the adaptive planner can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans of equal start are listed: (kind, expression, group that is the secret, its least characters).
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Kinds that the scan adds to the base.
MORE = [
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,250}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", 0, 27),
]
KINDS = BASE + MORE


#: What a made-up value often says.
MARKER = "(?i)example|sample|dummy|placeholder|changeme|your|xxxx|test"
#: Least entropy of a value that looks random, in bits per character.
RANDOM_BITS = 2.95


def looks_random(value: Column) -> Column:
    """Whether a value has letters and digits, an entropy of ``RANDOM_BITS`` a character, and no marker of an example."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c))) / n
    letters = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(MARKER) & (entropy >= RANDOM_BITS)


def matches(text: Column, pattern: str, group: int) -> Column:
    """Of the leftmost matches that do not overlap: gaps before them, lengths, and values (characters, hash, whether random), in three arrays.

    Each array is one pass of the expression over the text; nothing is looked up
    match by match.
    """
    empty = F.array()
    hit = text.rlike(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.struct(F.length(v).alias("n"), F.sha2(v.cast("binary"), 256).alias("secret"), looks_random(v).alias("random")))
    kinds = ("array<int>", "array<int>", "array<struct<n:int,secret:string,random:boolean>>")
    return F.struct(*[F.when(hit, x).otherwise(empty.cast(kind)).alias(name) for name, x, kind in zip(("gaps", "sizes", "values"), (gaps, sizes, values), kinds, strict=True)])


def candidates(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column, kinds: list[tuple[str, str, int, int]] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (_row, _id) of all rows, and the spans (_row, repo, owner, rank, kind, start, end, secret, random), in code points.

    ``secret`` is the SHA-256 of the value, so no secret leaves the text.
    """
    text = F.col("_text")
    found = docs.select(F.col(id_col).alias("_id"), repo.alias("repo"), owner.alias("owner"), common.text_or_empty(text_col).alias("_text")).select(
        F.monotonically_increasing_id().alias("_row"), "_id", "repo", "owner", F.array(*[matches(text, pattern, group) for _, pattern, group, _ in kinds]).alias("found")
    )
    found = common.stored(found, "secrets")  # with the rows' numbers, which a second scan could deal otherwise
    rows = found.where(F.exists("found", lambda k: F.size(k["sizes"]) > 0)).select("_row", "repo", "owner", F.posexplode("found").alias("rank", "k"))
    rows = rows.select("_row", "repo", "owner", "rank", F.posexplode(F.arrays_zip(F.col("k.gaps").alias("gap"), F.col("k.sizes").alias("size"), F.col("k.values").alias("value"))).alias("i", "m"))
    to_here = W.partitionBy("_row", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(to_here).cast("int")
    kind, least = (F.array(*[F.lit(k[x]) for k in kinds]) for x in (0, 3))
    rows = rows.where("m.size is not null").select("_row", "repo", "owner", "rank", F.get(kind, F.col("rank")).alias("kind"), (end - F.col("m.size")).alias("start"), end.alias("end"), "m.value.*")
    spans = common.stored(rows.where(F.col("n") >= F.get(least, F.col("rank"))).drop("n"), "spans")
    return found.select("_row", "_id"), spans


def ownership(spans: DataFrame, example_owners: int = 3, example_repos: int = 4) -> DataFrame:
    """Per secret: ``n_repos``, ``n_owners``, ``n_seen`` and ``is_example`` (held by so many owners or repositories, or more).

    Exact counts by aggregations with partial sums: first by (secret, owner,
    repository), then by secret and owner, then by secret, so no task ever holds
    a popular secret's rows.
    """
    by_repo = spans.groupBy("secret", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("secret", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    every = by_owner.groupBy("secret").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_seen"))
    return every.withColumn("is_example", (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, example_owners: int = 3, example_repos: int = 4) -> DataFrame:
    """Per document: counts of the base kinds, ``base_sha256``, ``spans``, and how its secrets fall.

    ``n_example`` counts spans whose value ``example_owners`` owners or
    ``example_repos`` repositories hold, or more; ``n_live`` those of the others
    that look random, ``n_weak`` the rest.  ``most_owners`` and ``most_repos``
    are of the most widely held value.  By default the owner is the source and a
    repository is a source's part in one language.  Null texts are empty and have
    no span; null owners and repositories count as one owner and one repository.
    Rows that repeat an id keep a row each.
    """
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None else owner
    repo = F.concat_ws("/", F.col("source").cast("string"), F.col("lang").cast("string")) if repo is None else repo
    every, spans = candidates(docs, id_col, text_col, repo, owner)
    known = common.stored(ownership(spans, example_owners, example_repos), "ownership")  # so the join's sides come straight from exchanges, and a popular secret's rows can be split
    marked = spans.join(known, "secret")
    base, zero = [k for k, *_ in BASE], F.lit(0).cast("long")
    count = lambda where: F.sum(where.cast("long"))
    example = F.col("is_example")
    found = marked.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"), *[count(F.col("kind") == k).alias(f"n_{k}") for k in base],
        count(~example & F.col("random")).alias("n_live"), count(example).alias("n_example"), count(~example & ~F.col("random")).alias("n_weak"), F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"),
    )
    texts = {"base_sha256": F.filter("found", lambda s: s["rank"] < len(BASE)), "spans": F.col("found")}
    found = found.withColumns({name: render(x) for name, x in texts.items()}).drop("found")
    numbers = lambda *names: [F.coalesce(n, zero).alias(n) for n in names]
    return every.join(found, "_row", "left").select(
        F.col("_id").alias(id_col), *numbers(*[f"n_{k}" for k in base]), F.sha2(F.coalesce("base_sha256", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        *numbers("n_live", "n_example", "n_weak", "most_owners", "most_repos"),
    )
