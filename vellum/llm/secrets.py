"""Secret scans: patterns in every text, and ownership frequency of what they find over the whole corpus.

The candidates of all documents are hashed and counted by distinct repositories and owners. A value that many owners or
repositories share is a copied example; one that few use looks like a live credential. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import as_row, from_row, materialize

#: Kind, pattern, group that counts, least code points of that group; order of kinds at one start.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Words that may be bare credentials: long, of letters and digits. They count only by their owners.
BARE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: A value in at least so many owners' hands, or in so many repositories, is a copied example; any other belongs to its owners.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 4
PLACEHOLDER = "[REDACTED]"

#: What is counted of a value.
SPREAD = ("owners", "repositories", "uses")
SPAN = "array<struct<start:long,rank:int,end:long,kind:string,value:string>>"
_BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(sizes: Column) -> Column:
    """For each element the sum of those before it, by blocks, so that long arrays take no quadratic time."""

    def place(blocks: Column, starts: Column) -> Column:
        return F.transform(sizes, lambda _, i: F.get(starts, F.floor(i / _BLOCK).cast("int")) + _total(F.slice(sizes, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), (i % _BLOCK).cast("int"))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / _BLOCK).cast("int")), lambda b: _total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, lambda bs: let(F.transform(bs, lambda _, b: _total(F.slice(bs, F.lit(1), b))), lambda st: place(bs, st)))


def spans_of(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches whose group has at least ``least`` code points, as spans."""
    none = F.array().cast(SPAN)

    def build(whole: Column, value: Column, gaps: Column) -> Column:
        size = F.transform(whole, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("long"))
        return let(size, lambda sz: let(_before(sz), lambda at: F.filter(
            F.transform(whole, lambda m, i: F.struct(
                (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(rank).alias("rank"), (F.get(at, i) + F.get(sz, i)).alias("end"),
                F.lit(kind).alias("kind"), F.get(value, i).alias("value"))),
            lambda s: F.length(s["value"]) >= least)))

    def matches(t: Column) -> Column:
        every = lambda g: F.regexp_extract_all(t, F.lit(pattern), F.lit(g))
        return let(every(0), lambda w: let(every(group), lambda v: let(F.split(t, pattern, -1), lambda g: build(w, v, g))))

    return F.when(text.rlike(pattern), matches(text)).otherwise(none)


def _named(docs: DataFrame, column: str) -> Column:
    """A column as a string; null where the table lacks it."""
    return F.col(f"`{column}`").cast("string") if column in docs.columns else F.lit(None).cast("string")


def scan(docs: DataFrame, owner: str, repository: Column) -> DataFrame:
    """(doc_id, kd, kh, owner, repository, base, bare): the spans of each text, without the text. One narrow pass.

    A run of a character class that is long enough is found directly: it starts and ends where the plain run does."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    longer = {"access": r"AKIA[A-Z0-9]{14,}+", "hex": r"[0-9a-f]{16,}+"}
    base = [spans_of(F.col("text"), kind, rank, longer.get(kind, pattern), group, least) for rank, (kind, pattern, group, least) in enumerate(KINDS)]
    bare = F.filter(spans_of(F.col("text"), "owned", len(KINDS), BARE, 0, 20), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(_named(docs, owner), F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"))
    found = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("kd"), F.xxhash64("text").alias("kh"), "owner", "repository", F.array_sort(F.concat(*base)).alias("base"), bare.alias("bare"))
    apart = F.filter("bare", lambda b: ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    return found.withColumn("bare", F.when(F.size("bare") > 0, apart).otherwise(F.col("bare")))


def _hashed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.sha2(s["value"], 256))


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, n_uses) of every candidate value of the corpus.

    Counts are taken for (value, owner, repository), then (value, owner), then the value, each with a map-side part, so
    that a value in a third of all documents sends a few rows for each task."""
    uses = scanned.select("owner", "repository", F.explode(_hashed(F.concat("base", "bare"))).alias("hash"))
    by_repository = uses.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("uses").alias("n_uses"))


def _judged(scanned: DataFrame) -> DataFrame:
    """scanned with ``added`` (bare spans that belong to few), n_live and n_copied, and how far its values spread at most."""
    spans = F.concat("base", "bare")
    uses = scanned.where(F.size("base") + F.size("bare") > 0).dropDuplicates(["kd", "kh"]).select("kd", "kh", F.explode(spans).alias("s"))
    known = uses.withColumn("hash", F.sha2("s.value", 256)).join(ownership(scanned), "hash")
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)
    by_doc = known.groupBy("kd", "kh").agg(
        F.collect_list(F.when(~copied & (F.col("s.kind") == "owned"), F.col("s"))).alias("added"), F.count_if(~copied).alias("n_live"), F.count_if(copied).alias("n_copied"),
        *(F.max(f"n_{x}").alias(f"max_{x}") for x in SPREAD))
    out = scanned.join(by_doc, ["kd", "kh"], "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_live", "n_copied", *(f"max_{x}" for x in SPREAD))})


def find_secrets(docs: DataFrame, owner: str = "source", repository: Column | None = None) -> DataFrame:
    """Spans of secrets in every whole text: (doc_id, kd, kh, base, added, n_live, n_copied, max_owners, max_repositories, max_uses).

    ``owner`` names the column of the owner; the repository is owner and language unless given. A table without these
    columns has one owner and one repository. Spans are in code points, end exclusive. Null texts are empty, a null
    owner is an owner of its own; a null doc_id stays null; rows that repeat doc_id and text have equal results, and
    each counts as a use; very long texts are scanned whole; an empty table gives an empty result; other columns are
    ignored."""
    if repository is None:
        repository = F.concat_ws("/", _named(docs, owner), _named(docs, "lang"))
    return _judged(materialize(scan(docs, owner, repository), "secrets"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, owner: str = "source") -> DataFrame:
    """One row for each document: counts by kind, digest of the base spans, all spans, how many values look live or copied,
    and of its values the most owners, repositories and uses. Odd rows: see ``find_secrets``."""
    found = find_secrets(docs, owner)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(kind) for kind, *_ in KINDS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_owned"), "n_live", "n_copied", *(f"max_{x}" for x in SPREAD))


def redact_secrets(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The documents with every secret's span replaced by a placeholder; texts without any stay as they are.

    Overlapping spans make one placeholder. ``n_chars`` follows the text where the table has it. Null, empty and very
    long texts, null ids and owners, repeated rows and empty tables: see ``find_secrets``; other columns go through,
    whatever their names."""
    spans = find_secrets(docs, owner).where(F.size("base") + F.size("added") > 0).select("kd", "kh", F.array_sort(F.concat("base", "added")).alias("spans")).dropDuplicates(["kd", "kh"])
    text = F.col("row.text").cast("string")
    keyed = as_row(docs).withColumn("kd", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63)))).withColumn("kh", F.xxhash64(F.coalesce(text, F.lit(""))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.lit(PLACEHOLDER)).alias("out"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(F.struct(F.greatest(s["end"], done["at"]).alias("at"), done["out"].alias("out")))

    done = let(F.aggregate("spans", start, step), lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text))))
    joined = keyed.join(spans, ["kd", "kh"], "left").withColumn("hidden", F.when(F.col("spans").isNotNull(), done))
    return from_row(joined, docs, F.col("spans").isNotNull(), F.col("hidden"))
