"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is normalised and cut into chunks where its content says so. Chunks are deduplicated into a
book of verified identifiers: a 64-bit hash, checked against the chunk's SHA-256, plus a rank that
tells apart chunks whose 64-bit hashes collide. From then on a document is its recipe, the ordered
list of its chunk identifiers; equal recipes mean equal texts, and only recipes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage

SALTS = 16
WHITE = r"[\x20\x09-\x0D]+"


def _cut_class(last: int = 0x4FF) -> str:
    """Characters after which a chunk may end: code points of 4 modulo 16, written as a regex class."""
    return "[" + "".join(f"\\x{{{c:X}}}" for c in range(0x24, last + 1, 16)) + "]"


def chunk_pattern(least: int = 1024, most: int = 8192) -> str:
    """A chunk ends after two cut characters in a row, from `least` code points on; `most` bounds it where none come."""
    cut = _cut_class()
    return f"(?s).{{{least},{most}}}?{cut}{cut}|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    """The text without the characters space, tab, line feed, vertical tab, form feed and carriage return; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per input row: row_id, doc_id, text_hash, n_points, text_sha256, recipe (ordered verified chunk identifiers).

    A null or white-space-only text has the empty recipe. Other columns are ignored, whatever their names.
    """
    pattern = pattern or chunk_pattern()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_hash"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), normalised(F.col("text")).alias("norm")
    )
    cut = base.select(
        "row_id", "doc_id", "text_hash", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(F.regexp_extract_all("norm", F.lit(pattern), F.lit(0)), lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha"))).alias("chunks"),
    )
    cut = stage(cut, "chunks")
    uses = cut.select("row_id", F.posexplode("chunks").alias("pos", "c")).select("row_id", "pos", "c.h", "c.sha")
    book = uses.select("h", "sha").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("sha")) - 1)
    recipes = (
        uses.join(book, ["h", "sha"])
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "h", "rank"))).alias("r"))
        .select("row_id", F.transform("r", lambda x: F.struct(x["h"].alias("h"), x["rank"].alias("rank"))).alias("recipe"))
    )
    empty = F.array().cast("array<struct<h:bigint,rank:int>>")
    return cut.select("row_id", "doc_id", "text_hash", "n_points", "text_sha256").join(recipes, "row_id", "left").withColumn("recipe", F.coalesce("recipe", empty))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks, text_hash (of the original text): one row per input row, dropped ones too.

    Of rows with equal normalised texts the one with most code points in the original text stays, then the
    smallest doc_id (null first), then the first of repeated rows; so exactly one row of each group is kept,
    even if rows repeat with one doc_id. Null, empty and white-space texts are one group. An empty table
    gives no rows.
    """
    recipes = stage(chunk_recipes(docs, id_col, text_col, pattern), "recipes")
    groups = recipes.groupBy("recipe").agg(F.min(F.struct((-F.col("n_points")).alias("n"), "doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # a group of very many copies is dealt over SALTS tasks; texts without a copy need no group
    several = groups.filter("group_size > 1").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    placed = recipes.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(several, ["recipe", "salt"], "left")
    alone = F.col("group_size").isNull()
    return placed.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row_id") == F.col("best.row_id"))).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"), "text_hash",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, one of each group of equal texts, with all their columns, whatever their names.

    Of rows that repeat both doc_id and text one stays; null ids are equal. The keys that go are written first:
    where they are few, as Spark finds by their size, no text is shuffled.
    """
    own, key_id, key_hash = (free_name(docs, c) for c in ("_text_hash", "_kept_id", "_kept_hash"))
    keys = exact_dedup(docs, id_col, text_col).groupBy(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept"))
    keys = stage(keys.filter("n > n_kept"), "gone")
    same = F.col(id_col).eqNullSafe(F.col(key_id)) & (F.xxhash64(text_col) == F.col(key_hash))
    rest = docs.join(keys.select(key_id, key_hash), same, "left_anti")
    repeated = stage(keys.filter("n_kept > 0").select(key_id, key_hash), "repeated")
    if repeated.isEmpty():
        return rest
    one = docs.join(repeated, same, "left_semi").withColumn(own, F.xxhash64(text_col)).dropDuplicates([id_col, own]).drop(own)
    return rest.unionByName(one)
