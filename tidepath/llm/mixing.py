"""Mixing sources to target weights: hash-random order, range sort, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size, target of each row (source, source_size) of a table with a row per source.

    Sources by code point, null last, get the weights in turn. They share `share` times the total size by
    weight; no target passes `epochs` times its source, and what is above goes to the others by weight until
    none is above. That fixed point is found in one ordered pass: with sources by capacity per weight, a
    source is full if the level of all sources from it on, the fuller ones taken out, reaches its capacity.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(0))
    by = everything.orderBy("ratio", "place")
    ranked = (
        sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", pick)
        .withColumn("cap", F.col("source_size") * float(epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weight_left"))
        .withColumn("open", F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "place", "level")))
        .withColumn("first_open", F.min("open").over(everything))
    )
    full = F.col("first_open").isNull() | (F.struct("ratio", "place") < F.struct(F.col("first_open.ratio").alias("ratio"), F.col("first_open.place").alias("place")))
    return ranked.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("first_open.level")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target, taken, start: one row per input row.

    Every document gets a hash-random key. Documents are range-sorted by source and key, so a hot source
    spreads over many partitions; each partition sums its words, sums of partitions are added up per source,
    and the place of each document in its source's order of words is known without one task seeing a whole
    source. A source with target t takes t // size whole epochs, then documents in order up to the exact
    remainder; the document at the cut gives only its first words. Null texts have size 0 and take 0; null
    sources are one source; repeated rows are cut one after the other. Reruns agree: the key depends on the
    seed and doc_id alone (rows that repeat a doc_id are ordered by size, then by a hash of the text). row_col is
    kept as own_row. An empty table gives no rows.
    """
    own = [] if row_col is None else ["own_row"]
    sized = (
        docs.select(*[F.col(row_col).alias(c) for c in own], F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text_col).alias("text_hash"))
        .withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    # range sorting looks at its input twice: words are counted once, before it
    sized = (
        stage(sized, "counted")
        .repartitionByRange("source", "key", "doc_id", "size", "text_hash")
        .sortWithinPartitions("source", "key", "doc_id", "size", "text_hash")
        .select(*own, "doc_id", "source", "size", "key", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("row_id"))
    )
    sized = stage(sized, "sized")
    local = Window.partitionBy("source", "pid").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("source", "pid").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "p.pid", "p.ahead", "t.source_size", "t.target")
    placed = sized.withColumn("local", F.coalesce(F.sum("size").over(local), F.lit(0)))
    placed = placed.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.pid") == F.col("p.pid")))
    out = placed.select(*[f"d.{c}" for c in own], "d.row_id", "d.doc_id", "d.source", "d.size", "p.source_size", "p.target", (F.col("p.ahead") + F.col("d.local")).alias("start"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - whole * F.col("source_size")
    return out.withColumn("taken", whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start"))))


def apply_mix(docs: DataFrame, mix: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus: docs' columns plus epoch (from 0) and taken (words of this copy), a row per copy of a document; where docs has columns of these names the new ones get underscores.

    A copy that the cut falls in keeps only its first words. id_col must be unique and not null in docs (`mixed`
    takes any table); documents of which nothing is taken are left out.
    """
    own_id, own_size, epoch, taken = (free_name(docs, c) for c in ("_mix_id", "_mix_size", "epoch", "taken"))
    copies = mix.filter("taken > 0 and size > 0").select(
        F.col("doc_id").alias(own_id), F.col("size").alias(own_size), F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")).cast("long")), lambda e: F.least(F.col("size"), F.col("taken") - e * F.col("size")))).alias(epoch, taken)
    )
    head = F.expr(f"array_join(slice(regexp_extract_all(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0), 1, cast(`{taken}` as int)), ' ')")
    joined = docs.join(copies, F.col(id_col) == F.col(own_id))
    return joined.withColumn(text_col, F.when(F.col(taken) < F.col(own_size), head).otherwise(F.col(text_col))).drop(own_id, own_size)


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed corpus of docs row by row: rows that repeat a doc_id or have none are cut and copied like any other."""
    row = free_name(docs, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # written before use, so that numbers stay
    mix = mix_sources(rows, row_col=row).filter("taken > 0").select(F.col("own_row").alias("doc_id"), "size", "taken")
    return apply_mix(rows, stage(mix, "mix"), id_col=row).drop(row)
