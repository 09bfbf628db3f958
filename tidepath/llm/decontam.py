"""Benchmark decontamination by spaced seeds.

Fixed masks choose some of consecutive words and ignore the others, so a substituted word leaves some seeds
whole. Which masks an item has depends on its length: those for long items meet every overlap of 12 to 24 words
that counts, those for items of 3 to 15 words every one that counts there, and items of one or two words are
seeds themselves. Documents' seed hashes that pass a fixed-size bitmap of the benchmark's hashes are joined with
the benchmark's, hits are gathered by document, item and diagonal, and around the hits the texts themselves are
aligned word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage
from .tokens import NOT_WORD, mix, raw_column, split_rows, words_of

#: Masks by the length that items have at least; 1 is a word that counts. Tests go through all overlaps that count.
MASKS = {1: ("1",), 2: ("11",), 3: ("111", "1101", "1011"), 16: ("111011", "10010111", "111000101", "11111")}
#: Words of an overlap that must be equal, in all and as a share of the overlap; items shorter than that must be whole but for the share.
LEAST_WORDS, LEAST_SHARE = 12, 0.75

_SEEDS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("seed", pa.int64()), ("pos", pa.int64())])
SEEDS = "doc_id long, text_hash long, seed long, pos long"


def _seed_hashes(h: np.ndarray, rows: np.ndarray, kinds: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, place, hash) for each mask of these kinds, where the mask lies inside one row."""
    for kind in kinds:
        for k, mask in enumerate(MASKS[kind]):
            span = len(mask)
            n = len(h) - span + 1
            if n <= 0:
                continue
            acc = np.full(n, 31 * kind + k + 1, dtype=np.uint64)
            for j, c in enumerate(mask):
                if c == "1":
                    acc = (acc ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019)
            at = np.flatnonzero(rows[:n] == rows[span - 1 :])
            yield kind, at, mix(acc[at])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of all items (item_row, text_hash, text), each by the masks of its length."""
    starts = np.array(sorted(MASKS))
    for batch in batches:
        data, offs = raw_column(batch.column(2))
        for lo, hi in split_rows(offs):
            words = words_of(data, offs, lo, hi, NOT_WORD)
            h, rows = words.hashes(lower=True), words.rows
            own = starts[np.maximum(np.searchsorted(starts, np.diff(words.first), "right") - 1, 0)]
            for kind, at, seed in _seed_hashes(h, rows, sorted(MASKS)):
                keep = own[rows[at]] == kind
                at, seed = at[keep], seed[keep]
                row = pa.array(rows[at] + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.full(len(at), kind)), pa.array(seed.view(np.int64)), pa.array(at - words.first[rows[at]])], schema=_SEEDS)


def _seeds(shared):
    """Of rows (doc_id, text_hash, text) the seeds whose bit is set in the broadcast bitmap, by the masks that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, kinds = shared.value
        bits = np.frombuffer(raw, dtype=np.uint8)
        for batch in batches:
            data, offs = raw_column(batch.column(2))
            for lo, hi in split_rows(offs):
                words = words_of(data, offs, lo, hi, NOT_WORD)
                h, rows = words.hashes(lower=True), words.rows
                for _, at, seed in _seed_hashes(h, rows, kinds):
                    low = seed & np.uint64(8 * len(bits) - 1)
                    got = (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    at, seed = at[got], seed[got]
                    if len(at):
                        row = pa.array(rows[at] + lo)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(seed.view(np.int64)), pa.array(at - words.first[rows[at]])], schema=_SEEDS)

    return run


def best_overlap(a: np.ndarray, b: np.ndarray, shifts: np.ndarray, least_share: float = LEAST_SHARE) -> tuple[int, int, int, int]:
    """(equal words, first word in b, words, shift) of the ungapped overlap of b with a, at b's word 0 = a's word `shift` for one of the shifts, that has the most equal words of all whose equal words are at least `least_share` of it, then the fewest words and the least shift; begins and ends with an equal word."""
    at = shifts[:, None] + np.arange(len(b))
    inside = (at >= 0) & (at < len(a))
    same = inside & (a[np.clip(at, 0, len(a) - 1)] == b)
    # equal words gain, others lose, so that an overlap has the share if the sum does not fall over it
    total = np.zeros((len(shifts), len(b) + 1))
    np.cumsum(np.where(same, 1 - least_share, -least_share), axis=1, out=total[:, 1:])
    equal = np.zeros(total.shape, dtype=np.int64)
    np.cumsum(same, axis=1, out=equal[:, 1:])
    low = -np.minimum.accumulate(total, axis=1)
    best = (0, 0, 0, 0)
    for i in np.flatnonzero(equal[:, -1]):
        # the first place from which the sum does not fall up to j is the first whose running least is not above it
        begin = np.searchsorted(low[i], -total[i] - 1e-9)
        gain = equal[i] - equal[i][begin]
        j = int(np.argmax(gain))
        if gain[j] < max(best[0], 1):
            continue
        places = np.flatnonzero(same[i, begin[j] : j]) + begin[j]
        found = (len(places), int(places[0]), int(places[-1] - places[0]) + 1, int(shifts[i]))
        best = max(best, found, key=lambda x: (x[0], -x[2], -x[3]))
    return best


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("overlap", pa.int64()), ("item_words", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("text_hash", pa.int64())])
FOUND = "doc_id long, item_id long, matched long, overlap long, item_words long, doc_start long, item_start long, text_hash long"


def _verify(least_words: int, least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # text, item text, doc_id, item_id, shifts, text_hash
            hashes = []
            for c in (0, 1):
                data, offs = raw_column(batch.column(c))
                own = []
                for lo, hi in split_rows(offs):
                    words = words_of(data, offs, lo, hi, NOT_WORD)
                    h = words.hashes(lower=True)
                    own += [h[words.first[i] : words.first[i + 1]] for i in range(hi - lo)]
                hashes.append(own)
            out = []
            for i in range(batch.num_rows):
                a, b, shifts = hashes[0][i], hashes[1][i], batch.column(4)[i].values.to_numpy()
                matched, start, size, shift = 0, 0, 0, 0
                step = max(1, 2_000_000 // max(1, len(b)))
                for at in range(0, len(shifts), step):
                    found = best_overlap(a, b, shifts[at : at + step], least_share)
                    matched, start, size, shift = max((matched, start, size, shift), found, key=lambda x: (x[0], -x[2], -x[3]))
                if size and matched >= min(least_words, least_share * len(b)):
                    out.append((batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), matched, size, len(b), start + shift, start, batch.column(5)[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(8)], schema=_FOUND)

    return run


def _bitmap(seeds: DataFrame) -> bytes:
    """Set bits of the benchmark's seed hashes, in a power of two of bits that grows with their count up to 32 MB; no more than the bitmap itself reaches the driver."""
    log = min(28, max(20, (1024 * seeds.count()).bit_length()))
    low = seeds.select(F.col("seed").bitwiseAND(F.lit((1 << log) - 1)).alias("b")).groupBy(F.expr("cast(b div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("x"))
    words = np.zeros((1 << log) // 64, dtype=np.int64)
    for row in low.toLocalIterator():
        words[row.w] = row.x
    return words.tobytes()


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """doc_id, item_id, matched, overlap, item_words, doc_start, item_start of documents that overlap with a benchmark item; clean documents give no row.

    Words are runs of letters and digits (bytes above ASCII count as letters), A-Z lower-cased. An overlap is
    an ungapped alignment; `matched` of its words are equal. It counts if they are at least `least_words`, or that
    share of a shorter item, and at least `least_share` of the overlap. With the default measures every overlap of
    an item of up to 15 words and every one of 12 to 24 words has a seed; longer ones miss one only if none of
    their parts would count. Null and empty texts match nothing, nor do items without words. A repeated row or
    item gives its own pair. Of the overlaps of a pair that have the share, the one with the most equal words is
    returned. Empty tables give no rows. with_hash adds text_hash (xxhash64), with which doc_id tells rows apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    items = stage(benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")), "items")
    seeds = stage(items.select("item_row", F.lit(0).cast("long").alias("text_hash"), "item_text").mapInArrow(_item_seeds, SEEDS), "seeds")
    kinds = sorted(r.kind for r in seeds.select(F.col("text_hash").alias("kind")).distinct().collect())  # at most one for each entry of MASKS
    seeds = seeds.select(F.col("doc_id").alias("item_row"), "seed", F.col("pos").alias("item_pos"))
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(seeds), kinds))
    hits = rows.mapInArrow(_seeds(shared), SEEDS)
    near = hits.join(seeds, "seed").select("doc_id", "text_hash", "item_row", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    near = stage(near.groupBy("doc_id", "text_hash", "item_row").agg(F.collect_list("shift").alias("shifts")), "near")
    same = rows["doc_id"].eqNullSafe(near["doc_id"]) & (rows["text_hash"] == near["text_hash"])
    pairs = rows.join(near, same).select("text", rows["doc_id"], near["text_hash"], "item_row", "shifts").join(items, "item_row")
    found = pairs.select("text", "item_text", "doc_id", "item_id", "shifts", "text_hash").mapInArrow(_verify(least_words, least_share), FOUND)
    return found if with_hash else found.drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that overlap with a benchmark item, with all their columns, whatever their names.

    Each row goes or stays by its own text, whatever rows share its doc_id or have none. The keys that go are
    written first: where they are few, as Spark finds by their size, no text is shuffled.
    """
    name, text_hash = free_name(docs, "_gone"), free_name(docs, "_gone_hash")
    gone = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, with_hash=True).select(F.col("doc_id").alias(name), F.col("text_hash").alias(text_hash)).distinct()
    gone = stage(gone, "gone")
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(text_hash)), "left_anti")
