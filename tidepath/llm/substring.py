"""Substring deduplication with an FM-index per shard.

Every window of 50 words is routed by its minimizer, the least hash of the 10-word sequences in it, so equal
windows meet wherever they stand. Consecutive windows with one minimizer are a span. Only minimizers that
occur in several documents go on, and of equal spans only one copy, with the smallest document it occurs in.
A shard builds a compressed FM-index (wavelet matrix over the Burrows-Wheeler transform of word ids, with
marks where neighbouring suffixes share 50 words) of its spans, and streams the spans through it: backward
search gives the suffix interval of each position's longest match of up to 50 words, and at full length the
interval's smallest document. A window that occurs in a smaller document than its own is reported.

A minimizer whose distinct spans are too much for one shard, as that of a passage which stands in very many
surroundings, is taken apart: of its windows those with a content hash that several spans have go on, once each,
and are dealt over shards by that hash, so equal windows still meet and no shard grows with the passage's fame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .tokens import mix, raw_column, split_rows, windows, words_of

WINDOW, GRAM = 50, 10
#: Words of a shard; a minimizer with more of them in distinct spans is taken apart.
SHARD_WORDS = 400_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width and len(out):
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def _content(g: np.ndarray, window: int, gram: int) -> np.ndarray:
    """A hash of each window from those of its `gram`-word sequences, by place of the first."""
    n = max(0, len(g) - (window - gram))
    whole = windows(g, 1, 2)[:n].copy()
    for j in range(gram, window - gram + 1, gram):
        whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + g[j : j + n])
    if window % gram:
        whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + g[window - gram : window - gram + n])
    return whole


_RUNS = pa.schema([("m", pa.int64()), ("span", pa.int64()), ("n_windows", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64())])
RUNS = "m long, span long, n_windows long, doc_id long, text_hash long, start long"


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw_column(batch.column(2))
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in split_rows(offs):
                words = words_of(data, offs, lo, hi)
                h, rows = words.hashes(lower=False), words.rows
                if len(h) < window:
                    continue
                g = windows(h, gram, 1)
                least = _sliding_min(g, window - gram + 1)
                inside = rows[: len(least)] == rows[window - 1 :]
                begin = inside.copy()
                begin[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (rows[1 : len(least)] != rows[: len(least) - 1])
                at = np.flatnonzero(begin)
                if not len(at):
                    continue
                # a span's content, from its windows in order
                whole = _content(g, window, gram)
                own = np.flatnonzero(inside)
                run_of = np.cumsum(begin)[own] - 1
                place = (own - at[run_of]).astype(np.uint64)
                content = mix(whole[own] + place * np.uint64(0xD6E8FEB86659FD93))
                first = np.searchsorted(run_of, np.arange(len(at)))
                span = np.add.reduceat(content, first)
                count = np.diff(np.concatenate([first, [len(own)]]))
                row = rows[at] + lo
                yield pa.RecordBatch.from_arrays([pa.array(least[at].view(np.int64)), pa.array(span.view(np.int64)), pa.array(count), pa.array(ids[row]), pa.array(keys[row]), pa.array(at - words.first[rows[at]])], schema=_RUNS)

    return run


_SPANS = pa.schema([("m", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("words", pa.list_(pa.int64()))])


def _spans(window: int):
    """The word hashes of requested spans: rows text, doc_id and the lists m, span, start, n_windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw_column(batch.column(0))
            for lo, hi in split_rows(offs):
                words = words_of(data, offs, lo, hi)
                h = words.hashes(lower=False).view(np.int64)
                part = batch.slice(lo, hi - lo)
                lists = [part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
                each = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(hi - lo), each)
                begin = words.first[row] + lists[2]
                lens = lists[3] + window - 1
                ends = np.cumsum(lens)
                taken = h[np.repeat(begin - (ends - lens), lens) + np.arange(int(lens.sum()))]
                ids = part.column(1).to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays([pa.array(lists[0]), pa.array(lists[1]), pa.array(ids), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(taken))], schema=_SPANS)

    return run


_UNITS = pa.schema([("m", pa.int64()), ("span", pa.int64()), ("at", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64())])
UNITS = "m long, span long, at long, content long, doc_id long, text_hash long, start long"


def _units(window: int, gram: int):
    """The windows of requested spans: rows text, doc_id, the lists m, span, start, n_windows, and text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw_column(batch.column(0))
            for lo, hi in split_rows(offs):
                words = words_of(data, offs, lo, hi)
                whole = _content(windows(words.hashes(lower=False), gram, 1), window, gram)
                part = batch.slice(lo, hi - lo)
                m, span, start, count = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
                row = np.repeat(np.arange(hi - lo), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(start, count) + at
                ids, keys = (part.column(i).to_numpy(zero_copy_only=False)[np.repeat(row, count)] for i in (1, 6))
                content = whole[np.repeat(words.first[row], count) + place].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(m, count)), pa.array(np.repeat(span, count)), pa.array(at), pa.array(content), pa.array(ids), pa.array(keys), pa.array(place)], schema=_UNITS)

    return run


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence: a bit vector per bit of the symbols, 64 bits to a word, with a count before each word."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, dtype=np.uint8)]).view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(len(seq) - int(counts.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def _ones(self, k: int, pos: np.ndarray) -> np.ndarray:
        word = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def rank(self, symbols: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        base = np.zeros_like(pos)
        for k in range(self.levels):
            bit = (symbols >> (self.levels - 1 - k)) & 1
            one, one_base = self._ones(k, pos), self._ones(k, base)
            pos = np.where(bit == 1, self.zeros[k] + one, pos - one)
            base = np.where(bit == 1, self.zeros[k] + one_base, base - one_base)
        return pos - base


class FMIndex:
    """Backward search over a sequence of symbols from 1 on, 0 between its parts; contexts count up to `depth` symbols."""

    def __init__(self, seq: np.ndarray, owners: np.ndarray, depth: int):
        n = len(seq)
        sigma = int(seq.max(initial=0)) + 1
        rank, have, halves = seq.astype(np.int64), 1, {}
        order = np.argsort(rank, kind="stable")
        while have < depth:
            after = np.zeros(n, dtype=np.int64)
            if have < n:
                after[: n - have] = rank[have:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            step = np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, dtype=bool)
            halves[have] = rank
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(step)
            have *= 2
        half = have // 2
        lead = halves.get(half, rank)[order]
        rest = np.zeros(n, dtype=np.int64)
        if depth - half < n:
            rest[: n - (depth - half)] = halves.get(half, rank)[depth - half :] + 1
        rest = rest[order]
        self.depth = depth
        self.bwt = WaveletMatrix(seq[order - 1], sigma)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        # runs of suffixes that share `depth` symbols: first row, end row, smallest owner
        edge = np.ones(n, dtype=bool)
        edge[1:] = (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])
        first = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        self.run_first, self.run_end = first[run], np.concatenate([first[1:], [n]])[run]
        self.run_owner = np.minimum.reduceat(owners[order], first)[run]
        self.n = n

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals and lengths after one more symbol in front; a match over `depth` symbols loses its last one. Where nothing matches the search begins anew."""
        lo2 = self.starts[symbols] + self.bwt.rank(symbols, lo)
        hi2 = self.starts[symbols] + self.bwt.rank(symbols, hi)
        none = hi2 <= lo2
        lo2, hi2 = np.where(none, 0, lo2), np.where(none, self.n, hi2)
        length = np.where(none, 0, np.minimum(length + 1, self.depth))
        full = length == self.depth
        lo2[full], hi2[full] = self.run_first[lo2[full]], self.run_end[lo2[full]]
        return lo2, hi2, length


def search_spans(words: np.ndarray, lens: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For each window of each span, in order, the smallest owner among all spans that contain it."""
    ends = np.cumsum(lens)
    begins = ends - lens
    seq = np.zeros(len(words) + len(lens), dtype=np.int64)
    at = np.arange(len(words)) + np.repeat(np.arange(len(lens)), lens)
    seq[at] = np.unique(words, return_inverse=True)[1] + 1
    index = FMIndex(seq, np.repeat(owners, lens + 1), window)
    begins = begins + np.arange(len(lens))
    counts = lens - window + 1
    out_at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    order = np.argsort(-lens, kind="stable")
    begins, lens, out_at = begins[order], lens[order], out_at[order]
    lo, hi, length = np.zeros(len(lens), dtype=np.int64), np.full(len(lens), index.n, dtype=np.int64), np.zeros(len(lens), dtype=np.int64)
    # lanes are spans, longest first; step t looks at the word t from a span's end
    for t in range(1, int(lens[0]) + 1):
        live = int(np.searchsorted(-lens, -t, "right"))
        place = lens[:live] - t
        lo[:live], hi[:live], length[:live] = index.extend(seq[begins[:live] + place], lo[:live], hi[:live], length[:live])
        if t >= window:
            out[out_at[:live] + place] = index.run_owner[lo[:live]]
    return out


_FOUND = pa.schema([("m", pa.int64()), ("span", pa.int64()), ("at", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("owner", pa.list_(pa.int64()))])
FOUND = "m long, span long, at array<long>, size array<long>, owner array<long>"


def _search(window: int, shard_words: int):
    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        words = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        lens = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = search_spans(words, lens, batch.column(2).to_numpy(zero_copy_only=False), window)
        counts = lens - window + 1
        span = np.repeat(np.arange(len(lens)), counts)
        edge = np.ones(len(owner), dtype=bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (span[1:] != span[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.concatenate([first, [len(owner)]]))
        cut = np.searchsorted(span[first], np.arange(len(lens) + 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(first - (np.cumsum(counts) - counts)[span[first]]), lists(size), lists(owner[first])], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # sorted by m
            if not batch.num_rows:
                continue
            m = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1, [len(m)]])
            weight = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            at = 0
            for a, b in zip(cuts[:-1], cuts[1:]):
                joined = a == 0 and held and held[-1].column(0)[-1].as_py() == m[0]
                if size + weight[a] - weight[at] >= shard_words and not joined and (held or a > at):
                    if a > at:
                        held.append(batch.slice(at, a - at))
                    yield shard(held)
                    held, size, at = [], 0, a
            held.append(batch.slice(at))
            size += int(weight[-1] - weight[at])
        if held:
            yield shard(held)

    return run


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = raw_column(batch.column(1))
        for lo, hi in split_rows(offs):
            words = words_of(data, offs, lo, hi)
            part = batch.slice(lo, hi - lo)
            n = len(words.starts)
            change = np.zeros(n + 1, dtype=np.int64)
            begin, end = (part.column(i) for i in (2, 3))
            each = np.nan_to_num(begin.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            row = np.repeat(np.arange(hi - lo), each)
            np.add.at(change, words.first[row] + begin.flatten().to_numpy(zero_copy_only=False).astype(np.int64), 1)
            np.add.at(change, words.first[row] + end.flatten().to_numpy(zero_copy_only=False).astype(np.int64), -1)
            keep = np.cumsum(change)[:n] == 0
            at = np.concatenate([[0], np.cumsum(keep)])[words.first]
            lens = (words.ends - words.starts + 1)[keep]
            to = np.concatenate([[0], np.cumsum(lens)])
            out = np.full(int(to[-1]), 32, dtype=np.uint8)
            inner = lens - 1
            pos = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
            out[np.repeat(to[:-1], inner) + pos] = words.data[np.repeat(words.starts[keep], inner) + pos]
            raw = out.tobytes()
            texts = [raw[a : max(a, b - 1)] for a, b in zip(to[at[:-1]].tolist(), to[at[1:]].tolist())]
            kept = pa.array([hashlib.sha256(x).hexdigest() for x in texts]) if digest else pa.array(texts, pa.binary()).cast(pa.string())
            total = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(total - np.diff(at)), kept], schema=_CUT)


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut(batches, False)


def _cut_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut(batches, True)


def _asked(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts with lists of the spans (m, span, start, n_windows by doc_id and text_hash) that are wanted of them, as _spans and _units take them."""
    lists = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("m", "span", "start", "n_windows")).alias("asked"))
    return texts.join(lists, ["doc_id", "text_hash"]).select("text", "doc_id", *[F.col(f"asked.{c}").alias(c) for c in ("m", "span", "start", "n_windows")], "text_hash")


def repeated_intervals(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text_hash, begin, end of word ranges that also occur in a document with a smaller doc_id; texts has doc_id, text_hash, text."""
    runs = texts.filter("doc_id is not null").mapInArrow(_runs(window, gram), RUNS)
    runs = stage(runs, "runs")
    common = runs.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("m")
    uses = stage(runs.join(common, "m"), "uses")
    kinds = uses.groupBy("m", "span").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.first("n_windows").alias("n_windows"))
    kinds = stage(kinds.select("m", "span", "n_windows", "first.*"), "kinds")
    several = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_windows") + window - 1).alias("words")).filter("n > 1")
    several = stage(several.select("m", (F.col("words") > shard_words).alias("hot")), "several")
    pick = lambda hot: kinds.join(several.filter("hot" if hot else "not hot").select("m"), "m", "left_semi")

    def searched(spans: DataFrame) -> DataFrame:
        words = spans.mapInArrow(_spans(window), "m long, span long, doc_id long, words array<long>")
        return words.repartition("m").sortWithinPartitions("m").mapInArrow(_search(window, shard_words), FOUND).dropDuplicates(["m", "span"])

    found = searched(_asked(texts, pick(False))).select("m", "span", F.arrays_zip("at", "size", "owner").alias("found"))
    if not several.filter("hot").isEmpty():
        units = stage(_asked(texts, pick(True)).mapInArrow(_units(window, gram), UNITS), "units")
        repeated = units.groupBy("content").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        # a shard's key is the content hash's share of the range that gives shards of about shard_words
        n = repeated.count()
        shard = F.pmod(F.xxhash64("content"), F.lit(1 + n * window // shard_words))
        ones = repeated.select("first.*", F.col("content").alias("span"), shard.alias("m"), F.lit(1).cast("long").alias("n_windows"))
        owners = searched(_asked(texts, stage(ones, "ones"))).select(F.col("span").alias("content"), F.col("owner")[0].alias("owner"))
        each = units.join(owners, "content", "left").select("m", "span", F.struct("at", F.lit(1).cast("long").alias("size"), F.coalesce("owner", "doc_id").alias("owner")).alias("f"))
        found = found.unionByName(each.groupBy("m", "span").agg(F.collect_list("f").alias("found")).select("m", "span", F.col("found").cast("array<struct<at:bigint,size:bigint,owner:bigint>>")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n_windows").alias("size"), F.col("doc_id").alias("owner")))
    kinds = kinds.join(found, ["m", "span"], "left").select("m", "span", F.coalesce("found", alone).alias("found"))
    hits = uses.join(kinds, ["m", "span"]).select("doc_id", "text_hash", "start", F.explode("found").alias("f")).filter("f.owner < doc_id")
    return hits.select("doc_id", "text_hash", (F.col("start") + F.col("f.at")).alias("begin"), (F.col("start") + F.col("f.at") + F.col("f.size") + window - 1).alias("end"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (or kept_sha256 if digest): one row per input row.

    A word goes if it is covered by a window of `window` consecutive words whose sequence also starts in a
    document with a smaller doc_id; windows are judged on the input. Words are what stands between the
    characters space, tab, line feed, vertical tab, form feed and carriage return, unchanged; kept ones are
    joined by one space. Null texts have no words. Rows that repeat a doc_id do not remove from each other;
    rows with a null doc_id neither lose words nor remove any. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    cuts = repeated_intervals(texts, window, gram, shard_words).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    none = F.array().cast("array<bigint>")
    rows = texts.join(cuts, ["doc_id", "text_hash"], "left").select("doc_id", "text", F.coalesce("cuts.begin", none).alias("begin"), F.coalesce("cuts.end", none).alias("end"))
    out = rows.mapInArrow(_cut_digest if digest else _cut_text, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("kept_text", "kept_sha256") if digest else out
