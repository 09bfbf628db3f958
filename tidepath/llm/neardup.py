"""Near-duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

One hash per word shingle; its high bits choose a bin, and a bin keeps its least value. Empty bins borrow
from others by optimal densification. Bins in bands give bucket keys. Documents with equal shingle sets are
one class, and only one of them goes on. In a bucket of n classes a hub gets n - 1 edges; edges are confirmed
on full shingle sets. Buckets whose members are still in several components get further hubs, chosen outside
of the largest component and more of them each round, until every member that is still outside of it has been
a hub: pairs within a component are never looked at, and no link that shares a bucket is lost. Before that, classes that
have too few shingles in common with all others together to be linked with any are set aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage
from .graph import components
from .tokens import mix, raw_column, split_rows, windows, words_of

BINS, ROWS, BANDS = 256, 5, 40
#: Pairs are compared by sketch first: four bits of each half of a bin, before densification. Standard deviations that it
#: may fall behind what a pair at the threshold shows; of 84,000 simulated ones, with 4 to 3,000 shingles, the worst fell behind by 3.4.
SKETCH_SLACK = 5.0


def _shingles(words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the k-word shingles of a slice; of a shorter text the whole sequence as one."""
    h = words.hashes(lower=True)
    n = np.diff(words.first)
    out = windows(h, k)
    rows = words.rows
    inside = np.flatnonzero(rows[: len(out)] == rows[k - 1 :]) if len(out) else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    extra = np.zeros(len(short), dtype=np.uint64)
    for i, r in enumerate(short):
        part = h[words.first[r] : words.first[r + 1]]
        acc = np.uint64(len(part))
        with np.errstate(over="ignore"):
            for x in part:
                acc = (acc ^ x) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019)
        extra[i] = acc
    return np.concatenate([rows[inside], short]), np.concatenate([out[inside], mix(extra)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of rows lo to hi, by row and hash."""
    rows, hashes = _shingles(words_of(data, offsets, lo, hi), k)
    order = np.argsort(hashes)
    small = rows[order].astype(np.uint16 if hi - lo < 65536 else np.uint32)
    order = order[np.argsort(small, kind="stable")]
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def densify(values: np.ndarray, full: np.ndarray) -> None:
    """Fill empty bins, in place: bin i tries bins drawn by a hash of i and the attempt until one is full. Rows without a full bin stay empty."""
    n_bins = values.shape[1]
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        if attempt <= 8 * n_bins:
            other = (mix((col.astype(np.uint64) << np.uint64(20)) + np.uint64(attempt)) % np.uint64(n_bins)).astype(np.int64)
        else:  # the rest walks on
            other = (col + attempt) % n_bins
        got = full[row, other]
        values[row[got], col[got]] = values[row[got], other[got]]
        row, col = row[~got], col[~got]


def signatures(rows: np.ndarray, hashes: np.ndarray, values: np.ndarray, full: np.ndarray) -> None:
    """Write each row's least hash per bin into values, a column per bin; rows and hashes are sorted, so a bin's first is its least."""
    bins = (hashes >> np.uint64(65 - values.shape[1].bit_length())).astype(np.int64)
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1])
    values[rows[first], bins[first]] = hashes[first]
    full[rows[first], bins[first]] = True


def band_keys(values: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    mults = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    used = values[:, : rows * bands].reshape(len(values), bands, rows)
    keys = np.zeros((len(values), bands), dtype=np.uint64)
    for j in range(rows):
        keys += used[:, :, j] * mults[j]
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
SIGNED = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                data, offs = raw_column(batch.column(2))
                n = batch.num_rows
                halves, held = np.zeros((n, 2 * BINS), dtype=np.uint64), np.zeros((n, 2 * BINS), dtype=bool)
                size, d1, d2 = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                for lo, hi in split_rows(offs):
                    rows, hashes = shingle_sets(data, offs, lo, hi, k)
                    rows = rows + lo
                    if len(rows):
                        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                        own = rows[begin]
                        size[own] = np.diff(np.concatenate([begin, [len(rows)]]))
                        d1[own] = np.add.reduceat(mix(hashes + np.uint64(1)), begin)
                        d2[own] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begin)
                        signatures(rows, hashes, halves, held)
                # 0 marks an empty half; of a bin's halves the first that is not empty has its least hash
                nibbles = np.where(held, mix(halves.copy()) % np.uint64(15) + np.uint64(1), np.uint64(0)).astype(np.uint8)
                values, full = np.where(held[:, ::2], halves[:, ::2], halves[:, 1::2]), held[:, ::2] | held[:, 1::2]
                densify(values, full)
                keys = band_keys(values)
                # a plane for each of the four bits, 64 half bins to a word
                bits = np.concatenate([np.packbits(nibbles >> k & 1, axis=1, bitorder="little").view(np.int64) for k in range(4)], axis=1)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(np.ascontiguousarray(bits)), lists(keys)], schema=_SIGNED)

    return run


def _sets(k: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw_column(batch.column(1))
            for lo, hi in split_rows(offs):
                rows, hashes = shingle_sets(data, offs, lo, hi, k)
                ends = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], schema=schema)

    return run


def _similar(a: str, b: str, percent: int, slack: float | None) -> F.Column:
    """Sizes allow the similarity, and so do the sketches (unless slack is None).

    A half bin that is full in either set shows one shingle of their union; it shows the same in both if that is a
    shared one, so of a pair at the threshold a share of 1 - percent / 100 differs, or less. Halves draw from the
    union without replacement, so small sets are seen almost whole.
    """
    least = F.least(f"{a}.n_shingles", f"{b}.n_shingles")
    sizes = least * 100 >= percent * F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    if slack is None:
        return sizes
    words, rate = 2 * BINS // 64, 1 - percent / 100
    excess = F.lit(0.0)
    for i in range(words):
        differ = seen = None
        for k in range(4):
            x, y = F.col(f"{a}.sketch")[k * words + i], F.col(f"{b}.sketch")[k * words + i]
            differ = x.bitwiseXOR(y) if differ is None else differ.bitwiseOR(x.bitwiseXOR(y))
            seen = x.bitwiseOR(y) if seen is None else seen.bitwiseOR(x).bitwiseOR(y)
        excess = excess + F.bit_count(differ) - rate * F.bit_count(seen)
    # the halves that a union of that size fills, and one more for small unions, in which they are few
    union = (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) / (1 + percent / 100)
    full = 2 * BINS * (1 - F.exp(-union / (2 * BINS)))
    return sizes & (excess <= 1 + slack * F.sqrt(rate * (1 - rate) * full * F.greatest(F.lit(0.0), 1 - full / union)))


def fetch_sets(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """node, shingles of nodes (node, doc_id, text_hash), staged, one row each; only their texts become sets.

    A row that the table repeats gives its node's set once. Structs compare null ids as equal, and their hash
    partitioning serves the grouping as well as the join.
    """
    key = F.struct("doc_id", "text_hash").alias("key")
    rows = texts.select(key, "text").join(nodes.select("node", key), "key").groupBy("key", "node").agg(F.first("text").alias("text")).select("node", "text")
    return stage(rows.mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those whose full shingle sets are similar enough."""
    a = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    both = a.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    common = F.size(F.array_intersect("su", "sv")).cast("long")
    return both.filter(common * 100 >= percent * (F.size("su") + F.size("sv") - common)).select("u", "v").distinct()


def shared_counts(sets: DataFrame) -> DataFrame:
    """node, n_shared: how many of a node's shingles another node has too. No similarity can rest on the others."""
    each = sets.select("node", F.explode("shingles").alias("s"))
    several = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s")
    return each.join(several, "s", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n_shared"))


def near_duplicates(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text", more_hubs: int = 64, sketch_slack: float | None = SKETCH_SLACK, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    component_id is the smallest doc_id reachable over links of at least `percent` percent Jaccard similarity of
    k-word shingle sets (A-Z lower-cased). Texts that are null or without words are linked with nothing; shorter
    texts have their whole sequence as one shingle. Repeated rows and texts with equal sets are one class, so a
    row that repeats the smallest doc_id is kept too. A null doc_id comes after all others. An empty table gives no
    rows. with_hash adds text_hash (xxhash64), with which doc_id tells rows apart, and stays: whether the row is the
    one of its component that has the smallest doc_id, or repeats it.

    A pair at the threshold shares a band of 5 bins with probability 0.237, one of the 40 bands with
    probability 0.99998, and more above it. sketch_slack None compares the full sets of every candidate pair.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = texts.mapInArrow(_sign(k), SIGNED).withColumn("row_id", F.monotonically_increasing_id())
    signed = stage(signed, "signed")
    some = signed.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "text_hash"))
    classes = stage(some.groupBy("d1", "d2", "n_shingles").agg(first.alias("rep")).select("d1", "d2", "n_shingles", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.text_hash").alias("rep_hash"), F.col("rep.row_id").alias("node")), "classes")
    heads = some.join(classes.select("node"), F.col("row_id") == F.col("node"), "left_semi")
    # one exchange of (node, bucket) serves the count and the join
    banded = heads.select(F.col("row_id").alias("node"), F.posexplode("bands").alias("band", "bucket")).repartition("bucket")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    slots = stage(banded.join(shared, "bucket"), "slots")
    nodes = heads.withColumnRenamed("row_id", "node").select("node", "doc_id", "text_hash", "n_shingles", "sketch", "bands")
    nodes = stage(nodes.join(slots.select("node").distinct(), "node", "left_semi"), "nodes")
    members = stage(slots.join(nodes.select("node", "n_shingles", "sketch"), "node"), "members")
    sets = fetch_sets(nodes, texts, k)

    by_bucket = F.col("m.bucket") == F.col("h.bucket")
    pair = [F.greatest("m.node", "h.node").alias("u"), F.least("m.node", "h.node").alias("v")]
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles", "sketch")).alias("hub")).select("bucket", "hub.*")
    stars = members.alias("m").join(hubs.alias("h"), by_bucket & (F.col("m.node") != F.col("h.node")) & _similar("m", "h", percent, sketch_slack))
    links = stage(confirm(stage(stars.select(*pair).distinct(), "pairs"), sets, percent), "links")
    labels = stage(components(links), "labels")

    def labelled(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(labels.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    # buckets that hold several components; each has an anchor in its largest one. What is with the anchor stays so, as components only grow
    now = labelled(members, "node", "component")
    counts = now.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("anchor"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", "anchor", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("total")).filter("parts > 1")
    now = now.join(main, "bucket").withColumn("outside", F.col("component") != F.col("top.component")).withColumn("anchor", F.col("top.anchor")).withColumn("n_outside", F.col("total") - F.col("top.n")).drop("top", "parts", "total", "component")
    now = stage(now, "open")
    # how much of each set anything else that is open has too: a link needs s shingles in common, s (100 + percent) >= percent (a + b)
    known = sets.join(now.select("node").distinct(), "node", "left_semi")
    enough = F.col("n_shared") * 100 >= percent * F.col("n_shingles")
    both = (F.least("m.n_shared", "h.n_shared") * (100 + percent)) >= percent * (F.col("m.n_shingles") + F.col("h.n_shingles"))
    # members outside take turns as hubs, each once: about one a turn, by a hash, so no task orders a bucket
    rest = now.join(shared_counts(known), "node").filter(enough).join(nodes.select("node", "bands"), "node")
    draw = F.floor(F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 40)) / float(1 << 40) * F.col("n_outside")).cast("long") + 1
    rest = stage(rest.withColumn("turn", F.when(F.col("outside"), draw)).drop("outside", "n_outside"), "rest")
    # a pair is looked at in the first bucket it shares; one of the two is outside there, so it becomes a hub
    before = lambda side: F.slice(f"{side}.bands", F.lit(1), F.col(f"{side}.band"))
    new = ~F.arrays_overlap(before("m"), before("h"))
    last = rest.agg(F.max("turn")).first()[0] or 0
    done, upto = 0, more_hubs
    while done < last:
        now = labelled(labelled(rest, "node", "component"), "anchor", "main")
        hubs = now.filter((F.col("turn") > done) & (F.col("turn") <= upto) & (F.col("component") != F.col("main")))
        stars = now.alias("m").join(hubs.alias("h"), by_bucket & (F.col("m.component") != F.col("h.component")) & both & _similar("m", "h", percent, sketch_slack) & new)
        found = stage(confirm(stage(stars.select(*pair).distinct(), "pairs"), sets, percent), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = stage(components(links), "labels")
        done, upto = upto, upto * 4
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "text_hash"))
    ends = nodes.join(labels, "node").groupBy("component").agg(head.alias("head"))
    found = labels.join(ends, "component").select("node", F.col("head.doc_id").alias("head_doc"), F.col("head.text_hash").alias("head_hash"), F.lit(True).alias("linked"))
    placed = classes.join(found, "node", "left").select("d1", "d2", "n_shingles", *[F.when(F.col("linked"), F.col(f"head_{c}")).otherwise(F.col(f"rep_{c}")).alias(f"head_{c}") for c in ("doc", "hash")], F.lit(True).alias("known"))
    slim = signed.select("doc_id", "text_hash", "n_shingles", "d1", "d2")
    out = slim.join(placed, ["d1", "d2", "n_shingles"], "left").withColumn("component_id", F.when(F.col("known"), F.col("head_doc")).otherwise(F.col("doc_id")))
    same_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = out.withColumn("kept", same_id).withColumn("stays", F.col("known").isNull() | (same_id & (F.col("text_hash") == F.col("head_hash"))))
    return out.select("doc_id", *(["text_hash", "stays"] if with_hash else []), "n_shingles", "component_id", "kept")


def drop_near_copies(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group that near_duplicates links, that with the smallest doc_id, null last; with all their columns, whatever their names.

    Rows are told apart by doc_id, null or not, and text: rows that repeat both go or stay together. The keys that
    go are written first: where they are few, as Spark finds by their size, no text is shuffled.
    """
    name, text_hash = free_name(docs, "_gone"), free_name(docs, "_gone_hash")
    gone = near_duplicates(docs, percent, k, id_col, text_col, with_hash=True).filter("not stays").select(F.col("doc_id").alias(name), F.col("text_hash").alias(text_hash)).distinct()
    return docs.join(stage(gone, "gone"), F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(text_hash)), "left_anti")
