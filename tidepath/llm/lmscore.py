"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts every token from the three before and the three after it: position-wise embeddings of
the context are summed, squashed, and read out by a two-level softmax, first the token's class, then the
token in its class. A rare word's token is a bucket, and the word then has its exact share of the bucket's
count. Word counts cover the whole corpus, and the number of classes grows with it; training is data-parallel: each task runs gradient
steps over its own rows from the common parameters, and parameters are averaged by Spark, weighted by tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .tokens import mix, raw_column, split_rows, words_of

#: Classes, and tokens in each: at least LEAST_SIDE, and GROWTH times the fifth root of the number of distinct words, so tokens grow with its power of 2/5.
LEAST_SIDE, GROWTH = 32, 3.3
#: Of the tokens one in this many is a bucket of rare words, by hash; the others are words of their own.
PER_BUCKET = 8
REACH, HIDDEN = 3, 16
#: Every position trains once: one in ROUNDS positions of every document in each round, the next ones in the next round.
ROUNDS, BATCH, STEP = 2, 2048, 0.15
BLOCK = 64


def side_for(distinct: int) -> int:
    return max(LEAST_SIDE, math.ceil(GROWTH * distinct**0.2))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    ids: np.ndarray
    side: int
    totals: np.ndarray  # words counted in each bucket

    @property
    def size(self) -> int:
        return self.side**2

    @property
    def own(self) -> int:
        return self.size - self.size // PER_BUCKET

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        rest = self.own + (mix(hashes.copy()) % np.uint64(self.size - self.own)).astype(np.int64)
        if not len(self.hashes):
            return rest
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], rest)


_COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])


def _merge(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, back = np.unique(np.concatenate(words), return_inverse=True)
    return unique, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, held = [], [], 0
    for batch in batches:
        data, offs = raw_column(batch.column(0))
        for lo, hi in split_rows(offs):
            unique, n = np.unique(words_of(data, offs, lo, hi).hashes(lower=True), return_counts=True)
            words.append(unique)
            counts.append(n)
            held += len(unique)
            if held > 2_000_000:
                u, c = _merge(words, counts)
                words, counts, held = [u], [c], len(u)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], schema=_COUNTS)
                    words, counts, held = [], [], 0
    if words:
        u, c = _merge(words, counts)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], schema=_COUNTS)


def _totals(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(vocabulary.size, dtype=np.int64)
        for batch in batches:  # word, n
            token = vocabulary.tokens(batch.column(0).to_numpy().view(np.uint64))
            np.add.at(out, token, batch.column(1).to_numpy())
        at = np.flatnonzero(out)
        at = at[at >= vocabulary.own]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], schema=_COUNTS)

    return run


def count_words(texts: DataFrame) -> DataFrame:
    """word (hash), n of every distinct word."""
    return stage(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words by descending count, then hash, and the sums of the buckets of all others. Both have the model's size."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    found = Vocabulary(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), side_for(sum(n for _, n in steps)), np.zeros(0))
    least, held = 0, 0
    for least, n in steps:
        held += n
        if held >= found.own:
            break
    top = counts.filter(step >= least).orderBy(F.desc("n"), "word").limit(found.own).collect()
    words = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    found.hashes, found.ids = words[order], order.astype(np.int64)
    found.totals = np.zeros(found.size - found.own)
    for r in counts.mapInArrow(_totals(found), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        found.totals[r.word - found.own] = r.n
    return found


@dataclass
class Network:
    context: np.ndarray  # 2 * REACH, tokens + 1, HIDDEN; the last token stands outside of the text
    bias: np.ndarray
    classes: np.ndarray  # HIDDEN + 1, side
    words: np.ndarray  # side, HIDDEN + 1, side

    @staticmethod
    def fresh(side: int, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        return Network(f(2 * REACH, side**2 + 1, HIDDEN), f(HIDDEN), f(HIDDEN + 1, side), f(side, HIDDEN + 1, side))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.bias, self.classes, self.words)])

    @staticmethod
    def unflat(flat: np.ndarray, side: int) -> Network:
        like, out, at = Network.fresh(side), [], 0
        for x in (like.context, like.bias, like.classes, like.words):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Of contexts by position: around[j] has the tokens at position j."""
        total = self.context[0].take(around[0], axis=0)
        total += self.bias
        for j in range(1, 2 * REACH):
            total += self.context[j].take(around[j], axis=0)
        out = np.ones((len(total), HIDDEN + 1), dtype=np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def log_probs(self, around: np.ndarray, token: np.ndarray, learn: float = 0.0) -> np.ndarray:
        """Log probability of each token given its context; with learn, a gradient step of that rate follows."""
        side = len(self.words)
        cls = token // side
        # by class, so that each class's words are one product
        order = np.argsort(cls.astype(np.int16), kind="stable")
        around, cls, word = np.ascontiguousarray(around[order].T), cls[order], (token % side)[order]
        edges = np.searchsorted(cls, np.arange(side + 1))
        parts = [(c, edges[c], edges[c + 1]) for c in range(side) if edges[c + 1] > edges[c]]
        h = self.hidden(around)
        rows = np.arange(len(token))
        p, q = h @ self.classes, np.empty((len(token), side), dtype=np.float32)
        for c, lo, hi in parts:
            np.matmul(h[lo:hi], self.words[c], out=q[lo:hi])
        (log_p, total_p), (log_q, total_q) = _softmax(p, rows, cls), _softmax(q, rows, word)
        out = np.empty(len(token), dtype=np.float32)
        out[order] = log_p + log_q
        if learn:
            learn = np.float32(learn)
            p *= (learn / total_p)[:, None]
            p[rows, cls] -= learn
            q *= (learn / total_q)[:, None]
            q[rows, word] -= learn
            back, own = p @ self.classes.T, np.empty_like(h)
            self.classes -= h.T @ p
            for c, lo, hi in parts:
                np.matmul(q[lo:hi], self.words[c].T, out=own[lo:hi])
                self.words[c] -= h[lo:hi].T @ q[lo:hi]
            back += own
            grad = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2)
            self.bias -= np.ones(len(grad), dtype=np.float32) @ grad
            # pairs of numbers go as one complex number, half as many to take off
            pairs, loss = np.arange(HIDDEN // 2), grad.view(np.complex64).ravel()
            for j in range(2 * REACH):
                at = around[j].astype(np.int64)[:, None] * (HIDDEN // 2) + pairs
                np.subtract.at(self.context[j].reshape(-1).view(np.complex64), at.ravel(), loss)
        return out


#: Scores within this of 0 have exponentials and sums that float holds.
PLAIN = 60


def _softmax(scores: np.ndarray, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the chosen columns, and totals: scores become exponentials, in place, which are probabilities times their row's total."""
    if not (scores.size and -PLAIN < scores.min() and scores.max() < PLAIN):
        scores -= scores.max(axis=1, keepdims=True)
    chosen = scores[rows, which]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], dtype=np.float32)
    return chosen - np.log(total), total


def contexts(tokens: np.ndarray, rows: np.ndarray, outside: int) -> np.ndarray:
    """The tokens around each place, `outside` where its row has none."""
    out = np.full((len(tokens), 2 * REACH), outside, dtype=np.int32)
    for j in range(REACH):
        d = REACH - j
        same = rows[d:] == rows[:-d] if len(rows) > d else np.zeros(0, dtype=bool)
        out[d:, j][same] = tokens[:-d][same]
        out[: len(tokens) - d, 2 * REACH - 1 - j][same] = tokens[d:][same]
    return out


_TOKENS = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
TOKENS = "row_id long, doc_id long, tokens array<int>, rare array<long>, times array<int>"


def _tokenise(shared):
    """Each row's tokens, and its distinct rare words with how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:  # row_id, doc_id, text
            data, offs = raw_column(batch.column(2))
            for lo, hi in split_rows(offs):
                words = words_of(data, offs, lo, hi)
                h, rows = words.hashes(lower=True), words.rows
                tokens = vocabulary.tokens(h)
                rare = np.flatnonzero(tokens >= vocabulary.own)
                by = np.argsort(h[rare])
                rare = rare[by[np.argsort(rows[rare][by].astype(np.uint32), kind="stable")]]
                hr, rr = h[rare], rows[rare]
                first = np.flatnonzero(np.concatenate([[True], (hr[1:] != hr[:-1]) | (rr[1:] != rr[:-1])])) if len(rare) else rare
                times = np.diff(np.concatenate([first, [len(rare)]])).astype(np.int32) if len(rare) else np.zeros(0, dtype=np.int32)
                ends = pa.array(np.searchsorted(rr[first], np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(tokens.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(hr[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], schema=_TOKENS)

    return run


def _slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, tokens, bounds of the rows) of slices of about `most` tokens, or of one longer row."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tokens, bounds = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)])
    for lo, hi in split_rows(bounds, most):
        yield lo, hi, tokens[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]


_PARAMS = pa.schema([("block", pa.int64()), ("weight", pa.float64()), ("v", pa.list_(pa.float32()))])


def trained(first: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places that train in a round, of rows with bounds `first`: over all rounds every place is in one of them."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero((np.arange(len(rows)) - first[rows] + rows + turn) % rounds == 0)


def _train(shared, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, flat = shared.value
        net, seen = Network.unflat(flat, side), 0
        for batch in batches:
            for _, _, tokens, first in _slices(batch.column(0)):
                around = contexts(tokens, np.repeat(np.arange(len(first) - 1), np.diff(first)), side**2)
                which = trained(first, turn, rounds)
                for at in range(0, len(which), BATCH):
                    part = which[at : at + BATCH]
                    net.log_probs(around[part], tokens[part], STEP * 16 / BATCH)
                    seen += len(part)
        if seen:
            flat = net.flat()
            flat = np.concatenate([flat, np.zeros(-len(flat) % BLOCK, dtype=np.float32)])
            n = len(flat) // BLOCK
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, float(seen))), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BLOCK, dtype=np.int32)), pa.array(flat))], schema=_PARAMS)

    return run


def train_network(tokens: DataFrame, side: int, rounds: int = ROUNDS) -> Network:
    """Rounds of local steps and averaging over rows of tokens. The driver gets the average alone, which has the model's size."""
    net = Network.fresh(side)
    for turn in range(rounds):
        shared = tokens.sparkSession.sparkContext.broadcast((side, net.flat()))
        parts = tokens.select("tokens").mapInArrow(_train(shared, turn, rounds), "block long, weight double, v array<float>")
        sums = [F.sum(F.col("weight") * F.col("v")[i]).alias(f"s{i}") for i in range(BLOCK)]
        mean = parts.groupBy("block").agg(F.sum("weight").alias("w"), *sums).select("block", *[(F.col(f"s{i}") / F.col("w")).cast("float") for i in range(BLOCK)])
        rows = sorted(tuple(r) for r in mean.collect())
        if not rows:
            break
        net = Network.unflat(np.array([r[1:] for r in rows], dtype=np.float32).ravel(), side)
    return net


_SCORES = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("total", pa.float64())])
SCORES = "row_id long, doc_id long, n_tokens long, total double"


def _score(shared):
    """The sum of each row's tokens' log probabilities, less the logs of the buckets' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        net = Network.unflat(flat, vocabulary.side)
        whole = np.concatenate([np.zeros(vocabulary.own), np.log(vocabulary.totals + 1)])
        for batch in batches:  # row_id, doc_id, tokens
            for lo, hi, tokens, first in _slices(batch.column(2)):
                rows = np.repeat(np.arange(hi - lo), np.diff(first))
                around, logs = contexts(tokens, rows, vocabulary.size), np.zeros(len(tokens))
                for at in range(0, len(tokens), 16384):
                    logs[at : at + 16384] = net.log_probs(around[at : at + 16384], tokens[at : at + 16384])
                logs -= whole[tokens]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.bincount(rows, logs, hi - lo))], schema=_SCORES)

    return run


def tokenise(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """row_id, doc_id, tokens, rare, times of each row, staged: texts are split and hashed once for all rounds."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.mapInArrow(_tokenise(shared), TOKENS), "tokens")


def score_documents(docs: DataFrame, train_on: DataFrame | None = None, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_prob: one row per input row.

    log_likelihood sums the log probability of every word given the words around it, over the whole text. A
    rare word has its bucket's probability times its share n / (N + 1) of the bucket's N counted words; one
    that train_on does not have counts as one. Null and empty texts have no tokens, likelihood 0 and a null
    mean. Repeated rows get equal rows and weigh as often in training. An empty table gives no rows. The
    vocabulary counts every word of train_on (or docs), and every position of every document trains the network
    in one of the rounds. Within a round each task takes its own steps and their parameters are averaged, so
    scores depend a little on how rows are dealt over tasks; with rows dealt alike a rerun gives the same scores.
    """
    source = docs if train_on is None else train_on
    counts = count_words(source.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    vocabulary = build_vocabulary(counts)
    tokens = tokenise(docs, vocabulary, id_col, text_col)
    net = train_network(tokens if train_on is None else tokenise(train_on, vocabulary, id_col, text_col), vocabulary.side, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat()))
    totals = tokens.select("row_id", "doc_id", "tokens").mapInArrow(_score(shared), SCORES)
    words = tokens.select("row_id", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))).alias("w")).select("row_id", "w.word", "w.times")
    # a word that occurs once has the log 0 and needs no row
    shares = words.join(counts.filter("n > 1"), "word").groupBy("row_id").agg(F.sum(F.col("times") * F.log(F.col("n").cast("double"))).alias("share"))
    rows = totals.join(shares, "row_id", "left").withColumn("log_likelihood", F.col("total") + F.coalesce("share", F.lit(0.0)))
    return rows.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_prob"))
