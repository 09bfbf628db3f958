"""Language identification with a linear-chain conditional random field over words.

A word's emission scores come from hashed affixes and n-grams of its bytes and from a lexicon; transitions
between neighbouring words' labels are learned, on sequences spliced from documents of several languages, as
in code-switched text. Forward-backward gives each word's label probabilities; a document's language is the
one with the highest mean probability over its words with letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name
from .tokens import Words, raw_column, split_rows, words_of

FEATURES = 1 << 16
CHUNK = 64
UNDETERMINED = "und"
_CASE = np.arange(256, dtype=np.uint8)
_CASE[65:91] += 32
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # feature, label
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weights: np.ndarray  # entry, label
    transitions: np.ndarray  # from, to


def _slot(kind: int, *codes: np.ndarray) -> np.ndarray:
    acc = np.full(len(codes[0]), kind, dtype=np.uint32)
    for c in codes:
        acc = (acc ^ c.astype(np.uint32)) * np.uint32(16777619)
        acc ^= acc >> np.uint32(15)
    return (acc & np.uint32(FEATURES - 1)).astype(np.int64)


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `which`, feature) of the chosen words: bigrams and trigrams of bytes with marked ends, and affixes of three bytes."""
    lens = (words.ends - words.starts)[which]
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    x = _CASE[words.data[np.repeat(words.starts[which], lens) + pos]]
    before, after = np.empty_like(x), np.empty_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[at], after[at + lens - 1] = 0, 0
    own = np.repeat(np.arange(len(which)), lens)
    each = np.arange(len(which))
    last = at + lens - 1
    head = [x[at], x[np.minimum(at + 1, last)], x[np.minimum(at + 2, last)]]
    tail = [x[last], x[np.maximum(last - 1, at)], x[np.maximum(last - 2, at)]]
    short = np.minimum(lens, 3).astype(np.uint8)
    place = np.concatenate([own, own, each, each])
    return place, np.concatenate([_slot(1, before, x), _slot(2, before, x, after), _slot(3, *head, short), _slot(4, *tail, short)])


def emissions(crf: Crf, words: Words, hashes: np.ndarray) -> np.ndarray:
    """Label scores of each word, computed once for equal words."""
    unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    place, slot = word_features(words, first)
    n = len(unique)
    scores = np.stack([np.bincount(place, crf.weights[slot, k], n) for k in range(len(crf.labels))], axis=1)
    if len(crf.lexicon):
        at = np.minimum(np.searchsorted(crf.lexicon, unique), len(crf.lexicon) - 1)
        known = crf.lexicon[at] == unique
        scores[known] += crf.lexicon_weights[at[known]]
    return scores[back].astype(np.float32)


def posteriors(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word by forward-backward within each row; row r has words first[r] to first[r + 1]."""
    return forward_backward(scores, first, transitions)[0]


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of each word and, with pairs, the expected number of each transition, of the one into a row's first word too.

    Rows are cut into chunks that run side by side. A chunk's product of transition and emission matrices
    carries forward and backward vectors over it, so long rows cost no more steps than there are chunks.
    """
    n, k = scores.shape
    if not n:
        return scores, np.zeros(transitions.shape) if pairs else None
    sizes = np.diff(first)
    chunks = -(-sizes // CHUNK)
    chunk_row = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(len(chunk_row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = first[:-1][chunk_row] + nth * CHUNK
    count = np.minimum(CHUNK, first[1:][chunk_row] - begin)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    c = len(begin)
    grid = np.ones((CHUNK, c, k), dtype=np.float32)
    valid = np.arange(CHUNK)[:, None] < count
    index = np.minimum(begin + np.arange(CHUNK)[:, None], n - 1)
    grid[valid] = emit[index[valid]]
    product = np.broadcast_to(np.eye(k, dtype=np.float32), (c, k, k)).copy()
    long = bool((chunks > 1).any())
    if long:
        for t in range(CHUNK):
            moved = (product.reshape(-1, k) @ step).reshape(c, k, k) * grid[t][:, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True)
            product = np.where(valid[t][:, None, None], moved, product)
    ahead, behind = np.ones((c, k), dtype=np.float32), np.ones((c, k), dtype=np.float32)
    if long:
        by_nth = np.argsort(nth, kind="stable")
        edges = np.searchsorted(nth[by_nth], np.arange(int(nth.max()) + 2))
        for i in range(1, len(edges) - 1):
            now = by_nth[edges[i] : edges[i + 1]]
            v = np.einsum("ci,cij->cj", ahead[now - 1], product[now - 1])
            ahead[now] = v / v.max(axis=1, keepdims=True)
        for i in range(len(edges) - 2, 0, -1):
            now = by_nth[edges[i] : edges[i + 1]]
            v = np.einsum("cij,cj->ci", product[now], behind[now])
            behind[now - 1] = v / v.max(axis=1, keepdims=True)
    # the first word of a row has no transition into it; a uniform start through the matrix stands for it
    forward = np.empty_like(grid)
    expected = np.zeros(transitions.shape) if pairs else None
    v = ahead
    for t in range(CHUNK):
        moved = (v @ step) * grid[t]
        moved /= moved.max(axis=1, keepdims=True)
        v = np.where(valid[t][:, None], moved, v)
        forward[t] = v
    v = behind
    out = np.empty_like(grid)
    for t in range(CHUNK - 1, -1, -1):
        out[t] = forward[t] * v
        if pairs:
            # what leads here, the transition, this word's score and what follows
            joint = (forward[t - 1] if t else ahead)[:, :, None] * step * (grid[t] * v)[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True))[valid[t]].sum(axis=0)
        moved = (grid[t] * v) @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        v = np.where(valid[t][:, None], moved, v)
    out /= out.sum(axis=2, keepdims=True)
    probs = np.empty((n, k), dtype=np.float32)
    probs[index[valid]] = out[valid]
    return probs, expected


def transition_counts(labels: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The transitions of known labels; into a row's first label they come from each label by its share."""
    out = np.zeros(transitions.shape)
    inner = np.ones(len(labels), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    now = np.flatnonzero(inner)
    np.add.at(out, (labels[now - 1], labels[now]), 1.0)
    into = np.exp(transitions - transitions.max())
    np.add.at(out.T, labels[~inner], (into / into.sum(axis=0)).T[labels[~inner]])
    return out


def train(spans: list[tuple[str, str]], epochs: int = 4, rate: float = 0.3, seed: int = 7) -> Crf:
    """Fit on (label, words joined by one space): spans are spliced to sequences of CHUNK words whose language changes on the way."""
    labels = sorted({x for x, _ in spans})
    rng = np.random.default_rng(seed)
    pieces: list[tuple[int, list[bytes]]] = []
    for label, text in sorted(spans):
        words, at = text.encode().split(b" "), 0
        while at < len(words):
            size = int(rng.integers(4, 33))
            pieces.append((labels.index(label), words[at : at + size]))
            at += size
    rng.shuffle(pieces)
    tokens = [w for _, ws in pieces for w in ws if w]
    gold = np.array([k for k, ws in pieces for w in ws if w], dtype=np.int64)
    raw = np.frombuffer(b" ".join(tokens), dtype=np.uint8)
    words = words_of(raw, np.array([0, len(raw)]), 0, 1)
    hashes = words.hashes(lower=True)
    unique, counts = np.unique(hashes, return_counts=True)
    lexicon = unique[counts >= 3]
    k = len(labels)
    crf = Crf(labels, np.zeros((FEATURES, k)), lexicon, np.zeros((len(lexicon), k)), np.zeros((k, k)))
    sums = [np.full_like(x, 1e-2) for x in (crf.weights, crf.lexicon_weights, crf.transitions)]
    batch = 64 * CHUNK
    for _ in range(epochs):
        for lo in rng.permutation(np.arange(0, max(1, len(gold)), batch)):
            hi = min(lo + batch, len(gold))
            if hi - lo < 2:
                continue
            part = Words(words.data, words.starts[lo:hi], words.ends[lo:hi], np.append(np.arange(0, hi - lo, CHUNK), hi - lo))
            y, h = gold[lo:hi], hashes[lo:hi]
            scores = emissions(crf, part, h)
            probs, expected = forward_backward(scores, part.first, crf.transitions, pairs=True)
            error = -probs.astype(np.float64)
            error[np.arange(len(y)), y] += 1
            place, slot = word_features(part, np.arange(len(y)))
            grads = [np.zeros_like(crf.weights), np.zeros_like(crf.lexicon_weights), transition_counts(y, part.first, crf.transitions) - expected]
            np.add.at(grads[0], slot, error[place])
            if len(lexicon):
                at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
                known = lexicon[at] == h
                np.add.at(grads[1], at[known], error[known])
            for x, g, s in zip((crf.weights, crf.lexicon_weights, crf.transitions), grads, sums):
                g /= 64
                s += g * g
                x += rate * g / np.sqrt(s)
    crf.weights, crf.lexicon_weights = crf.weights.astype(np.float32), crf.lexicon_weights.astype(np.float32)
    return crf


def _span(most: int):
    schema = pa.schema([("lang", pa.string()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # lang, text, draw in [0, 1)
            data, offs = raw_column(batch.column(1))
            out = []
            for lo, hi in split_rows(offs):
                words = words_of(data, offs, lo, hi)
                for i in range(hi - lo):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    begin = a + int(batch.column(2)[lo + i].as_py() * max(1, b - a - most + 1))
                    end = min(b, begin + most)
                    out.append(" ".join(words.data[words.starts[j] : words.ends[j]].tobytes().decode("utf-8", "replace") for j in range(begin, end)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=schema)

    return run


def training_spans(labelled: DataFrame, per_language: int = 400, words: int = 64, most_languages: int = 1000) -> list[tuple[str, str]]:
    """At most `per_language` rows of each language, drawn by hash, a run of at most `words` words of each: the bound on what the driver gets.

    labelled has text and lang and a draw, a number in [0, 1) fixed by the row. A language whose rows, being
    repeats, all miss the draw gives its first ones. More than `most_languages` languages are an error, as the
    model has a weight per feature and language.
    """
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    if not counts:
        return []

    def draw(rows: DataFrame) -> list[tuple[str, str]]:
        first = Window.partitionBy("lang").orderBy("draw", "text")
        some = rows.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= per_language)
        inside = some.select("lang", "text", F.pmod(F.col("draw") * 1e6, F.lit(1.0)).alias("where"))
        return [(r.lang, r.words) for r in inside.mapInArrow(_span(words), "lang string, words string").collect() if r.words]

    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(4.0 * per_language / n))]), F.col("lang"))
    found = draw(labelled.filter(F.col("draw") < share))
    missing = sorted(set(counts) - {k for k, _ in found})
    return found + (draw(labelled.filter(F.col("lang").isin(missing))) if missing else [])


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def _label(crf: Crf, data: np.ndarray, offs: np.ndarray, lo: int, hi: int, has_letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of rows lo to hi."""
    langs, best = np.full(hi - lo, UNDETERMINED, dtype=object), np.zeros(hi - lo)
    words = words_of(data, offs, lo, hi)
    if not crf.labels or not len(words.starts):
        return langs, best
    probs = posteriors(emissions(crf, words, words.hashes(lower=True)), words.first, crf.transitions)
    at = np.cumsum(_LETTER[words.data])
    spelled = at[words.ends - 1] - at[words.starts] + _LETTER[words.data[words.starts]] > 0
    rows = words.rows[spelled]
    total = np.stack([np.bincount(rows, probs[spelled, k], hi - lo) for k in range(len(crf.labels))], axis=1)
    number = np.bincount(rows, minlength=hi - lo)
    has = has_letters & (number > 0)
    langs[has] = np.array(crf.labels, dtype=object)[total.argmax(axis=1)[has]]
    best[has] = np.clip(total.max(axis=1)[has] / number[has], 0, 1)
    return langs, best


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id, held_out, has_letters, text
            data, offs = raw_column(batch.column(3))
            has = np.array(batch.column(2).to_pylist(), dtype=bool)
            for lo, hi in split_rows(offs):
                langs, best = _label(model.value, data, offs, lo, hi, has[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(best)], schema=_PREDICTED)

    return run


def _keep(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the columns of docs, has_letters, text
            names = batch.schema.names[:-2]
            data, offs = raw_column(batch.column(batch.num_columns - 1))
            has = np.array(batch.column(batch.num_columns - 2).to_pylist(), dtype=bool)
            good = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi in split_rows(offs):
                langs, best = _label(model.value, data, offs, lo, hi, has[lo:hi])
                good[lo:hi] = (langs != UNDETERMINED) & (best >= least)
            yield batch.select(list(range(len(names)))).filter(pa.array(good))

    return run


def _held(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, per_language: int = 400, words: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """A model of the rows that are not held out, have a language and have letters; without such rows one without labels."""
    known = docs.filter(~_held(id_col)).filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.lit("draw"), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)
    spans = training_spans(known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw")), per_language, words)
    return train(spans) if spans else Crf([], np.zeros((1, 0)), np.zeros(0, dtype=np.uint64), np.zeros((0, 0)), np.zeros((0, 0)))


def _letters(text_col: str) -> F.Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify_language(docs: DataFrame, train_on: DataFrame | None = None, per_language: int = 400, words: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    held_out rows have CRC-32 of doc_id as text equal to 2 modulo 4 (a null doc_id counts as the empty text);
    the model learns from the others only, from text and lang that are not null, of train_on or else docs: from
    a run of at most `words` words of at most `per_language` rows of each language. A
    prediction uses the whole text and nothing else. lang_pred is a learned label, or `und` with score 0 where
    the text is null or has no letters, or where nothing could be learned. Repeated rows get equal rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if train_on is None else train_on, per_language, words, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held(id_col).alias("held_out"), _letters(text_col).alias("has_letters"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), PREDICTED)


def keep_identified(docs: DataFrame, least_score: float = 0.4, per_language: int = 400, words: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is identified with at least that score, with all their columns; null and letterless texts go. No shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, words, id_col, text_col, lang_col))
    return docs.select("*", _letters(text_col).alias(free_name(docs, "_has_letters")), F.col(text_col).alias(free_name(docs, "_text"))).mapInArrow(_keep(model, least_score), docs.schema)
