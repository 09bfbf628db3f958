"""Stages on nulls in every column, empty, repeated and long texts, and columns named like those the stages use."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidepath.llm.common import stage
from tidepath.llm.decontam import drop_contaminated
from tidepath.llm.exact import drop_exact_copies
from tidepath.llm.langid import keep_identified
from tidepath.llm.mixing import apply_mix, mix_sources, mixed
from tidepath.llm.neardup import drop_near_copies

PLAIN = " ".join(f"word{i}" for i in range(60))
LEAK = "the quiet harbour kept seven lanterns burning while nobody counted the small grey boats outside"
LONG = " ".join(f"long{i}" for i in range(60_000))
ROWS = [
    (1, PLAIN, "en", "a", 1), (1, PLAIN, "en", "a", 1), (2, PLAIN + "  ", None, "a", 2), (3, PLAIN + " more", "en", None, None), (4, None, None, None, None),
    (5, "", "en", "b", 0), (None, "a null id stands here and nothing else does", "en", "b", 3), (6, LONG, "en", "b", 4), (7, f"before {LEAK} after", "en", "c", 5), (None, None, None, None, None),
]
CLASHES = ("_gone", "_text_hash", "_kept_id", "_kept_hash", "_mix_id", "_mix_size", "_has_letters", "_text", "text_hash", "n_shingles", "size", "key", "row_id")


@pytest.fixture
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def ids(frame, docs):
    assert frame.columns == docs.columns
    assert all(r[c] == f"own {c}" for r in frame.collect() for c in CLASHES)
    return sorted((r.doc_id for r in frame.collect()), key=lambda x: (x is None, x))


def test_exact_stage(docs):
    # 2 is the longest of its group; 4, 5 and the last row are one group of empty texts, of which the null id comes first
    assert ids(drop_exact_copies(docs), docs) == [2, 3, 6, 7, None, None]


def test_near_stage(docs):
    # a repeated row of the smallest id stays with it; rows without words, and those without an id, stay
    assert ids(drop_near_copies(docs), docs) == [1, 1, 4, 5, 6, 7, None, None]


def test_decontamination_stage(spark, docs):
    benchmark = spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string")
    assert ids(drop_contaminated(docs, benchmark), docs) == [1, 1, 2, 3, 4, 5, 6, None, None]


def test_language_stage(docs):
    assert ids(keep_identified(docs), docs) == [1, 1, 2, 3, 6, 7, None]


def test_mixing_stage(docs):
    unique = docs.filter("doc_id > 1")
    mix = stage(mix_sources(unique), "mix")
    out = apply_mix(unique, mix)
    assert out.columns == [*unique.columns, "epoch", "taken"]
    assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES)
    words = F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    assert out.agg(F.sum("taken"), F.sum(words)).first() == mix.agg(F.sum("taken"), F.sum("taken")).first()


def test_stages_decide_by_row(spark):
    near = PLAIN.replace("word30", "other")
    rows = [(1, PLAIN), (2, near), (2, "clean text of its own"), (None, near), (None, "clean as well"), (3, f"a {LEAK} b"), (3, "clean third"), (None, f"c {LEAK} d")]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda frame: sorted(r.text for r in frame.collect())
    assert texts(drop_near_copies(docs)) == sorted(t for _, t in rows if t != near)
    assert texts(drop_near_copies(docs.filter("doc_id is null or doc_id = 1"))) == sorted(t for i, t in rows if i in (1, None) and t != near)
    benchmark = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    assert texts(drop_contaminated(docs, benchmark)) == sorted(t for _, t in rows if LEAK not in t)
    out = mixed(docs)
    assert out.columns == [*docs.columns, "epoch", "taken"]
    words = sum(len(t.split()) for _, t in rows)
    got = out.collect()
    assert sum(r.taken for r in got) == int(1.5 * words) and all(len(r.text.split()) == r.taken for r in got)
    assert texts(out.filter("epoch = 0")) == sorted(t for _, t in rows)
