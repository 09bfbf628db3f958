import itertools
import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepath.llm import decontam, langid, licenses, lmscore, mixing, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)


def test_mixing_targets_and_cuts(spark):
    rng = random.Random(3)
    sizes = {"a": 40, "b": 400, "c": 10, None: 90, "e": 0}
    rows, i = [], 0
    for s, total in sizes.items():
        while total:
            n = min(total, rng.randrange(1, 9))
            rows.append((i, "w " * n, "en", s))
            total, i = total - n, i + 1
    rows += [(i, None, "en", "e"), (i + 1, "", "en", "a")]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    # the rule, step by step: by weight, what is above twice a source shared again
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, cap = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2 * n for s, n in sizes.items()}
    budget, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap[s]}
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: float(cap[s]) for s in above}
        free -= above
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1
    # repeated rows, rows without an id, and a very long text
    odd = [(1, "w " * 3, "en", "a")] * 4 + [(None, "v " * 2, "en", "a"), (None, "u " * 5, "en", "b"), (2, "t " * 50_000, "en", None)]
    more = mixing.mix_sources(docs(spark, odd))
    assert more.count() == 7 and all(abs(r.t - r.target) < 1 for r in more.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect())
    own = docs(spark, odd).withColumn("epoch", F.lit("own")).withColumn("taken", F.lit("own"))
    named = mixing.mixed(own)
    assert named.columns == [*own.columns, "epoch_", "taken_"] and {(r.epoch, r.taken) for r in named.collect()} == {("own", "own")}
    again = mixing.mix_sources(docs(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    mixed = mixing.apply_mix(docs(spark, rows), mixing.mix_sources(docs(spark, rows)))
    assert mixed.agg(F.sum("taken")).first()[0] == sum(taken.values())
    assert mixed.filter(F.regexp_count("text", F.lit(r"\S+")) != F.col("taken")).count() == 0


PAGES = "page_id long, url string, html string, host string"


def test_warc_round_trip(spark, tmp_path):
    trick = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/"
    rows = [(1, "http://a/x?y", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c/\r\nInjected: 1", trick), (5, "http://d/", trick + "\r\n"), (6, "http://e/", "ü" * 1000), (6, "http://e/", "ü" * 1000), (None, "http://f", "z"), (7, "x", "")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], PAGES)
    path = f"file://{tmp_path}/warc"
    warc.write_warc(pages, path)
    records = warc.read_warc(spark, path).collect()
    assert len(records) == 3 * len(rows)
    bodies = sorted(r.payload.decode() for r in records if r.record_type == "response")
    assert bodies == sorted({"same", "", trick, trick + "\r\n", "ü" * 1000, "z"})
    got = warc.captures_digest(warc.read_warc(spark, path)).collect()
    assert len(got) == len(rows) and all(r.n_requests == r.n_metadata == 1 for r in got)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[2].record_type, by[1].payload_bytes) == ("revisit", 2, "response", 4)
    assert by[3].refers_to == 7 and by[7].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert sorted(r.record_type for r in got if r.page_id == 6) == ["response", "revisit"]
    nested = warc.assemble(warc.read_warc(spark, path), ["payload"]).filter("record_type = 'response' and record_id like 'urn:capture:5:%'").first()
    assert nested.request.http_head.startswith("GET / HTTP/1.1") and nested.metadata.fields.startswith("payloadBytes")


def test_warc_broken_records(spark, tmp_path):
    """A broken record costs itself alone: cut short, without a length, with a wrong or a huge one, at the end of a file, and beside a payload that quotes records."""
    import gzip

    def record(name, payload, length=None):
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nContent-Type: text/plain\r\n"
        return (head + ("" if length == "none" else f"Content-Length: {len(payload) if length is None else length}\r\n") + "\r\n" + payload + "\r\n\r\n").encode()

    quoted = record("inner", "xyz").decode()
    path = tmp_path / "warc"
    path.mkdir()
    first = [record("a", "one"), record("cut", "short", 500), record("b", "two"), record("odd", "x", "12x"), record("c", quoted + "tail"), record("none", "y", "none"), record("d", ""), record("negative", "z", -5), record("huge", "z", 1 << 40), record("e", "five")]
    (path / "1.warc.gz").write_bytes(gzip.compress(b"".join(first)))
    (path / "2.warc.gz").write_bytes(gzip.compress(record("f", "six") + record("last", "seven", 60)))
    (path / "3.warc.gz").write_bytes(gzip.compress(b"".join([record("g", "ok"), b"not a record at all\r\n\r\n", record("h", "fine")])))
    rows = warc.read_warc(spark, f"file://{path}", most_bytes=1 << 20).collect()
    good = {r.record_id: r.payload.decode() for r in rows if r.reason is None}
    assert {k: v for k, v in good.items() if k not in ("g",)} == {"a": "one", "b": "two", "c": quoted + "tail", "d": "", "e": "five", "f": "six", "h": "fine"} and good["g"].startswith("ok")
    assert sorted((r.record_id, r.reason) for r in rows if r.reason) == [("cut", "TRUNCATED"), ("huge", "TOO_LONG"), ("last", "TRUNCATED"), ("negative", "LENGTH"), ("none", "LENGTH"), ("odd", "LENGTH")]
    assert all(r.payload is None for r in rows if r.reason) and warc.assemble(warc.read_warc(spark, f"file://{path}"), []).count() == 8


def test_warc_of_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_links(spark):
    schema = "record_id string, record_type string, target_uri string, warc_date string, content_type string, concurrent_to array<string>, refers_to string, header_digest string, http_head string, payload binary, reason string"
    row = lambda i, k, to: (i, k, "u", "d", "c", to, None, None, i, bytearray(b"x"), None)
    rows = [row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["q1"]), row("r2", "response", []), row("q9", "request", ["gone"])]
    got = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, schema), []).collect()}
    assert (got["r1"].request.record_id, got["r1"].metadata.record_id) == ("q1", "m1")
    assert got["r2"].request is None and got["r2"].n_requests == 0 and len(got) == 2


def test_url_lists_as_of(spark):
    e = spark.createDataFrame([("ads", "bad.com", "add", 10), ("ads", "bad.com", "remove", 20), ("ads", "bad.com", "add", 20), ("ads", "bad.com", "remove", 30), ("ads", "ok.com/x", "add", 5), ("ads", None, "add", 5), ("ads", "ok.com/x", "add", 5)], "list_name string, pattern string, action string, at long")
    rows = [(1, "http://a.BAD.com:80/q", 10), (2, "http://bad.com", 29), (3, "http://bad.com", 30), (4, "http://bad.com", 9), (5, "https://ok.com/x/y?z", 6), (6, "https://ok.com/xy", 6), (7, None, 6), (8, "nonsense", 6), (9, "http://bad.com", None), (1, "http://a.BAD.com:80/q", 10)]
    got = urlfilter.filter_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, fetched_at long, host string"), e).collect()
    assert len(got) == len(rows) and {r.page_id for r in got if r.blocked} == {1, 2, 5}
    assert next(r for r in got if r.page_id == 5).pattern == "ok.com/x"
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_at long"), e).count() == 0


def test_licenses(spark):
    s = licenses.SENTENCES
    rows = [(1, f"intro.\n{s[10]} {s[11]}\n\n{s[12]}", "en", "s"), (2, "This work is  licensed under the GNU general public license, VERSION 3!", "en", "s"), (3, "no licence here", "en", "s"), (4, None, "en", "s"), (5, f"{s[40]} {s[41]} {s[42]}", "en", "s"), (6, f"{s[41]} {s[40]}", "en", "s"), (7, f"{s[1]} x. {s[2]}", "en", "s"), (7, f"{s[1]} x. {s[2]}", "en", "s")]
    got = sorted((r.doc_id, r.licenses) for r in licenses.scan_licenses(docs(spark, rows)).collect())
    more = [(20, f"{s[25]}", "MPL-2.0"), (21, f"{s[33]} {s[31]} {s[32]}", "GPL-2.0-or-later"), (22, f"{s[17]} {s[18]} {s[19]}", "Zlib"), (23, f"{s[14]} {s[16]}", "ISC"), (24, s[56], "CC0-1.0"), (25, s[37], "AGPL-3.0-or-later")]
    assert sorted((r.doc_id, r.licenses) for r in licenses.scan_licenses(docs(spark, [(i, t, "en", "s") for i, t, _ in more] + [(26, None, "en", "s"), (27, "", "en", "s"), (28, "x " * 60_000 + ". " + s[28], "en", "s")])).collect()) == [(i, k) for i, _, k in more] + [(28, "Unlicense")]
    assert licenses.scan_licenses(docs(spark, []).withColumn("steps", F.lit(1))).count() == 0
    assert got == [(1, "MIT"), (2, "GPL-3.0-only"), (5, "BSD-2-Clause"), (7, "Apache-2.0,MIT"), (7, "Apache-2.0,MIT")]


APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_wrapped_licenses(spark):
    s = licenses.SENTENCES
    wrap = lambda prefix, ids, width: "\n".join(f"{prefix}{x}" for i in ids for x in textwrap.wrap(s[i], width))
    commented = lambda prefix: "\n".join(f"{prefix} {x}".rstrip() for x in APACHE.split("\n"))
    rows = [(1, "MIT License\n\nCopyright (c) 2020 X\n\n" + wrap("", (10, 11, 12), 78), "", "s"), (2, "/*\n" + wrap(" * ", (30, 31, 32), 70) + "\n */\nint x;", "", "s"), (3, "#!/bin/sh\n" + wrap("# ", (40, 41, 42, 43), 60).replace("\n", "\r\n"), "", "s")]
    rows += [(4 + i, commented(c), "", "s") for i, c in enumerate(["", "#", "//", " *", ";;"])]
    rows += [(9, f"Title\n{s[1]}\nmore text", "", "s"), (10, "a line. Released under\nthe MIT License\nx", "", "s"), (11, "Released. Under the MIT License", "", "s"), (12, "Not released under\nthe MIT License", "", "s")]
    got = {r.doc_id: (r.rules, r.n_sentences, r.first_sentence, r.last_sentence) for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "mit-terms", 2: "gpl3-header", 3: "bsd-3", **dict.fromkeys(range(4, 9), "apache-header"), 9: "mit-notice", 10: "mit-notice"}
    assert got[9][1:] == got[10][1:] == (1, 1, 1) and got[4][1:] == (5, 1, 8)


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randrange(300))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(5)] + [(9, " ".join(text(8))), (10, None), (11, "two words")]
    swapped = items[1][1].split()
    for j in range(3, 40, 9):
        swapped[j] = "other"
    clean = [(100 + i, " ".join(text(120)), "en", "s") for i in range(20)]
    rows = clean + [(1, " ".join(text(60) + items[0][1].split() + text(60)), "en", "s"), (2, " ".join(text(9) + swapped), "en", "s"), (3, items[2][1].upper().replace(" ", ", "), "en", "s"), (4, " ".join(items[3][1].split()[10:25]), "en", "s"), (5, items[5][1], "en", "s"), (6, None, "en", "s"), (7, "", "en", "s"), (3, items[2][1].upper().replace(" ", ", "), "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 1), (3, 2), (3, 2), (4, 3), (5, 9)]
    assert next(r for r in got if r.doc_id == 1).doc_start == 60 and next(r for r in got if r.doc_id == 2).matched == 35
    assert decontam.drop_contaminated(docs(spark, rows), bench).count() == len(clean) + 2
    assert decontam.contaminated(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_overlap_against_all_windows(spark):
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 45))
        b = rng.integers(0, 2**40, n)
        a = np.where(rng.random(n) < rng.choice([0.2, 0.28, 0.5]), -1, b)
        same = a == b
        best = max((int(same[i:j].sum()) for i in range(n) for j in range(i + 1, n + 1) if 4 * same[i:j].sum() >= 3 * (j - i)), default=0)
        matched, start, size, shift = decontam.best_overlap(a, b, np.array([0]))
        assert matched == best and matched == same[start : start + size].sum() and 4 * matched >= 3 * size
    # an overlap that goes on below the share is found, also beside a diagonal with more equal words
    item = [f"w{i}" for i in range(43)]
    other = lambda *spans: [f"x{i}" if any(lo <= i < hi for lo, hi in spans) else w for i, w in enumerate(item)]
    rows = [(1, " ".join(other((12, 20), (29, 43))), "en", "s"), (2, " ".join(other((20, 31))), "en", "s"), (3, " ".join(other((6, 12), (18, 24), (30, 36)) + item[:12]), "en", "s")]
    got = decontam.contaminated(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.matched, r.overlap) for r in got) == [(1, 12, 12), (2, 20, 20), (3, 12, 12)]


def overlaps(least, most, words):
    """All ways that words of an overlap of least to most words may be equal if it counts, for an item of that many words; it begins and ends with an equal word."""
    need = min(decontam.LEAST_WORDS, decontam.LEAST_SHARE * words)
    for n in range(least, most + 1):
        for wrong in range(n + 1):
            if n - wrong < need or n - wrong < decontam.LEAST_SHARE * n:
                break
            for places in itertools.combinations(range(1, n - 1), wrong):
                yield n, sum(1 << i for i in range(n) if i not in places)


def test_every_overlap_that_counts_has_a_seed():
    def met(n, equal, masks):
        return any((equal >> i) & m == m for m, span in masks for i in range(n - span + 1))

    as_bits = lambda kind: [(sum(1 << i for i, c in enumerate(x) if c == "1"), len(x)) for x in decontam.MASKS[kind]]
    for words in range(1, 16):
        masks = as_bits(max(k for k in decontam.MASKS if k <= words))
        assert all(met(n, equal, masks) for n, equal in overlaps(1, words, words))
    assert all(met(n, equal, as_bits(16)) for n, equal in overlaps(12, 24, 40))


def test_short_items_against_brute_force(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"{rng.choice('abcdefg')}{rng.randrange(12)}" for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 16, 18, 24, 40, 40])]
    rows = [(100, None), (101, ""), (102, " ".join(f"{rng.choice('abcdefg')}{rng.randrange(12)}" for _ in range(30_000)))]
    for k in range(160):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 1 + len(words) // 3)):
            words[rng.randrange(len(words))] = rng.choice(["zz", "yy"])
        rows.append((k + 200, " ".join(["q"] * rng.randrange(5) + words + ["q"] * rng.randrange(5))))
    want = set()
    for d, text in rows:
        a = (text or "").split()
        for i, t in items:
            b = t.split()
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= shift + j < len(a) and a[shift + j] == b[j] for j in range(len(b))]
                if sum(same) < min(12, 0.75 * len(b)):
                    continue
                if any(sum(same[x:y]) >= min(12, 0.75 * len(b)) and 4 * sum(same[x:y]) >= 3 * (y - x) for x in range(len(b)) for y in range(x + 1, len(b) + 1)):
                    want.add((d, i))
                    break
    frame = docs(spark, [(d, t, "en", "s") for d, t in rows])
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 150
    assert decontam.contaminated(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


LANGS = {"xx": "ba be bo bu da".split(), "yy": "ki ke ku shi tsu".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, 80), lang, "s") for i, lang in enumerate(["xx", "yy"] * 60)]
    odd = [(1000, None, "xx", "s"), (1001, "123 456 %%%", "xx", "s"), (1002, "", "yy", "s"), (1003, prose(rng, "xx", 300) + " " + prose(rng, "yy", 30), None, "s"), (1004, prose(rng, "yy", 5000), "yy", "s")]
    df = docs(spark, rows + odd)
    got = {r.doc_id: r for r in langid.identify_language(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in range(1000, 1005)] == ["und", "und", "und", "xx", "yy"] and got[1000].score == 0
    assert 0.8 < got[1003].score < 0.97
    assert langid.keep_identified(df).count() == len(rows) + 2 and langid.keep_identified(df).columns == df.columns
    assert langid.identify_language(docs(spark, [])).count() == 0
    assert langid.identify_language(docs(spark, [(1, "abc", None, "s")])).first().lang_pred == "und"


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 3, 5):
        scores, trans = rng.normal(size=(n, 2)).astype(np.float32), rng.normal(size=(2, 2))
        # the first word is entered from a uniform start through the transitions
        total = np.zeros((n, 2))
        for y in itertools.product(range(2), repeat=n):
            w = sum(np.exp(trans[s, y[0]]) for s in range(2)) * np.exp(sum(scores[i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            for i in range(n):
                total[i, y[i]] += w
        assert np.allclose(langid.posteriors(scores, np.array([0, n]), trans), total / total.sum(axis=1, keepdims=True), atol=1e-4)
    # chunks change nothing
    scores, trans = rng.normal(size=(300, 3)).astype(np.float32), rng.normal(size=(3, 3))
    whole = langid.posteriors(scores, np.array([0, 300]), trans)
    old, langid.CHUNK = langid.CHUNK, 512
    try:
        assert np.allclose(langid.posteriors(scores, np.array([0, 300]), trans), whole, atol=1e-3)
    finally:
        langid.CHUNK = old


def test_transition_gradient():
    rng = np.random.default_rng(3)
    n, k = 5, 3
    scores, trans, y = rng.normal(size=(n, k)).astype(np.float32), rng.normal(size=(k, k)), rng.integers(0, k, n)

    def log_likelihood(t):
        weight = lambda y: np.log(sum(np.exp(t[s, y[0]]) for s in range(k))) + sum(scores[i, y[i]] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1))
        return weight(y) - np.log(sum(np.exp(weight(z)) for z in itertools.product(range(k), repeat=n)))

    grad = langid.transition_counts(y, np.array([0, n]), trans) - langid.forward_backward(scores, np.array([0, n]), trans, pairs=True)[1]
    for i, j in itertools.product(range(k), repeat=2):
        step = np.zeros((k, k))
        step[i, j] = 1e-5
        assert grad[i, j] == pytest.approx((log_likelihood(trans + step) - log_likelihood(trans - step)) / 2e-5, abs=1e-3)


def test_language_of_repeated_rows(spark):
    rng = random.Random(10)
    again = prose(rng, "yy", 40)
    # one row over and over, under one id or none, is still learned
    rows = [(i, prose(rng, "xx", 40), "xx", "s") for i in range(40)] + [(7, again, "yy", "s")] * 900 + [(None, again, "yy", "s")] * 900
    df = docs(spark, rows)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify_language(df, per_language=5).collect()}
    assert (7, "yy") in got and (None, "yy") in got and (8, "xx") in got
    with pytest.raises(ValueError, match="languages"):
        langid.training_spans(df.select("text", "lang", F.rand(1).alias("draw")), most_languages=1)


def test_network_against_plain_sums():
    rng, side = np.random.default_rng(8), 3
    net = lmscore.Network.fresh(side)
    for x in (net.context, net.bias, net.classes, net.words):
        x += rng.normal(size=x.shape).astype(np.float32)
    around = rng.integers(0, side**2 + 1, (7, 2 * lmscore.REACH))
    token = rng.integers(0, side**2, 7)
    softmax = lambda v: np.exp(v) / np.exp(v).sum()
    for i in range(7):
        h = np.append(np.tanh(net.bias + sum(net.context[j][around[i, j]].astype(float) for j in range(2 * lmscore.REACH))), 1.0)
        p = [softmax(h @ net.classes)[t // side] * softmax(h @ net.words[t // side])[t % side] for t in range(side**2)]
        assert sum(p) == pytest.approx(1) and net.log_probs(around[i : i + 1], token[i : i + 1])[0] == pytest.approx(np.log(p[token[i]]), abs=1e-4)


def test_language_model_on_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, "a b c", "en", "s"), (2, " ".join(rng.choice(words) for _ in range(40_000)), "en", "s"), (3, None, None, None)]
    clash = docs(spark, rows).select("*", F.lit("own").alias("word"), F.lit(1).alias("row_id"), F.lit(2).alias("n"))
    got = [tuple(r) for r in lmscore.score_documents(clash).collect()]
    assert len(got) == 5 and len({g[2] for g in got if g[1] == 3}) == 1 and sum(g[1] for g in got) == 40_009
    # one shard of rows, in one order: the same scores again
    one = docs(spark, rows).coalesce(1)
    assert sorted(map(str, lmscore.score_documents(one).collect())) == sorted(map(str, lmscore.score_documents(one).collect()))


def test_language_model(spark):
    rng = random.Random(2)
    cycle = [f"w{i}" for i in range(12)]
    good = [(i, " ".join(cycle[(i + j) % 12] for j in range(200)), "en", "s") for i in range(250)]
    mixed = [(1000 + i, " ".join(rng.choice(cycle) for _ in range(200)), "en", "s") for i in range(10)]
    df = docs(spark, good + mixed + [(5000, None, "en", "s"), (5001, "", "en", "s")])
    got = {r.doc_id: r for r in lmscore.score_documents(df).collect()}
    mean = lambda ids: sum(got[i].mean_log_prob for i in ids) / len(ids)
    assert mean(range(250)) > mean(range(1000, 1010)) + 0.3
    assert got[5000].n_tokens == 0 and got[5000].mean_log_prob is None and got[5001].log_likelihood == 0
    assert all(r.log_likelihood <= 0 for r in got.values())
    assert lmscore.score_documents(docs(spark, [])).count() == 0


def test_language_model_rare_words(spark):
    rng = random.Random(5)
    rare = [f"r{i}" for i in range(3000)]
    # words of one bucket differ by their counts, and one that training has not seen is as rare as one seen once
    train = [(i, " ".join(rng.choice(rare[:1000] if rng.random() < 0.9 else rare[1000:]) for _ in range(60)), "en", "s") for i in range(400)]
    counts = lmscore.count_words(docs(spark, train).select("text"))
    vocabulary = lmscore.build_vocabulary(counts)
    hashes = {w: int(lmscore.words_of(*lmscore.raw_column(pa.array([w])), 0, 1).hashes(lower=True)[0]) for w in [*rare, "unseen0"]}
    n = {w: sum(t.split().count(w) for _, t, _, _ in train) for w in rare}
    token = {w: int(vocabulary.tokens(np.array([h], dtype=np.uint64))[0]) for w, h in hashes.items()}
    buckets = {}
    for w in rare:
        if n[w] and token[w] >= vocabulary.own:
            buckets.setdefault(token[w], []).append(w)
    assert all(vocabulary.totals[k - vocabulary.own] == sum(n[w] for w in ws) for k, ws in buckets.items())
    words = next([min(ws, key=n.get), max(ws, key=n.get)] for ws in buckets.values() if len({n[w] for w in ws}) > 1)
    test = [(i, w, "en", "s") for i, w in enumerate(words)] + [(3, f"{words[1]} {words[1]}", "en", "s")]
    got = {r.doc_id: r for r in lmscore.score_documents(docs(spark, test), docs(spark, train)).collect()}
    assert got[1].log_likelihood - got[0].log_likelihood == pytest.approx(np.log(n[words[1]] / n[words[0]]), abs=1e-5)
    assert got[3].n_tokens == 2 and lmscore.side_for(10**5) < lmscore.side_for(10**7)


def test_language_model_trains_every_position():
    first = np.array([0, 1, 3, 3, 80])
    for rounds in (1, lmscore.ROUNDS, 5):
        assert sorted(np.concatenate([lmscore.trained(first, turn, rounds) for turn in range(rounds)]).tolist()) == list(range(80))
    rows, tokens = np.repeat(np.arange(4), np.diff(first)), np.arange(80)
    around = lmscore.contexts(tokens, rows, 999)
    for i in range(80):
        assert around[i].tolist() == [i + d if 0 <= i + d < 80 and rows[i + d] == rows[i] else 999 for d in (-3, -2, -1, 1, 2, 3)]
    # a step with words added up is the gradient step of each example
    rng, side, e = np.random.default_rng(1), 4, 1e-3
    net = lmscore.Network.fresh(side)
    around, token = rng.integers(0, 17, (30, 2 * lmscore.REACH)), rng.integers(0, 16, 30)
    flat = net.flat().astype(np.float64)
    loss = lambda v: lmscore.Network.unflat(v, side).log_probs(around, token).sum()
    net.log_probs(around, token, 1e-2)
    moved = (net.flat() - flat) / 1e-2
    for k in rng.integers(0, 6 * 17 * lmscore.HIDDEN, 40):
        up, down = flat.copy(), flat.copy()
        up[k] += e
        down[k] -= e
        assert moved[k] == pytest.approx((loss(up) - loss(down)) / (2 * e), abs=0.05)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage step by step in Python; of the language model only that the fixture's two languages are told from texts without letters."""
    import hashlib

    import corpus_pipeline
    from test_dedup import brute_near

    rng = random.Random(7)
    base = [prose(rng, lang, 90) for lang in ["xx", "yy"] * 12]
    item = prose(rng, "xx", 30)
    near = base[2].split()
    near[40] = "zzz"
    rows = [(i, t, ["xx", "yy"][i % 2], f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, base[0].replace(" ", "  "), "xx", "s0"), (101, " ".join(near), "xx", "s1"), (102, base[4] + " " + item, "xx", "s2"), (103, None, "xx", "s0"), (104, "12 34", "xx", "s0"), (105, base[6], "xx", None), (None, base[8], "xx", "s1"), (7, base[7], "yy", "s1")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda r: (r[0] is not None, r[0] or 0)
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = {}
    for r in left:
        groups.setdefault("".join(r[1].split()), []).append(r)
    left = [min(g, key=lambda r: (-len(r[1]), order(r))) for g in groups.values()]
    # among near copies the smallest id stays, no id comes last
    ranked = sorted(left, key=lambda r: (r[0] is None, r[0] or 0))
    left = [ranked[i] for i, _, k in brute_near([(i, r[1]) for i, r in enumerate(ranked)]) if i == k]
    left = [r for r in left if item not in r[1]]
    size = {}
    for r in left:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    target = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    want = []
    for s in size:
        own = sorted((r for r in left if r[3] == s), key=lambda r: (hashlib.md5(f"mix{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0))
        words, start = int(target[s]), 0
        while words > start:
            for r in own:
                n = len(r[1].split())
                if start < words:
                    want.append((r[0], start // size[s], min(n, words - start)))
                start += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.epoch, r.taken) for r in got), key=str) == sorted(want, key=str)
    assert {102, 103, 104, 0, 101, 105}.isdisjoint({w[0] for w in want}) and {100, 7, 2}.issubset({w[0] for w in want})
    empty = tmp_path / "empty"
    docs(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
