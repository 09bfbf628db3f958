import hashlib
import random
import re

import numpy as np
import pytest

from tidepath.llm import exact, neardup, substring
from tidepath.llm.graph import components

SCHEMA = "doc_id long, text string, recipe string, node long"  # the last two clash with names used inside
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [sentence(rng, rng.randrange(60, 300)) for _ in range(12)]
    shared = sentence(rng, 70)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "ONE TWO"), (6, "on e two")]
    for i, b in enumerate(base):
        words = b.split()
        for k in range(rng.randrange(1, 5)):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
            out.append((100 + 10 * i + k, " ".join(w)))
        if i % 3 == 0:
            out.append((500 + i, b.replace(" ", "\n  ")))
            out.append((600 + i, b + " " + shared + " " + sentence(rng, 5)))
    out.append((900, sentence(rng, 9000)))  # a very long text, and a part of it
    out.append((901, " ".join(out[-1][1].split()[3000:3200])))
    out += [out[-1], (100, out[7][1])]  # repeated rows
    rng.shuffle(out)
    return out


def test_exact(spark, rows):
    got = exact.exact_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    digest = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    kept = {}
    for r in got:
        v = digest[r.text_sha256]
        assert (r.keep_id, r.group_size) == (v[0][1], len(v))
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    assert exact.drop_exact_copies(table(spark, rows)).count() == len(groups)
    assert exact.drop_exact_copies(table(spark, rows)).columns == ["doc_id", "text", "recipe", "node"]


def test_exact_chunks_tell_near_texts_apart(spark):
    rng = random.Random(1)
    long = sentence(rng, 4000)
    got = exact.exact_dedup(table(spark, [(1, long), (2, long + "x"), (3, "x" + long), (4, long)])).collect()
    assert sorted(r.group_size for r in got) == [1, 1, 2, 2] and all(r.n_chunks > 5 for r in got)


def test_empty_tables(spark):
    none = table(spark, [])
    for df in (exact.exact_dedup(none), substring.substring_dedup(none), neardup.near_duplicates(none)):
        assert df.count() == 0


def brute_windows(rows, w):
    toks = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, t in toks:
        for j in range(len(t) - w + 1):
            k = tuple(t[j : j + w])
            first[k] = min(first.get(k, i), i)
    for i, t in toks:
        gone = set()
        for j in range(len(t) - w + 1):
            if first[tuple(t[j : j + w])] < i:
                gone |= set(range(j, j + w))
        yield i, len(t), len(gone), " ".join(x for k, x in enumerate(t) if k not in gone)


def test_substring(spark, rows):
    got = sorted(tuple(r) for r in substring.substring_dedup(table(spark, rows)).collect())
    assert got == sorted(brute_windows(rows, 50)) and sum(r[2] for r in got) > 500
    sha = {r.kept_sha256 for r in substring.substring_dedup(table(spark, rows), digest=True).collect()}
    assert sha == {hashlib.sha256(r[3].encode()).hexdigest() for r in got}


def test_substring_periodic_text_and_null_ids(spark):
    rows = [(1, "na " * 200), (2, "na " * 90), (None, "na " * 90), (3, "la " * 49)]
    got = sorted((tuple(r) for r in substring.substring_dedup(table(spark, rows)).collect()), key=str)
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 200, 0), (2, 90, 90), (None, 90, 0), (3, 49, 0)}


def test_substring_hot_passage(spark, rows):
    """Minimizers that are too much for a shard are taken apart, and nothing changes."""
    rng = random.Random(3)
    passage = sentence(rng, 56)
    hot = [(2000 + i, f"{sentence(rng, rng.randrange(0, 40))} {passage} {sentence(rng, rng.randrange(0, 40))}") for i in range(60)]
    hot += [(2100 + i, hot[i][1] + " end") for i in range(5)] + [(2200, "na " * 200), (2201, "na " * 120), hot[3]]
    frame = table(spark, rows + hot)
    got = sorted(tuple(r) for r in substring.substring_dedup(frame, shard_words=600).collect())
    assert got == sorted(brute_windows(rows + hot, 50))
    assert got == sorted(tuple(r) for r in substring.substring_dedup(frame).collect())


def test_fm_index_counts(spark):
    rng = np.random.default_rng(0)
    seq = np.append(rng.integers(1, 5, 300), 0)
    index = substring.FMIndex(seq, np.arange(301), 6)
    for _ in range(50):
        n = int(rng.integers(1, 6))
        pattern = rng.integers(1, 5, n)
        lo, hi, length = np.array([0]), np.array([301]), np.array([0])
        for c in pattern[::-1]:
            lo, hi, length = index.extend(np.array([c]), lo, hi, length)
            if length[0] == 0:
                break
        want = sum((seq[i : i + n] == pattern).all() for i in range(301 - n))
        assert (hi[0] - lo[0] if length[0] == n else 0) == want


def shingles(t, k=5):
    w = re.findall(WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_near(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)] if s else i) for a, (i, s) in enumerate(sets))


def test_near(spark, rows):
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    # the exact way, without sketches, and hubs in many small rounds
    again = neardup.near_duplicates(table(spark, rows), sketch_slack=None, more_hubs=1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_near_copies_without_ids(spark):
    rng = random.Random(5)
    w = sentence(rng, 100).split()
    near = [" ".join([*w[:i], "odd", *w[i + 1 :]]) for i in (10, 50, 90)]
    other = sentence(rng, 60)
    stay = sorted(r.text for r in neardup.drop_near_copies(table(spark, [(None, t) for t in near] + [(None, other), (5, other + " x"), (5, other + " y")])).collect())
    # of three near copies without an id one stays; of those with one the smallest, and of two rows of one id one
    assert len(stay) == 2 and len(set(stay) & set(near)) == 1 and any(t.startswith(other) and t != other for t in stay)


def test_near_chain_through_the_middle(spark):
    rng = random.Random(8)
    w = sentence(rng, 200).split()
    docs = [(i, " ".join(w[6 * i : 6 * i + 120])) for i in range(12)]  # neighbours overlap, ends do not
    got = neardup.near_duplicates(table(spark, docs)).collect()
    assert {r.component_id for r in got} == {0} and brute_near(docs)[-1][2] == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
