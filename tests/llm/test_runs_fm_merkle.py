"""Periodic runs, FM-index decontamination and Merkle manifest against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsight.llm import decontaminate, fm_index, merkle, runs

SEQUENCE = st.one_of(
    st.lists(st.integers(0, 2), max_size=40),
    st.tuples(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), min_size=1, max_size=5),
              st.integers(1, 9)).map(lambda x: x[0] + x[1] * x[2] + x[1][:1] + x[0]))


def brute_runs(words, least, times):
    """Every period, every stretch in which words that far apart are equal."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(runs.Run(s, n, q) for (s, n), q in found.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(SEQUENCE, max_size=5), st.sampled_from([(6, 4), (2, 2), (3, 3)]))
def test_runs_equal_brute_force(sequences, limits):
    assert runs.word_runs(sequences, *limits) == [brute_runs(x, *limits) for x in sequences]


def test_long_repetitions_are_not_quadratic():
    assert runs.word_runs([["x"] * 200_000, ["x", "y", "x"] * 50_000]) == [
        [runs.Run(0, 200_000, 1)], [runs.Run(0, 150_000, 3)]]


def test_suffix_array_order_and_common_words():
    a, b = [2, 1, 2, 1, 2], [1, 2, 1]
    array = runs.SuffixArray(np.array([*a, 0, *b, 0]))
    codes = [*a, 0, *b, 0]
    suffixes = sorted(((k > 5), codes[k:6] if k < 6 else codes[k:], k) for k in range(len(codes)))
    assert array.order.tolist() == [k for *_, k in suffixes]
    for row in range(1, len(codes)):
        (o, x, _), (p, y, _) = suffixes[row - 1:row + 1]
        same = 0
        while o == p and same < min(len(x), len(y)) and x[same] == y[same]:
            same += 1
        assert array.common[row] == same


def test_periodic_runs_on_odd_rows(odd, odd_rows, empty):
    for size in (100, 2_000_000):
        got = {}
        for r in runs.periodic_runs(odd, shard_bytes=size).collect():
            got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
        for doc_id, text in odd_rows:
            words = (text or "").encode().split()
            want = brute_runs(words, 6, 4) if len(words) < 5000 else [(0, 9000, 1)]
            keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in want)]
            assert (len(words), [tuple(x) for x in want], b" ".join(keep).decode()) in got[doc_id]
        assert sum(map(len, got.values())) == len(odd_rows)
    assert runs.run_report(empty).count() == 0
    null = runs.run_report(odd.where("doc_id = 101")).first()
    assert null.n_runs == 0 and null.start is null.period is null.exponent_milli is None
    assert null.runs_sha256 == null.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_strongest_run_and_planted_words():
    assert runs.strongest([]) is None
    ties = [runs.Run(9, 8, 2), runs.Run(3, 12, 3), runs.Run(3, 4, 1), runs.Run(0, 15, 4)]
    assert runs.strongest(ties) == runs.Run(3, 4, 1)
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    for doc_id in range(60):
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        want = words if h % 10 else [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert runs.planted(doc_id, words) == want
    assert runs.planted(None, words) == words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), max_size=8),
       st.integers(1, 9))
def test_fm_index_finds_every_occurrence(codes, patterns, sample):
    index = fm_index.FMIndex(np.array(codes, np.int64), 4, sample)
    matrix = np.array([[0] * (5 - len(p)) + p for p in patterns], np.int64).reshape(-1, 5)
    low, high = index.search(matrix, (matrix > 0).sum(1))
    for p, a, b in zip(patterns, low, high):
        want = [k for k in range(len(codes) - len(p) + 1) if codes[k:k + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=300))
def test_wavelet_matrix_rank_and_access(symbols):
    matrix = fm_index.WaveletMatrix(np.array(symbols, np.int64), 5)
    at = np.arange(len(symbols))
    assert matrix.access(at)[0].tolist() == symbols
    for s in set(symbols):
        assert matrix.rank(np.full(len(symbols) + 1, s), np.arange(len(symbols) + 1)).tolist() == [
            symbols[:k].count(s) for k in range(len(symbols) + 1)]


ITEMS = [("b", "Dogs while rain falls softly on quiet hills beyond our small VILLAGE where nobody"),
         ("a", "quick brown fox"), ("a", "nowhere to be seen in any of these texts at all, not one"), ("c", ""), ("d", None),
         (None, "same id"), ("e", "café ÉTÉ"), ("f", "word word word word word word word word word word word")]


def brute_hits(text, items, size=10):
    words, spots, names = decontaminate.words_of(text), set(), set()
    for name, item in items:
        w = decontaminate.words_of(item)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            for at in range(len(words)):
                if words[at:at + size][:len(w[k:k + size])] == w[k:k + size]:
                    spots.update(range(at, at + len(w[k:k + size])))
                    names.add(name or "")
    return len(words), len(spots), sorted(names)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300, "slice_words": 5}])
def test_contaminated_spans_on_odd_rows(spark, odd, odd_rows, empty, options):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate.contaminated_spans(odd, benchmark, **options).collect()
    got = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), r.items) for r in rows)
    assert got == sorted((str(i), *brute_hits(t, ITEMS)) for i, t in odd_rows)
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    report = decontaminate.decontamination_report(odd, benchmark, **options).where("doc_id = 102").first()
    assert tuple(report) == (102, 0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert decontaminate.decontamination_report(empty, benchmark, **options).count() == 0
    none = decontaminate.decontamination_report(odd, benchmark.where("false"), **options)
    assert none.where("contaminated").count() == 0 and none.count() == len(odd_rows)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 16 * 16
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
        i //= 16
    return out


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((digest(map(field, r)), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        groups[k].sort(key=lambda x: (x[1][0] is not None, x[1][0], x[0]))
    trees = {k: tree([d for d, _ in groups[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    for at, k in enumerate(keys):
        for i, (leaf, r) in enumerate(groups[k]):
            path, cur = siblings(trees[k], i) + siblings(top, at), leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                cur = digest(map(field, (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))))
            for a, b in path:
                cur = digest([a, cur, b])
            yield (r[0], leaf, trees[k][-1][0], top[-1][0], digest(a + b for a, b in path), cur, cur == top[-1][0])


def test_manifest_equals_brute_force(spark, odd_rows):
    rows = [(i, f"s{i % 7}" if i is not None and i % 11 else None, None if i == 3 else "en", len(t or ""), t) for i, t in odd_rows]
    rows += [(1000 + i, "big", "dé", i, f"Text {i}") for i in range(300)] + [(5, "", None, None, ""), (6, "lone", "x", 1, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    docs = docs.withColumns({c: F.lit("x") for c in ("key", "pos", "n", "digest", "item", "id", "zero", "path", "top")})
    got = sorted(map(str, map(tuple, merkle.verified_manifest(docs).collect())))
    assert got == sorted(map(str, brute_manifest(rows)))
    assert {r.verified for r in merkle.verified_manifest(docs).collect()} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", 1, "B") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.verified_manifest(docs).collect())) == sorted(brute_manifest(rows))


def test_manifest_of_text_ids(spark):
    rows = [(f"d{i}", "s", None, i, "T") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.verified_manifest(docs).collect())) == sorted(brute_manifest(rows))
