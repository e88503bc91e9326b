"""Exact dedup, n-gram join and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsight.llm import components, exact_dedup, ngram_join, shingles
from tests.llm.conftest import sentence


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_exact_duplicates(odd, odd_rows, partitions):
    got = exact_dedup.exact_duplicates(odd, partitions=partitions).select(
        F.col("row.doc_id").alias("doc_id"), "row.text", "row.salt", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = brute_exact(odd_rows)
    assert len(got) == len(odd_rows)
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        ids = [i for i in groups[norm] if i is not None]
        assert r["keep_id"] == (min(ids) if ids else None) and r["group_size"] == len(groups[norm])
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest() and r["salt"] == 0
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_hot_text_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same  text")).otherwise(
        F.concat(F.lit("text "), (F.col("id") % 500).cast("string"))).alias("text"))
    out = exact_dedup.exact_duplicates(df, partitions=8).select("row.doc_id", "row.text", "keep_id", "group_size", "kept")
    rows = out.collect()
    groups = brute_exact([(r["doc_id"], r["text"]) for r in rows])
    for r in rows:
        own = groups[re.sub(r"\s+", " ", r["text"])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


# ------------------------------------------------------------------ shingles
def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_set(text, k=5):
    w = words(text)
    if len(w) >= k:
        return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, k=5):
    sets = [brute_set(t, k) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def near_copies(seed=5, families=12, size=9, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, i = [], 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, n))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w + [rng.choice(vocabulary) for _ in range(rng.randint(1, 4))]
            rows.append((i, (" ".join(w)).upper() if rng.random() < 0.2 else "\n ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_shingle_sets_equal_tuples(odd_rows, monkeypatch):
    texts = [t for _, t in odd_rows] + [t for _, t in near_copies()]
    want = [len(brute_set(t)) for t in texts]
    assert [len(s) for s in shingles.shingle_sets(texts)] == want
    whole = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "PIECE_WORDS", 11)
    monkeypatch.setattr(shingles, "BUFFER_BYTES", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(texts)))
    names = {}
    for t, s in zip(texts, whole):
        assert names.setdefault(brute_set(t), s.tobytes()) == s.tobytes()


@pytest.mark.parametrize("seed", range(6))
def test_prefix_tree_finds_exactly_the_links(seed):
    rng = np.random.default_rng(seed)
    base = [np.sort(rng.choice(200, rng.integers(1, 60), replace=False)) for _ in range(4)]
    sets = []
    for _ in range(60):
        s = set(base[rng.integers(4)].tolist())
        for _ in range(rng.integers(0, 5)):
            s ^= {int(rng.integers(200))}
        if s and s not in [set(x.tolist()) for x in sets]:
            sets.append(np.array(sorted(s)))
    tree = ngram_join.PrefixTree(sets, 200)
    for x in sets:
        want = {j for j, y in enumerate(sets) if 9 * len(set(x) & set(y)) >= 4 * (len(x) + len(y))}
        assert set(tree.linked(x).tolist()) == want


@pytest.mark.parametrize("options", [{}, {"block_shingles": 60, "max_seen": 2}])
def test_near_duplicates_equal_brute_force(spark, options):
    for seed in (5, 6):
        rows = near_copies(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, ngram_join.near_duplicates(df, partitions=4, **options).collect()))
        assert got == sorted(brute_components(rows))


def test_near_duplicates_on_odd_rows(odd, odd_rows, empty):
    got = sorted(map(tuple, ngram_join.near_duplicates(odd, partitions=4).collect()), key=str)
    assert got == sorted(brute_components(odd_rows), key=str)
    assert ngram_join.near_duplicates(empty, partitions=4).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    joined = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: label[x] for x in joined}


def test_near_stage_goes_by_row_not_by_id(spark):
    a, b, c = sentence(1, 60), sentence(2, 60), sentence(4, 60)
    rows = [(3, a, "x"), (5, a + " tail", "x"), (5, b, "x"), (7, c, "x"), (7, c + " tail", "x"), (8, b + " tail", "x"), (9, "", "x"), (9, "", "x"),
            (2, sentence(6, 60), "y"), (2, sentence(6, 60), "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_stage(spark, df, "").collect()]
    assert len(got) == len(set(got)) + 1  # the two empty texts
    assert {r for r in got if r[0] not in (2, 7)} == {(3, a, "x"), (5, b, "x"), (9, "", "x"), (None, a, "x")}
    assert [r[0] for r in got].count(7) == 1 and [r[0] for r in got].count(2) == 1
    again = corpus_pipeline.near_stage(spark, df.orderBy(F.desc("source"), "text"), "").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in corpus_pipeline.near_stage(spark, df, "").collect())
