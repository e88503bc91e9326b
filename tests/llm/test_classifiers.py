"""Quality, language and URL classifiers."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsight.llm import language, quality, url_filter
from tests.llm.conftest import sentence


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


# -------------------------------------------------------------------- quality
@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "\n".join(sentence(i + j, 12) + "." for j in range(1 + i % 4)), 1) for i in range(150)]
    rows += [(i, "\n".join(" ".join([f"BUY!! {i}"] * 9) for _ in range(1 + i % 3)), 0) for i in range(150, 220)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(3, None, 1), (3, 1, 1), (None, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_learns_and_marks_folds(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality.classify_quality(docs, labels).collect()}
    assert all(r["held_out"] == fold(i) for i, r in got.items())
    assert all(r["predicted"] == (1 if i < 150 else 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_never_sees_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.classify_quality(docs, labels).orderBy("doc_id").collect()
    assert a == quality.classify_quality(docs, flipped).orderBy("doc_id").collect()


def test_quality_odd_rows(odd, odd_rows, empty, labelled):
    labels = labelled[1]
    got = quality.classify_quality(odd, labels).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify_quality(empty, labels).count() == 0
    none = quality.classify_quality(odd, labels.where("false")).collect()
    assert {r["score"] for r in none} <= {0.0, 0.5}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(2, 2))
    field = quality.LineField(np.zeros((quality.N_RAW, quality.N_BINS - 1)), np.zeros(1), moves)
    odds = rng.normal(size=6).tolist()
    weight = {}
    for path in itertools.product((0, 1), repeat=6):
        weight[path] = np.exp(sum(u for u, y in zip(odds, path) if y) + sum(moves[a, b] for a, b in zip(path, path[1:])))
    total = sum(weight.values())
    want = [sum(w for p, w in weight.items() if p[t]) / total for t in range(6)]
    assert np.allclose(field.marginals(odds), want)


def test_line_features_in_blocks_equal_whole():
    rng = np.random.default_rng(1)
    lines = [sentence(i, 3 + i % 5) for i in range(30)]
    raw = quality.line_features(lines, Counter(lines))
    cuts = quality.cut_points(raw)
    field = quality.LineField(cuts, np.append(rng.normal(size=quality.NOTHING), 0.0), np.zeros((2, 2)))
    assert np.allclose(field.log_odds(lines), field.log_odds(lines, block=7))


# ------------------------------------------------------------------- language
@pytest.fixture(scope="module")
def spoken(spark):
    en = "the cat sat on the mat and then it went away with the others to find some food near the old house"
    de = "der hund und die katze gehen nicht mehr auf die strasse weil es heute sehr stark regnet im dorf"
    rows = []
    for i in range(120):
        words, lang = (en.split(), "en") if i % 2 else (de.split(), "de")
        rows.append((i, " ".join(words[(i * 5 + j * 3) % len(words)] for j in range(12 + i % 7)), lang))
    return spark.createDataFrame(rows + [(500, en, None), (None, de, "de")], "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spoken):
    got = {r["doc_id"]: r for r in language.identify_language(spoken).where("doc_id < 200").collect()}
    assert all(r["held_out"] == fold(i) for i, r in got.items())
    assert np.mean([r["lang_pred"] == ("en" if i % 2 else "de") for i, r in got.items() if r["held_out"]]) >= 0.95


def test_language_never_sees_held_out_labels(spoken):
    changed = spoken.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a = language.identify_language(spoken).orderBy("doc_id").collect()
    assert a == language.identify_language(changed).orderBy("doc_id").collect()


def test_language_odd_rows(odd, odd_rows, empty):
    got = language.identify_language(odd).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (100, 101, 102)} == {"und"} and by[103]["lang_pred"] == "en"
    assert language.identify_language(empty).count() == 0
    nobody = language.identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nobody} == {("und", 0.0)}


def test_language_stage_rejects_unlearned_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) if j % 6 else " " for j, c in enumerate(rng.integers(*span, 240)))
             for span in ((0x430, 0x450), (0x4e00, 0x9fff), (0x3b1, 0x3ca), (97, 123)) for _ in range(3)]
    foreign = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(texts)], docs.schema)
    stays = corpus_pipeline.language_stage(spark, docs.unionByName(foreign), "").select("doc_id", "lang").collect()
    assert all(r["doc_id"] >= 0 for r in stays)
    clean = dict(docs.where("length(text) >= 20").groupBy("lang").count().collect())
    kept = Counter(r["lang"] for r in spark.createDataFrame(stays).join(docs.where("length(text) >= 20"), "doc_id", "left_semi").collect())
    assert len(clean) == 4 and all(kept[lang] >= 0.99 * n for lang, n in clean.items())


def test_language_stage_with_one_language(spark, spoken):
    english = spoken.where("lang = 'en'")
    assert corpus_pipeline.language_stage(spark, english, "").count() == english.count()


def test_presence_in_steps_equals_whole(monkeypatch):
    text = "".join(chr(97 + (i * i) % 26) for i in range(500)) + "\u4e2d\U00013000"
    a, b = np.zeros(language.BUCKETS, bool), np.zeros(language.BUCKETS, bool)
    language.presence(text, a)
    monkeypatch.setattr(language, "STEP", 17)
    language.presence(text, b)
    assert np.array_equal(a, b) and a.any()


def test_scores_equal_the_explicit_kernel():
    rng = np.random.default_rng(2)
    sample = [("a" if i % 2 else "b", np.unique(rng.integers(0, 300, 80) + 150 * (i % 2))) for i in range(30)]
    model = language.fit_model(sample, landmarks=8)
    marks = [i for i in range(30)][:16]
    size = lambda x: len(x)
    k = np.array([[len(np.intersect1d(sample[i][1], sample[j][1])) / np.sqrt(size(sample[i][1]) * size(sample[j][1]))
                   for j in marks] for i in range(30)])
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-8 * values.max()
    phi = np.hstack([k @ vectors[:, good] / np.sqrt(values[good]), np.ones((30, 1))])
    y = np.array([[1.0 if c == lang else -1.0 for c in ("a", "b")] for lang, _ in sample])
    pen = 1e-3 * 30 * np.eye(phi.shape[1])
    pen[-1, -1] = 0
    want = phi @ np.linalg.solve(phi.T @ phi + pen, phi.T @ y)
    rows = np.array([[p in set(x.tolist()) for p in model.places.tolist()] for _, x in sample], np.float32)
    got = rows @ model.weights / np.sqrt([len(x) for _, x in sample])[:, None] + model.bias
    assert np.allclose(got, want, atol=1e-3)


# ----------------------------------------------------------------------- urls
RULES = [url_filter.Rule("block", "net/"), url_filter.Rule("allow", "example.net/en/"),
         url_filter.Rule("block", "example.com/de/"), url_filter.Rule("allow", "org/fr/")]
URLS = [None, "", "no scheme", "http://a.NET/x", "http://Example.net/en/1?q=/no#f", "https://w.example.net/en", "http://net/",
        "http://net", "http://fakenet/x", "http://x.example.com/de/2", "http://example.com/DE/2", "http://a.org/fr/", "a://b://c.net/",
        "http://\u00c4.net/p", "http://h.org?x=1&y=2#z", "http://h.org#a?b", "http://org/fr/x" + "y" * 3000, "http://h.org/\nq"]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]), rest[at:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    found = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(found, key=lambda r: len(r.pattern)) if found else None


def test_rules_and_trees(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [
        (100 + i, f"https://h{i}.example.{('net', 'com', 'org')[i % 3]}/{('en', 'de', 'fr')[i % 5 % 3]}/{i * 37}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES, trees=3).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, rule = brute_url(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.pattern), u
        assert r["verdict"] == (rule.verdict if rule else "block" if r["block_score"] >= 0.5 else "allow")
    assert len({r["block_score"] for r in got.values()}) > 1


def test_url_trees_learn_given_labels(spark):
    rows = [(f"http://s{i}.example.org/{'a' * (i % 9)}{i}" + ("?id=1&x=2&y=3&z=99999" if i % 2 else ""), i % 2) for i in range(200)]
    labelled = spark.createDataFrame(rows + [(None, 1), ("http://q.org/", None)], "url string, blocked int")
    pages = spark.createDataFrame([(1, "http://n.example.org/ok"), (2, "http://n.example.org/ok?id=5&x=1&y=2&z=88888")],
                                  "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], labelled).collect()}
    assert got == {1: "allow", 2: "block"}


def test_urls_without_two_kinds_of_label(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in url_filter.judge(pages, RULES).collect()} == {"allow"}
    only = spark.createDataFrame([("http://b.org/", 1)], "url string, blocked int")
    assert {r["verdict"] for r in url_filter.judge(pages, [], only).collect()} == {"block"}
    assert url_filter.judge(pages.where("false"), RULES).count() == 0


def test_url_copies_do_not_fill_the_sample(spark):
    rows = [("http://copy.example.org/x", 0)] * 20_000 + [(f"http://s{i}.example.org/{i}" + "?id=1&x=2&y=3" * (i % 2), i % 2)
                                                       for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    pages = spark.createDataFrame([(1, "http://s9.example.org/7"), (2, "http://s8.example.org/8?id=1&x=2&y=3")],
                                  "page_id long, url string")
    got = {r["page_id"]: r["block_score"] for r in url_filter.judge(pages, [], labelled, max_rows=40).collect()}
    assert got[1] < got[2]


def test_language_learns_all_of_80_languages(spark):
    rng = np.random.default_rng(5)
    words = {lang: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for lang in range(80)}
    rows = [(100 * lang + k, " ".join(rng.choice(words[lang], 12)), f"l{lang:02}") for lang in range(80) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_language(docs, max_rows=400, max_landmarks=160).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.9 and len({r["lang_pred"] for r in got}) == 80
    assert language.share(200, 4000, 4) == 200 and language.share(200, 4000, 9999) == 1


def test_quality_learns_from_late_lines(spark):
    good = [sentence(i, 12) + "." for i in range(90)]
    rows = [(i, "\n".join(good[:70] + good[i % 20:]), 1) for i in range(60)]
    rows += [(i, "\n".join(good[:70] + [f"BUY!! {i} " * 9] * 200), 0) for i in range(60, 120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify_quality(docs, labels).collect()}
    assert all(got[i] == (1 if i < 60 else 0) for i in got)


def test_sampled_runs_and_pieces():
    assert quality.sampled_runs(0, 64, 1) == [] and quality.sampled_runs(64, 64, 1) == [(0, 64)]
    runs = [quality.sampled_runs(1000, 64, seed) for seed in range(300)]
    assert all(sum(b - a for a, b in r) in (64, 56) and all(a % 16 == 0 for a, _ in r) for r in runs)
    assert max(b for r in runs for _, b in r) == 1000 and len({tuple(r) for r in runs}) > 200
    lines = [sentence(i, 3 + i % 5) for i in range(30)]
    raw = quality.line_features(lines, Counter(lines))
    field = quality.LineField(quality.cut_points(raw), np.zeros(1), np.zeros((2, 2)))
    whole = quality.Piece(raw, 1).places(field)
    for a, b in ((0, 10), (7, 19), (20, 30)):
        lo, hi = max(0, a - 1), min(30, b + 1)
        piece = quality.Piece(raw[lo:hi], 1, lo < a, hi > b)
        assert piece.size == b - a and np.array_equal(piece.places(field), whole[a:b])
