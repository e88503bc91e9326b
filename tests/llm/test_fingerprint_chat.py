"""Order-MinHash fingerprints and tool-call linking."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tabsight.llm import chat, fingerprint
from tests.llm.conftest import sentence


def edited(texts):
    """Texts in ascending order of the id -> their edited texts."""
    out = []
    for i, a in enumerate(texts):
        b = texts[(i + 1) % len(texts)]
        h = len(a) // 2
        out.append(a[:len(a) - h] + b[:h])
    return out


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_edited_texts_and_neighbours(spark, partitions):
    rows = [(i * 3, sentence(i, 3 + 11 * (i % 7))) for i in range(60)] + [(2, None), (5, ""), (8, "one"), (11, "\U00013000\u00e9" * 9)]
    rows.sort()
    texts = [t or "" for _, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).repartition(5)
    out = fingerprint.fingerprints(df, partitions=partitions)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for (i, _), a, e in zip(rows, texts, edited(texts)):
        assert got[i]["n_chars"] == len(a) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    again = {r["fingerprint"] for r in fingerprint.fingerprints(
        spark.createDataFrame([(1, rows[9][1]), (2, rows[9][1])], "doc_id long, text string"), partitions=2).collect()}
    assert again == {got[rows[9][0]]["fingerprint"]}
    assert got[2]["fingerprint"] == got[5]["fingerprint"] == ""
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprint_odd_rows(odd, odd_rows, empty, spark):
    got = fingerprint.fingerprints(odd, partitions=4).collect()
    assert len(got) == len(odd_rows)
    assert fingerprint.fingerprints(empty, partitions=4).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), partitions=4).first()
    assert one["near_next"] == 1.0
    assert one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()
    nulls = fingerprint.fingerprints(spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string"), partitions=4)
    assert nulls.count() == 2


def likeness(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    sig = lambda c: fingerprint.signature(fingerprint.numbered(fingerprint.kmers(F.col(c))))
    return df.select(sig("a").alias("x"), sig("b").alias("y")).select(fingerprint.likeness(F.col("x"), F.col("y"))).first()[0]


def test_likeness_follows_edits_order_and_repeats(spark):
    words = [f"w{i}" for i in range(600)]
    text = " ".join(words)
    assert likeness(spark, text, text) == 1.0
    small = " ".join(words[:300] + ["new"] + words[300:])
    large = " ".join(words[:300] + [f"v{i}" for i in range(300)])
    other = " ".join(f"v{i}" for i in range(600))
    assert likeness(spark, text, small) > 0.8 > likeness(spark, text, large) > 0.02
    assert likeness(spark, text, other) == 0.0
    moved = " ".join(words[300:] + words[:300])  # the same k-mers but for the seam, in another order
    assert 0.3 < likeness(spark, text, moved) < 0.7
    assert likeness(spark, "x y z " * 50, "x y z " * 100) < 0.9  # occurrence numbers count
    assert likeness(spark, "x" * 5000, "x" * 5000 + "y") > 0.5  # unspaced text


# ----------------------------------------------------------------------- chat
SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "additionalProperties": False,
                   "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["integer", "null"]},
                                  "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}},
                                  "mode": {"enum": ["x", "y"]}}}}


@pytest.mark.parametrize("arguments, errors", [
    ({"a": 1, "b": None}, []), ({"a": 1, "b": 2, "tags": ["abc"], "mode": "x"}, []),
    ({"a": -1, "b": 1}, ["$.a: below minimum"]), ({"a": True, "b": 1}, ["$.a: not integer"]),
    ({"b": 1}, ["$.a: missing"]), ({"a": 1, "b": 1, "c": 2}, ["$.c: unknown"]),
    ({"a": 1, "b": 1, "tags": ["abcd", 3]}, ["$.tags[0]: too long", "$.tags[1]: not string"]),
    ({"a": 1, "b": 1, "mode": "z"}, ["$.mode: not in enum"]), ([1], ["$: not object"])])
def test_schema_errors(arguments, errors):
    assert chat.schema_errors(arguments, SCHEMAS["add"]) == errors


def test_link_calls(spark):
    calls = spark.createDataFrame([
        ("c1", 1, 0, "add", '{"b": 2, "a": 1}', []), ("c2", 1, 1, "add", '{"a": 1.5, "b": 1}', ["c1"]),
        ("c3", 1, 2, "add", '{"a": 3, "b": null}', ["c2", "c1", "gone"]), ("c4", 1, 3, "sub", "{}", None),
        ("c5", 1, 4, "add", "not json", ["c6"]), ("c6", 1, 5, "add", None, ["c5"]), ("c7", None, None, None, None, ["c6"]),
        (None, 2, 0, "add", "{}", ["c1"]), ("c1", 1, 0, "add", '{"b": 2, "a": 1}', [])],
        "call_id string, conv_id long, turn long, name string, arguments string, depends_on array<string>").withColumn("level", F.lit(9))
    results = spark.createDataFrame([("c1", "\u00e9\n"), ("c1", "z"), ("c3", None), ("nobody", "r"), (None, "n")],
                                    "call_id string, content string")
    rows = chat.link_calls(calls, results, SCHEMAS).collect()
    assert len(rows) == 9 and sum(r["call_id"] == "c1" for r in rows) == 2
    by = {r["call_id"]: r for r in rows}
    assert {k: r["level"] for k, r in by.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": 0, "c5": None, "c6": None, "c7": None, None: None}
    assert {k for k, r in by.items() if r["linked"]} == {"c1", "c3"}
    assert by["c1"]["json"] == '{"arguments":{"a":1,"b":2},"depends_on":[],"id":"c1","name":"add","result":"z"}'
    assert by["c1"]["valid"] and by["c3"]["valid"] and not by["c2"]["valid"]
    assert by["c4"]["errors"] == ["$: unknown function"] and by["c5"]["errors"] == ["$: not JSON"]
    assert by["c6"]["errors"] == ["$: not object"] and json.loads(by["c3"]["json"])["depends_on"] == ["c1", "c2", "gone"]
    assert chat.link_calls(calls.where("false"), results, SCHEMAS).count() == 0


def test_conversation_calls(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", ""), (1, 4, "user", None), (2, 0, "system", "s"),
            (2, 1, "user", 'q"\n'), (2, 2, "assistant", None), (None, 0, "user", "lost"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls, results = chat.conversation_calls(df)
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_calls(calls, results, chat.REPLY).collect()}
    assert {k: (r["level"], r["linked"], r["valid"]) for k, r in got.items()} == {
        (1, 0): (0, True, True), (1, 2): (1, False, False), (1, 4): (2, False, False), (2, 1): (0, True, True), (None, 0): (None, False, True)}
    assert json.loads(got[(2, 1)]["json"]) == {"id": "2:1", "name": "reply", "arguments": {"prompt": 'q"\n'}, "depends_on": [], "result": None}


def test_every_turn_is_in_a_row(spark):
    rows = [(1, 0, "system", "be \u00e9\n"), (1, 1, "user", "hi"), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 3, "assistant", "twice"),
            (1, 6, "user", "q"), (1, 8, "assistant", "late"), (2, 0, "assistant", None), (2, 1, None, "t"), (None, 1, "assistant", "lost"),
            (3, 0, "user", "u"), (3, 1, "assistant", None), (3, 1, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    called = chat.link_calls(*chat.conversation_calls(df), chat.REPLY)
    other = chat.other_turns(df)
    assert other.columns == called.columns and other.schema.simpleString() == called.schema.simpleString()
    assert {r["linked"] for r in other.collect()} == {False}
    got = [(r["conv_id"], r["turn"], *json.loads(r["json"]).values()) for r in other.collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        (1, 0, "system", "be \u00e9\n"), (1, 2, "assistant", "b"), (1, 3, "assistant", "twice"), (1, 8, "assistant", "late"),
        (2, 0, "assistant", None), (2, 1, None, "t"), (None, 1, "assistant", "lost"), (3, 1, "assistant", None)]))
    said = [json.loads(r["json"]) for r in called.collect()]
    texts = [t for x in said for t in (x["arguments"]["prompt"], x["result"])] + [g[3] for g in got]
    assert {t for _, _, _, t in rows} <= set(texts)


def brute_levels(deps):
    """Levels by settling what can be settled, again and again."""
    level = {}
    while True:
        new = {c: 1 + max((level[d] for d in ds), default=-1) for c, ds in deps.items() if c not in level and all(d in level for d in ds)}
        if not new:
            return level
        level.update(new)


def found_levels(spark, deps):
    calls = spark.createDataFrame([(c,) for c in deps], "call_id string")
    edges = spark.createDataFrame([(c, d) for c, ds in deps.items() for d in ds], "call_id string, dep_id string")
    rows = chat.levels(edges, calls).collect()
    assert len({r["call_id"] for r in rows}) == len(rows)
    return {r["call_id"]: r["level"] for r in rows}


def test_levels_equal_settling_one_by_one(spark):
    rng = random.Random(7)
    graphs = [{}, {"a": []}, {"a": ["a"]}, {"a": ["b"], "b": ["c"], "c": ["b"], "d": ["a", "e"], "e": []}]
    for _ in range(4):
        names = [f"n{i}" for i in range(rng.randint(5, 60))]
        deps = {c: sorted(set(rng.choices(names[:i], k=rng.choice([1, 1, 1, 2, 3])))) if i and rng.random() < 0.9 else [] for i, c in enumerate(names)}
        for c in rng.sample(names, rng.choice([0, 2])):  # cycles
            deps[c] = sorted({*deps[c], rng.choice(names)})
        graphs.append(deps)
    for deps in graphs:
        assert found_levels(spark, deps) == brute_levels(deps)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    n, made = 10_000, []
    keep = chat.shared_checkpoint
    monkeypatch.setattr(chat, "shared_checkpoint", lambda df: made.append(df) or keep(df))
    calls = spark.range(n).select(F.format_string("c%d", "id").alias("call_id"))
    edges = spark.range(1, n).select(F.format_string("c%d", "id").alias("call_id"), F.format_string("c%d", F.col("id") - 1).alias("dep_id"))
    out = chat.levels(edges, calls)
    assert out.where(F.col("call_id") == F.concat(F.lit("c"), F.col("level").cast("string"))).count() == n
    assert len(made) < 25
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 40


def test_results_are_hash_joined(spark):
    calls = spark.createDataFrame([("a", 1, 0, "add", "{}", [])],
                                  "call_id string, conv_id long, turn long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("a", "r")], "call_id string, content string")
    plan = chat.link_calls(calls, results, SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def xx(*values):
    """Spark's xxhash64 of texts (str), longs (int) and ints ((int,)), signed."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else \
            v[0].to_bytes(4, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def plain_signature(text):
    """bin -> hash of its pair, from the definition: number the k-mers by
    occurrence, keep each bin's two smallest, put them in text order."""
    words = [xx(w) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    mers = [xx(*words[i:i + 3]) >> 24 for i in range(max(1, len(words) - 2))] if words else []
    seen, bins = Counter(), {}
    for at, m in enumerate(mers):
        h = xx(m, (seen[m],))
        seen[m] += 1
        bins.setdefault((h >> 58) & 63, []).append((h >> 24, at))
    out = {}
    for b, members in bins.items():
        pair = sorted(sorted(members)[:2], key=lambda x: x[1])
        out[b] = (xx(*[h for h, _ in pair]) & ((1 << 64) - 1)) >> 32
    return out


def test_signature_and_likeness_equal_plain_python(spark):
    texts = [sentence(i, 3 + 17 * i) for i in range(12)] + ["", " ", "a", "a b", "a b c", "a b c a b c a b c", "x" * 100, "word " * 300,
             "café 中文 \U00013000 \x85 é"]
    texts += [texts[5] + " and more", " ".join(reversed(texts[6].split()))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, partitions=2).collect()}
    plain = [plain_signature(t) for t in texts]
    changed = [plain_signature(t) for t in edited(texts)]

    def alike(a, b):
        return sum(a.get(k) == v for k, v in b.items()) / len(a.keys() | b.keys()) if a or b else 1.0

    def text(sig):  # bins 32 to 63 have a sign bit, so they come first in the order of the hashes
        return "".join(f"{(b << 32) | sig[b]:010x}" for b in sorted(sig, key=lambda b: b - 64 if b >= 32 else b))
    for i in range(len(texts)):
        assert got[i]["fingerprint"] == text(plain[i]) and got[i]["edited_fingerprint"] == text(changed[i]), texts[i]
        assert got[i]["near_edited"] == pytest.approx(alike(plain[i], changed[i]))
        assert got[i]["near_next"] == pytest.approx(alike(plain[i], plain[(i + 1) % len(texts)]))


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_ids_of_text_null_and_repeated(spark, partitions):
    rows = [(f"d{i * 7 % 50:02}", sentence(i, 4 + i % 9)) for i in range(50)] + [(None, sentence(i, 5)) for i in range(30)] + [
        ("same", sentence(i, 6)) for i in range(60, 100)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    got = fingerprint.fingerprints(df, partitions=partitions).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", xx(r[1])))
    want = Counter((i, hashlib.sha256(e.encode()).hexdigest()) for (i, _), e in zip(order, edited([t for _, t in order])))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
