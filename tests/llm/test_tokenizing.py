"""Token counts, distinct-word BPE and packing against the libraries."""

import random
import tracemalloc
import weakref
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsight.llm import bpe_words, packing, tokens, wordbpe

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
TOK = wordbpe.load(wordbpe.read_json(WORDS))
COUNT = tokens.TokenCounter(*tokens.read_model(PIECES))
IDS = wordbpe.WordEncoder(wordbpe.read_json(WORDS))
ALPHABET = list(" \n\t  ab\u2581e\u00e9\u4e2d\U00013000\x00\r.,'</t1 ") + [
    "<0x0A>", "</s>", "the ", "   ", "\u0301", "aaaa", "<|endoftext|>", "<|ENDOFTEXT|>", "H\u0331", "\u0130", "\xa0",
    "\x85", "\x1c", "'s", "'S", "\u00c9", "\u00df", "\u0308", "\u03a3"]
TEXT = st.lists(st.one_of(st.sampled_from(ALPHABET), st.characters(codec="utf-8")), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_count_equals_sentencepiece(text):
    assert COUNT(text) == len(SP.encode(text))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_library(text):
    want = TOK.encode(text, add_special_tokens=False).ids
    ids, end = IDS.texts(pa.array([text, None, "", f"{text} {text}"]))
    assert ids.tolist() == want * 3 and end.tolist() == [len(want) * k for k in (1, 1, 1, 3)]
    assert np.frombuffer(b"".join(IDS(wordbpe.words_of(text))), "<u4").tolist() == want


def test_known_table_stays_bounded():
    counter = tokens.TokenCounter(*tokens.read_model(PIECES), max_known=10)
    texts = [f"w{i} x{i}" for i in range(50)]
    assert [counter(t) for t in texts] == [len(SP.encode(t)) for t in texts]
    assert len(counter.known) <= 14


def test_known_table_is_bounded_by_characters_and_in_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 7)
    counter = tokens.TokenCounter(*tokens.read_model(PIECES), max_chars=40)
    for text in (" ".join(f"word{i}" for i in range(200)), "  ".join(f"w{i}" for i in range(200)), "x" * 500 + " y" * 30):
        assert counter(text) == len(SP.encode(text))
    assert counter.chars <= 40 + 500 + 7 * 7


def test_count_tokens_on_odd_rows(odd, odd_rows, empty):
    got = sorted(map(tuple, tokens.count_tokens(odd, PIECES).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 4096) for i, t in odd_rows), key=str)
    assert got == want
    assert tokens.count_tokens(empty, PIECES).count() == 0


def test_encode_decode_on_odd_rows(odd, odd_rows, empty):
    for options in ({}, {"buckets": 3, "block_bytes": 2000, "max_known": 5}):
        got = sorted(map(str, bpe_words.encode_decode(odd, WORDS, **options).collect()))
        rows = []
        for i, t in odd_rows:
            ids = TOK.encode(t or "", add_special_tokens=False).ids
            rows.append((i, ids, TOK.decode(ids, skip_special_tokens=False)))
        want = sorted(f"Row(doc_id={i}, ids={ids}, decoded={d!r})" for i, ids, d in rows)
        assert got == want
    assert bpe_words.encode_decode(empty, WORDS).count() == 0


def check_pieces(pieces, texts, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array(TOK.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded


def test_packing_on_odd_rows(odd, odd_rows, empty):
    unique = {i: t for i, t in odd_rows if i is not None and i != 7}
    df = odd.where("doc_id IS NOT NULL AND doc_id <> 7")
    for capacity, most in ((2048, 64 << 20), (64, 3 * 64 * 4)):
        pieces = packing.with_checksums(packing.pack_documents(df, WORDS, capacity, most)).collect()
        assert check_pieces(pieces, unique, capacity) == 0
    all_rows = packing.pack_documents(odd, WORDS).collect()
    assert sum(p["length"] for p in all_rows) == sum(
        len(TOK.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_level_packer_takes_the_least_sum_of_squares():
    rng = random.Random(3)
    packer = packing.LevelPacker(50, 1 << 40, 0)
    for doc in range(300):
        s = rng.randint(1, 49)
        before = list(packer.level)

        def squares(level):
            return sum(x * x for x in level[1:50])

        def after(h):
            level = list(before)
            if h:
                level[h] -= 1
            level[h + s] += 1
            return squares(level)
        options = {h: after(h) for h in range(50) if (h == 0 or before[h]) and h + s <= 50}
        packer.add(doc, bytes(4 * s))
        assert squares(packer.level) == min(options.values())
    packer.finish()
    assert sum(p[2] for p in packer.out) == sum(p[3] for p in {p[0]: p for p in packer.out}.values())


def test_ids_of_words_are_joined_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(1)
    size = rng.integers(0, 5, 1000)
    ids, first = rng.integers(0, 1 << 31, int(size.sum())).astype(np.uint32), np.cumsum(size) - size
    code = rng.integers(0, 1000, 2_000_000).astype(np.int32)
    tracemalloc.start()
    try:
        out, end = wordbpe.joined(code, ids, first, size)
        beside = tracemalloc.get_traced_memory()[1] - out.nbytes - end.nbytes
    finally:
        tracemalloc.stop()
    assert beside < 20 << 20  # 80 MB when all words were looked up at once
    assert end.tolist() == np.cumsum(size[code]).tolist()
    assert out[:end[4999]].tolist() == [i for c in code[:5000] for i in ids[first[c]:first[c] + size[c]].tolist()]
    for words in (1, 3, 7):
        monkeypatch.setattr(wordbpe, "WORDS", words)
        for n in (0, 1, 6, 7, 50):
            some, to = wordbpe.joined(code[:n], ids, first, size)
            assert to.tolist() == end[:n].tolist() and some.tolist() == out[:end[n - 1] if n else 0].tolist()


def test_packing_task_holds_one_stretch_and_hands_on_small_batches(monkeypatch):
    held, held_ids, most = [], [], []

    class Encoder(wordbpe.WordEncoder):
        def __init__(self):
            pass

        def distinct(self, words):
            assert words.to_pylist() == ["word"]
            return np.arange(300, dtype=np.uint32), np.array([0]), np.array([300])

    def joined(*args):
        most.append(sum(x() is not None for x in held))
        ids, end = whole(*args)
        held.append(weakref.ref(ids))
        held_ids.append(len(ids))
        return ids, end

    whole = wordbpe.joined
    monkeypatch.setattr(wordbpe, "joined", joined)
    monkeypatch.setattr(packing, "RUN_BYTES", 3000, raising=False)
    monkeypatch.setattr(packing, "encoder", lambda _: Encoder())
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batches = [pa.RecordBatch.from_pydict({"doc_id": range(9000 * k, 9000 * (k + 1)), "text": ["word"] * 9000}) for k in range(2)]
    made = list(packing._worker("", 2048, 64 << 20, 1, 12_000, pa.int64())(iter(batches)))
    assert len(most) == 24 and max(most) <= 1  # of 750 texts; the last ones may stay, not those of a whole stretch
    assert max(held_ids) == 750 * 300
    assert max(b.column("ids").nbytes for b in made) <= packing.OUT_BYTES + 4 * 513
    rows = [r for b in made for r in b.to_pylist()]
    assert max(b.num_rows for b in made) <= 512 < len(rows) / 10
    assert sum(r["length"] for r in rows) == 18_000 * 301
    assert sorted(r["doc_id"] for r in rows if r["start"] == 0) == list(range(18_000))


def test_ids_of_runs_are_those_of_the_texts():
    texts = ["", None, "one two", "two <|x|> three", "ünï ONE", "b" * 40, None, " "]
    for some in (texts, [None], []):
        for most in (1, 8, 1000):
            got = list(IDS.runs(pa.array(some, pa.string()), most))
            assert [k for a, b, _, _ in got for k in range(a, b)] == list(range(len(some)))
            made = [ids[x:y].tolist() for _, _, ids, end in got for x, y in zip([0, *end.tolist()], end.tolist())]
            assert made == [TOK.encode(t or "", add_special_tokens=False).ids for t in some]
