"""Distinct-word encoding with a ``tokenizers`` file whose pre-tokeniser never
joins characters across ASCII white space and drops that white space: the ids
of a text are then the ids of its ASCII-space-separated words, one after the
other (the tests compare this with the library on whole texts)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabsight.llm.common import byte_stretches

JOINED = 1000  # words of letters encoded as one text
TEXTS = 16  # such texts handed to the library at a time
WORDS = 1 << 17  # words of texts whose ids are looked up at a time


def load(tokenizer_json: str):
    """The library's tokenizer, with truncation and padding off, for one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def read_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, split at ASCII white space.  A-Z are lower-cased where
    that cannot change the ids: the normaliser lower-cases anyway, but special
    tokens are matched before it and composition (NFC) happens before it, so
    texts with ``<|`` or characters above U+00FF stay as they are."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    if b"<|" not in raw:
        try:
            text.encode("latin-1")
            raw = raw.lower()
        except UnicodeEncodeError:
            pass
    return raw.split()


#: Letters up to U+00FF, and such words with or without a full stop or comma:
#: the word is one pre-token, the mark another, and neither composition nor
#: special tokens touch them.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = f"^[{_LETTERS}]+[.,]?$"


def _parts(words: pa.Array) -> Iterator[pa.Array]:
    """The words in stretches that are handed to the library at a time."""
    for at in range(0, len(words), JOINED * TEXTS):
        yield words.slice(at, JOINED * TEXTS)


class WordEncoder:
    """Ids of distinct words.  Words of letters are encoded many in one text
    by the same merges, without normaliser and pattern, and cut at the pieces
    that end a word; all others go through the library's whole chain."""

    def __init__(self, tokenizer_json: str):
        self.tok, self.plain = load(tokenizer_json), None
        spec = json.loads(tokenizer_json)
        suffix = spec["model"].get("end_of_word_suffix")
        pieces = spec["model"]["vocab"]
        byte_pieces = [p for p in pieces if len(p) == 1]
        # every byte has a piece, also at the end of a word, so each word ends with a piece that says so
        if suffix and len(byte_pieces) == 256 and all(p + suffix in pieces for p in byte_pieces):
            level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
            self.plain = load(json.dumps({**spec, "normalizer": None, "pre_tokenizer": split, "post_processor": None,
                                          "added_tokens": []}))
            self.ends = np.zeros(max(pieces.values()) + 1, bool)
            self.ends[[i for p, i in pieces.items() if p.endswith(suffix)]] = True

    def _plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # few texts at a time: the library's results are much larger than their ids
        marked, flat = [np.zeros(0, bool)], [np.zeros(0, np.uint32)]
        for part in _parts(words):
            marked.append(pc.match_substring_regex(part, "[.,]$").to_numpy(zero_copy_only=False))
            apart = pc.utf8_lower(pc.replace_substring_regex(part, "([.,])$", r" \1")).to_pylist()
            texts = [" ".join(apart[at:at + JOINED]) for at in range(0, len(apart), JOINED)]
            flat += [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        marked, flat = np.concatenate(marked), np.concatenate(flat)
        ends = np.flatnonzero(self.ends[flat]) + 1
        return flat, np.diff(ends[np.cumsum(1 + marked) - 1], prepend=0)

    def _other_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part in _parts(words):
            ids = [e.ids for e in self.tok.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(size[-1].sum())))
        return np.concatenate(flat), np.concatenate(size)

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): a word's ids are ids[first:first + size]."""
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = pc.match_substring_regex(words, _PLAIN) if self.plain else pa.array(np.zeros(len(words), bool))
        parts, start = [], 0
        for mask, encode in ((plain, self._plain_ids), (pc.invert(plain), self._other_ids)):
            ids, n = encode(words.filter(mask))
            at = mask.to_numpy(zero_copy_only=False)
            size[at], first[at] = n, start + np.cumsum(n) - n
            parts.append(ids)
            start += len(ids)
        return np.concatenate(parts), first, size

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The words' ids as little-endian unsigned 32-bit bytes."""
        ids, first, size = self.distinct(pa.array(words, pa.binary()).cast(pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * (first + size)).tolist())]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end): the ids of all texts in a row, and where each text's
        end; null is empty.  Each distinct word is encoded once.  The memory
        is that of the texts' words, so hand over bounded stretches."""
        words, code, word_end = split_texts(texts)
        out, end = joined(code, *self.distinct(words))
        return out, np.append(0, end)[word_end]

    def runs(self, texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(a, b, ids, end) for ranges of texts of ``most`` bytes, or of one
        longer text: what ``texts`` gives for texts[a:b].  Each distinct word
        of all texts is encoded once; texts are split and ids looked up for
        one range at a time."""
        ranges = list(byte_stretches(texts, most))
        parts = [split_texts(texts.slice(a, b - a)) for a, b in ranges]
        ends = [end for _, _, end in parts]
        parts = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(code), words) for words, code, _ in parts],
                                 pa.dictionary(pa.int32(), pa.string())).unify_dictionaries().chunks
        known = self.distinct(parts[0].dictionary) if parts else None
        for (a, b), part, word_end in zip(ranges, parts, ends):
            ids, end = joined(part.indices.to_numpy(), *known)
            yield a, b, ids, np.append(0, end)[word_end]


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code, end): the words of all texts, as ``words_of``
    splits them, as numbers of distinct words in a row, and where each text's
    end; null is empty."""
    texts = pc.fill_null(texts, "")
    kept = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"[^\x00-\x{FF}]"))
    lists = pc.ascii_split_whitespace(pc.if_else(kept, texts, pc.ascii_lower(texts)))
    end = np.cumsum(pc.list_value_length(lists).to_numpy())
    words = lists.flatten().dictionary_encode()
    del lists
    code, distinct = words.indices.to_numpy(), words.dictionary
    empty = pc.index(distinct, "").as_py()  # beside leading and trailing white space
    if empty >= 0:
        full = code != empty
        end = np.append(0, np.cumsum(full))[end]
        code = code[full]
        code = code - (code > empty)
        distinct = pa.concat_arrays([distinct.slice(0, empty), distinct.slice(empty + 1)])
    return distinct, code, end


def joined(code: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the coded words in a row, where each word's end).  What is
    worked with beside these two is that of ``WORDS`` words."""
    end = np.empty(len(code), np.int64)
    at = 0
    for a in range(0, len(code), WORDS):
        end[a:a + WORDS] = np.cumsum(size[code[a:a + WORDS]]) + at
        at = int(end[min(a + WORDS, len(code)) - 1])
    out, at = np.empty(at, ids.dtype), 0
    for a in range(0, len(code), WORDS):
        part, to = code[a:a + WORDS], end[a:a + WORDS]
        n = size[part]
        out[at:to[-1]] = ids[np.arange(at, to[-1]) + np.repeat(first[part] - (to - n), n)]
        at = int(to[-1])
    return out, end


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(tokenizer_json: str) -> WordEncoder:
    """The encoder, kept by the worker process (its size is that of the file)."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]
