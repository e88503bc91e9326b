"""Token counts of whole texts under a SentencePiece BPE model.

The count of a text is its number of initial symbols minus the number of
merges; no identifiers are produced.  A text is cut where no merge can ever
cross (before a space that follows another character, and around newlines),
and the count of each distinct stretch is kept in a bounded per-task table,
so the heap runs once for a word that a task meets often.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import small_batches

SLICE = 50_000  # stretches of a text looked up at a time
SPACE = "▁"  # the visible space of SentencePiece


class PairMerger:
    """Counts the pieces of one stretch by repeated merging.

    ``ranks`` maps a mergeable piece to its rank (lower merges first) and
    ``plain`` holds the single characters that have a piece of their own; any
    other character costs one symbol for each of its UTF-8 bytes and never
    merges."""

    def __init__(self, ranks: dict[str, int], plain: frozenset[str]):
        self.ranks, self.plain = ranks, plain

    def count(self, s: str) -> int:
        """Symbols of ``s`` minus merges.  The heap holds (rank, left index,
        merged length); neighbours are linked by two index lists, and an entry
        is stale when its symbols have changed length since it was pushed."""
        ranks, plain = self.ranks, self.plain
        total = sum(1 if c in plain else len(c.encode("utf-8", "replace")) for c in s)
        n = len(s)
        if n < 2:
            return total
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        end = list(range(1, n + 1))  # symbol i is s[i:end[i]]; 0 once it is merged away
        heap = []
        for i in range(n - 1):
            rank = ranks.get(s[i:i + 2])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            if not end[i]:
                continue
            j = after[i]
            if j >= n or end[j] - i != size:
                continue
            merges += 1
            end[i], end[j] = end[j], 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(s[i:end[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[k] - i))
            h = before[i]
            if h >= 0:
                rank = ranks.get(s[h:end[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, h, end[i] - h))
        return total - merges


class TokenCounter:
    """Whole-text counts with a table of stretches already counted, bounded by
    their number and by their characters."""

    def __init__(self, ranks: dict[str, int], plain: frozenset[str], max_known: int = 300_000, max_chars: int = 16 << 20):
        self.merger, self.max_known, self.max_chars = PairMerger(ranks, plain), max_known, max_chars
        self.known: dict[str, int] = {}
        self.chars = 0

    def _stretch(self, key: str) -> int:
        # a key that begins with a newline is that newline and what follows it;
        # any other key follows a space
        if key[:1] == "\n":
            return self.merger.count("\n") + (self.merger.count(key[1:]) if len(key) > 1 else 0)
        return self.merger.count(SPACE + key)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        keys = text.replace("\n", " \n").split(" ")
        if "" in keys:
            return self._with_runs(keys)
        return sum(self._slice(keys[at:at + SLICE]) for at in range(0, len(keys), SLICE))

    def _slice(self, keys: list[str]) -> int:
        self._bound()
        known = self.known
        counts = list(map(known.get, keys))
        if None in counts:
            for at, key in enumerate(keys):
                if counts[at] is None:
                    n = known.get(key)
                    if n is None:
                        n = known[key] = self._stretch(key)
                        self.chars += len(key)
                    counts[at] = n
        return sum(counts)

    def _bound(self) -> None:
        if len(self.known) > self.max_known or self.chars > self.max_chars:
            self.known.clear()
            self.chars = 0

    def _with_runs(self, keys: list[str]) -> int:
        """Several spaces in a row stay with the word behind them: their merges
        compete with its own."""
        total, run = 0, 0
        for at, key in enumerate(keys):
            if at % SLICE == 0:
                self._bound()
            if key == "":
                run += 1
                continue
            if key[0] == "\n":
                if run:
                    total += self._known(SPACE * (run - 1))
                total += self._known(key)
            else:
                total += self._known(SPACE * run + key)
            run = 0
        if run:
            total += self._known(SPACE * (run - 1))
        return total

    def _known(self, key: str) -> int:
        n = self.known.get(key)
        if n is None:
            n = self.known[key] = self._stretch(key)
            self.chars += len(key)
        return n


def read_model(path: str) -> tuple[dict[str, int], frozenset[str]]:
    """(ranks, plain characters) of a SentencePiece BPE model with byte
    fallback, identity normalisation and a dummy prefix; any other kind is an
    error, because the cuts above would not hold for it."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    norm = model.normalizer_spec
    if (model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback
            or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
            or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("only BPE models with byte fallback, identity normalisation and dummy prefix are read")
    ranks, plain = {}, set()
    scored = [p for p in model.pieces if p.type == kinds.NORMAL]
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not read")
    order = {s: i for i, s in enumerate(sorted({p.score for p in scored}, reverse=True))}
    for p in scored:
        if "\n" in p.piece or SPACE in p.piece.lstrip(SPACE):
            raise ValueError(f"piece {p.piece!r} crosses a cut")
        if len(p.piece) == 1:
            plain.add(p.piece)
        else:
            ranks[p.piece] = order[p.score]
    return ranks, frozenset(plain)


def _worker(ranks, plain, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        counter = TokenCounter(ranks, plain)
        for batch in small_batches(batches, 1):
            texts = batch.column(1)
            n = [counter(t) if t else 0 for t in texts.to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return run


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, map-only.

    Null and empty texts have 0 bytes and 0 tokens; null and repeated ids pass
    through, one output row for each input row; other columns are not read.
    A task keeps one Arrow batch and at most ``max_known`` stretches; the heap
    grows with the longest stretch without space or newline.  The model file
    is read on the driver (its size is that of the vocabulary)."""
    ranks, plain = read_model(model_path)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _worker(ranks, plain, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
