"""Near duplicates by an exact n-gram Jaccard join on prefix trees.

Texts with the same shingle set are one node.  Two nodes link when the
intersection of their sets holds at least ``NUM / DEN`` of the union (0.8).

1. Candidates.  All shingles have one global order: first those of three
   eighths of the hash range, rarest (by the number of rows that hold them) first,
   then the others.  By the prefix principle two linked sets share a shingle
   among the first n - ceil(0.8 n) + 1 of each.  Only shingles that several
   nodes hold matter, and most texts have enough shingles of their own to
   fill that prefix, so they drop out here.
2. Cells.  Nodes that share a prefix shingle, directly or through others, are
   a cell; links never leave a cell.
3. Tree join.  A set that shares fewer than 0.8 of its shingles with the
   others of its cell links with none of them and is left out, until no more
   fall away.  The others, each in one order of shingles, are stored in a
   compressed prefix tree.  A set traverses it level by level: the
   overlap with a stretch shared by many sets is counted once, and a subtree
   is left as soon as no length of the sets below could still reach the
   threshold with what remains of both sides.  As the result is components,
   traversals stop once everything is connected, and only sets outside the
   largest component traverse.
4. Cells whose sets hold more than ``block_shingles`` are dealt to blocks;
   each block also gets the cell's first set, so that most of a large group
   of near copies is connected at once.  What is not in the cell's largest
   component then traverses all blocks of the cell.  This is exact, and no
   task holds more than a block and a stream of traversing sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import shared_checkpoint, shuffle_partitions, small_batches
from tabsight.llm.components import components
from tabsight.llm.shingles import shingle_sets

# link when DEN * intersection >= NUM * union, that is
# (NUM + DEN) * intersection >= NUM * (size + size)
NUM, DEN = 4, 5
FIRST = np.uint64(3 << 61)  # hashes below (three eighths) come first in the global order


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def node_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


# ---------------------------------------------------------------- set passes
def _members(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "text_key", "n", "node"])
    return run


def _prefix_rows(k: int, max_seen: int):
    """(shingle, node, spare): the possible prefix of every set, once for each
    node that a task meets.  ``spare`` is the prefix length minus the number
    of first-class shingles (negative if there are more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in small_batches(batches, "text"):
            shingles, nodes, spares = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                if len(seen) >= max_seen:
                    seen.clear()
                seen.add(node)
                first = int(np.searchsorted(s, FIRST))
                spare = prefix_length(len(s)) - first
                take = s[:first + max(0, spare)]
                shingles.append(take)
                nodes.append(np.full(len(take), node, np.int64))
                spares.append(np.full(len(take), spare, np.int32))
            if shingles:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(nodes)),
                     pa.array(np.concatenate(spares))], names=["shingle", "node", "spare"])
    return run


def _block_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("cell", "blocks", "node", "comp", "role")]
                + [pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["cell", "blocks", "node", "comp", "role", "shingles"])
    return run


# ---------------------------------------------------------------- prefix tree
class PrefixTree:
    """Compressed prefix tree of sorted integer arrays (no two alike), in
    breadth-first arrays: stretch of tokens, depth at its end, children, set
    that ends there, and the range of set sizes below."""

    def __init__(self, sets: list[np.ndarray], n_tokens: int):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        shared = [0] * len(sets)  # tokens shared with the set before, in this order
        for at in range(1, len(order)):
            a, b = sets[order[at - 1]], sets[order[at]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[at] = int(differ[0]) if len(differ) else m
        shared_arr = np.array(shared)
        sizes = np.array([len(sets[i]) for i in order])
        seg, depth, ends, low, high, child, n_child, last = [], [], [], [], [], [], [], []
        queue = [(0, len(order), 0, -1)]
        at = 0
        while at < len(queue):
            lo, hi, d, before = queue[at]
            at += 1
            one = sets[order[lo]]
            stop = len(one) if hi - lo == 1 else int(shared_arr[lo + 1:hi].min())
            seg.append(one[d:stop])
            depth.append(stop)
            low.append(int(sizes[lo:hi].min()))
            high.append(int(sizes[lo:hi].max()))
            tail = int(one[stop - 1]) if stop > d else before
            last.append(tail)
            ended = len(one) == stop
            ends.append(order[lo] if ended else -1)
            child.append(len(queue))
            start = lo + 1 if ended else lo
            if start < hi:
                cuts = [start] + [j for j in range(start + 1, hi) if shared[j] == stop] + [hi]
                queue += [(a, b, stop, tail) for a, b in zip(cuts, cuts[1:])]
            n_child.append(len(queue) - child[-1])
        self.tokens = np.concatenate(seg) if seg else np.zeros(0, np.int64)
        self.seg_len = np.array([len(s) for s in seg])
        self.seg_at = np.cumsum(self.seg_len) - self.seg_len
        self.depth, self.ends, self.low, self.high = map(np.array, (depth, ends, low, high))
        self.child, self.n_child, self.last = np.array(child), np.array(n_child), np.array(last)
        self.inside = np.zeros(n_tokens + 1, bool)

    def linked(self, x: np.ndarray) -> np.ndarray:
        """Indices of the sets that link with ``x`` (sorted tokens)."""
        found, n, inside = [], len(x), self.inside
        inside[x] = True
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            size = self.seg_len[nodes]
            stop = np.cumsum(size)
            at = np.arange(stop[-1]) + np.repeat(self.seg_at[nodes] - (stop - size), size)
            hits = np.concatenate([[0], np.cumsum(inside[self.tokens[at]])])
            overlap = overlap + hits[stop] - hits[stop - size]
            depth = self.depth[nodes]
            whole = (self.ends[nodes] >= 0) & ((NUM + DEN) * overlap >= NUM * (n + depth))
            found.append(self.ends[nodes[whole]])
            # most that any size below can reach: what is left of x behind the
            # last token, and of the set behind this depth
            rest = n - np.searchsorted(x, self.last[nodes], side="right")
            best = np.clip(rest + depth, self.low[nodes], self.high[nodes])
            most = overlap + np.minimum(best - depth, rest)
            go = (self.n_child[nodes] > 0) & ((NUM + DEN) * most >= NUM * (n + best))
            nodes, overlap = nodes[go], overlap[go]
            kids = self.n_child[nodes]
            if not len(kids):
                break
            stop = np.cumsum(kids)
            overlap = np.repeat(overlap, kids)
            nodes = np.arange(stop[-1]) + np.repeat(self.child[nodes] - (stop - kids), kids)
        inside[x] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def in_order(sets: list[np.ndarray], more: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Sets as sorted token numbers, the token that most of ``sets`` hold
    first (ties by hash); ``more`` in the same numbers, without the tokens
    that no set has (their count still matters to the caller)."""
    tokens, count = np.unique(np.concatenate(sets), return_counts=True)
    number = np.empty(len(tokens), np.int64)
    number[np.lexsort((tokens, -count))] = np.arange(len(tokens))
    own = [np.sort(number[np.searchsorted(tokens, s)]) for s in sets]
    others = []
    for s in more:
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        known = tokens[at] == s
        # unknown tokens become one number past the end, so sizes stay right
        others.append(np.sort(np.where(known, number[at], len(tokens))))
    return own, others, len(tokens)


class Groups:
    """Union-find over indices that knows the largest group."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n
        self.largest = 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        if self.size[i] < self.size[j]:
            i, j = j, i
        self.up[j] = i
        self.size[i] += self.size[j]
        if self.size[i] > self.size[self.find(self.largest)]:
            self.largest = i
        return True


def dense(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """Indices of the sets that can link at all: those that share enough of
    their shingles with the other sets left, found by leaving out the others
    again and again.  With ``side`` (0 or 1 for each set) only shingles of
    the other side count."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    alive = np.ones(len(sets), bool)
    while True:
        at = alive[owner]
        if side is None:
            shared = np.bincount(codes[at], minlength=codes.max() + 1)[codes] > 1
        else:
            held = [np.bincount(codes[at & (side[owner] == k)], minlength=codes.max() + 1) for k in (0, 1)]
            shared = np.where(side[owner] == 0, held[1][codes], held[0][codes]) > 0
        left = alive & (DEN * np.bincount(owner[at & shared], minlength=len(sets)) >= NUM * sizes)
        if left.sum() == alive.sum() or not left.any():
            return np.flatnonzero(left)
        alive = left


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect exactly what all links among ``sets`` connect: every
    set outside the largest group traverses the tree."""
    if len(sets) < 2:
        return []
    kept = dense(sets)
    if len(kept) < 2:
        return []
    if len(kept) < len(sets):
        return [(int(kept[i]), int(kept[j])) for i, j in spanning_links([sets[k] for k in kept])]
    own, _, n_tokens = in_order(sets, [])
    tree, groups, out = PrefixTree(own, n_tokens), Groups(len(sets)), []
    waiting = list(range(len(sets)))
    while waiting:
        later, moved = [], False
        for i in waiting:
            if groups.find(i) == groups.find(groups.largest) and groups.size[groups.find(i)] > 1:
                later.append(i)
                continue
            moved = True
            out += [(i, int(j)) for j in tree.linked(own[i]) if groups.join(i, int(j))]
        if not moved:
            break
        waiting = later
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (cell, block), which are neighbours in the stream."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for rows in _grouped(batches):
        sets = {node: np.frombuffer(blob, np.uint64) for node, _, _, blob in rows}  # a node once
        nodes = sorted(sets)
        out += [(nodes[a], nodes[b]) for a, b in spanning_links([sets[x] for x in nodes])]
        if len(out) >= 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _join_strays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block come members (role 0) first, then the strays of the
    whole cell (role 1): only the members are held."""
    def search(members: dict, chunk: list) -> list[tuple[int, int]]:
        nodes = list(members)
        every = [members[x][1] for x in nodes] + [s for _, _, s in chunk]
        kept = dense(every, np.arange(len(every)) >= len(nodes))
        chunk = [chunk[i - len(nodes)] for i in kept if i >= len(nodes)]
        nodes = [nodes[i] for i in kept if i < len(nodes)]
        if not nodes or not chunk:
            return []
        own, probes, n_tokens = in_order([members[x][1] for x in nodes], [s for _, _, s in chunk])
        tree = PrefixTree(own, n_tokens)
        return [(node, nodes[j]) for (node, comp, _), x in zip(chunk, probes)
                for j in tree.linked(x).tolist() if members[nodes[j]][0] != comp]
    key, members, chunk, out = None, {}, [], []
    for batch in batches:
        for cell, block, node, comp, role, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if (cell, block) != key or len(chunk) >= 512:
                if chunk and members:
                    out += search(members, chunk)
                chunk = []
                if (cell, block) != key:
                    key, members = (cell, block), {}
            s = np.frombuffer(blob, np.uint64)
            if role:
                chunk.append((node, comp, s))
            else:
                members[node] = (comp, s)
            if len(out) >= 50_000:
                yield _edges(out)
                out = []
    if chunk and members:
        out += search(members, chunk)
    yield _edges(out)


# ------------------------------------------------------------------ operators
def candidate_cells(docs: DataFrame, k: int, partitions: int, max_seen: int) -> DataFrame:
    """(node, root): nodes that share a prefix shingle with another node, and
    the cell they fall into.  ``docs`` has a column text."""
    rows = docs.select("text").mapInArrow(_prefix_rows(k, max_seen), "shingle long, node long, spare int")
    first_class = F.col("shingle").between(0, int(FIRST) - 1)
    # rows of a shingle are counted before the shuffle and joined back, so one
    # that very many nodes hold is split by adaptive execution; a node that
    # several tasks meet counts once for each, which only moves its shingles
    # back in the global order
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = rows.join(counts, "shingle").select("shingle", "node", "spare", "rows")
    # of a node's first-class shingles only it has (number first - shared),
    # those come first; so many of the shared ones are in its prefix
    own = Window.partitionBy("node", "first_class")
    prefix = (shared.withColumn("first_class", first_class)
              .repartition(partitions, "node").dropDuplicates(["node", "shingle"])
              .withColumn("n_shared", F.count(F.lit(1)).over(own))
              .withColumn("rank", F.row_number().over(own.orderBy("rows", "shingle")))
              .where(~F.col("first_class") | (F.col("rank") <= F.col("spare") + F.col("n_shared")))
              .select("shingle", "node"))
    # each node with the first node of its shingle: minima are combined before
    # the shuffle and joined back, so a shingle of very many nodes can be split
    prefix = shared_checkpoint(prefix)
    heads = prefix.groupBy("shingle").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    edges = prefix.join(heads, "shingle").where("node <> head")
    return components(edges.select(F.col("node").alias("u"), F.col("head").alias("v")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    partitions: int | None = None, block_shingles: int = 2_000_000,
                    max_seen: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``df``.

    Null and empty texts and texts without words have an empty set, link with
    nothing and are their own component.  Texts with equal sets always link.
    Repeated ids are rows of their own; null ids pass through, and a component
    of null ids only has a null component_id.  Other columns are not read."""
    labelled = labelled_rows(df, id_col, text_col, k, partitions, block_shingles, max_seen)
    least = labelled.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def labelled_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                  partitions: int | None = None, block_shingles: int = 2_000_000,
                  max_seen: int = 500_000) -> DataFrame:
    """(doc_id, text_key, n_shingles, comp), one row for each row of ``df``:
    the xxhash64 of the text and a number of the component, null for an empty
    set.  Rows of one text_key have one component."""
    parts = partitions or shuffle_partitions(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    members = shared_checkpoint(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _members(k), f"doc_id {kind}, text_key long, n long, node long"))

    cells = shared_checkpoint(candidate_cells(docs, k, parts, max_seen).withColumnRenamed("root", "cell"))
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("n").alias("n"))
    placed = nodes.join(cells, "node")
    per_cell = placed.groupBy("cell").agg(F.min("node").alias("pivot"),
                                          F.ceil(F.sum("n") / block_shingles).cast("int").alias("n_blocks"))
    placed = shared_checkpoint(placed.join(per_cell, "cell"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").groupBy("text_key").agg(F.first("text").alias("text"))

    def sets_of(chosen: DataFrame) -> DataFrame:
        """``chosen`` (text_key, cell, blocks array, node, comp, role) with sets,
        one row for each of the blocks, neighbours in the order of the role."""
        made = texts.join(chosen, "text_key").select("cell", "blocks", "node", "comp", "role", "text").mapInArrow(
            _block_sets(k), "cell long, blocks array<int>, node long, comp long, role int, shingles binary")
        return (made.select("cell", F.explode("blocks").alias("block"), "node", "comp", "role", "shingles")
                .repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "role"))

    block = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    first_round = placed.select("text_key", "cell", F.when(F.col("node") == F.col("pivot"), every).otherwise(
        F.array(block)).alias("blocks"), "node", F.lit(0).cast("long").alias("comp"), F.lit(0).alias("role"))
    edges = shared_checkpoint(sets_of(first_round).mapInArrow(_join_blocks, "u long, v long"))
    found = shared_checkpoint(components(edges))

    large = placed.where("n_blocks > 1")
    if not large.isEmpty():
        known = large.join(found, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        main = (known.groupBy("cell", "comp").agg(F.count(F.lit(1)).alias("size"))
                .groupBy("cell").agg(F.max_by("comp", F.struct("size", "comp")).alias("main")))
        known = known.join(main, "cell")
        row = ["text_key", "cell", "blocks", "node", "comp", "role"]
        # a set's own block was joined in full in the first round
        strays = known.where("comp <> main").withColumns(
            {"blocks": F.array_remove(every, block), "role": F.lit(1)}).select(*row)
        open_cells = strays.select("cell").distinct()
        held = known.join(open_cells, "cell", "left_semi").withColumns({"blocks": F.array(block), "role": F.lit(0)}).select(*row)
        more = sets_of(held.unionByName(strays)).mapInArrow(_join_strays, "u long, v long")
        found = shared_checkpoint(components(edges.union(more)))

    return members.join(found, "node", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("comp"))
