"""N-gram Jaccard join with a prefix tree.

Every text is the set of its distinct word n-grams, held as 64-bit hashes.  The
hash value is the global order of n-grams.  Two sets are linked when
``100 * intersection >= percent * union``; the join gives the connected
components of those links, exactly.

How the work is spread
  1. Equal sets are one node from the start (a fingerprint groups them), so
     copies are never compared or multiplied.
  2. Cutting the ordered sets of one size class at ``k`` fixed points gives ``k``
     segments.  Linked sets differ in at most ``d`` members, so with
     ``k = d + m`` at least ``m`` segments agree member for member.  So a set may
     leave ``m - 1`` segments out, the last ones in an order that all sets share:
     first those without members (a set that has ``m`` of these or more uses
     them), then those that most sets agree on.  ``m`` is larger than the segments
     without members need by a quarter of ``d``.  Texts that only have some
     passages in common leave just these out and never meet.  Sets that agree on a
     segment left in meet in a block under their smallest fingerprint, the block's
     pivot.
  3. In a block the ordered sets go into a prefix tree.  Each set walks the tree
     and shares the overlap counted on a common path; a subtree is left when the
     members still to come cannot reach the needed overlap, when its sizes are
     out of range, or when all of it already is in the set's component.  Sets that
     can have no partner in the block stay out of the tree: of the members ordered
     rarest first, linked sets share one of the first few (the prefix filter).
  4. A block over the bounds is cut into chunks that each hold the pivot.  Only
     the sets which did not get connected to the pivot then meet the other
     chunks, so a large group of near copies costs one pass and no pair is lost.
     Before that a block goes whose sets all lie in the block of its own pivot's
     pivot: every pair of it meets there as well.  So a set's text goes to about
     one block, not to one for each set that it shares a segment with.
  5. Tree edges of the components (never all pairs) go into a distributed
     min-label contraction of alternating stars, checkpointed each round.

``jaccard_links`` gives every link between different sets, and ``link_counts`` the
number of each document's; there the tree leaves no subtree for being connected.

Only texts that have a candidate are shuffled, and once, when these are few enough
to be broadcast by id (checked); else texts and candidates are dealt by id first.  Each phase is written
to the checkpoint folder, and its shuffle files go then.

Rows with null or wordless text have no members, size 0, and link with nothing.
Repeated rows and ids: equal texts are one node; each input row gives one output
row.  A component's id is the smallest non-null document id in it.  Rows without
an id take part; a set that occurs only without an id is found by its fingerprint.
Texts are never cut: one text's set is held whole by the task that reads it, about
150 bytes a word.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kmerlake.llm.bytewords import SPACE, U64, Words, fingerprint, mix, pieces
from kmerlake.llm.tables import bounded, cut, near, per_piece, runs, small

_EMPTY = U64(0xA0761D6478BD642F)
#: A class has so many times fewer segments to spare than linked sets may differ in.
_SPARE = 4
#: A set's segments to spare, below the number of the class, in one int.
_SPARE_BITS = 24
#: Sets under one key are counted up to here.
_LONG = 1 << 16
_KEY = np.dtype([("key", "<i8"), ("node", "<i8"), ("spare", "<i4")])
_BIN_BITS = 12


def size_classes(percent: int, largest: int) -> list[tuple[int, int, int]]:
    """(lowest size, segments, needed agreements) of each class up to one that holds ``largest``."""
    ratio = (100 / percent) ** 1.8
    out, low = [], 1
    while not out or low <= largest:
        high = max(low + 1, math.ceil(low * ratio))
        d = (high - 1) * (100 - percent) // percent
        m = 1 + math.ceil(d / _SPARE)
        empties = (d + m) * math.exp(-low / (d + m))
        m += 0 if empties < 0.05 else math.ceil(empties + 3 * math.sqrt(empties))
        out.append((low, d + m, m))
        low = high
    return out


def segment_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the segments under which each set can meet a linked set."""
    return spared_keys(sets, percent)[:2]


def spared_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, spare) of the segments under which each set can meet a linked set.

    Of the keys of a row with the same ``spare`` (they are of one class) the last
    ``spare & (1 << 24) - 1`` may go, in any order that is the same for all sets:
    linked sets agree on one of the others.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    classes = size_classes(percent, int(sizes.max()))
    lows, segments, needed = (np.array(x, dtype=np.int64) for x in zip(*classes))
    least = (sizes * percent + 99) // 100
    top, bottom = (np.searchsorted(lows, x, side="right") - 1 for x in (sizes, least))
    rows, keys, spares = [], [], []
    for down in range(int((top - bottom)[sizes > 0].max()) + 1):
        use = np.flatnonzero((sizes > 0) & (top - down >= bottom))
        if not len(use):
            continue
        level = top[use] - down
        k, m = segments[level], needed[level]
        base = np.concatenate(([0], np.cumsum(k)))
        members = np.concatenate([sets[i] for i in use])
        owner = np.repeat(np.arange(len(use)), sizes[use])
        at = base[owner] + ((members >> U64(32)) * k[owner].astype(np.uint64) >> U64(32)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        content = np.full(base[-1], _EMPTY, dtype=np.uint64)
        content[at[heads]] = np.add.reduceat(mix(members ^ U64(0x8EBC6AF09C88C6E3)), heads)
        filled = np.zeros(base[-1], dtype=bool)
        filled[at[heads]] = True
        who = np.repeat(np.arange(len(use)), k)
        gaps = k - np.add.reduceat(filled.astype(np.int64), base[:-1])
        keep = filled | (gaps >= m)[who]
        number = np.arange(base[-1]) - base[who]
        salt = mix((level[who].astype(np.uint64) << U64(32)) + number.astype(np.uint64) + U64(1))
        spare = np.clip(m - 1 - gaps, 0, (1 << _SPARE_BITS) - 1) | level << _SPARE_BITS
        rows.append(use[who[keep]])
        keys.append(mix(content + salt)[keep])
        spares.append(spare[who[keep]].astype(np.int32))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(spares)


class PrefixTree:
    """A path-compressed prefix tree over sorted integer sets that joins while it grows.

    ``add(members)`` walks the tree for the sets linked with the new one, unites
    their components and then stores the set.  With ``every`` it also notes each
    link in ``links``, so that no subtree is left for being connected already.
    """

    # A node: label (the members on the edge to it), children by first member,
    # smallest and largest set size below, and one set below when all are in one
    # component (else -1).
    __slots__ = ("percent", "root", "parent", "links")

    def __init__(self, percent: int, every: bool = False):
        self.percent, self.parent = percent, []
        self.links: list[tuple[int, int]] | None = [] if every else None
        self.root = [np.zeros(0, np.uint64), {}, 1 << 60, 0, -1, -1]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, members: np.ndarray) -> int:
        new = len(self.parent)
        self.parent.append(new)
        self._link(new, members)
        self._store(new, members)
        return new

    def _link(self, new: int, members: np.ndarray) -> None:
        n, p = len(members), self.percent
        smallest, largest = -(-n * p // 100), n * 100 // p
        stack = [(c, 0, 0, 0) for c in self.root[1].values()]
        while stack:
            node, depth, seen, overlap = stack.pop()
            if node is None:  # all below was visited: note whether it is one component now
                seen[4] = self._one_component(seen)
                continue
            if node[3] < smallest or node[2] > largest:
                continue
            if self.links is None and node[4] >= 0 and self.find(node[4]) == self.find(new):
                continue
            need = -(-p * (n + max(node[2], smallest)) // (100 + p))
            if overlap + min(n - seen, node[3] - depth) < need:
                continue
            label = node[0]
            end = depth + len(label)
            to = int(np.searchsorted(members, label[-1], side="right"))
            part = members[seen:to]
            if len(part) and len(label):
                at = np.searchsorted(part, label)
                at[at == len(part)] = 0
                overlap += int(np.count_nonzero(part[at] == label))
            if node[5] >= 0 and 100 * overlap >= p * (n + end - overlap):
                a, b = self.find(new), self.find(node[5])
                self.parent[max(a, b)] = min(a, b)
                if self.links is not None:
                    self.links.append((new, node[5]))
            if overlap + min(n - to, node[3] - end) < need:
                continue
            if node[1]:
                stack.append((None, 0, node, 0))
                stack.extend((c, end, to, overlap) for c in node[1].values())

    def _one_component(self, node: list) -> int:
        below = [c[4] for c in node[1].values()] + ([node[5]] if node[5] >= 0 else [])
        return below[0] if all(x >= 0 for x in below) and len({self.find(x) for x in below}) == 1 else -1

    def _store(self, new: int, members: np.ndarray) -> None:
        node, n, depth = self.root, len(members), 0
        while True:
            node[2], node[3] = min(node[2], n), max(node[3], n)
            if node[4] >= 0 and self.find(node[4]) != self.find(new):
                node[4] = -1
            if depth == n:
                if node[5] < 0:
                    node[5] = new
                return
            child = node[1].get(members[depth])
            if child is None:
                node[1][members[depth]] = [members[depth:], {}, n, n, new, new]
                return
            label = child[0]
            size = min(len(label), n - depth)
            differ = np.flatnonzero(label[:size] != members[depth : depth + size])
            same = int(differ[0]) if len(differ) else size
            if same < len(label):
                upper = [label[:same], {label[same]: child}, child[2], child[3], child[4], -1]
                node[1][label[0]] = upper
                child[0] = label[same:]
                child = upper
            node, depth = child, depth + same


def partnerless(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether none of the other (non-empty, different) sets can be linked with each set.

    Members are ordered rarest first among these sets.  Linked sets of sizes n
    share ``percent * n / 100`` members or more, so one of the first
    ``n - ceil(percent * n / 100) + 1`` of either stands among the other's first.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    ordered = owner << 32 | rank[number]
    ordered.sort()
    place = np.arange(len(ordered)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    head = place < np.repeat(sizes - (sizes * percent + 99) // 100 + 1, sizes)
    first = ordered[head] & 0xFFFFFFFF
    shared = np.bincount(first, minlength=len(n))[first] > 1
    out = np.ones(len(sets), dtype=bool)
    out[owner[head][shared]] = False
    return out


def _sets(width: int, lower: bool = True):
    def of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return Words(batch.column("text"), SPACE, lower).shingle_sets(width)

    return of


def document_sets(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_shingles and node (fingerprint of the set; null for an empty one) of each row."""
    of = _sets(width)

    def rows(batch: pa.RecordBatch) -> dict:
        sets = of(batch)
        return {"doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets], "node": [fingerprint(s) if len(s) else None for s in sets]}

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_piece(rows, schema), "doc_id long, n_shingles long, node long")


def shared_keys(docs: DataFrame, width: int, percent: int, most: int = 1 << 22) -> DataFrame:
    """(key, node, spare, n): the segments that several sets agree on, and how many do (up to 65,536), for each of these sets.

    Keys travel packed, by bins of the key, and a bin is sorted alone; beyond
    ``most`` rows of a bin the keys of very many sets leave it at once.
    """
    of = _sets(width)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.concatenate(held)
            bins = (keys["key"].view(np.uint64) >> U64(64 - _BIN_BITS)).astype(np.uint16)
            order = np.argsort(bins, kind="stable")
            there, n = np.unique(bins, return_counts=True)
            at = np.append(0, np.cumsum(n)) * _KEY.itemsize
            texts = pa.BinaryArray.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(keys[order].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), texts], ["bin", "keys"])

        held, size = [], 0
        for batch in batches:
            known: set[int] = set()  # copies in one batch are combined before the shuffle
            for piece in pieces(batch):
                fresh, nodes = [], []
                for s in of(piece):
                    if len(s) and (f := fingerprint(s)) not in known:
                        known.add(f)
                        fresh.append(s)
                        nodes.append(f)
                if fresh:
                    row, key, spare = spared_keys(fresh, percent)
                    rows = np.empty(len(row), _KEY)
                    rows["key"], rows["node"], rows["spare"] = key.view(np.int64), np.array(nodes, np.int64)[row], spare
                    held.append(rows)
                    size += len(rows)
                    if size >= 1 << 20:
                        yield packed(held)
                        held, size = [], 0
        if size:
            yield packed(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 1 << 18):
                part = rows[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([*(pa.array(part[c]) for c in _KEY.names), pa.array(n[i : i + (1 << 18)])], [*_KEY.names, "n"])

        def by_key(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate(held)
            rows = rows[np.lexsort((rows["node"], rows["key"]))]
            rows = rows[np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1]))]
            heads = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
            size = np.diff(np.append(heads, len(rows)))
            return rows, np.repeat(np.minimum(size, _LONG), size).astype(np.int32)

        bin_, held, size, limit, long = None, [], 0, most, np.zeros(0, np.int64)
        for batch in chain(batches, [None]):
            for number, text in [(None, None)] if batch is None else zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != bin_ and held:
                    rows, n = by_key(held)
                    n = np.where(np.isin(rows["key"], long), np.int32(_LONG), n)
                    yield from told(rows[n > 1], n[n > 1])
                    held, size, limit, long = [], 0, most, long[:0]
                bin_ = number
                if number is None:
                    break
                held.append(np.frombuffer(text.as_buffer(), _KEY))
                size += len(held[-1])
                if size > limit:
                    rows, n = by_key(held)
                    n = np.where(np.isin(rows["key"], long), np.int32(_LONG), n)
                    yield from told(rows[n == _LONG], n[n == _LONG])
                    long = np.union1d(long, rows["key"][n == _LONG])
                    held = [rows[n < _LONG], rows[:0]]
                    size = len(held[0])
                    limit = max(most, 2 * size)

    keys = docs.select("text").mapInArrow(emit, "bin int, keys binary")
    dealt = keys.repartition("bin").sortWithinPartitions("bin")
    return dealt.mapInArrow(count, "key long, node long, spare int, n int")


def candidate_blocks(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, pivot): sets that agree on a segment, under the smallest of them.

    A set leaves its most frequent segments out, as many as it has to spare, so
    texts that only have some passages in common do not meet.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, pivot = None, 0
        for batch in batches:
            key, node = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            head = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
            at = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            own = np.where(at >= 0, node[np.maximum(at, 0)], pivot)
            last_key, pivot = key[-1], own[-1]
            met = node != own
            if met.any():
                pairs = np.unique(np.stack([node[met], own[met]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["node", "pivot"])

    place = F.row_number().over(W.partitionBy("node", "spare").orderBy(F.desc("n"), F.desc("key")))
    asked = cut(shared_keys(docs, width, percent)).withColumn("place", place).where(F.col("place") > F.col("spare").bitwiseAND((1 << _SPARE_BITS) - 1))
    dealt = asked.select("key", "node").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(meet, "node long, pivot long").distinct()


def needed_blocks(met: DataFrame) -> DataFrame:
    """``met`` (node, pivot) without the blocks that lie in another one.

    The block of P lies in that of Q, the smallest pivot P itself is under, when
    all its nodes are under Q too.  Q is smaller than P, so what remains holds
    every pair, however long the chain.
    """
    over = met.groupBy(F.col("node").alias("pivot")).agg(F.min("pivot").alias("upper"))
    asked = met.join(near(over), "pivot").select("node", "pivot", "upper")
    there = met.select("node", F.col("pivot").alias("upper"), F.lit(True).alias("there"))
    missing = asked.join(there, ["node", "upper"], "left").groupBy("pivot").agg(F.count_if(F.col("there").isNull()).alias("missing"))
    return met.join(near(missing.where("missing = 0").select("pivot")), "pivot", "left_anti").select("node", "pivot")


def _node_texts(docs: DataFrame, width: int) -> DataFrame:
    """(node, text) of each row with words."""
    of = _sets(width)

    def rows(batch: pa.RecordBatch) -> dict:
        return {"node": [fingerprint(s) if len(s) else None for s in of(batch)], "text": batch.column("text")}

    schema = pa.schema([("node", pa.int64()), ("text", pa.string())])
    return docs.select("text").mapInArrow(per_piece(rows, schema), "node long, text string").where("node is not null")


def block_edges(members: DataFrame, docs: DataFrame, width: int, percent: int, every: bool = False) -> DataFrame:
    """Join the sets of each block.

    ``members`` has pivot, chunk, part, node, and rep: the id of a document with
    that set, null if it occurs only without an id.  Gives pivot, node, head (a
    set of its component in the block, the same for all of it) and whether the
    pivot is in that component.  With ``every`` a row for each link instead: head
    is the linked set, and the last column null.
    """
    of = _sets(width)
    keys = ["pivot", "chunk", "part"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for key, rows, last in runs(batches, keys):
            for piece in pieces(rows):
                for node, s in zip(piece.column("node").to_pylist(), of(piece)):
                    if node not in held and len(s) and fingerprint(s) == node:
                        held[node] = s
            if last:
                tree = PrefixTree(percent, every)
                nodes = sorted(held, key=lambda x: (len(held[x]), x))
                alone = partnerless([held[x] for x in nodes], percent) if nodes else []
                apart = [x for x, single in zip(nodes, alone) if single]
                nodes = [x for x, single in zip(nodes, alone) if not single]
                for node in nodes:
                    tree.add(held[node])
                if every:
                    rows_ = [(nodes[i], nodes[j], None) for i, j in tree.links]
                else:
                    heads = {x: nodes[tree.find(i)] for i, x in enumerate(nodes)} | {x: x for x in apart}
                    rows_ = [(x, h, h == heads.get(key[0])) for x, h in heads.items()]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows_), pa.int64()), *(pa.array([r[i] for r in rows_], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], ["pivot", "node", "head", "to_pivot"])
                held = {}

    members = members.select(*keys, "node", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    dealt = F.broadcast(members) if small(members) else members
    known = texts.join(dealt, F.col("doc_id") == F.col("rep")).select(*keys, "node", "text")
    lost = members.where("rep is null")
    if not lost.isEmpty():
        unnamed = _node_texts(texts.where("doc_id is null"), width).groupBy("node").agg(F.min("text").alias("text"))
        known = known.union(lost.join(unnamed, "node").select(*keys, "node", "text"))
    return known.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "pivot long, node long, head long, to_pivot boolean")


def star_components(edges: DataFrame, near_rows: int = 1_000_000) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root the smallest node of its component.

    Alternates large-star and small-star contractions until the edges are stars.
    The minima are broadcast when there are ``near_rows`` edges at most (counted
    each round), so a hub's edges need not meet; else Spark splits a hub's join.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        dealt = F.broadcast if now[0] <= near_rows else (lambda x: x)
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(dealt(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        e = cut(large.join(dealt(low), "a").select(F.explode(small_star).alias("e")).select("e.*").where("a <> b").distinct())


def _blocks(docs: DataFrame, width: int, percent: int, block_sets: int, block_members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sets, the distinct sets, and the members of each block with the number of chunks it is cut into."""
    bounded(docs)
    sized = cut(document_sets(docs, width))
    nodes = cut(sized.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")))
    met = cut(needed_blocks(cut(candidate_blocks(docs, width, percent))))
    members = met.union(met.select("pivot", "pivot").distinct()).join(nodes, "node")
    load = members.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_members)).cast("int").alias("chunks"))
    return sized, nodes, cut(members.join(near(load), "pivot"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, block_sets: int = 1500, block_members: int = 1_500_000) -> DataFrame:
    """doc_id, n_shingles, component_id and component_sets (distinct sets in the component) of each row.

    ``block_sets`` and ``block_members`` bound what one task holds of a block;
    larger blocks are cut, none is dropped.
    """
    sized, nodes, members = _blocks(docs, width, percent, block_sets, block_members)
    spread = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "chunks").cast("int")))
    tasks = members.select("pivot", F.explode(spread).alias("chunk"), F.lit(0).alias("part"), "node", "rep")
    found = cut(block_edges(tasks, docs, width, percent))
    edges = found.select(F.col("node").alias("a"), F.col("head").alias("b"))

    apart = found.where("not to_pivot").join(members.where("chunks > 1"), ["pivot", "node"]).select("pivot", "node", "rep", "n", "chunks")
    if not apart.isEmpty():
        parts = near(apart.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_members)).cast("int").alias("parts")))
        across = members.join(parts, "pivot")
        own = across.select("pivot", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "rep")
        other = apart.join(parts, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("part"), "node", "rep")
        more = cut(block_edges(cut(own.union(other).distinct()), docs, width, percent))
        edges = edges.union(more.select(F.col("node").alias("a"), F.col("head").alias("b")))

    # Components are told from distinct sets, so a group of copies is one row here.
    rooted = nodes.join(star_components(edges), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    grouped = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("component_sets")))
    told = cut(rooted.join(grouped, "root").select("node", "component_id", "component_sets"))
    return sized.join(told, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_sets", F.lit(0)).alias("component_sets"))


def _linked_sets(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b), a < b: every link between different sets.

    Of a block every two chunks meet in a task of their own.
    """
    own = F.pmod(F.xxhash64("node"), "chunks").cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(own, x).alias("chunk"), F.greatest(own, x).alias("part")))
    tasks = members.select("pivot", F.explode(others).alias("t"), "node", "rep").select("pivot", "t.chunk", "t.part", "node", "rep")
    found = block_edges(tasks, docs, width, percent, every=True)
    return cut(found.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct())


def jaccard_links(docs: DataFrame, width: int = 3, percent: int = 90, block_sets: int = 1500, block_members: int = 1_500_000) -> DataFrame:
    """(a, b, doc_a, doc_b): every link between different sets, once, a < b.

    ``doc_a`` and ``doc_b`` are the smallest ids with these sets, null if there is
    none.  Equal texts are one set, so copies are not expanded.  The rows are as
    many as there are links, which in a group of near copies that all differ are
    its pairs; ``jaccard_components`` needs far fewer comparisons.
    """
    _, nodes, members = _blocks(docs, width, percent, block_sets, block_members)
    links = _linked_sets(docs, members, width, percent)
    name = lambda x: nodes.select(F.col("node").alias(x), F.col("rep").alias(f"doc_{x}"))
    return links.join(name("a"), "a").join(name("b"), "b").select("a", "b", "doc_a", "doc_b")


def link_counts(docs: DataFrame, width: int = 3, percent: int = 90, block_sets: int = 1500, block_members: int = 1_500_000) -> DataFrame:
    """doc_id, n_shingles and n_links (other rows linked with it, copies among them) of each row; 0 for an empty set."""
    sized, _, members = _blocks(docs, width, percent, block_sets, block_members)
    links = _linked_sets(docs, members, width, percent)
    copies = cut(sized.where("node is not null").groupBy("node").agg(F.count("*").alias("copies")))
    both = links.union(links.select("b", "a")).toDF("node", "other")
    linked = both.join(copies.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("linked"))
    told = copies.join(linked, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return sized.join(told, "node", "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the near copies: of each component the smallest doc_id stays.

    Columns are the input's.  Rows that share the kept id stay together, repeated
    rows too; rows without an id are never dropped.  The
    ids that go are broadcast when they are few (checked), so the texts stay put.
    """
    found = cut(jaccard_components(docs, width, percent))
    kept = found.where("doc_id = component_id").select("doc_id")
    gone = cut(found.where("doc_id is not null").select("doc_id").distinct().join(kept, "doc_id", "left_anti").select(F.col("doc_id").alias("gone_id")))
    gone = F.broadcast(gone) if small(gone) else gone
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
