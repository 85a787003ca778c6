"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike: A-Z in lower case, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with single spaces between them.  An
item's windows are its runs of ``width`` words (a shorter item is one window).
All windows go into one automaton, which reads each text once; a hit is a place
where the words of a window stand one after another, and its words are mapped
back to character positions of the original text.

The benchmark is small next to the corpus, but its size is checked, not assumed:
beyond ``block_chars`` characters its items are dealt into blocks, each with an
automaton of its own (about 0.5 GB for a million characters).  One block at a time
is on the driver and in a worker's memory, which keeps its automaton between
tasks; the documents are read once a block, what a block finds is written to the
checkpoint folder, and the findings, not the texts, are joined at the end.

Null and wordless texts have no words and no hits.  Items without words are
ignored, repeated items count once; items without an id have no place in a list
of ids, so ``scan_benchmark`` leaves them out, while ``drop_contaminated`` counts
them.  Each input row gives one output row, so repeated rows and ids stay apart.
Texts are read whole, a long one as a batch by itself; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerlake.llm.bytewords import LOWER, NONALNUM, Words, pieces
from kmerlake.llm.tables import bounded, cut, small

_PLAIN = bytes(0x20 if NONALNUM[LOWER[b]] else int(LOWER[b]) for b in range(256))
_SPAN = "array<struct<start:bigint,end:bigint>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_PLAIN).split()


def windows(items: list[tuple[int | None, str]], width: int) -> dict[str, tuple[int, list[int | None]]]:
    """Window text (a space on either side, bytes as Latin-1) to its words and items."""
    out: dict[str, tuple[int, list[int | None]]] = {}
    for item, text in items:
        words = normal_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            part = words[i : i + width]
            _, of = out.setdefault((b" " + b" ".join(part) + b" ").decode("latin-1"), (len(part), []))
            if item not in of:
                of.append(item)
    return out


def dealt_items(benchmark: DataFrame, block_chars: int, unnamed: bool = False) -> tuple[DataFrame, int]:
    """The items with words as item_id, text and block, and the number of blocks of about ``block_chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").where(F.lit(unnamed) | F.col("item_id").isNotNull()).distinct()
    n = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) + 1
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def one_block(items: DataFrame, block: int):
    """The items of one block, broadcast."""
    rows = [tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").collect()]
    return items.sparkSession.sparkContext.broadcast(rows)


_HELD: dict[tuple[str, int], "Scanner"] = {}


def held_scanner(token: str, items, width: int) -> "Scanner":
    """The scanner of a block, built once in a worker process; another block's makes room for it."""
    if (token, width) not in _HELD:
        _HELD.clear()
        _HELD[token, width] = Scanner(items.value, width)
    return _HELD[token, width]


class Scanner:
    """Finds the windows of one block of items in batches of texts."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.automaton = ahocorasick.Automaton()
        for window, (n, of) in windows(items, width).items():
            self.automaton.add_word(window, (n, of))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, texts: pa.Array) -> tuple[list[int], dict[int, tuple[np.ndarray, set[int]]]]:
        """Words of each text, and for texts with hits the numbers of the words hit and the items found."""
        counts, lines = [], []
        for text in texts.to_pylist():
            words = normal_words(text)
            counts.append(len(words))
            lines.append(b" " + b" ".join(words) + b" ")
        found: dict[int, list] = {}
        if not self.empty:
            joined = b"\n".join(lines)
            heads = np.cumsum([0, *(len(x) + 1 for x in lines)])
            hits = list(self.automaton.iter(joined.decode("latin-1")))
            rows = np.searchsorted(heads, [end for end, _ in hits], side="right") - 1
            for row, (end, (n, of)) in zip(rows.tolist(), hits):
                found.setdefault(row, []).append((end - heads[row], n, of))
        out = {}
        for row, hits in found.items():
            gaps = np.flatnonzero(np.frombuffer(lines[row], np.uint8) == 0x20)
            stops = np.searchsorted(gaps, [end for end, _, _ in hits])
            mark = np.zeros(counts[row] + 1, dtype=np.int64)
            np.add.at(mark, stops - [n for _, n, _ in hits], 1)
            np.add.at(mark, stops, -1)
            out[row] = np.flatnonzero(np.cumsum(mark)[:-1] > 0), {i for _, _, of in hits for i in of}
        return counts, out


_FOUND = "n_words long, hit array<long>, items array<long>"


def _scanned(docs: DataFrame, items: DataFrame, block: int, width: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row, n_words, and the words hit and the items of one block found."""
    held, token = one_block(items, block), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, big = held_scanner(token, held, width), pa.list_(pa.int64())
        for batch in batches:
            for piece in pieces(batch):
                counts, found = scanner.scan(piece.column("text"))
                hit, of = [[]] * piece.num_rows, [[]] * piece.num_rows
                for row, (words, ids) in found.items():
                    hit[row], of[row] = words.tolist(), sorted(ids, key=lambda i: (i is None, i))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(hit, big), pa.array(of, big)], [*keep, "n_words", "hit", "items"])

    fields = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes)
    return docs.mapInArrow(scan, f"{fields}, {_FOUND}")


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words hit as runs of character positions of the original text."""
    for batch in batches:
        hits = batch.column("hit").to_pylist()
        spans: list[list[dict]] = [[] for _ in hits]
        rows = [i for i, h in enumerate(hits) if h]
        if rows:
            words = Words(batch.column("text").take(pa.array(rows)), NONALNUM, lower=True)
            chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            for k, i in enumerate(rows):
                h = np.array(hits[i])
                split = np.flatnonzero(np.diff(h) > 1)
                a, b = h[np.concatenate(([0], split + 1))], h[np.concatenate((split, [len(h) - 1]))]
                base = chars[words.at[k]]
                starts, ends = chars[words.starts[words.first[k] + a]] - base, chars[words.ends[words.first[k] + b]] - base
                spans[i] = [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array([len(h) for h in hits], pa.int64()), batch.column("items"), pa.array(spans, kind)], ["doc_id", "n_words", "n_hit", "items", "spans"])


def _findings(docs: DataFrame, items: DataFrame, blocks: int, width: int) -> DataFrame:
    """(key, hit, items) of the texts with hits in any block, by the texts' digest."""
    keyed = docs.where("text is not null").select(F.sha2("text", 256).alias("key"), "text")
    parts = None
    for block in range(blocks):
        part = cut(_scanned(keyed, items, block, width, ["key"]).where(F.size("hit") > 0).dropDuplicates(["key"]))
        parts = part if parts is None else parts.union(part)
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return cut(parts.groupBy("key").agg(together("hit").alias("hit"), together("items").alias("items")))


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with occurring windows, ascending) and
    spans (runs of hit words as character positions of the original text, end exclusive)."""
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, blocks = dealt_items(benchmark, block_chars)
    if blocks == 1:
        found = _scanned(texts, items, 0, width, ["doc_id", "text"])
    else:
        findings = _findings(texts, items, blocks, width)
        near = F.broadcast(findings) if small(findings, 10_000) else findings
        none = F.array().cast("array<long>")
        nothing = benchmark.sparkSession.createDataFrame([], "item_id long, text string, block int")
        joined = texts.withColumn("key", F.sha2("text", 256)).join(near, "key", "left").select("doc_id", "text", F.coalesce("hit", none).alias("found"), F.coalesce("items", none).alias("of"))
        counted = _scanned(joined, nothing, 0, width, ["doc_id", "text", "found", "of"])
        found = counted.select("doc_id", "text", "n_words", F.col("found").alias("hit"), F.col("of").alias("items"))
    return found.mapInArrow(_place, f"doc_id long, n_words long, n_hit long, items array<long>, spans {_SPAN}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = 1_000_000) -> DataFrame:
    """The documents in which no window of any item occurs, columns unchanged."""
    items, blocks = dealt_items(benchmark, block_chars, unnamed=True)
    if blocks > 1:
        findings = _findings(bounded(docs).select("text"), items, blocks, width).select(F.col("key").alias("_dirty_key"))
        near = F.broadcast(findings) if small(findings, 100_000) else findings
        return docs.join(near, F.sha2(docs["text"], 256) == near["_dirty_key"], "left_anti")
    held, token = one_block(items, 0), uuid.uuid4().hex

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held_scanner(token, held, width)
        for batch in batches:
            for piece in pieces(batch):
                _, found = scanner.scan(piece.column("text"))
                yield piece.take(pa.array([i for i in range(piece.num_rows) if i not in found], pa.int64()))

    return bounded(docs).mapInArrow(clean, docs.schema)
