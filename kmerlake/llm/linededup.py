"""Line dedup over content-defined chunks of lines.

The lines of a text (split at ``\\n``) are hashed.  A chunk ends after a line
when a rolling hash over the last ``window`` line hashes is 0 modulo ``divisor``,
so borders depend on nearby lines only and come back to the same places after
lines were put in or taken out.  A chunk has ``least`` lines with words or more
and ``most`` at most; what is left at a text's end joins the last chunk.  Every
chunk with two worded lines counts.

Where the same chunk occurs more than once in the corpus, the first occurrence
(lowest doc_id, then position) stays and the others are removed, each only after
its bytes were compared with those of the first.  Two further steps, each of
which can be switched off, take what chunk borders leave:

``extend``      a repeat goes on, line by line, over the borders of its chunk: any
                two neighbouring lines with words (and the blank lines between)
                are compared too, and a run of lines that stand earlier goes when
                it holds a removed chunk or long line, ``run_words`` words, or all
                the words of its text.
``long_words``  a single line of so many words that stands earlier goes, since it
                is a passage by itself (None: off).

The output tells for each row how many lines went by which step.  The first
occurrence of every line stays.

How the work is spread: unit hashes are counted with map-side combining, so a
passage in a third of all documents is one row per task; only units that repeat
send text, once from the first document and then along with each occurrence, in a
plain join that Spark splits where a hash is frequent.

Null text stays null, empty text stays empty.  Rows that share an id count as one
document: their equal chunks at equal positions stay.  Rows without an id come
after the others, ordered by a hash of the text, so equal ones count as one.  A
text all of whose lines are removed becomes empty.  Texts are read whole, one at a
time.  Input columns named like the added ones are replaced; any others, whatever
their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kmerlake.llm.tables import bounded, cut

_MASK = (1 << 64) - 1
_SIGN = 1 << 63
CHUNK, LONG, PAIR = 0, 1, 2
ADDED = ("cut_lines", "cut_by_chunk", "cut_by_long_line", "cut_by_extension")


@dataclass(frozen=True)
class How:
    window: int = 2
    divisor: int = 2
    least: int = 2
    most: int = 12
    extend: bool = False
    run_words: int = 16
    long_words: int | None = 16


def line_chunks(lines: list[bytes], how: How = How()) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, first, worded = [], 0, 0
    for i, line in enumerate(lines):
        worded += not not line.split()
        rolling = 0
        for h in hashes[max(0, i - how.window + 1) : i + 1]:
            rolling = (rolling * 0x9E3779B97F4A7C15 + h) & _MASK
        rolling ^= rolling >> 29
        if worded >= how.most or worded >= how.least and rolling % how.divisor == 0:
            out.append((first, i + 1))
            first, worded = i + 1, 0
    if first < len(lines):
        if out and worded < how.least:
            out[-1] = out[-1][0], len(lines)
        else:
            out.append((first, len(lines)))
    return out


class Units:
    """What is compared of a text: (first line, end line, kind) in order of position."""

    def __init__(self, text: str, how: How):
        self.lines = text.encode().split(b"\n")
        self.words = [len(x.split()) for x in self.lines]
        self.how = how
        worded = [i for i, n in enumerate(self.words) if n]
        units = [(a, b, CHUNK) for a, b in line_chunks(self.lines, how) if sum(1 for n in self.words[a:b] if n) >= 2]
        if how.long_words is not None:
            units += [(i, i + 1, LONG) for i in worded if self.words[i] >= how.long_words]
        if how.extend:
            units += [(a, b + 1, PAIR) for a, b in zip(worded, worded[1:])]
        self.units = sorted(units)

    def said(self, unit: tuple[int, int, int]) -> bytes:
        """The bytes compared of a unit.  A pair shows a digest for a long line, whose own bytes are compared as one."""
        a, b, kind = unit
        return b"%d" % kind + b"\n".join(xxhash.xxh3_128_digest(self.lines[i]) if kind == PAIR and self.long(i) else self.lines[i] for i in range(a, b))

    def long(self, i: int) -> bool:
        return self.how.long_words is not None and self.words[i] >= self.how.long_words

    def hash(self, unit: tuple[int, int, int]) -> int:
        h = xxhash.xxh3_64_intdigest(self.said(unit), seed=7)
        return h - (1 << 64) if h >= _SIGN else h

    def dropped(self, marked: list[dict]) -> tuple[set[int], set[int], set[int]]:
        """Lines that go by their chunk, as long lines and by extension, from (seq, first, own) of repeated units."""
        lines: tuple[set[int], ...] = (set(), set(), set())
        for m in marked:
            if m["seq"] >= len(self.units) or self.said(self.units[m["seq"]]) != m["first"]:
                continue
            a, b, kind = self.units[m["seq"]]
            if m["own"] is not None and m["own"] < len(self.units):
                c, d, own = self.units[m["own"]]
                if own == kind and c < a < d:
                    a = d  # a repeat that begins inside its first occurrence leaves that whole
            lines[kind].update(i for i in range(a, b) if kind != PAIR or not self.long(i))
        chunk, long, pair = lines
        long -= chunk
        if not self.how.extend:
            return chunk, long, set()
        gone = self._runs(chunk | long, pair)
        return chunk, long, gone - chunk - long

    def _runs(self, sure: set[int], pair: set[int]) -> set[int]:
        drop, run = set(), []
        marked = sorted(sure | pair)
        for line, following in zip(marked, [*marked[1:], None]):
            run.append(line)
            if following != line + 1:
                n = sum(self.words[i] for i in run)
                if n >= self.how.run_words or n == sum(self.words) or not sure.isdisjoint(run):
                    drop.update(run)
                run = []
        # Blank lines go where nothing else is left.
        return set(range(len(self.lines))) if drop and not any(n for i, n in enumerate(self.words) if i not in drop) else drop


def _unit_rows(docs: DataFrame, how: How) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for none, key, text in zip(*(batch.column(c).to_pylist() for c in ("none", "key", "text"))):
                if text:
                    units = Units(text, how)
                    for k, u in enumerate(units.units):
                        for column, value in zip(out, (units.hash(u), none, key, k)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int32()))], ["hash", "none", "key", "seq"])

    return docs.select("none", "key", "text").mapInArrow(rows, "hash long, none boolean, key long, seq int")


def _first_texts(docs: DataFrame, firsts: DataFrame, how: How) -> DataFrame:
    """(hash, first) with the bytes of the first occurrence of each repeated unit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                units = Units(text or "", how)
                for w in wanted:
                    if w["seq"] < len(units.units) and units.hash(units.units[w["seq"]]) == w["hash"]:
                        hashes.append(w["hash"])
                        texts.append(units.said(units.units[w["seq"]]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(texts, pa.binary())], ["hash", "first"])

    lists = firsts.groupBy("none", "key").agg(F.collect_list(F.struct("hash", "seq")).alias("wanted"))
    joined = docs.select("none", "key", "text").join(lists, ["none", "key"]).select("text", "wanted")
    return joined.mapInArrow(rows, "hash long, first binary").groupBy("hash").agg(F.min("first").alias("first"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, **how) -> DataFrame:
    """The input's rows and columns with repeated lines cut out of ``text``, and
    ``cut_lines``, how many went, in all and by step (null where text is null).

    With ``drop_emptied`` rows that lose all their lines are left out.  Further
    arguments are those of ``How``.
    """
    way = How(**how)
    longest = "_" * max(map(len, docs.columns))  # no column of the input has a name with these added
    none, key, marked_as = (x + longest for x in ("none", "key", "marked"))
    told = bounded(docs).withColumns({none: F.col("doc_id").isNull(), key: F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))})
    keyed = told.select(F.col(none).alias("none"), F.col(key).alias("key"), "text")
    units = cut(_unit_rows(keyed, way))
    at = F.struct("none", "key", "seq")
    repeated = cut(units.groupBy("hash").agg(F.count("*").alias("n"), F.min(at).alias("at")).where("n > 1").select("hash", "at.*"))
    firsts = repeated.select("hash", F.struct("none", "key", "seq").alias("at"))
    firsts = cut(firsts.join(_first_texts(keyed, repeated, way), "hash"))
    own = F.when((F.col("none") == F.col("at.none")) & (F.col("key") == F.col("at.key")), F.col("at.seq"))  # the first occurrence in the same text
    later = units.join(firsts, "hash").where(F.col("at") != at)
    cuts = later.groupBy(F.col("none").alias(none), F.col("key").alias(key)).agg(F.collect_list(F.struct("seq", "first", own.alias("own"))).alias(marked_as))
    joined = told.join(cuts, [none, key], "left").drop(none, key)
    kept_columns = [c for c in docs.columns if c not in ADDED]
    schema = docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in kept_columns], *[F.lit(None).cast("long").alias(c) for c in ADDED]).schema
    names = [f.name for f in schema]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, counts = [], [], []
            for i, (text, marked) in enumerate(zip(batch.column("text").to_pylist(), batch.column(marked_as).to_pylist())):
                by: tuple[int | None, ...] = (None,) * 4 if text is None else (0,) * 4
                if text and marked:
                    units_ = Units(text, way)
                    parts = units_.dropped(marked)
                    by = sum(map(len, parts)), *map(len, parts)
                    if by[0]:
                        gone = set().union(*parts)
                        text = b"\n".join(x for k, x in enumerate(units_.lines) if k not in gone).decode()
                        if drop_emptied and by[0] == len(units_.lines):
                            continue
                keep.append(i)
                texts.append(text)
                counts.append(by)
            rest = batch.take(pa.array(keep, pa.int64()))
            put = {"text": pa.array(texts, pa.string())} | {c: pa.array([x[k] for x in counts], pa.int64()) for k, c in enumerate(ADDED)}
            if "doc_id" in rest.schema.names:
                put["doc_id"] = rest.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([put[n] if n in put else rest.column(n) for n in names], names)

    return joined.mapInArrow(remove, schema)
