"""k-mers of whole columns of sequences, found a batch at a time with array operations.

A k-mer is its 2-bit code, a long, so shuffles carry eight bytes; text is made only
where it is asked for.  The windows of a batch are found in pieces of bounded size,
and a long sequence is read in slices that overlap by k-1 bases, so a genome takes
linear time and little memory.  Spark deals the rows and merges the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.functions.seq import BUCKETS, check_k, parts_of

_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[[ord(b) for b in "ACGT"]] = range(4)


@dataclass
class Windows:
    """The clean windows of a piece: row in the batch, position from 0 and codes of either strand; where they begin in the piece and its bases."""

    row: np.ndarray
    pos: np.ndarray
    forward: np.ndarray
    reverse: np.ndarray
    text: Callable[[], pa.Array]
    at: np.ndarray
    base: np.ndarray

    @property
    def canonical(self) -> np.ndarray:
        return np.minimum(self.forward, self.reverse)


def codes(base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows and of their reverse complements, joined from windows of 1, 2, 4 and so on bases."""
    fwd, rev = base.astype(np.int64), 3 - base.astype(np.int64)
    out: tuple[np.ndarray, np.ndarray] | None = None
    width, done = 1, 0
    while True:
        if k & width:
            if out is None:
                out = fwd, rev
            else:
                n = len(base) - done - width + 1
                out = (out[0][:n] << 2 * width) + fwd[done : done + n], out[1][:n] + (rev[done : done + n] << 2 * done)
            done += width
        if done == k:
            return out
        fwd, rev = (fwd[:-width] << 2 * width) + fwd[width:], rev[:-width] + (rev[width:] << 2 * width)
        width *= 2


def windows(column: pa.Array, k: int, limit: int = 1 << 20) -> Iterator[Windows]:
    """The windows of a string column (null: none), about ``limit`` bases at a time."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        for begin in range(at[first], max(at[last] - k, at[first]) + 1, limit):
            part = data[begin : min(at[last], begin + limit + k - 1)]
            if len(part) >= k:
                yield _found(part, np.clip(at[first : last + 1] - begin, 0, len(part)), first, k, data[at[first] : begin])
        first = last


def _found(data: np.ndarray, at: np.ndarray, first: int, k: int, before: np.ndarray) -> Windows:
    base = _CODE[data]
    bad = np.concatenate(([0], np.cumsum(base > 3)))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    use = np.flatnonzero((bad[k:] == bad[:-k]) & (row[: len(row) - k + 1] == row[k - 1 :]))
    fwd, rev = codes(np.minimum(base, 3), k)
    own = row[use]
    # Positions count characters; only foreign ones take several bytes.
    ahead = len(before) - int(np.count_nonzero((before & 0xC0) == 0x80))
    extra = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
    pos = use - at[own] - (extra[use] - extra[at[own]]) + ahead

    def text() -> pa.Array:
        chars = np.lib.stride_tricks.sliding_window_view(data, k)[use]
        return pa.StringArray.from_buffers(len(use), pa.py_buffer(np.arange(len(use) + 1, dtype=np.int32) * k), pa.py_buffer(np.ascontiguousarray(chars)))

    return Windows(own + first, pos, fwd[use], rev[use], text, use, base)


def _mapped(df: DataFrame, seq: str, keep: list[str], fields: str, give: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray | None, list[pa.Array]]]]) -> DataFrame:
    """Rows that ``give`` makes of a batch: row numbers, at which the columns ``keep`` are taken, and further columns."""
    kept = df.select(*keep)
    names = [*keep, *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, columns in give(batch):
                taken = [batch.column(i).take(pa.array(row)) for i in range(len(keep))] if keep else []
                yield pa.RecordBatch.from_arrays([*taken, *columns], names)

    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes), fields])
    return df.select(*keep, F.col(seq).alias("_seq")).mapInArrow(run, schema)


def kmer_rows(df: DataFrame, k: int, seq: str = "seq", keep: list[str] | None = None, form: str = "code") -> DataFrame:
    """A row (``pos`` from 0, ``kmer``) for each window; ``form`` is code, canonical or text."""
    check_k(k)
    keep = [c for c in df.columns if c != seq] if keep is None else keep
    of = {"code": lambda w: pa.array(w.forward), "canonical": lambda w: pa.array(w.canonical), "text": lambda w: w.text()}[form]

    def give(batch: pa.RecordBatch):
        for w in windows(batch.column("_seq"), k):
            yield w.row, [pa.array(w.pos, pa.int32()), of(w)]

    return _mapped(df, seq, keep, "pos int, kmer " + ("string" if form == "text" else "long"), give)


def kmer_profile(df: DataFrame, k: int, key: str, seq: str | Column = "seq", form: str = "code", limit: int = 1 << 22, parts: int | None = None) -> DataFrame:
    """(key, n, n_forward, n_distinct, low, high, checksum) of the windows of each key's sequences; keys without a window give no row.

    ``n_forward`` counts windows that are no larger than their reverse complement,
    ``checksum`` adds up codes modulo 1,000,003.  ``seq`` may be an expression: rows
    are dealt by key first, so only sequences are shuffled, and a key's windows are
    told apart where they are found.  A key of more than ``limit`` windows leaves its
    codes to Spark, so no task holds them.
    """
    check_k(k)
    dealt = df.repartition(parts or parts_of(df), key).select(key, (F.col(seq) if isinstance(seq, str) else seq).alias("_seq")).sortWithinPartitions(key)
    sums = ("n", "n_forward", "n_distinct", "low", "high", "checksum")

    def told(forward: list[np.ndarray], reverse: list[np.ndarray], whole: bool) -> tuple:
        fwd, rev = (x[0] if len(x) == 1 else np.concatenate(x) for x in (forward, reverse))
        code = np.sort(fwd if form == "code" else np.minimum(fwd, rev))
        new = np.append(True, code[1:] != code[:-1])
        return len(code), int(np.count_nonzero(fwd <= rev)), int(np.count_nonzero(new)) if whole else 0, code[0], code[-1], int((code % 1000003).sum()), None if whole else code[new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(owner: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(sums))]
            return pa.RecordBatch.from_arrays([owner, *columns, pa.array([x[-1] for x in found], pa.list_(pa.int64()))], [key, *sums, "codes"])

        owner, forward, reverse, size, large = None, [], [], 0, False  # the last key so far, which may go on
        for batch in batches:
            keys, done, whose = batch.column(0), [], []
            number = keys.dictionary_encode("encode").indices.to_numpy()
            group = np.cumsum(np.append(False, number[1:] != number[:-1]))
            if owner is not None and owner[0].as_py() != keys[0].as_py():
                if size:
                    yield record(owner, [told(forward, reverse, not large)])
                forward, reverse, size, large = [], [], 0, False
            last = 0
            for w in windows(batch.column("_seq"), k):
                if not len(w.row):
                    continue
                own = group[w.row]
                cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                    if own[a] != last:
                        if size:
                            done.append(told(forward, reverse, not large))
                            whose.append(last)
                        forward, reverse, size, large, last = [], [], 0, False, own[a]
                    forward.append(w.forward[a:b])
                    reverse.append(w.reverse[a:b])
                    size += b - a
                    if size > limit:
                        yield record(keys.take(pa.array([int(np.searchsorted(group, last))])), [told(forward, reverse, False)])
                        forward, reverse, size, large = [], [], 0, True
            if group[-1] != last:
                if size:
                    done.append(told(forward, reverse, not large))
                    whose.append(last)
                forward, reverse, size, large = [], [], 0, False
            if done:
                yield record(keys.take(pa.array(np.searchsorted(group, whose))), done)
            owner = keys.slice(len(keys) - 1, 1)
        if size:
            yield record(owner, [told(forward, reverse, not large)])

    schema = f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"{c} long" for c in sums) + ", codes array<long>"
    rows = dealt.mapInArrow(run, schema).select(key, *sums, F.posexplode_outer("codes").alias("_place", "_code"))
    once = lambda c: F.sum(F.when(F.coalesce("_place", F.lit(0)) == 0, F.col(c)))
    return rows.groupBy(key).agg(once("n").alias("n"), once("n_forward").alias("n_forward"), (once("n_distinct") + F.countDistinct("_code")).alias("n_distinct"), F.min("low").alias("low"), F.max("high").alias("high"), once("checksum").alias("checksum"))


#: Runs of windows are dealt into so many bins, each counted alone.
_BINS = 4096
_RUN = np.dtype([("code", "<u8"), ("windows", "u1")])


def _rank(code: np.ndarray, m: int) -> np.ndarray:
    """A fixed shuffle of the numbers below 4^m."""
    bits, x = np.int64(2 * m), code
    for factor in (0x9E3779B1, 0x85EBCA6B):
        x = (x * np.int64(factor)) & ((np.int64(1) << bits) - 1)
        x = x ^ (x >> (bits + 1 >> 1))
    return x


def runs(w: Windows, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, run) of a piece: consecutive windows whose smallest word of ``m`` bases is the same, as one stretch of 32 bases at most.

    Words count on either strand alike, so a k-mer and its reverse complement lie in
    one bin wherever they occur.
    """
    least = _rank(np.minimum(*codes(np.minimum(w.base, 3), m)), m)
    width, done = k - m + 1, 1
    while done < width:
        step = min(done, width - done)
        least, done = np.minimum(least[:-step], least[step:]), done + step
    least = least[w.at]
    fresh = np.append(True, (w.at[1:] != w.at[:-1] + 1) | (least[1:] != least[:-1]))
    head = np.flatnonzero(fresh)
    place = np.arange(len(least)) - np.repeat(head, np.diff(np.append(head, len(least))))
    # The first and the last window of a stretch hold all its bases.
    first = np.flatnonzero(place % min(33 - k, k + 1) == 0)
    n = np.diff(np.append(first, len(least)))
    tail = (2 * (n - 1)).astype(np.uint64)
    out = np.empty(len(first), _RUN)
    out["code"] = (w.forward[first].astype(np.uint64) << tail) | (w.forward[first + n - 1].astype(np.uint64) & ((np.uint64(1) << tail) - np.uint64(1)))
    out["windows"] = n
    return least[first] % _BINS, out


def _turned(code: np.ndarray, k: int) -> np.ndarray:
    """Codes of the reverse complements."""
    x = (~code.astype(np.uint64)).byteswap()
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def _canonical_of(run: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers of all windows of runs."""
    code, n = run["code"].astype(np.uint64), run["windows"].astype(np.int64)
    found = []
    for i in range(int(n.max(initial=0))):
        use = np.flatnonzero(n > i)
        found.append((code[use] >> (2 * (n[use] - 1 - i)).astype(np.uint64)) & np.uint64((1 << 2 * k) - 1))
    fwd = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
    return np.minimum(fwd, _turned(fwd, k))


def _added(kmer: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(kmer, kind="stable")
    kmer, head = kmer[order], np.flatnonzero(np.append(True, kmer[order][1:] != kmer[order][:-1]))
    return kmer[head], np.add.reduceat(n[order], head)


def kmer_totals(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n) of the canonical k-mers of all sequences.

    Runs of windows that share their smallest word travel as one packed stretch, about
    one and a half bytes a window, to the bin of that word; a bin holds all windows of
    its k-mers and is counted alone, in little memory, whatever the number of sequences.
    """
    check_k(k)
    if k <= 12:
        return _few_totals(df, k, seq)
    m = min(10, k - 1)

    def give(batch: pa.RecordBatch):
        for w in windows(batch.column("_seq"), k, 4 << 20):
            if len(w.row):
                bin_, run = runs(w, k, m)
                order = np.argsort(bin_.astype(np.uint16), kind="stable")
                there, n = np.unique(bin_, return_counts=True)
                ends = np.append(0, np.cumsum(n)) * _RUN.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(run[order].tobytes())])
                yield None, [pa.array(there, pa.int32()), packed]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kmer, n, held, waiting, bin_ = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, None

        def settle() -> None:
            nonlocal kmer, n, waiting
            if held:
                new, often = np.unique(_canonical_of(np.frombuffer(b"".join(held), _RUN), k), return_counts=True)
                kmer, n = _added(np.append(kmer, new), np.append(n, often))
                held.clear()
                waiting = 0

        def whole() -> Iterator[pa.RecordBatch]:
            nonlocal kmer, n
            settle()
            for i in range(0, len(kmer), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(kmer[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], ["kmer", "n"])
            kmer, n = kmer[:0], n[:0]

        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != bin_:
                    yield from whole()
                    bin_ = number
                held.append(packed)
                waiting += len(packed)
                # A bin of many windows is added up time and again, the more rarely the more it holds.
                if waiting > max(4 << 20, 8 * len(kmer)):
                    settle()
        yield from whole()

    dealt = _mapped(df, seq, [], "bin int, runs binary", give).repartition(parts_of(df), "bin").sortWithinPartitions("bin")
    return dealt.mapInArrow(count, "kmer long, n long")


def _few_totals(df: DataFrame, k: int, seq: str) -> DataFrame:
    """The same for short k-mers, of which there are few: each piece's equal ones are added up before the shuffle."""

    def give(batch: pa.RecordBatch):
        for w in windows(batch.column("_seq"), k, 2 << 20):
            kmer, n = np.unique(w.canonical, return_counts=True)
            yield None, [pa.array(kmer), pa.array(n)]

    return _mapped(df, seq, [], "kmer long, n long", give).groupBy("kmer").agg(F.sum("n").alias("n"))


def bucket_totals(df: DataFrame, k: int, key: str, seq: str | Column = "seq", parts: int | None = None) -> DataFrame:
    """(key, bucket, cnt): canonical k-mers by their low 20 bits.

    Rows are dealt by key first, so only sequences are shuffled; of a key that goes on
    in a next batch the counts so far are held, one for each bucket at most.
    """
    check_k(k)
    dealt = df.repartition(parts or parts_of(df), key).select(key, (F.col(seq) if isinstance(seq, str) else seq).alias("_seq")).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(keys: pa.Array, cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(cell), 1 << 18):
                c = cell[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(c // BUCKETS)), pa.array(c % BUCKETS, pa.int32()), pa.array(n[i : i + (1 << 18)])], [key, "bucket", "cnt"])

        owner, cell, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last key so far and its cells, as of group 0
        for batch in batches:
            keys = batch.column(0)
            number = keys.dictionary_encode("encode").indices.to_numpy()
            group = np.cumsum(np.append(False, number[1:] != number[:-1]))
            heads = keys.take(pa.array(np.flatnonzero(np.append(True, group[1:] != group[:-1]))))
            if owner is not None and owner[0].as_py() != keys[0].as_py():
                yield from record(owner, cell, n)
                cell, n = cell[:0], n[:0]
            for w in windows(batch.column("_seq"), k):
                if len(w.row):
                    new, often = np.unique(group[w.row] * BUCKETS + (w.canonical & (BUCKETS - 1)), return_counts=True)
                    cell, n = (new, often) if not len(cell) else _added(np.append(cell, new), np.append(n, often))
                    open_ = int(np.searchsorted(cell, cell[-1] // BUCKETS * BUCKETS))
                    yield from record(heads, cell[:open_], n[:open_])
                    cell, n = cell[open_:], n[open_:]
            if len(cell) and cell[0] // BUCKETS != group[-1]:
                yield from record(heads, cell, n)
                cell, n = cell[:0], n[:0]
            cell, owner = cell % BUCKETS, keys.slice(len(keys) - 1, 1)
        if len(cell):
            yield from record(owner, cell, n)

    return dealt.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, bucket int, cnt long")


def panel_codes(panel: DataFrame, most: int = 1_000_000) -> np.ndarray | None:
    """The distinct codes (column ``kmer``) of a panel, sorted, if there are ``most`` (8 MB for a million) at most."""
    found = panel.select("kmer").where("kmer is not null").distinct().limit(most + 1).toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64)) if found.num_rows <= most else None


def _held(sorted_codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(0, np.int64)
    at = np.searchsorted(sorted_codes, wanted)
    at[at == len(sorted_codes)] = 0
    return np.flatnonzero(sorted_codes[at] == wanted)


def panel_hits(df: DataFrame, k: int, codes_: np.ndarray, seq: str = "seq", keep: list[str] | None = None) -> DataFrame:
    """(keep, strand, pos, kmer) of the windows whose code is in a panel, on either strand.

    Strand 1 is the reverse complement, and its positions are on it.
    """
    keep = [c for c in df.columns if c != seq] if keep is None else keep
    held = df.sparkSession.sparkContext.broadcast(codes_)

    def give(batch: pa.RecordBatch):
        # Positions on the other strand need the whole length, which a slice does not know.
        length = np.array([len(s or "") for s in batch.column("_seq").to_pylist()], np.int64)
        for w in windows(batch.column("_seq"), k):
            for strand, code in ((0, w.forward), (1, w.reverse)):
                at = _held(held.value, code)
                if len(at):
                    pos = w.pos[at] if not strand else length[w.row[at]] - k - w.pos[at]
                    yield w.row[at], [pa.array([strand] * len(at), pa.int32()), pa.array(pos, pa.int32()), pa.array(code[at])]

    return _mapped(df, seq, keep, "strand int, pos int, kmer long", give)


def panel_counts(df: DataFrame, k: int, codes_: np.ndarray, group: str, seq: str = "seq") -> DataFrame:
    """(group, kmer, n): forward windows whose code is in a panel, added up batch by batch before any row leaves."""
    held = df.sparkSession.sparkContext.broadcast(codes_)

    def give(batch: pa.RecordBatch):
        # Equal sequences of a batch are read once.
        told = batch.column("_seq").dictionary_encode()
        seqs, which = told.dictionary, told.indices.fill_null(len(told.dictionary)).to_numpy().astype(np.int64)
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for w in windows(seqs, k):
            at = _held(held.value, w.forward)
            rows.append(w.row[at])
            found.append(w.forward[at])
        hit, kmer = np.concatenate(rows), np.searchsorted(held.value, np.concatenate(found))
        number = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        groups = int(number.max(initial=0)) + 1
        pair, example, times = np.unique(which * groups + number, return_index=True, return_counts=True)  # by sequence
        begin, end = np.searchsorted(pair // groups, hit), np.searchsorted(pair // groups, hit, side="right")
        size = end - begin
        use = np.arange(int(size.sum())) + np.repeat(begin - np.cumsum(size) + size, size)
        cell, first, inverse = np.unique(pair[use] % groups * max(len(held.value), 1) + np.repeat(kmer, size), return_index=True, return_inverse=True)
        n = np.bincount(inverse, times[use], len(cell)).astype(np.int64)
        yield example[use][first], [pa.array(held.value[cell % max(len(held.value), 1)]), pa.array(n)]

    return _mapped(df, seq, [group], "kmer long, n long", give)
