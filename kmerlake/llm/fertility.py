"""Quality rules: plain text counts and tokeniser fertility.

The plain rules (the base) count words, symbols, repeated lines and repeated
3-word windows.  The method then encodes every word with a public vocabulary and
measures, for each text, the characters per token, the share of byte-fallback
tokens and the entropy of its token distribution (as a share of what its token
count allows).  A text is rejected when a measure leaves the band of its language.

Bands come from the corpus: for each language, and for each script, histograms of
the measures over all texts that pass the base give the quartiles, and a band
reaches some interquartile ranges beyond them (``REACH``).  Quartiles do not move
much while less than a quarter of the texts is odd on one side.  A language with
fewer than ``least`` texts has its script's band; a script with too few texts has the stated band of ``BANDS``.

A word's tokens are those of the word encoded on its own, so each task encodes a
distinct word once and the rest is array work over word numbers.  Only histogram
counts are shuffled.

Null text counts as empty.  An empty text has no words, so the base fails.  Each
input row gives one output row, so repeated rows stay apart; other columns are not
touched.  A null or missing ``lang`` leaves the script's band.  Texts are measured
whole, a long one as a batch by itself (some 100 bytes of memory a word).  With no
text at all there is nothing to learn and nothing to reject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from kmerlake.llm.bytewords import SPACE, U64, Words, mix, pieces
from kmerlake.llm.tables import bounded, cut, near, small

#: Bands of scripts with too few texts to learn from: least and most characters
#: per token, most byte-fallback share, least share of the possible entropy.
BANDS = {
    "latin": (1.55, 7.0, 0.20, 0.67),
    "cyrillic_greek": (1.2, 6.0, 0.30, 0.30),
    "semitic": (0.7, 5.0, 0.60, 0.30),
    "indic": (0.4, 4.0, 0.90, 0.25),
    "east_asian": (0.3, 3.0, 0.90, 0.25),
    "none": (1.0, 12.0, 0.50, 0.30),
}
#: How far a band reaches beyond the quartiles, in interquartile ranges, and the
#: least such range, of each measure.
REACH = {"chars_per_token": (4.0, 0.05), "byte_share": (4.0, 0.0125), "entropy_share": (2.0, 0.02)}
_BIN = 1000  # histogram bins in one unit of a measure
_SCRIPTS = list(BANDS)
#: Lead byte of a character to its script's number; ASCII letters are Latin.
_SCRIPT_OF = np.full(256, -1, dtype=np.int8)
_SCRIPT_OF[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = 0
_SCRIPT_OF[[*range(0xCD, 0xD4)]] = 1
_SCRIPT_OF[[*range(0xD6, 0xDC)]] = 2
_SCRIPT_OF[0xE0] = 3
_SCRIPT_OF[[*range(0xE3, 0xEE)]] = 4
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

BASE_FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean")]
MORE_FIELDS = [("n_tokens", "long"), ("chars_per_token", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("entropy_share", "double"), ("script", "string")]
_TYPES = {"long": LongType, "double": DoubleType, "string": StringType, "boolean": BooleanType}
_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
    return count


class Meter:
    """Measures batches of texts; keeps the tokens of the words it has met."""

    def __init__(self, model_file: str, most_words: int = 200_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_file)
        self.byte = np.array([self.model.is_byte(i) for i in range(len(self.model))])
        self.most = most_words
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def _numbers(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """The number under which each word's tokens are kept."""
        values, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.number) + len(values) > self.most:
            self._forget()
        fresh = [i for i, v in enumerate(values.tolist()) if v not in self.number]
        if fresh:
            where = at[fresh]
            raw = words.data.tobytes()
            got = self.model.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[where].tolist(), words.ends[where].tolist())], num_threads=1)
            first = len(self.size)
            self.number.update(zip(values[fresh].tolist(), range(first, first + len(fresh))))
            self.size = np.concatenate([self.size, np.array([len(x) for x in got], np.int64)])
            self.ids = np.concatenate([self.ids, np.array([t for x in got for t in x], np.int64)])
            self.head = np.concatenate(([0], np.cumsum(self.size)))
        return np.array([self.number[v] for v in values.tolist()], np.int64)[inverse]

    def measure(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        words = Words(texts, SPACE)
        rows, n = len(texts), words.counts()
        data, at, first = words.data, words.at, words.first

        def per_row(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))
            return total[at[1:]] - total[at[:-1]]

        out: dict = {"n_words": n, "word_chars": per_row(words._inside & ((data & 0xC0) != 0x80)), "n_symbols": per_row(_SYMBOL[data])}
        raw = data.tobytes()
        out["n_dup_lines"] = [repeated_lines(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        hashes = words.hashes()
        out["n_repeat_words"] = self._repeats(hashes, first)
        scripts = np.stack([per_row(_SCRIPT_OF[data] == s) for s in range(5)], axis=1)
        script = np.where(scripts.sum(axis=1) > 0, scripts.argmax(axis=1), 5)
        out["script"] = [_SCRIPTS[s] for s in script.tolist()]

        tokens, share, entropy = np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
        if len(words):
            number = self._numbers(words, hashes)
            size = self.size[number]
            row_of_word = np.repeat(np.arange(rows), n)
            tokens = np.bincount(row_of_word, weights=size, minlength=rows).astype(np.int64)
            within = np.arange(int(size.sum())) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
            ids = self.ids[np.repeat(self.head[number], size) + within]
            row_of_token = np.repeat(row_of_word, size)
            share = np.bincount(row_of_token, weights=self.byte[ids], minlength=rows) / np.maximum(tokens, 1)
            pair, count = np.unique(row_of_token * len(self.byte) + ids, return_counts=True)
            of = pair // len(self.byte)
            entropy = np.log2(np.maximum(tokens, 1)) - np.bincount(of, weights=count * np.log2(count), minlength=rows) / np.maximum(tokens, 1)
        per_token = out["word_chars"] / np.maximum(tokens, 1)
        out |= {"n_tokens": tokens, "chars_per_token": per_token, "byte_share": share, "token_entropy": np.maximum(entropy, 0.0)}
        out["base_failed"] = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
        out["entropy_share"] = out["token_entropy"] / np.log2(np.clip(tokens, 2, 512))
        return out

    @staticmethod
    def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(hashes)
        rows = len(first) - 1
        if n < 3:
            return np.zeros(rows, np.int64)
        row = np.repeat(np.arange(rows), np.diff(first))
        inside = row[2:] == row[:-2]
        window = mix(hashes[:-2] * U64(3) + mix(hashes[1:-1]) * U64(5) + mix(mix(hashes[2:])) * U64(7) + mix(row[:-2].astype(np.uint64)))
        at = np.flatnonzero(inside)
        order = at[np.argsort(window[at], kind="stable")]
        same = window[order][1:] == window[order][:-1] if len(order) else np.zeros(0, bool)
        twice = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        mark = np.zeros(n, dtype=bool)
        for i in range(3):
            mark[twice + i] = True
        return np.bincount(row[mark], minlength=rows)


#: Columns of measures beside those of the documents; no document column is named so.
_P = "_fertility_"


def measured_rows(docs: DataFrame, model_file: str, columns: list[str]) -> DataFrame:
    """``columns`` of each row, its language and its measures (names with ``_P``)."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    fields = BASE_FIELDS + MORE_FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model_file)
        for batch in batches:
            for piece in pieces(batch, f"{_P}text"):
                got = meter.measure(piece.column(f"{_P}text"))
                kept = [piece.column(i) for i in range(len(columns) + 1)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[n], _KINDS[t]) for n, t in fields)], [*columns, f"{_P}lang", *(_P + n for n, _ in fields)])

    given = bounded(docs).select(*[F.col(f"`{c}`") for c in columns], lang.alias(f"{_P}lang"), F.col("text").alias(f"{_P}text"))
    out = StructType([*given.schema.fields[:-1], *(StructField(_P + n, _TYPES[t]()) for n, t in fields)])
    return given.mapInArrow(run, out)


def learn_bands(measured: DataFrame, least: int = 100) -> DataFrame:
    """(script, lang, low, high, most_bytes, least_entropy), lang null for a script's band, from the rows of ``measured_rows`` that pass the base.

    A row for each language with ``least`` texts or more, however many there are.
    """
    script, lang = F.col(f"{_P}script").alias("script"), F.col(f"{_P}lang").alias("lang")
    of = F.array(F.struct(script, F.lit(None).cast("string").alias("lang")), F.struct(script, lang))
    groups = F.explode(F.when(lang.isNull(), F.slice(of, 1, 1)).otherwise(of))
    good = measured.where(~F.col(f"{_P}base_failed")).select(groups.alias("g"), *[F.col(_P + m).alias(m) for m in REACH])
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * _BIN).cast("long").alias("bin")) for m in REACH]))
    counted = good.select("g.*", cells.alias("c")).groupBy("script", "lang", "c.measure", "c.bin").count()
    own = Window.partitionBy("script", "lang", "measure")
    placed = counted.withColumns({"upto": F.sum("count").over(own.orderBy("bin")), "total": F.sum("count").over(own)})
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) / _BIN
    found = placed.where(F.col("total") >= least).groupBy("script", "lang", "measure").agg(quartile(0.25).alias("a"), quartile(0.75).alias("b"))
    per = found.groupBy("script", "lang").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("a", "b")))).alias("m"))

    def end(measure: str, side: int) -> Column:
        reach, narrowest = REACH[measure]
        q = F.try_element_at("m", F.lit(measure))
        return q["ab"[side > 0]] + side * reach * F.greatest(q["b"] - q["a"], F.lit(narrowest))

    return per.select("script", "lang", end("chars_per_token", -1).alias("low"), end("chars_per_token", 1).alias("high"), end("byte_share", 1).alias("most_bytes"), end("entropy_share", -1).alias("least_entropy"))


def judged(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """``measured`` with ``_P`` kept: whether each text passes the base and lies in the band of its language, else of its script.

    The bands go to the tasks if they are few (counted); else they are joined.
    """
    bands = near(bands)
    whole = bands.where("lang is null").select(F.col("script").alias(f"{_P}of"), F.struct(*_ENDS).alias(f"{_P}whole"))
    own = bands.where("lang is not null").select(F.col("script").alias(f"{_P}own_of"), F.col("lang").alias(f"{_P}own_lang"), F.struct(*_ENDS).alias(f"{_P}own"))
    sent = F.broadcast if small(bands) else (lambda x: x)
    met = measured.join(sent(own), (F.col(f"{_P}script") == F.col(f"{_P}own_of")) & (F.col(f"{_P}lang") == F.col(f"{_P}own_lang")), "left").join(sent(whole), F.col(f"{_P}script") == F.col(f"{_P}of"), "left")
    stated = F.create_map(*[x for name, band in BANDS.items() for x in (F.lit(name), F.struct(*[F.lit(v).alias(n) for v, n in zip(band, _ENDS)]))])
    band = F.coalesce(f"{_P}own", f"{_P}whole", F.try_element_at(stated, F.col(f"{_P}script")))
    m = lambda name: F.col(_P + name)
    kept = ~m("base_failed") & (m("chars_per_token") >= band["low"]) & (m("chars_per_token") <= band["high"]) & (m("byte_share") <= band["most_bytes"]) & (m("entropy_share") >= band["least_entropy"])
    return met.select(*measured.columns, kept.alias(f"{_P}kept"))


_ENDS = ("low", "high", "most_bytes", "least_entropy")


def text_quality(docs: DataFrame, model_file: str, bands: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the fertility measures of each row."""
    measured = cut(measured_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model_file, ["doc_id"]))
    told = judged(measured, learn_bands(measured) if bands is None else bands)
    return told.select("doc_id", *[F.col(_P + n).alias(n) for n in (*(n for n, _ in BASE_FIELDS), "kept", *(n for n, _ in MORE_FIELDS))])


def keep_quality(docs: DataFrame, model_file: str, bands: DataFrame | None = None) -> DataFrame:
    """The documents that pass the base and the bands, columns unchanged.

    Learning the bands reads the texts once, filtering once more: writing them
    beside their measures would save the second measuring and cost their size in
    disk and a third more of an executor's memory.
    """
    bands = learn_bands(cut(measured_rows(docs, model_file, []))) if bands is None else bands
    told = judged(measured_rows(docs, model_file, docs.columns), bands)
    return told.where(F.col(f"{_P}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
