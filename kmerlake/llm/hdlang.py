"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An
n-gram of letters is bound into one vector: the letters' vectors, each permuted
(rotated) by its place, are multiplied element by element.  A text is the bundle
(sum) of its n-gram vectors, a language the bundle of the texts known to be in
it, and a text belongs to the language whose prototype has the highest cosine.

Texts are lower-cased and every run of other characters is one blank.  The
bundles of a language are sums, so each task adds up its n-gram counts and sends
one vector per language, and Spark adds those; nothing else is gathered.

Learning uses the text and non-null language of the training rows only.  A text
that is null or without a letter is ``und`` with score 0, as is every text when
nothing was learned.  Ties go to the first language by name.  Each input row
gives one output row, so repeated rows stay apart; other columns, whatever their
names, are not read.  Texts are read whole: a long one is bundled some thousand
n-grams at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.llm.bytewords import pieces
from kmerlake.llm.tables import bounded

_BLANK = 0


class Encoder:
    """Turns texts into n-gram counts and n-grams into vectors."""

    def __init__(self, size: int = 512, width: int = 3, most: int = 40_000):
        self.size, self.width, self.most = size, width, most
        self.kind = np.full(0x110000, -1, dtype=np.int32)  # letter number of a code point, 0 for none
        self.kind[0x20] = _BLANK
        self.letters = [self._random(0x20)]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.vectors = np.zeros((0, self.size), np.float32)

    def _random(self, point: int) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(point + 1)).integers(0, 2, self.size).astype(np.float32) * 2 - 1

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distinct n-grams as numbers, how often each occurs, and whether there was a letter."""
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[points]
        if (kind < 0).any():
            for p in np.unique(points[kind < 0]).tolist():
                if chr(p).isalpha():
                    self.kind[p] = len(self.letters)
                    self.letters.append(self._random(p))
                else:
                    self.kind[p] = _BLANK
            kind = self.kind[points]
        kind = kind[np.concatenate(([True], (kind[1:] != _BLANK) | (kind[:-1] != _BLANK)))].astype(np.int64)
        if len(kind) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), False
        code = np.zeros(max(1, len(kind) - self.width + 1), np.int64)
        if len(kind) < self.width:
            kind = np.concatenate([kind, np.zeros(self.width - len(kind), np.int64)])
        for i in range(self.width):
            code = (code << 20) + kind[i : i + len(code)]
        code.sort()
        heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        return code[heads], np.diff(np.concatenate((heads, [len(code)]))), True

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Where the vectors of the n-grams stand in ``vectors``."""
        number = self.number
        out = [number.get(g, -1) for g in grams.tolist()]
        fresh = [g for g, i in zip(grams.tolist(), out) if i < 0]
        if fresh:
            if len(number) + len(fresh) > self.most:  # a call asks for fewer than ``most``
                self._forget()
                number, fresh = self.number, grams.tolist()
            made = np.ones((len(fresh), self.size), np.float32)
            for i in range(self.width):
                letters = np.array([self.letters[(g >> 20 * (self.width - 1 - i)) & 0xFFFFF] for g in fresh])
                made *= np.roll(letters, self.width - 1 - i, axis=1)
            number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
            if len(number) > len(self.vectors):
                grown = np.zeros((min(max(4096, 2 * len(number)), max(self.most, len(number))), self.size), np.float32)
                grown[: len(self.vectors)] = self.vectors
                self.vectors = grown
            self.vectors[len(number) - len(fresh) : len(number)] = made
            out = [number[g] for g in grams.tolist()]
        return np.array(out, dtype=np.int64)

    def bundle(self, grams: np.ndarray, counts: np.ndarray, step: int = 4096) -> np.ndarray:
        """The sum of the n-grams' vectors, ``step`` of them at a time, so a text's memory does not grow with its n-grams."""
        total = np.zeros(self.size, np.float64)
        for i in range(0, len(grams), step):
            at = self.rows(grams[i : i + step])
            total += counts[i : i + step].astype(np.float32) @ self.vectors[at]
        return total


def prototypes(docs: DataFrame, size: int = 512, width: int = 3) -> dict[str, np.ndarray]:
    """Language to its bundle, from the rows with text and ``lang``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(size, width), {}
        for batch in batches:
            for piece in pieces(batch):
                seen: dict[str, list] = {}
                for text, lang in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist()):
                    grams, counts, _ = encoder.grams(text)
                    seen.setdefault(lang, []).append((grams, counts))
                for lang, parts in seen.items():
                    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    if len(grams):
                        counts = np.bincount(at, weights=np.concatenate([c for _, c in parts]))
                        total[lang] = total.get(lang, 0.0) + encoder.bundle(grams, counts)
        langs = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([x for x in langs for _ in range(size)], pa.string()), pa.array(list(range(size)) * len(langs), pa.int32()), pa.array(np.concatenate([total[x] for x in langs]) if langs else [], pa.float64())], ["lang", "place", "value"])

    known = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    summed = known.mapInArrow(add, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for lang, place, value in summed.collect():
        out.setdefault(lang, np.zeros(size))[place] = value
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 512, width: int = 3) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) of each row."""
    langs = sorted(profiles)
    matrix = np.array([profiles[x] / max(np.linalg.norm(profiles[x]), 1e-12) for x in langs], dtype=np.float32).reshape(len(langs), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(size, width)
        for batch in batches:
            for piece in pieces(batch):
                names, scores = [], []
                for text in piece.column("text").to_pylist():
                    grams, counts, letters = encoder.grams(text or "")
                    if not letters or not langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    bundle = encoder.bundle(grams, counts)
                    cosine = matrix @ bundle / max(float(np.linalg.norm(bundle)), 1e-12)
                    best = int(cosine.argmax())
                    names.append(langs[best])
                    scores.append(min(1.0, max(0.0, float(cosine[best]))))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    """Whether a row's crc32 of the id is 2 modulo 4 (rows without an id are not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; held-out rows are not learned from."""
    profiles = prototypes(bounded(docs).where(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
