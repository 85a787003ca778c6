"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here (only the few fields needed) and the
tokenizer is rebuilt from it: normaliser, metaspace marker, pieces with scores
and byte fallback.  A unigram model becomes a Unigram model with its scores.  A
BPE model gets its merges from the pieces: each split of a piece into two pieces
is a merge, ranked by the score of the whole.

Pieces never join across the start of a run of markers (checked when the model is
read), so a text's ids are those of its segments, one after another.  Each task
encodes a distinct segment once, in batches on as many of the library's threads
as Spark gives the task cores (``spark.task.cpus``), and holds it against the
SentencePiece library and against its own decoding.  A model whose pieces do
cross, or whose normaliser does more than mark spaces, has its texts encoded,
checked and decoded whole.

The ids that stand are always the tokenizers library's.  ``parity`` says whether
the SentencePiece library gives the same ones; its ids go nowhere else.

Null text gives null ids; empty text gives none.  ``round_trip`` says whether
decoding gives the text back (a text that holds the marker U+2581 itself cannot).
Texts are never cut: a long one is a batch by itself, and its segments are kept
once.  Other columns, whatever their names, are not read.  No shuffle; each input
row gives one output row, so repeated rows stay apart.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kmerlake.llm.bytewords import pieces
from kmerlake.llm.tables import bounded

_MARK = "▁"
_SEGMENT = re.compile("▁+[^▁]*|[^▁]+")
#: Values fixed by the SentencePiece file format: model kinds and piece kinds.
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + size]
            i += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unknown = _UNIGRAM, 0
        self.charsmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        self.byte_fallback = False
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, _NORMAL)))
            elif number == 2:
                got = dict(_fields(value))
                self.kind, self.byte_fallback, self.unknown = got.get(3, _UNIGRAM), bool(got.get(35, 0)), got.get(40, 0)
            elif number == 3:
                got = dict(_fields(value))
                self.charsmap, self.prefix, self.squeeze, self.escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError(f"model kind {self.kind} is not unigram or BPE")
        self.crosses = any(re.search("[^▁]▁", p) for p, _, k in self.pieces if k in (_NORMAL, _USER))

    def merges(self) -> list[tuple[str, str]]:
        usable = {p: (s, i) for i, (p, s, k) in enumerate(self.pieces) if k in (_NORMAL, _USER)}
        found = []
        for whole, (score, i) in usable.items():
            for cut in range(1, len(whole)):
                a, b = whole[:cut], whole[cut:]
                if a in usable and b in usable:
                    found.append((-score, i, usable[a][1], usable[b][1], a, b))
        return [(a, b) for *_, a, b in sorted(found)]

    def library_model(self, **options):
        """The pieces alone in the tokenizers library."""
        from tokenizers import models

        if self.kind == _BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            return models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, **options)
        return models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)

    def tokenizer(self):
        """The whole of it: normaliser, cuts before runs of markers, pieces, decoder."""
        from tokenizers import Regex, Tokenizer, decoders, normalizers, pre_tokenizers

        out = Tokenizer(self.library_model())
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
        if self.prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", _MARK))
        out.normalizer = normalizers.Sequence(steps)
        if not self.crosses:
            out.pre_tokenizer = pre_tokenizers.Split(Regex("▁+[^▁]*|[^▁]+"), "isolated")
        parts = [decoders.Replace(_MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*parts, decoders.Strip(" ", 1, 0)] if self.prefix else parts)
        return out


class Codec:
    """Encodes and decodes batches and holds each against the SentencePiece library."""

    def __init__(self, model_file: str, most_segments: int = 300_000):
        task = TaskContext.get()
        self.threads = task.cpus() if task else os.cpu_count() or 1
        os.environ.setdefault("RAYON_NUM_THREADS", str(self.threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from sentencepiece import SentencePieceProcessor

        with open(model_file, "rb") as f:
            self.model = Model(f.read())
        self.tokenizer, self.native = self.model.tokenizer(), SentencePieceProcessor(model_file=model_file)
        self.plain = not self.model.crosses and not self.model.charsmap and not self.model.squeeze and self.model.prefix and self.model.escape
        if self.plain:
            from tokenizers import Tokenizer

            self.segment_tokenizer = Tokenizer(self.model.library_model(**({"cache_capacity": 0} if self.model.kind == _BPE else {})))
        self.most = most_segments
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, list[int]] = {}
        self.odd: set[str] = set()  # segments on which the libraries differ
        self.lossy: set[str] = set()  # segments that do not decode to themselves

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[str]]:
        """SentencePiece's ids of each text, ours, and what ours decode to."""
        if self.plain:  # segments, marked here; the library's word cache would be of no use to distinct ones
            got = self.segment_tokenizer.encode_batch_fast([_MARK + t.replace(" ", _MARK) for t in texts], add_special_tokens=False)
        else:
            got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ours = [e.ids if t else [] for e, t in zip(got, texts)]
        want = self.native.encode(texts, num_threads=self.threads)
        # Segments decode one after another, so one call tells whether all come back.
        if self.plain and self.tokenizer.decode(list(chain.from_iterable(ours)), skip_special_tokens=False) == " ".join(texts):
            return want, ours, texts
        return want, ours, self.tokenizer.decode_batch(ours, skip_special_tokens=False)

    @staticmethod
    def segments(text: str) -> list[str]:
        """The segments of a text, each without its first marker and with spaces for the rest."""
        if "  " not in text and _MARK not in text and text[-1:] != " " and text[:1] != " ":
            return text.split(" ") if text else []
        return [(s[1:] if s[0] == _MARK else s).replace(_MARK, " ") for s in _SEGMENT.findall((" " + text).replace(" ", _MARK))] if text else []

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """Ids, agreement and round trip of each text."""
        if not self.plain:
            want, ours, back = self._both(texts)
            return ours, [a == b for a, b in zip(want, ours)], [a == b for a, b in zip(back, texts)]
        cuts = [self.segments(t) for t in texts]
        needed = set().union(*cuts)
        if len(self.ids) > self.most:
            self._forget()
        fresh = [s for s in needed if s not in self.ids and s]
        # Both libraries put one marker before a text, which is the segment's first.
        want, ours, back = self._both(fresh) if fresh else ([], [], [])
        self.ids.update(zip(fresh, ours))
        if want != ours:
            self.odd.update(s for s, a, b in zip(fresh, want, ours) if a != b)
        if back != fresh:
            self.lossy.update(s for s, b in zip(fresh, back) if s != b)
        if "" in needed and "" not in self.ids:  # a marker and nothing else
            self.ids[""] = self.segment_tokenizer.encode(_MARK, add_special_tokens=False).ids
            if self.ids[""] != (self.native.encode(" ")[1:] or self.native.piece_to_id([_MARK])):
                self.odd.add("")
        of = self.ids.__getitem__
        ids = [list(chain.from_iterable(map(of, c))) for c in cuts]
        odd, lossy = self.odd, self.lossy
        return ids, [not odd or odd.isdisjoint(c) for c in cuts], [(not lossy or lossy.isdisjoint(c)) and _MARK not in t for c, t in zip(cuts, texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, parity (SentencePiece gives the same ids) and round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file)
        gc.disable()  # many short lists and no cycles: collections would only walk the caches
        try:
            for batch in batches:
                for piece in pieces(batch, limit=2 << 20):
                    texts = piece.column("text").to_pylist()
                    ids, same, whole = codec.encode([t or "" for t in texts])
                    none = [t is None for t in texts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id"),
                            pa.array([None if x else i for i, x in zip(ids, none)], pa.list_(pa.int32())),
                            pa.array([None if x else len(i) for i, x in zip(ids, none)], pa.int64()),
                            pa.array([None if x else s for s, x in zip(same, none)], pa.bool_()),
                            pa.array([None if x else w for w, x in zip(whole, none)], pa.bool_()),
                        ],
                        ["doc_id", "token_ids", "n_tokens", "parity", "round_trip"],
                    )
        finally:
            gc.enable()

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def decode(tokens: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows with doc_id and token_ids (null ids: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_file)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = part.column("token_ids").to_pylist()
                texts = codec.decode([i or [] for i in ids])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")
