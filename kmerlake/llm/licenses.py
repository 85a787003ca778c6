"""License scans: exact phrases and fuzzy short notices.

Texts are normalised to words (A-Z in lower case, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
with single spaces between.  The base looks for fixed phrases of whole words.

The method looks for short notices with up to ``k`` edits of characters.  A
notice is split into ``k + 1`` pieces; by the pigeonhole principle a place with
at most ``k`` edits holds one of them unchanged.  One Aho-Corasick automaton
finds the pieces of all notices in one reading of the text, each gives the
window in which its notice could stand, and the regex library's bounded-error
matching tells whether it does, with how many edits and where.

Null text counts as empty; each input row gives one output row, so repeated rows
stay apart; no shuffle.  Texts are read whole, a long one as a batch by itself.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from kmerlake.llm.bytewords import NONALNUM, Words, pieces
from kmerlake.llm.decontam import normal_words
from kmerlake.llm.tables import bounded


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int


#: The base's phrases and labels, fixed values.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Short notices of common licenses, normalised.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("apache-2", "licensed under the apache license version 2 0", 4),
    Notice("cc-by-nc", "licensed under cc by nc", 2),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 7),
    Notice("mpl-2", "subject to the terms of the mozilla public license", 4),
    Notice("cc-by", "licensed under a creative commons attribution", 4),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
    Notice("all-rights-reserved", "all rights reserved", 1),
)


class Finder:
    """Finds notices in normalised texts."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.forms = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.text)}){{e<={n.edits}}}(?![^ ])") for n in notices]
        self.automaton = ahocorasick.Automaton()
        for i, n in enumerate(notices):
            cuts = np.linspace(0, len(n.text), n.edits + 2).round().astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                piece = n.text[a:b]
                of = self.automaton.get(piece, [])
                of.append((i, a, len(piece)))
                self.automaton.add_word(piece, of)
        self.automaton.make_automaton()

    def windows(self, line: str) -> dict[int, list[list[int]]]:
        """For each notice the merged stretches of a text in which it could stand."""
        out: dict[int, list[list[int]]] = {}
        for end, of in self.automaton.iter(line):
            for i, offset, size in of:
                n = self.notices[i]
                a = max(0, end + 1 - size - offset - n.edits - 1)
                b = min(len(line), end + 1 - size - offset + len(n.text) + n.edits + 1)
                own = out.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        return out

    def find(self, line: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices in a normalised text, ordered."""
        found = set()
        for i, stretches in self.windows(line).items():
            for a, b in stretches:
                for m in self.places(i, line, a, b):
                    found.add((m.start(), m.end(), self.notices[i].label, sum(m.fuzzy_counts)))
        return sorted(found)

    def places(self, i: int, line: str, a: int, b: int) -> list:
        """The matches of a notice in a stretch: the best, then those of the parts before and behind it, until none is left."""
        out, parts = [], [(a, b)]
        while parts:
            a, b = parts.pop()
            m = self.forms[i].search(line, a, b) if a < b else None
            if m and m.end() > m.start():
                out.append(m)
                parts += [(a, m.start()), (m.end(), b)]
        return out


def phrase_places(line: str, phrase: str) -> list[int]:
    """Character positions where the phrase's words stand in a text with a blank at either end."""
    out, needle = [], f" {phrase} "
    at = line.find(needle)
    while at >= 0:
        out.append(at)
        at = line.find(needle, at + 1)
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64())]))


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``score`` is 1 for a text with a base phrase, else the best notice's share of
    characters without edits, else 0.  ``spans`` are the notices as character
    positions of the original text, end exclusive, with label and edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices)
        full = {label: max(len(n.text) for n in notices if n.label == label) for label in {n.label for n in notices}}
        for batch in batches:
            for piece in pieces(batch):
                out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
                for row, text in enumerate(piece.column("text").to_pylist()):
                    words = normal_words(text)
                    # Bytes as Latin-1: one character per byte, and all patterns are ASCII.
                    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
                    places = {label: phrase_places(line, phrase) for label, phrase in PHRASES}
                    at = [p for own in places.values() for p in own]
                    hits = finder.find(line)
                    base = sorted(k for k, own in places.items() if own)
                    out["n_words"].append(len(words))
                    out["n_base"].append(len(at))
                    out["first_word"].append(line.count(" ", 0, min(at)) if at else None)
                    out["last_word"].append(line.count(" ", 0, max(at)) if at else None)
                    out["base_labels"].append(",".join(base))
                    out["labels"].append(",".join(sorted({*base, *(h[2] for h in hits)})))
                    out["score"].append(1.0 if at else max((1 - h[3] / max(h[1] - h[0], full[h[2]] // 2, 1) for h in hits), default=0.0))
                    out["spans"].append(original_spans(piece.column("text").slice(row, 1), line, hits) if hits else [])
                kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:bigint,end:bigint,label:string,edits:bigint>>"
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def original_spans(text: pa.Array, line: str, hits: list[tuple[int, int, str, int]]) -> list[dict]:
    """Stretches of a normalised text as character positions of the original one."""
    words = Words(text, NONALNUM, lower=True)
    chars = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    out = []
    for start, end, label, edits in hits:
        first = min(line.count(" ", 0, start + (line[start] == " ")) - 1, len(words) - 1)
        last = min(line.count(" ", 0, end - (line[end - 1] == " ")) - 1, len(words) - 1)
        out.append({"start": int(chars[words.starts[max(first, 0)]]), "end": int(chars[words.ends[max(last, 0)]]), "label": label, "edits": edits})
    return out
