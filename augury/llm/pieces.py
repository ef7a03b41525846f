"""SentencePiece encoding and decoding over a table of distinct marked words.

SentencePiece turns each space into the marker ``▁`` and, in a model none of whose pieces has a marker
behind another character, merges never cross from the end of one marked word into the next. So a text is
a row of marked words (``▁+[^▁]*``) that can be segmented one by one: each distinct one of a task goes
through the library once, and ids and decoded text are joined back by position. Whether the model has the
property is checked when it is loaded; one without it is encoded text by text.

Rows: null text counts as empty (no ids, empty decoded text); very long texts are handled whole; repeated
rows give repeated results; other columns pass through untouched unless they carry an output's name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

MARK = "▁"
#: Entries of the table in one Python worker; beyond it starts anew (memory, not results).
TABLE_ENTRIES = 300_000
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def marked_words(text: str) -> list[str]:
    """The keys of a text's marked words: the word without one marker, further markers as spaces."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        found = _WORDS.findall(MARK + text.replace(" ", MARK))
        return [w[1:].replace(MARK, " ") for w in found]
    return text.split(" ")


class PieceTable:
    """Distinct marked word -> its ids (as int32 bytes) and its decoded text."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = map(self.sp.id_to_piece, range(self.sp.vocab_size()))
        self.separable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.alone = self.sp.piece_to_id(MARK)
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def fill(self, keys: set[str]) -> None:
        if len(self.ids) + len(keys) > TABLE_ENTRIES:
            self.ids.clear()
            self.texts.clear()
        new = [k for k in keys if k not in self.ids]
        encoded = self.sp.encode(new, num_threads=1)
        encoded = [e if k else [self.alone] for k, e in zip(new, encoded, strict=True)]
        self.texts.update(zip(new, self.sp.decode(encoded, num_threads=1), strict=True))
        self.ids.update(zip(new, (np.array(e, np.int32).tobytes() for e in encoded), strict=True))

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        if not self.separable:
            encoded = self.sp.encode(texts, num_threads=1)
            return [np.array(e, np.int32).tobytes() for e in encoded], self.sp.decode(encoded, num_threads=1)
        words = [marked_words(t) for t in texts]
        self.fill(set().union(*words))
        return ([b"".join(map(self.ids.__getitem__, w)) for w in words],
                [" ".join(map(self.texts.__getitem__, w)) for w in words])


def encode_decode(df: DataFrame, model: str, *, text_col: str = "text", ids_col: str = "ids",
                  decoded_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all but the text, unless given) with the ids of the whole text and what they decode to."""
    keep = [c for c in (keep or df.columns) if c not in (text_col, ids_col, decoded_col)]
    given = df.select(*(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(text_col), F.lit("")).alias(unused(df, "_text")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]),
                        f"`{ids_col}` array<int>", f"`{decoded_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceTable(model)
        names = [*keep, ids_col, decoded_col]
        for part in slices(batches):
            ids, texts = pieces(part.column(len(keep)).to_pylist())
            ends = np.cumsum([0, *(len(b) // 4 for b in ids)])
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(texts, pa.string())], names=names)

    return given.mapInArrow(run, schema)
