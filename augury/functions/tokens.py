"""Words of many texts at once, inside tasks: Arrow columns in, Arrow columns out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at a time; a longer text is cut alone.
BYTES = 1 << 23
WORD = np.zeros(256, bool)
WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _ends(texts: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(texts.type)
    return np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]


def words_of(texts: pa.Array) -> pa.ListArray:
    """The words of lower-cased texts, none of them null: what ``functions.text.words`` gives for each."""
    ends = _ends(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kept = WORD[data]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    begin = ends[:-1][ends[:-1] < len(data)]
    first[begin] = kept[begin]  # no word goes on in the next text
    starts = np.flatnonzero(first)
    letters = np.cumsum(kept, dtype=np.int32)
    at = np.append(letters[starts] - 1, letters[-1:]).astype(np.int32) if len(starts) else np.zeros(1, np.int32)
    said = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[kept]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends), pa.int32()), said)


def worded(batches: Iterator[pa.RecordBatch], size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Of batches of a column and lower-cased texts, some MB at a time: the column and the words of each text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends, i = _ends(b.column(1)), 0
        while i < b.num_rows:
            j = max(int(np.searchsorted(ends, ends[i] + size, "right")) - 1, i + 1)
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([part.column(0), words_of(part.column(1))], [b.schema.names[0], "words"])
            i = j


def pairs_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of ``group, words``: ``group, gram, n``, how many texts of a group and batch hold a run of two words, so that a run is sent once
    for many texts."""
    for b in batches:
        sizes = np.diff(b.column(1).offsets.to_numpy())
        said, groups = b.column(1).flatten().dictionary_encode(), b.column(0).dictionary_encode("encode")
        row, code = np.repeat(np.arange(b.num_rows), sizes), said.indices.to_numpy().astype(np.int64)
        inside = row[1:] == row[:-1]
        pair, row = (code[:-1] * len(said.dictionary) + code[1:])[inside], row[:-1][inside]
        if not len(pair):
            continue
        order = np.argsort(pair, kind="stable")  # rows ascend within a pair
        pair, row = pair[order], row[order]
        other = np.concatenate([[True], pair[1:] != pair[:-1]])
        once = other.copy()
        once[1:] |= row[1:] != row[:-1]
        nth, pair = np.cumsum(other) - 1, pair[other]
        keys, n = np.unique((nth * len(groups.dictionary) + groups.indices.to_numpy()[row])[once], return_counts=True)
        nth, group = np.divmod(keys, len(groups.dictionary))
        a, z = (said.dictionary.take(pa.array(x)) for x in np.divmod(pair[nth], len(said.dictionary)))
        yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(group)), pc.binary_join_element_wise(a, z, " "), pa.array(n, pa.int64())], [b.schema.names[0], "gram", "n"])
