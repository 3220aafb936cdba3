"""Words of Arrow string columns, as codes into a dictionary: no Python object is made for a word, only for a distinct one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time; a longer text is taken alone, whole.
SLICE_BYTES = 8 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about SLICE_BYTES of text, so that memory is bounded whatever the texts' lengths."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """codes, offsets and the dictionary: row i has the words dictionary[codes[offsets[i]:offsets[i + 1]]].

    Words are split at space, tab, line feed, vertical tab, form feed and carriage return only; lower changes A-Z only.
    A null text has no words.
    """
    t = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    enc = lists.flatten().dictionary_encode()
    codes, words = enc.indices.to_numpy(zero_copy_only=False), enc.dictionary
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:
        kept = codes != empty
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        codes = codes[kept]
    return codes, offsets, words


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values[offsets[i]:offsets[i + 1]] for each i; 0 for an empty segment."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]
