"""Operator 5, packing by order-preserving dynamic programming.

The documents of a partition, in order, are one token stream, taken in blocks of about BLOCK_TOKENS that end with a
document. Windows of at most 4096 tokens are cut at document ends (free), after sentences (a truncation penalty) or, in
spans without either, between any tokens at a fixed step (a larger one). Over a block, padding plus penalties is least:
best[j] = penalty[j] + 4096 - p[j] + min(best[i] + p[i]) over the cuts i within 4096 tokens, a sliding minimum that a
monotone queue gives in constant time. The last window of a block is cut into powers of two, which need no padding, so it
costs nothing but what is before it.

There is no shuffle: a partition's packing needs its own documents only, and a lost task is redone alike. Memory is a batch
and a block, not a partition.

Defined cases: a null or empty text is the end id alone. A document longer than a window fills several, each id in exactly
one piece. Repeated rows, null doc_ids and other columns are packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .arrow_words import text_slices, word_codes
from .common import table

WINDOW = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 20
SENTENCE_PENALTY, SPAN_PENALTY, SPAN_STEP = 16, 48, 64
#: Entries kept of words met before, in each Python worker.
CACHE_WORDS = 300_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*#%&$]*)").fullmatch


class WordIds:
    """Ids of white-space separated words by a tokenizer whose pre-tokenizer never joins what white space parts.

    Words of Latin letters with punctuation after them are cut here into the tokenizer's own pre-tokens, and each distinct
    one goes through its model once; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache: dict[str, tuple[int, ...]] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.bytes = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)}

    def _token(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            shown = piece if piece.isascii() else "".join(map(self.bytes.__getitem__, piece.encode()))
            ids = self.cache[piece] = tuple(t.id for t in self.model.tokenize(shown))
        return ids

    def __call__(self, words: list[str]) -> list[tuple[int, ...]]:
        out, rest, token = [], [], self._token
        for n, w in enumerate(words):
            if m := _PLAIN(w):
                a, b = m.groups()
                out.append(token(a.lower()) + token(b) if b else token(a.lower()))
            else:
                out.append(())
                rest.append(n)
        for n, e in zip(rest, self.whole.encode_batch([words[n] for n in rest], add_special_tokens=False), strict=True):
            out[n] = tuple(e.ids)
        return out


def windows(ends: np.ndarray, marks: np.ndarray) -> list[int]:
    """The window ends of least cost for a stream: ends are the document ends in tokens, marks the sentence ends. The last end
    is the stream's. The cost is the padding of all windows but the last, and the penalties of their ends."""
    total = int(ends[-1])
    at = np.union1d(ends, marks)
    gap = np.diff(np.concatenate(([0], at)))
    wide = np.nonzero(gap > 2 * SPAN_STEP)[0]
    extra = [np.arange(int(at[k] - gap[k]) + SPAN_STEP, int(at[k]), SPAN_STEP) for k in wide]
    cost = np.full(total + 1, -1, np.int16)
    for x in extra:
        cost[x] = SPAN_PENALTY
    cost[marks] = SENTENCE_PENALTY
    cost[ends] = 0
    p = np.nonzero(cost >= 0)[0]
    p = p[p > 0]
    places, pens = [0, *p.tolist()], [0, *cost[p].tolist()]
    before, best = [0] * len(places), [0] * len(places)
    queue = deque([(0, 0, 0)])  # best + place, place, index; values ascend
    for j in range(1, len(places)):
        here = places[j]
        while queue[0][1] < here - WINDOW:
            queue.popleft()
        least = queue[0]
        before[j] = least[2]
        value = pens[j] + WINDOW + least[0]
        best[j] = value - here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    j = len(places) - 1
    near = bisect_left(places, total - WINDOW)
    before[j] = min(range(near, j), key=best.__getitem__)
    cuts = []
    while j:
        cuts.append(places[j])
        j = before[j]
    cuts.reverse()
    return cuts


def cut(ends: np.ndarray, marks: np.ndarray) -> list[int]:
    """The window ends of least cost, the last window cut into powers of two."""
    cuts, tail = windows(ends, marks), []
    start = cuts[-2] if len(cuts) > 1 else 0
    while cuts[-1] > start:
        start += 1 << (cuts[-1] - start).bit_length() - 1
        tail.append(start)
    return cuts[:-1] + tail


def _pack(doc_ids: list, ids: np.ndarray, ends: np.ndarray, marks: np.ndarray, first: int) -> tuple[list[list], int]:
    """The rows of a block, and the number of its sequences."""
    starts = np.concatenate(([0], ends[:-1]))
    windows = np.asarray(cut(ends, marks), np.int64)
    points = np.union1d(windows, ends)
    a = np.concatenate(([0], points[:-1]))
    doc = np.searchsorted(ends, a, side="right")
    seq = np.searchsorted(windows, a, side="right")
    begin = np.concatenate(([0], windows[:-1]))
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), points.tolist(), strict=True)]
    return [[doc_ids[d] for d in doc.tolist()], a - starts[doc], points - a, crc, (ends - starts)[doc], first + seq, a - begin[seq]], len(windows)


def packer(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _encoder
        if _encoder is None or _encoder[0] != path:
            _encoder = path, WordIds(path)
        encode, sequence = _encoder[1], TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        held: list = [[], [], [], [], 0]  # doc ids, id arrays, ends, marks, tokens

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            columns, n = _pack(held[0], np.concatenate(held[1]), np.concatenate(held[2]), np.concatenate(held[3]), sequence)
            sequence += n
            held = [[], [], [], [], 0]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for part in text_slices(batch):
                codes, offsets, dictionary = word_codes(part.column("text"), lower=True)
                words = dictionary.to_pylist()
                ids = encode(words)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                stop = np.fromiter((w[-1] in ".!?" for w in words if w), bool) if "" not in words else np.fromiter((w[-1:] in (".", "!", "?") for w in words), bool, len(words))
                flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
                flat, size, stop = np.append(flat, np.uint32(END_ID)), np.append(size, 1), np.append(stop, False)
                where = np.cumsum(size) - size
                codes = np.insert(codes, offsets[1:], len(words))  # the end id after each document
                offsets = offsets + np.arange(len(offsets))
                count = size[codes]
                token_at = np.concatenate(([0], np.cumsum(count)))
                doc_at = token_at[offsets]
                docs, row = part.column("doc_id").to_pylist(), 0
                while row < len(docs):
                    upto = max(row + 1, int(np.searchsorted(doc_at, doc_at[row] + BLOCK_TOKENS - held[4], side="right")) - 1)
                    x, y = offsets[row], offsets[upto]
                    n = count[x:y]
                    local = token_at[x + 1 : y + 1] - token_at[x]
                    take = np.repeat(where[codes[x:y]] - (local - n), n) + np.arange(int(local[-1]))
                    held[0] += docs[row:upto]
                    held[1].append(flat[take])
                    held[2].append(held[4] + doc_at[row + 1 : upto + 1] - doc_at[row])
                    held[3].append(held[4] + local[stop[codes[x:y]]])
                    held[4] += int(local[-1])
                    row = upto
                    if held[4] >= BLOCK_TOKENS:
                        yield flush()
        if held[4]:
            yield flush()

    return run


_encoder: tuple[str, WordIds] | None = None


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row for each piece: its document's id, its place there, and its sequence and place there."""
    return docs.select("doc_id", "text").mapInArrow(packer(tokenizer_path), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
