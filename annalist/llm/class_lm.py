"""Operator 2, scoring by a class-based bigram model (Brown), its classes found by exchange clustering.

A text's tokens are its words, A-Z lower-cased, and one end. p(text) is the product of p(class | class before) p(word | class);
before the first word stands an end. Every word of the training texts has a class by exchange:

1. the MOST frequent words exchange one after another on the driver, on the matrix of their own bigrams (the start, of a
   bounded size);
2. each other word goes to the class that makes its contexts with clustered words likeliest;
3. all words of the vocabulary, a hashed share of them at a time, move to the class of the greatest gain in likelihood over
   all training bigrams. What such a step changed is taken back if the likelihood fell.

The end has a class of its own, and so has the word never seen. Words seen once stand for it in transitions: as often as such
words follow a class, a new one is taken to. Transitions are smoothed by ADD, words in a class by one; both sum to one.

Nothing that grows with the vocabulary reaches the driver or is broadcast. Texts are coded in blocks, each with its own
dictionary; words are told by their 64-bit hash. In each step a block sends a row for each of its words, with its contexts by
class; rows are sorted by word, summed as they stream by, and the word's class goes back to the blocks that hold it, which
join it to their codes. A word has one row a block at most, so none is hot; what is held is 12 bytes a block for one word.

Defined cases: a null, empty or blank text is its end alone. Without training documents N and V are 0 and every token is
unknown. A null doc_id is not held out. Repeated rows are rows of their own. Other columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_words import segment_sums, text_slices, word_codes
from .common import release, table, tidy, written
from .quality import held_out

MOST, CLASSES = 1024, 24
SWEEPS = 10
#: Steps over the whole vocabulary, each for one hashed share of so many.
SHARES = 2
ADD = 0.5
#: Words of fewer occurrences move by the gain's first order, which for them differs little from the gain.
EXACT = 64
K = CLASSES + 2
UNKNOWN, END = CLASSES, CLASSES + 1
_NONE = 255
_ENTRY = np.dtype([("k", "u1"), ("n", "<u4")])
_FLUSH = 1 << 20
_WIDE = 2 * K + 1

BLOCKS = "block long, doc_ids array<long>, held binary, offsets binary, codes binary, hashes binary"
CHUNK = "block long, idx binary, val binary, a long, b long"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in text_slices(batch):
            codes, offsets, words = word_codes(part.column("text"), lower=True)
            seen = np.bincount(codes, minlength=len(words)) > 0
            to = np.cumsum(seen) - 1
            kept = words.filter(pa.array(seen)).cast(pa.binary()).to_pylist()
            hashes = np.fromiter(map(word_hash, kept), np.uint64, len(kept))
            held = part.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
            planes = 4 if len(kept) >> 24 else 3  # the bytes of codes, lowest first: they pack better so
            raw = [held, offsets.astype("<i8"), to[codes].astype("<i4").view("u1").reshape(-1, 4)[:, :planes].T, hashes.view("<i8")]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], ["block", "doc_ids", "held", "offsets", "codes", "hashes"])
            block += 1


class Block:
    """A block as arrays. Its words are numbers below size; the end is the number size, and follows each text in ids."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], t)
        self.number, at = row["block"], get("offsets", "<i8")
        codes = np.zeros((int(at[-1]), 4), "u1")
        codes[:, : len(row["codes"]) // max(1, int(at[-1]))] = get("codes", "u1").reshape(-1, int(at[-1])).T if at[-1] else 0
        codes = codes.view("<i4").reshape(-1)
        self.hashes = get("hashes", "<i8") if "hashes" in row else None
        self.held = get("held", "u1").astype(bool)
        chunks = sorted(row.get("chunks") or [], key=lambda c: c["kind"])
        self.size = len(self.hashes) if self.hashes is not None else int(codes.max(initial=-1)) + 1
        self.offsets = at + np.arange(len(at))
        self.ids = np.insert(codes, at[1:], self.size)
        self.counts = np.zeros(self.size, np.int64)
        self.group = np.full(self.size + 1, UNKNOWN, np.uint8)
        self.group[-1] = END
        for c in chunks:
            idx = np.frombuffer(c["idx"], "<i4")
            if c["kind"] == 0:
                self.counts[idx] = np.frombuffer(c["val"], "<i8")
            else:
                self.group[idx] = np.frombuffer(c["val"], "u1")
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.offsets[:-1]] = self.size
        self.training = np.repeat(~self.held, np.diff(self.offsets))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1).to_pylist()[0]
            yield row, Block(row)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of each block, with its occurrences in training texts."""
    for _, b in _blocks(batches):
        n = np.bincount(b.ids[b.training], minlength=b.size + 1)[: b.size]
        yield pa.RecordBatch.from_arrays([pa.array(b.hashes), pa.array(np.full(b.size, b.number)), pa.array(np.arange(b.size, dtype=np.int32)), pa.array(n, pa.int64())], ["h", "block", "idx", "n"])


class _Chunks:
    """Values for words of blocks, gathered, and given out by block."""

    def __init__(self, kind: str):
        self.kind, self.rows, self.n = kind, [], 0

    def add(self, block: np.ndarray, idx: np.ndarray, val: np.ndarray) -> pa.RecordBatch | None:
        self.rows.append((block, idx, val.astype(self.kind)))
        self.n += len(idx)
        return self.out() if self.n >= _FLUSH else None

    def out(self) -> pa.RecordBatch:
        block, idx, val = (np.concatenate(x) for x in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64), np.zeros(0, "<i4"), np.zeros(0, self.kind))
        self.rows, self.n = [], 0
        order = np.argsort(block, kind="stable")
        block, idx, val = block[order], idx[order].astype("<i4"), val[order]
        at = np.flatnonzero(np.diff(block, prepend=-1))
        ends = [*at[1:].tolist(), len(block)]
        zero = pa.array(np.zeros(len(at), np.int64))
        parts = [pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), ends, strict=True)], pa.binary()) for x in (idx, val)]
        return pa.RecordBatch.from_arrays([pa.array(block[at], pa.int64()), *parts, zero, zero], ["block", "idx", "val", "a", "b"])


def _facts(block: int, idx: bytes, val: bytes, a: list[int], b: list[int]) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([idx] * n, pa.binary()), pa.array([val] * n, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["block", "idx", "val", "a", "b"])


def _summed(most: int):
    """From rows sorted by word: the count of each word for each block; the totals (block -1) and the most frequent words (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total, distinct = _Chunks("<i8"), 0, 0
        top_h, top_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        carry = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]

        def done(h, block, idx, n):
            nonlocal total, distinct, top_h, top_c
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            c = np.add.reduceat(n, at)
            total, distinct = total + int(c.sum()), distinct + int((c > 0).sum())
            some = c > (top_c.min() if len(top_c) >= most else 0)
            top_h, top_c = np.concatenate((top_h, h[at][some])), np.concatenate((top_c, c[some]))
            best = np.lexsort((top_h, -top_c))[:most]
            top_h, top_c = top_h[best], top_c[best]
            return out.add(block, idx, np.repeat(c, np.diff([*at, len(h)])))

        for batch in batches:
            now = [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(carry, ("h", "block", "idx", "n"), strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            carry = [x[last:] for x in now]
            if last and (chunk := done(*(x[:last] for x in now))):
                yield chunk
        if len(carry[0]) and (chunk := done(*carry)):
            yield chunk
        yield out.out()
        yield _facts(-1, b"", b"", [total], [distinct])
        yield _facts(-2, b"", b"", top_h.tolist(), top_c.tolist())

    return run


def _keyed(keys: np.ndarray) -> pa.RecordBatch:
    k, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _places(hashes: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The place of each hash in top, -1 if it isn't there."""
    order = np.argsort(top)
    at = np.minimum(np.searchsorted(top[order], hashes), max(0, len(top) - 1))
    return np.where(top[order][at] == hashes, order[at], -1) if len(top) else np.full(len(hashes), -1)


def _bigrams(top: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _blocks(batches):
            at = np.append(_places(b.hashes, top), -1)
            v, w = at[b.before[b.training]], at[b.ids[b.training]]
            both = (v >= 0) & (w >= 0)
            yield _keyed(v[both] * MOST + w[both])

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def gains(c: np.ndarray, to: np.ndarray, fro: np.ndarray, own: float, classes: int = CLASSES) -> np.ndarray:
    """What each class adds to the likelihood by a word that c leaves out; to and fro are its neighbours' classes, own its pairs."""
    eye = np.eye(len(c), dtype=bool)
    gain = np.where(eye, 0, _f(c + to[None, :]) - _f(c)).sum(1) + np.where(eye, 0, _f(c + fro[:, None]) - _f(c)).sum(0)
    d, rows, columns = np.diagonal(c), c.sum(1), c.sum(0)
    out_n, in_n = to.sum() + own, fro.sum() + own
    gain = gain + _f(d + to + fro + own) - _f(d) - (_f(rows + out_n) - _f(rows)) - (_f(columns + in_n) - _f(columns))
    return gain[:classes]


def likelihood(c: np.ndarray) -> float:
    """Of class bigrams, up to what doesn't depend on classes."""
    return float(_f(c).sum() - _f(c.sum(0)).sum() - _f(c.sum(1)).sum())


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word; pairs[v, w] counts v before w. Words, in the order given, move to the class that makes the
    class bigrams' likelihood greatest, until none moves or for so many sweeps. It never falls."""
    m = len(pairs)
    group = np.arange(m) % classes
    pairs = pairs.astype(np.float64)
    one = np.zeros((m, classes))
    one[np.arange(m), group] = 1
    c = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            a, own = group[w], pairs[w, w]
            to, fro = np.bincount(group, pairs[w], classes), np.bincount(group, pairs[:, w], classes)
            to[a] -= own
            fro[a] -= own
            c[a, :] -= to
            c[:, a] -= fro
            c[a, a] -= own
            b = int(np.argmax(gains(c, to, fro, own, classes) + 1e-9 * (np.arange(classes) == a)))
            group[w] = b
            c[b, :] += to
            c[:, b] += fro
            c[b, b] += own
            moved += b != a
        if not moved:
            break
    return group


def _tallied(keys: np.ndarray, size: int, bins: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below size, in order, and how often each comes; so many counters at a time."""
    out = []
    for a in range(0, size, bins):
        some = keys if size <= bins else keys[(keys >= a) & (keys < a + bins)]
        n = np.bincount(some - a)
        k = np.flatnonzero(n)
        out.append((k + a, n[k]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (keys, keys)


def _contexts(top: np.ndarray | None, top_group: np.ndarray | None, share: int, shares: int):
    """A row for each word of the share in each block: its class, training occurrences, and neighbours by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _blocks(batches):
            group = b.group
            if top is not None:
                at = _places(b.hashes, top)
                group = np.append(np.where(at >= 0, top_group[at], _NONE), END).astype(np.uint8)
            mine = np.append(b.hashes.view(np.uint64) % np.uint64(shares) == share, False)
            v, w = b.before[b.training].astype(np.int64), b.ids[b.training].astype(np.int64)
            gv, gw = group[v], group[w]
            left, right = mine[w] & (gv != _NONE), mine[v] & (gw != _NONE)
            if top is not None:
                left, right = left & (gv != END), right & (gw != END)
            count = np.bincount(w, minlength=b.size + 1)
            keys = np.concatenate((w[left] * _WIDE + gv[left], v[right] * _WIDE + K + gw[right], v[mine[v] & (v == w)] * _WIDE + 2 * K))
            del v, w, gv, gw, left, right
            keys, n = _tallied(keys, b.size * _WIDE)
            word = keys // _WIDE
            entries = np.empty(len(keys), _ENTRY)
            entries["k"], entries["n"] = keys - word * _WIDE, n
            some = np.flatnonzero(mine[:-1])
            ends = np.searchsorted(word, some, side="right")
            binary = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.concatenate(([0], ends * _ENTRY.itemsize)).astype(np.int32)), pa.py_buffer(entries.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes[some]), pa.array(np.full(len(some), b.number)), pa.array(some.astype(np.int32)), pa.array(group[some].astype(np.int16)), pa.array(count[some], pa.int64()), binary], ["h", "block", "idx", "own", "n", "near"])

    return run


_NEAR = "h long, block long, idx int, own short, n long, near binary"


def chosen(c: np.ndarray, near: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class of the greatest gain for words with the contexts near (left classes, right classes, own pairs) and classes own.

    c counts class bigrams with all words where they are. A word without a class (_NONE) isn't in c.
    """
    fro, to = near[:, :K].copy(), near[:, K : 2 * K].copy()
    rows, columns = np.maximum(c.sum(1), 1), np.maximum(c.sum(0), 1)
    log = np.log(np.maximum(c, 0.5))
    value = fro @ log + to @ log.T - fro.sum(1)[:, None] * np.log(columns) - to.sum(1)[:, None] * np.log(rows)
    has = np.flatnonzero(own < CLASSES)
    a, x, y = own[has].astype(np.int64), fro[has], to[has]
    value[has, a] = (
        (x * np.log(np.maximum(c[:, a].T - x, 0.5))).sum(1) + (y * np.log(np.maximum(c[a] - y, 0.5))).sum(1)
        - x.sum(1) * np.log(np.maximum(columns[a] - x.sum(1), 1)) - y.sum(1) * np.log(np.maximum(rows[a] - y.sum(1), 1))
    )
    value = value[:, :CLASSES]
    best = np.argmax(value + 1e-9 * (np.arange(CLASSES) == own[:, None]), axis=1)
    for n in has[near[has, :K].sum(1) >= EXACT]:
        a, self_, m = int(own[n]), near[n, 2 * K], c.copy()
        x, y = fro[n].copy(), to[n].copy()
        x[a] -= self_
        y[a] -= self_
        m[a] -= y
        m[:, a] -= x
        m[a, a] -= self_
        best[n] = np.argmax(gains(m, y, x, self_) + 1e-9 * (np.arange(CLASSES) == a))
    return best


def _moved(c: np.ndarray, first: bool):
    """From rows sorted by word: its new class for each block that holds it, if it is new; and how many words each class gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kinds = _Chunks("u1"), np.zeros(K, np.int64)
        h, near, n, own = np.zeros(0, np.int64), np.zeros((0, _WIDE)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        where: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the words of h: word, block, idx

        def done(upto: int):
            nonlocal h, near, n, own, where
            new = chosen(c, near[:upto], own[:upto])
            bare = near[:upto].sum(1) == 0
            new = np.where(bare, np.where(own[:upto] < CLASSES, own[:upto], h[:upto].view(np.uint64) % np.uint64(CLASSES)), new).astype(np.int64)
            if first:
                new = np.where(own[:upto] < CLASSES, own[:upto], new)
            known = n[:upto] > 0
            kinds[:] += np.bincount(new[known], minlength=K)
            if not first:
                kinds[:] -= np.bincount(own[:upto][known], minlength=K)
            tell = known & (first | (new != own[:upto]))
            word, block, idx = (np.concatenate(x) for x in zip(*where, strict=True))
            ready = word < upto
            some = ready & tell[np.minimum(word, upto - 1)]
            where = [(word[~ready] - upto, block[~ready], idx[~ready])]
            chunk = out.add(block[some], idx[some], new[word[some]])
            h, near, n, own = h[upto:], near[upto:], n[upto:], own[upto:]
            return chunk

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("h").to_numpy()
            fresh = np.concatenate(([not len(h) or x[0] != h[-1]], x[1:] != x[:-1]))
            word = np.cumsum(fresh) - 1 + len(h)
            more = int(fresh.sum())
            h = np.concatenate((h, x[fresh]))
            own = np.concatenate((own, batch.column("own").to_numpy()[fresh]))
            n = np.concatenate((n, np.zeros(more, np.int64)))
            np.add.at(n, word, batch.column("n").to_numpy())
            column = batch.column("near")
            entries = np.frombuffer(b"".join(column.to_pylist()), _ENTRY)
            of = np.repeat(word, pc.binary_length(column).to_numpy() // _ENTRY.itemsize)
            base = len(h) - more - (not fresh[0])
            added = np.bincount((of - base) * _WIDE + entries["k"], entries["n"], (len(h) - base) * _WIDE).reshape(-1, _WIDE)
            near = np.concatenate((near, np.zeros((more, _WIDE))))
            near[base:] += added
            where.append((word, batch.column("block").to_numpy(), batch.column("idx").to_numpy()))
            if len(h) > 1 and (chunk := done(len(h) - 1)):
                yield chunk
        if len(h) and (chunk := done(len(h))):
            yield chunk
        yield out.out()
        yield _facts(-1, b"", b"", list(range(K)), kinds.tolist())

    return run


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigrams; then the classes before, and those after, words that occur once."""
    for _, b in _blocks(batches):
        v, w = b.before[b.training], b.ids[b.training]
        once = np.append(b.counts == 1, False)
        g = b.group.astype(np.int64)
        yield _keyed(np.concatenate((g[v] * K + g[w], K * K + g[v[once[w]]], K * K + K + g[w[once[v]]])))


@dataclass
class Model:
    n: int  # training tokens
    v: int  # distinct
    docs: int
    transition: np.ndarray  # log10
    within: np.ndarray  # by class, log10 of what a word's count plus one is divided by
    blocks: DataFrame
    chunks: list[tuple[int, DataFrame]]
    steps: list[float] = field(default_factory=list)  # the likelihood by classes after each step


def _met(blocks: DataFrame, chunks: list[tuple[int, DataFrame]]) -> DataFrame:
    """blocks with the chunks of their words."""
    rows = None
    for kind, t in chunks:
        x = t.where("block >= 0").select("block", F.struct(F.lit(kind).alias("kind"), "idx", "val").alias("x"))
        rows = x if rows is None else rows.unionByName(x)
    return blocks.join(rows.groupBy("block").agg(F.collect_list("x").alias("chunks")), "block", "left")


def _by_word(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h")


def _total(rows: DataFrame, size: int) -> np.ndarray:
    with tidy(rows.sparkSession):
        found = rows.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, most: int = MOST, shares: int = SHARES) -> Model:
    """docs has doc_id, text and held_out; the model learns from the others. At most MOST words start the exchange."""
    most = min(most, MOST)
    blocks = written(docs.select("doc_id", "text", "held_out").mapInArrow(_coded, BLOCKS), "blocks")
    plain = blocks.select("block", "held", "offsets", "codes", "hashes")
    counted = written(_by_word(plain.mapInArrow(_tally, "h long, block long, idx int, n long")).mapInArrow(_summed(most), CHUNK), "counts")
    n_docs = docs.where("not held_out").count()
    totals = counted.where("block = -1").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    top = counted.where("block = -2").orderBy(F.col("b").desc(), "a").limit(most).toArrow()["a"].to_numpy()
    pairs = _total(plain.mapInArrow(_bigrams(top), "key long, n long"), MOST * MOST).reshape(MOST, MOST)[: len(top), : len(top)]
    group = exchange(pairs)
    one = np.zeros((len(top), K))
    one[np.arange(len(top)), group] = 1
    near = plain.mapInArrow(_contexts(top, group, 0, 1), _NEAR)
    placed = written(_by_word(near).mapInArrow(_moved(one.T @ pairs @ one, True), CHUNK), "placed")
    chunks = [(0, counted), (1, placed)]

    def counts() -> np.ndarray:
        return _total(_met(plain.select("block", "held", "offsets", "codes"), chunks).mapInArrow(_transitions, "key long, n long"), K * K + 2 * K)

    c, steps = counts(), []
    steps.append(likelihood(c[: K * K].reshape(K, K)))
    for share in range(shares):
        near = _met(plain, chunks[1:]).mapInArrow(_contexts(None, None, share, shares), _NEAR)
        moved = written(_by_word(near).mapInArrow(_moved(c[: K * K].reshape(K, K), False), CHUNK), "moved")
        chunks.append((len(chunks), moved))
        now = counts()
        if likelihood(now[: K * K].reshape(K, K)) < steps[-1]:
            release(chunks.pop()[1])
        else:
            c = now
            steps.append(likelihood(c[: K * K].reshape(K, K)))
    kinds = np.zeros(K)
    for _, t in chunks[1:]:
        for r in t.where("block = -1").groupBy("a").agg(F.sum("b").alias("b")).collect():
            kinds[r.a] += r.b
    transition, size = smoothed(c)
    with np.errstate(divide="ignore"):
        within = np.where(size + kinds > 0, np.log10(np.maximum(size + kinds, 1)), 0.0)
    within[[UNKNOWN, END]] = 0
    return Model(totals[0] + n_docs, totals[1] + (n_docs > 0), n_docs, np.log10(transition), within, blocks, chunks, steps)


def smoothed(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of a class by the one before, and the tokens of each class, from what ``_transitions`` counts."""
    pairs, after, follow = c[: K * K].reshape(K, K), c[K * K : K * K + K], c[K * K + K :]
    t = pairs + ADD
    t[:, UNKNOWN] = after + ADD
    t[UNKNOWN] = follow + ADD
    t[UNKNOWN, UNKNOWN] = follow.sum() * after.sum() / max(1.0, pairs.sum()) + ADD
    return t / t.sum(1, keepdims=True), pairs.sum(0)


def _scorer(transition: np.ndarray, within: np.ndarray, below: float, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, b in _blocks(batches):
            g = b.group.astype(np.int64)
            more = np.append(np.log10(b.counts + 1), np.log10(ends + 1))
            emission = more - within[g]
            emission[-1] = 0
            known = np.append(b.counts > 0, ends > 0).astype(np.float64)
            own = transition[g[b.before], g[b.ids]] + emission[b.ids]
            arrays = [pa.array(np.diff(b.offsets), pa.int64()), pa.array(segment_sums(known[b.ids], b.offsets).astype(np.int64)), pa.array(segment_sums(more[b.ids] - below, b.offsets)), pa.array(segment_sums(own, b.offsets))]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(b.held), *arrays], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def word_classes(model: Model) -> DataFrame:
    """h (the word's XXH64), class and c for each training word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes), pa.array(b.group[:-1].astype(np.int32)), pa.array(b.counts)], ["h", "class", "c"])

    return _met(model.blocks.select("block", "held", "offsets", "codes", "hashes"), model.chunks).mapInArrow(run, "h long, class int, c long").where("c > 0").distinct()


def score_texts(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    m = fit(docs.select("doc_id", "text", held_out(F.col("doc_id"), folds, fold).alias("held_out")))
    below = float(np.log10(m.n + m.v + 1))
    each = _met(m.blocks.drop("hashes"), m.chunks).mapInArrow(_scorer(m.transition, m.within, below, m.docs), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
