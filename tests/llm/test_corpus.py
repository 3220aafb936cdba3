"""The corpus operators: brute force on small fixtures, and the defined cases for nulls, empty and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from annalist.llm import class_lm, fingerprints, graph, hamming, html_text, line_dedup, mixing, near_dedup, packing, quality, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, fp long, score string, row long, taken string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x", 3, "y") for i, t, s in rows], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    w = ["".join(rng.choice(["an", "th", "re", "ou", "in", "ed"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    return " ".join(rng.choice(w) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 9000)
    a, b = prose(2, 200), prose(3, 120)
    return [(1, a, "s1"), (2, b, "s2"), (3, a, "s1"), (4, "", "s1"), (5, None, None), (None, b + " more", "s2"), (6, "one", "s3"), (7, " \t two  words\n", "s3"), (8, long, "s1"), (1, a, "s1"), (9, "\x0b", "s2"), (10, a + " " + b, ""), (11, "é ß Ω! <|x|> 12's don't", "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_near_dedup(spark, docs, rows, none):
    found = near_dedup.near_groups(docs).collect()
    got = {(r.doc_id, r.th): r for r in found}
    assert len(found) == len(rows) and len(got) == len(set((i, t or "") for i, t, _ in rows))
    fp = {}
    for i, t, _ in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        s = [" ".join(w[n : n + 3]) for n in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fp[i, t or ""] = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    every = Counter((i, t or "") for i, t, _ in rows)
    linked = lambda f: [j for j, g in fp.items() if bin(f ^ g).count("1") <= 2]
    for (i, t), f in fp.items():
        r = next(r for (d, _), r in got.items() if d == i and r.fp % (1 << 64) == f)
        assert r.n_near == sum(every[j] for j in linked(f)) - 1
        seen, todo = set(), [(i, t)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += linked(fp[x])
        assert r.component_id == min((d for d, _ in seen if d is not None), default=None)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 3 not in ids and sum(i in (4, 5, 9) for i in ids) == 1 and 4 in ids
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.deduplicate(none).count() == 0


def test_linked_pairs_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(60)} | {0, 2**64 - 1, 1, 3}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in fps], "fp long")
    got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in near_dedup.linked_pairs(df).collect()}
    dist = lambda a, b: bin(a ^ b).count("1")
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in fps for b in fps if a != b and dist(a, b) <= 2}
    assert len(got) == len({frozenset(p) for p in got})
    three = {frozenset((a, b)) for a in fps for b in fps if a != b and dist(a, b) <= 3}
    found = fingerprints.near_pairs(df, 3).collect()
    assert {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in found} == three and len(found) == len(three)
    assert all(r.distance == dist(r.a % (1 << 64), r.b % (1 << 64)) for r in found)
    monkeypatch.setattr(hamming, "HOT_KEY", 3)  # most keys are hot now
    for got in (fingerprints.near_pairs(df, 3), fingerprints.near_pairs(df, 3, 5)):
        assert {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in got.collect()} == three
    got = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in near_dedup.linked_pairs(df).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a != b and dist(a, b) <= 2}


def test_components(spark):
    rng = random.Random(1)
    edges = [(n, n + 1) for n in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (None, 4), (5, 6), (6, 7), (5, 7)] + [(500, rng.randrange(501, 540)) for _ in range(60)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {len({got[x] for x in g}) for g in (range(100, 161), (1, 2), (5, 6, 7))} == {1}
    assert len(set(got.values())) == 4 and 3 not in got and 4 not in got
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fingerprints(spark, docs, rows, none):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    for n, (i, t) in enumerate(order):
        k = len(t) // 3
        edits = hashlib.sha256((t[: len(t) - k] + order[(n + 1) % len(order)][1][:k]).encode()).hexdigest()
        assert any(r.doc_id == i and r.edited_sha256 == edits and r.n_chars == len(t) for r in got)
    def bits(t):
        w = [x.encode() for x in words(t)]
        h = [xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(w, w[1:])] if len(w) > 1 else [xxhash.xxh64_intdigest(x, 42) for x in w]  # noqa: B905
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    alike = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    for n, (i, t) in enumerate(order):
        after, k = order[(n + 1) % len(order)][1], len(t) // 3
        f, e = bits(t), bits(t[: len(t) - k] + after[:k])
        assert any(r.doc_id == i and r.fp % (1 << 64) == f and r.edited_fp % (1 << 64) == e and r.near_edited == alike(f, e) and r.near_next == alike(f, bits(after)) for r in got)
    n_near = {r.fp % (1 << 64): r.n_near for r in fingerprints.near_counts(fingerprints.fingerprint_edits(docs).select("fp")).collect()}
    fps = [bits(t) for _, t in order]
    assert n_near == {f: sum(bin(f ^ g).count("1") <= fingerprints.RADIUS for g in fps) - 1 for f in fps}
    same = {r.fp for r in got if r.doc_id in (1, 3)}
    assert len(same) == 1 and {r.fp for r in got if r.doc_id in (4, 5, 9)} == {0}
    assert fingerprints.fingerprint_edits(none).count() == 0
    fingerprints.RANGE_ROWS, old = 3, fingerprints.RANGE_ROWS
    try:
        again = fingerprints.fingerprint_edits(docs).collect()
    finally:
        fingerprints.RANGE_ROWS = old
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_fingerprint_order_spreads_ties(spark, monkeypatch):
    """Rows that share a doc_id, or have none, are cut by text hash, and the order over all ranges is one cycle."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    rng = random.Random(5)
    rows = [(rng.choice([7, 7, 7, None, n]), f"text {n % 90} " * 3, "s") for n in range(120)]
    d = fingerprints.in_descending_order(make(spark, rows)).collect()
    assert len(d) == len(rows) and len({r["_bucket"] for r in d if r.doc_id is None}) > 1 and len({r["_bucket"] for r in d if r.doc_id == 7}) > 1
    d.sort(key=lambda r: (r["_bucket"], r["_rank"]))
    assert all(x["_next"] == y.text for x, y in zip(d, d[1:] + d[:1], strict=True))
    ids = [r.doc_id for r in d]
    assert ids == sorted(ids, key=lambda i: (i is None, -(i or 0)))


def test_class_lm(spark, docs, rows, none):
    got = class_lm.score_texts(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    low = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t, _ in rows if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, len(low(t)), sum(c[w] > 0 for w in low(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(t)), 6)) for i, t, _ in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert class_lm.score_texts(none).count() == 0
    alone = make(spark, [(n, t, "s") for n, t in enumerate(["a b", None]) if zlib.crc32(str(n).encode()) % 7 == 2] or [(9, "a b", "s")])
    assert class_lm.score_texts(alone).count() == 1


@pytest.mark.parametrize("slice_bytes", [300, 8 << 20])
def test_class_lm_is_the_sequential_model(spark, monkeypatch, slice_bytes):
    """Every training word has a class, scores are those of a plain model with these classes, and it sums to one."""
    rng = random.Random(3)
    kinds = [[f"{k}{n}" for n in range(30)] for k in "xyz"]
    texts = [" ".join(rng.choice(kinds[p % 3]) for p in range(rng.randrange(3, 40))) for _ in range(120)] + ["new words x1 y2", "", "x1 X1 x1"]
    docs = make(spark, [(n, t, "s") for n, t in enumerate(texts)]).repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    monkeypatch.setattr(class_lm, "text_slices", lambda b, c="text": (b.slice(k, 9) for k in range(0, b.num_rows, 9)) if slice_bytes < 1000 else iter([b]))
    m = class_lm.fit(docs.select("doc_id", "text", class_lm.held_out(F.col("doc_id"), 7, 2).alias("held_out")), most=12)
    by = {r.h % (1 << 64): (r["class"], r.c) for r in class_lm.word_classes(m).collect()}
    train = [t.lower().split() for n, t in enumerate(texts) if not held(n)]
    c = Counter(w for t in train for w in t)
    group = {w: by[class_lm.word_hash(w.encode())][0] for w in c}
    assert len(by) == len(c) and all(by[class_lm.word_hash(w.encode())][1] == n for w, n in c.items())
    assert all(0 <= g < class_lm.CLASSES for g in group.values())
    assert m.steps == sorted(m.steps)
    k, u, end = class_lm.K, class_lm.UNKNOWN, class_lm.END
    pairs, after, follow = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in train:
        seq = [(None, end), *((w, group[w]) for w in t), (None, end)]
        for (v, a), (w, b) in zip(seq, seq[1:]):  # noqa: B905
            pairs[a, b] += 1
            after[a] += c[w] == 1
            follow[b] += c[v] == 1
    trans = pairs + class_lm.ADD
    trans[:, u], trans[u] = after + class_lm.ADD, follow + class_lm.ADD
    trans[u, u] = follow.sum() * after.sum() / pairs.sum() + class_lm.ADD
    trans /= trans.sum(1, keepdims=True)
    size = Counter()
    for w, n in c.items():
        size[group[w]] += n + 1
    for before in range(k):
        total = trans[before, u] + trans[before, end] + sum(trans[before, group[w]] * (n + 1) / size[group[w]] for w, n in c.items())
        empty = sum(trans[before, g] for g in range(class_lm.CLASSES) if not size[g])
        assert total + empty == pytest.approx(1)
    got = {r.doc_id: r.score for r in class_lm.score_texts(docs).collect()} if slice_bytes > 1000 else None
    if got:
        m2 = class_lm.fit(docs.select("doc_id", "text", class_lm.held_out(F.col("doc_id"), 7, 2).alias("held_out")))
        by = {r.h % (1 << 64): r["class"] for r in class_lm.word_classes(m2).collect()}
        group = {w: by[class_lm.word_hash(w.encode())] for w in c}
        assert len({tuple(sorted({group[w] for w in ws if w in group})) for ws in kinds}) == 3
    each = class_lm._met(m.blocks.drop("hashes"), m.chunks).mapInArrow(class_lm._scorer(m.transition, m.within, 1.0, m.docs), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").collect()
    group = {w: class_lm.word_hash(w.encode()) for w in c}
    cls = {r.h % (1 << 64): r["class"] for r in class_lm.word_classes(m).collect()}
    for r in each:
        seq = [end, *(cls[group[w]] if w in c else u for w in texts[r.doc_id].lower().split()), end]
        want = sum(math.log10(trans[a, b]) for a, b in zip(seq, seq[1:]))  # noqa: B905
        want += sum(math.log10((c[w] + 1) / size[cls[group[w]]]) for w in texts[r.doc_id].lower().split() if w in c)
        assert r.score == pytest.approx(want)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 60)
    follow = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.8, 0.1, 0.1]])
    pairs = rng.poisson(5 * follow[truth][:, truth])
    g = class_lm.exchange(pairs, 3)
    assert len({(a, b) for a, b in zip(truth, g, strict=True)}) == 3  # the planted classes


def test_line_dedup(spark, none):
    p = "This passage has a number of words that somebody wrote down once. It goes on for another sentence of a similar length here. And then a third one ends the passage that all of the documents share."
    own = [prose(40 + n, 60) + "." for n in range(4)]
    rows = [(3, f"{own[0]} {p} tail of three. {own[3]}", "s"), (1, f"{own[1]}\n{p}\nend", "s"), (2, p + "\n" + own[2], "s"), (4, "Too short. Too short.", "s"), (5, None, "s"), (6, "", "s"), (7, own[0] + " nothing else", "s"), (None, p, "s")]
    d = line_dedup.dedup_lines(make(spark, rows))
    assert d.columns[:10] == make(spark, rows).columns
    got = {r.doc_id: r for r in d.collect()}
    assert got[1].text == rows[1][1] and got[1].n_removed == 0
    assert "third one ends" not in got[2].text and own[2] in got[2].text
    assert "third one ends" not in got[3].text and "tail of three" in got[3].text
    assert got[4].text == rows[3][1] and got[5].text is None and got[6].text == "" and got[None].text == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(2)
    coded = lambda t: line_dedup._hashed(line_dedup.pa.array([t], line_dedup.pa.string()))
    for _ in range(200):
        shared = [prose(rng.random(), rng.randrange(3, 12)) for _ in range(6)]
        texts = ["\n".join([*(prose(rng.random(), 9) for _ in range(rng.randrange(4))), *shared, *(prose(rng.random(), 9) for _ in range(rng.randrange(4)))]) for _ in range(2)]
        (f, _), (g, _) = (line_dedup.winnow(*coded(t)) for t in texts)
        if sum(len(s.split()) for s in shared) >= line_dedup.MIN_WORDS:
            assert set(f.tolist()) & set(g.tolist())


def test_line_dedup_every_earlier_text_counts(spark):
    """Six lines in one text, the same and one to three more in two others: of the last, nothing that stands before is left."""
    rng = random.Random(9)
    for _ in range(3):
        base = [prose(rng.random(), 9) + "." for _ in range(6)]
        more = [prose(rng.random(), 6) + "." for _ in range(rng.randrange(1, 4))]
        rows = [(1, "\n".join(base), "s"), (2, "\n".join(base + more), "s"), (3, "\n".join(base + more), "s")]
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(spark, rows)).collect()}
        assert got[1] == rows[0][1] and got[2] == "\n".join(more) and got[3] == ""


def test_packing(spark, docs, rows, none):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs.coalesce(2), path).collect()
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r.doc_id] += r.length
    assert have == want
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for r in (r for r in got if r.doc_id == i and r.doc_tokens == len(ids)):
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    assert packing.pack(none, path).count() == 0


def test_cut_is_least(monkeypatch):
    """Against the plain recurrence on short streams: padding of all windows but the last, and the penalties of their ends."""
    monkeypatch.setattr(packing, "WINDOW", 12)
    rng = random.Random(4)
    for _ in range(60):
        ends = np.cumsum([rng.randrange(1, 16) for _ in range(rng.randrange(1, 5))])
        total = int(ends[-1])
        marks = np.array(sorted({rng.randrange(1, total + 1) for _ in range(9)} | set(range(6, total, 6))), np.int64)
        price = {int(m): packing.SENTENCE_PENALTY for m in marks} | {int(e): 0 for e in ends} | {0: 0}
        best = {0: 0}
        for p in sorted(price):
            if p:
                best[p] = price[p] + min(best[q] + 12 - (p - q) for q in best if p - q <= 12)
        least = min(best[q] for q in best if q < total and total - q <= 12)
        w = packing.windows(ends, marks)
        assert w[-1] == total and all(0 < b - a <= 12 for a, b in zip([0, *w], w))  # noqa: B905
        assert sum(price[b] + 12 - (b - a) for a, b in zip([0, *w], w[:-1])) == least  # noqa: B905
        cuts = packing.cut(ends, marks)
        assert cuts[: len(w) - 1] == w[:-1] and all((b - a).bit_count() == 1 for a, b in zip([0, *cuts], cuts) if a >= ([0, *w])[-2])  # noqa: B905


def test_quality(spark, none):
    good = [(n, prose(n, 80), "s") for n in range(60)]
    bad = [(100 + n, " ".join(w.upper() + "!!" for w in prose(n, 80).split()), "s") for n in range(60)]
    labels = spark.createDataFrame([(n, 1, 0) for n in range(60)] + [(100 + n, 0, 0) for n in range(60)] + [(None, 1, 0), (5, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    d = make(spark, good + bad + [(200, None, "s"), (201, "", "s"), (None, good[0][1], "s"), (3, good[3][1], "s")])
    w = quality.train(d.select("doc_id", "text"), labels)
    got = quality.scored(d.select("doc_id", "text"), w).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == 124 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held]
    assert held and all(r.predicted == (r.doc_id < 100) for r in held if r.doc_id < 200)
    kept = quality.filter_quality(d, labels)
    assert kept.columns == d.columns
    assert quality.filter_quality(none, labels).count() == 0
    assert 0 <= quality.scored(d.select("doc_id", "text"), quality.train(d, labels.where("false"))).first().score <= 1


def test_mixing(spark, docs, rows, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, len(words(t))) for i, t, _ in rows)
    total = sum(r["size"] for r in got)
    sizes, targets, taken = {}, {}, Counter()
    for r in got:
        sizes[r.source], targets[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    want, full = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        level = left / max(1e-9, sum(weight[s] for s in order if s not in full))
        want = {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
        more = {s for s in order if want[s] > 3 * sizes[s]} - full
        if not more:
            break
        full |= more
    for s in order:
        assert targets[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 12
    m = mixing.mix(docs)
    assert m.columns == docs.columns
    assert sum(len(words(r.text)) for r in m.collect()) == pytest.approx(sum(taken.values()), abs=4)
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_schedule_is_low_discrepancy(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RUN", 64)
    for slots in ({"a": 100, "b": 200, None: 300}, {"a": 1, "b": 997, "c": 2, "d": 40}, {"a": 0, "b": 5}, {"a": 0}):
        s = sorted(mixing.schedule(spark.createDataFrame(list(slots.items()), "source string, slots long")).collect())
        n = sum(slots.values())
        assert [r.slot for r in s] == list(range(n))
        for k, m in slots.items():
            assert sorted(r["rank"] for r in s if r.source == k) == list(range(m))
        for upto in range(0, n + 1, 50):
            c = Counter(r.source for r in s[:upto])
            assert all(abs(c[k] - upto * m / max(1, n)) <= 4 for k, m in slots.items())


def test_mixing_joins_blocks_to_slots(spark):
    """Slot by slot against a plain model: the slot of rank r has words r * slot to (r + 1) * slot of its source's stream."""
    rng = random.Random(6)
    rows = [(n, " ".join(f"{n}w{k}" for k in range(rng.randrange(0, 60))), rng.choice(["a", "b", "b", "b", None])) for n in range(80)] + [(3, "again w", "a"), (3, "again w", "a"), (None, "nobody knows", "b")]
    docs = make(spark, rows)
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    d = spark.createDataFrame(d.collect(), d.schema)
    sources = mixing.plan(d, 16)
    rank = {r.slot: (r.source, r["rank"]) for r in mixing.schedule(sources).collect()}
    found = {}
    for p in mixing.pieces(d, sources, 16).collect():
        found.setdefault(p.slot, []).append(p)
    at = {r.row: (r.source, r["at"], r["size"]) for r in mixing.laid_out(d).collect()}
    for r in sources.collect():
        stream = [x for row, (s, a, n) in sorted(at.items(), key=lambda x: x[1][1]) if s == r.source for x in ((row, k) for k in range(n))]
        stream = (stream * 3)[: r.words]
        assert len(stream) == r.words and r.slots == -(-r.words // 16)
        for slot, (s, k) in rank.items():
            if s == r.source:
                have = sorted((p.epoch, at[p.row][1], p.begin, p.row, p.length) for p in found.pop(slot))
                assert [(row, b + i) for _, _, b, row, n in have for i in range(n)] == stream[16 * k : 16 * k + 16]
    assert not found


def test_mix_is_in_slot_order(spark):
    rows = [(n, " ".join(f"{s}{n}w{k}" for k in range(20)), s) for s in "ab" for n in range(50)]
    m = mixing.mix(make(spark, rows), 8).collect()
    first = Counter(r.source for r in m[: len(m) // 2])
    assert min(first.values()) > len(m) // 8
    assert all(r.text == rows[r.doc_id + 50 * (r.source == "b")][1][: len(r.text)] for r in m)


def test_names_that_clash(spark):
    """User columns named like those added on the way come out as they went in."""
    import corpus_pipeline as c

    extra = "_s _t _n _k _size _take _hot _chars n_removed n_runs runs k t d u row _row slot _slot fp m key _c0 _c1 hash pos epoch".split()
    rows = [(n, prose(n % 9, 40), "ab"[n % 2], 7, *[f"{x}{n}" for x in extra]) for n in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra))
    for f in (mixing.mix, near_dedup.deduplicate, lambda x: c.line_dedup(spark, x, ""), lambda x: line_dedup.dedup_lines(x).toDF(*x.columns, "r1", "r2").drop("r1", "r2")):
        out = f(d)
        assert out.columns == d.columns
        got = out.collect()
        assert got and all(tuple(r)[4:] == tuple(f"{x}{r.doc_id}" for x in extra) for r in got)


def test_topk(spark):
    rng = random.Random(8)
    vs = [(n, [rng.choice([-1.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(6)], 0) for n in range(400)]
    vs += [(500, None, 0), (600, [1.0, None], 0), (700, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (800, [1.0, 2.0], 0), (801, [], 0), vs[3], vs[100]]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>, label int")
    topk.GROUP_ROWS, topk.BLOCK_ROWS, old = 50, 8, (topk.GROUP_ROWS, topk.BLOCK_ROWS)
    try:
        v = topk.quantized(df)
        got = {}
        for r in topk.top_k(v, v.where("vec_id % 100 = 0")).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    finally:
        topk.GROUP_ROWS, topk.BLOCK_ROWS = old
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, _ in vs if i is not None and e is not None and not any(x is None or x != x for x in e)]
    for q in (0, 100, 200, 300, 800):
        qv = next(e for i, e in good if i == q)
        want = sorted((-sum(a * b for a, b in zip(qv, e, strict=False)), i) for i, e in good if i != q)[:10]
        assert [(n, i, s) for n, i, s in sorted(got[q])] == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert sorted(got) == [0, 100, 200, 300, 800]
    none = topk.quantized(df.where("false"))
    assert topk.top_k(none, none).count() == 0


def test_url_filter(spark):
    page = lambda head: f"<html><head>{head}</head></html>"
    rows = [
        (1, "https://www.Example.com/en/7x?q#f", ""), (2, "http://a.com/en/1", None), (3, "http://b.io/x", page('<link href="http://a.com/en/1" rel="canonical">')),
        (4, "http://c.io/", page('<meta http-equiv="refresh" content="0; url=http://b.io/x#part">')), (5, None, ""), (6, "no scheme/en/", ""), (7, "http://example.com/en/71", page("<link rel='canonical' href='http://a.com/en/1'>")),
        (8, "http://d.io/", page("<link rel=canonical href=/relative>")), (3, "http://b.io/x", ""), (9, "http://m.example.net/de/81", ""), (10, "http://xcom/en/", ""), (11, "ftp://e.io", page('<link rel="canonical" href="http://q.org/es/">')),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge(df, url_filter.page_links(df)).collect()
    v = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert v[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert v[2] == ("a.com", "/en/1", "com/en/", "block")
    assert v[5] == ("", "", None, "allow") and v[6][:2] == ("", "")
    assert v[9][2:] == ("example.net/de/8", "block") and v[10][2] is None and v[8][3] == "allow"
    assert v[11] == ("e.io", "", None, "block")
    assert v[7][3] == "allow" and v[3] == ("b.io", "/x", None, "allow") == (*v[3][:3], v[4][3])  # an alias is allowed by name
    got = url_filter.judge(df.where("page_id <> 7"), url_filter.page_links(df.where("page_id <> 7"))).collect()
    assert {r.verdict for r in got if r.page_id in (2, 3, 4)} == {"block"}
    assert url_filter.judge(df.where("false"), url_filter.page_links(df.where("false"))).count() == 0


def test_html(spark):
    art = "<article><h1>Title &amp; more</h1><p>First  paragraph\nof <b>bold</b>text.<p>Second&nbsp;one.<div class='advert'>buy this now</div><ul><li>x</li></ul></article>"
    page = f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>menu item</li></ul></nav><div class=ad>An advert of several words stands here.</div>{art}<aside>side</aside><section id='comments'><p>a reader says a lot of words here</p></section><form>f</form><footer>foot</footer></body></html>"
    plain = "<html><body><div id=menu>home about</div><div class='content'><p>" + "word " * 60 + "</p><p>last one here</p></div><div class='footer'>foot</div></body>"
    df = spark.createDataFrame([(n, "u", page) for n in range(20)] + [(30, None, None), (31, "u", ""), (32, "u", "<nav>only</nav>"), (33, "u", plain), (None, "u", "<p>just text"), (0, "u", page), (34, "u", "a < b & c")], "page_id long, url string, html string")
    w = html_text.train(df)
    got = {r.page_id: r for r in html_text.extract(df, w).collect()}
    assert got[0].text == "Title & more\n\nFirst paragraph of boldtext.\n\nSecond one.\n\nx" and got[0].n_chars == len(got[0].text)
    assert got[30].text == got[31].text == got[32].text == "" and got[30].n_chars == 0
    assert got[33].text == ("word " * 60).strip() + "\n\nlast one here"
    assert got[None].text == "just text" and got[34].text == "a < b & c"
    assert html_text.extract(df.where("false"), html_text.train(df.where("false"))).count() == 0
    for weights in (w, html_text._FIXED):
        text = lambda page, weights=weights: html_text.main_text(page, weights)
        two = "<nav>m</nav><article><p>The first has some words.</p></article><div class=ad>no</div><p>between</p><article><p>Short.</p></article>"
        assert text(two) == "The first has some words.\n\nShort."
        assert text("<article><p>Some words here.</p><div class='warning'>Mind the gap.</div><p class='related-work'>As others did.</p><p>By <math><mi>x</mi><mo>=</mo><mi>y</mi></math> it holds.</p></article>") == "Some words here.\n\nMind the gap.\n\nAs others did.\n\nBy x=y it holds."
        assert text("<body><div><h1>A short title</h1><p>A first paragraph.</p></div><div><p>" + "word " * 80 + "</p></div></body>").startswith("A short title\n\nA first paragraph.\n\nword word")
        assert text("<article><p>in</p><div class='cookie-notice'>c</div><ul id=comment-list><li>r</li></ul></article>") == "in"


def test_maximal_brute_force():
    def best(s, lo, hi):
        found = max(((sum(s[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if found[0] <= 1e-12:
            return []
        return best(s, lo, -found[1]) + [(-found[1], -found[2])] + best(s, -found[2], hi)

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.uniform(-1, 1) for _ in range(rng.randrange(20))]
        assert html_text.maximal(s) == best(s, 0, len(s))


@pytest.mark.parametrize("x", ["<a b ", "<a '", "<a b='", "<a b=\"x' ", "<!-- ", "<!", "<script>", "<p class=ad>x", "<a b='>", "</", "<p>word "])
def test_html_takes_linear_time(x):
    import time

    page = x * (1_000_000 // len(x))
    t = time.process_time()
    html_text.main_text(page, html_text._FIXED)
    assert time.process_time() - t < 5


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    step = c.quality(spark, docs, sf)
    assert step.columns == docs.columns
    kept = {r.doc_id for r in step.collect()}
    assert len(good - kept) <= 0.02 * len(good) and len(bad & kept) <= 0.2 * len(bad) + 1
    assert c.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def repeated(texts):
    """Which words of the texts, in order, lie in MIN_WORDS words that stand at an earlier place."""
    n, first, out = line_dedup.MIN_WORDS, set(), []
    for w in map(words, texts):
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            p = tuple(w[a : a + n])
            if p in first:
                gone[a : a + n] = [True] * n
            first.add(p)
        out.append(gone)
    return out


def test_line_dedup_brute_force(spark):
    """Passages in mid-sentence, of one sentence, at the least length, and whose grams all stand earlier elsewhere."""
    rng = random.Random(11)
    flat = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    p, least, short = flat(60), flat(25), flat(24)
    stock = [flat(15) for _ in range(5)]
    joined = " ".join(stock)
    texts = [flat(30) + " " + p + " " + flat(30), *(flat(9) + " " + x + " " + flat(9) for x in stock), flat(5) + " " + least, short + " " + flat(9)]
    texts += [flat(7) + " " + joined + " " + flat(8), flat(3) + " " + joined + ". end", flat(12) + " " + p + " " + flat(12), least + " " + flat(4), flat(4) + " " + short, p + "\n" + p, flat(20) + " " + " ".join(p.split()[20:]) + " " + " ".join(p.split()[:33])]
    texts += [" ".join(rng.choice([p, joined, least]).split()[rng.randrange(9) :]) + " " + flat(rng.randrange(6)) for _ in range(30)] + [" ".join(rng.choice("ab") for _ in range(300))] * 2
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make(spark, [(n, t, "s") for n, t in enumerate(texts)]).repartition(5)).collect()}
    for n, (t, gone) in enumerate(zip(texts, repeated(texts), strict=True)):
        assert words(got[n].text) == [w for w, g in zip(words(t), gone, strict=True) if not g]
        assert (got[n].n_removed > 0) == any(gone) and (any(gone) or got[n].text == t)
    assert len(words(got[9].text)) == 5 and len(words(got[10].text)) == 24


def test_line_dedup_leaves_no_passage(spark):
    """On a whole table, no word of a repeated passage is left and no other word goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted({(r.doc_id, r.text) for r in docs.where("doc_id is not null and text is not null").collect()})
    assert len({i for i, _ in rows}) == len(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    for (i, t), gone in zip(rows, repeated([t for _, t in rows]), strict=True):
        assert words(got[i]) == [w for w, g in zip(words(t), gone, strict=True) if not g]


def test_line_dedup_true_copy_is_a_later_occurrence(spark):
    """Each sentence of the passage is a text of its own first, so the copy's source has second occurrences only."""
    stock = ["".join(f"s{n}x{k} " for k in range(11)) + f"e{n}." for n in range(5)]
    passage = " ".join(stock)
    texts = [*stock, f"{prose(80, 30)}. {passage} {prose(81, 30)}", f"{prose(82, 30)}. {passage} {prose(83, 30)}"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(spark, [(n, t, "s") for n, t in enumerate(texts)])).collect()}
    assert [got[n] for n in range(6)] == texts[:6]
    assert words(got[6]) == words(prose(82, 30) + ". " + prose(83, 30))


def test_mixing_serves_small_sources(spark):
    """Sources whose targets are under a slot, beside a hot one, come to their targets."""
    rng = random.Random(3)
    big = [(n, "x " * 4000, "hot") for n in range(60)]
    small = [(1000 + 10 * n + k, "y " * rng.choice([1, 7, 10]), f"s{n:03}") for n in range(120) for k in range(2)]
    d = make(spark, big + small)
    got = mixing.mixed(d, slot_words=256).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(taken[s] > 0 and abs(taken[s] - t) <= max(1, t / 32) for s, t in target.items())


def test_url_filter_resolves_links(spark):
    """Relative links in all their forms, against Python's urljoin, and every link of a page."""
    from urllib.parse import urljoin

    bases = ["http://a.com/en/x.html", "https://a.com", "http://a.com/", "http://a.com/en/7/?q=/z/y", "ftp://h.net/a/b/c", "http://a.com?u=http://b.com/"]
    refs = ["/en/7", "next.html", "../up", "../../../far", "./here", "sub/./x/../y", "..", ".", "//h.org/es/1", "?page=2", "//h.org", "/a//b/../c", "z?u=http://q.com/", "https://o.io/en/../1", "mailto:x@y.z", "en/7/", "a:b/c"]
    rows = [(n, b, f"<link rel=canonical href='{r}'>", r) for n, (b, r) in enumerate((b, r) for b in bases for r in refs)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, ref string")
    got = {r.page_id: r.dst for r in df.select("page_id", url_filter.resolved(F.col("url"), F.col("ref")).alias("dst")).collect()}
    for n, b, _, r in rows:
        want = r if "://" in r.split("?")[0] else None if r in ("mailto:x@y.z", "a:b/c") else urljoin(b, r)
        assert got[n] == want, (b, r)
    pages = [
        (1, "http://p.io/a/b", "<link rel=canonical href='c'><link rel='canonical' href='http://a.com/en/1'>"), (2, "http://a.com/q", '<meta http-equiv=refresh content="0; url=en/2">'),
        (3, "https://w.io/", '<link rel=canonical href="//b.com/en/3?x=1&amp;y=2#f">'), (4, "http://v.io/z", '<link rel=canonical href="#top"><link rel=canonical href="mailto:a@b.c">'), (5, None, "<link rel=canonical href=/x>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = url_filter.page_links(df)
    assert {tuple(r) for r in links.collect()} == {("http://p.io/a/b", "http://p.io/a/c"), ("http://p.io/a/b", "http://a.com/en/1"), ("http://a.com/q", "http://a.com/en/2"), ("https://w.io/", "https://b.com/en/3?x=1&y=2")}
    assert {r.page_id: r.verdict for r in url_filter.judge(df, links).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_url_filter_brute_force(spark, monkeypatch):
    """Random links and rules, against plain components and rule matching; rules compiled and joined give the same."""
    rng = random.Random(12)
    hosts = ["a.com", "x.a.com", "b.net", "c.b.net", "com", "d.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', ''])}{rng.choice(['', '/'])}{n}" for n in range(60)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(35)]
    rules = sorted({(f"{rng.choice(hosts)}/{rng.choice(['', 'en', 'en/', 'de/', 'de/1'])}", rng.choice(["allow", "block"])) for _ in range(8)})

    def own(u):
        host, path = u[7:].split("/", 1)
        fit = [r for r in sorted(rules, key=lambda r: (-len(r[0]), r)) if (host == (h := r[0].split("/", 1))[0] or host.endswith("." + h[0])) and path.startswith(h[1])]
        return fit[0] if fit else (None, None)

    group = {u: {u} for u in urls}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    pages = spark.createDataFrame([(n, u, "") for n, u in enumerate(urls * 2 + urls[:1] * 50)], "page_id long, url string, html string")
    edges = spark.createDataFrame(links, "src string, dst string").where("src <> dst").distinct()
    for most in (500, 0):
        monkeypatch.setattr(url_filter, "COMPILED", most)
        got = url_filter.judge(pages, edges, rules).collect()
        assert len(got) == pages.count()
        for r in got:
            u = (urls * 2 + urls[:1] * 50)[r.page_id]
            of_group = sorted(v for x in group[u] if (v := own(x)[1]))
            assert (r.rule, r.verdict) == (own(u)[0], own(u)[1] or (of_group or ["allow"])[0])


def test_quality_is_sequential_ftrl(spark):
    """The weights are those of a plain loop over dictionaries."""
    rows = [(n, prose(n, 30) if n % 2 else prose(n, 30).upper() + " !!", "s") for n in range(24)]
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(24)], "doc_id long, quality int, toxic int")
    d = make(spark, rows).select("doc_id", "text")
    got = quality.train(d, labels)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    rank = lambda i: sign(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
    train = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: rank(r[0]))
    z, n = Counter(), Counter()
    w = lambda i: 0.0 if abs(z[i]) <= quality.L1 else (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for i, t, _ in train:
            kinds, offsets = quality.features(quality.pa.array([t], quality.pa.string()))
            c = Counter(int(f) for k in kinds for f in k)
            x = {f: float(np.float32(m * quality.SCALE / max(1, offsets[1]))) for f, m in c.items()} | {1 << quality.BITS: 1.0}
            p = 1 / (1 + math.exp(-sum(w(f) * v for f, v in x.items())))
            step = {f: ((p - i % 2) * v, w(f)) for f, v in x.items()}
            for f, (g, old) in step.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA * old
                n[f] += g * g
    assert {int(f) for f in np.nonzero(got)[0]} == {f for f in z if w(f)}
    assert all(got[f] == pytest.approx(w(f), rel=1e-4, abs=1e-6) for f in z)


def test_topk_agrees_with_its_sql(spark, tmp_path):
    """On repeated rows, null ids and bad vectors, too."""
    import duckdb

    rng = random.Random(2)
    vs = [(n, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for n in range(0, 300, 10)] + [(100, [0.5] * 4), (100, [0.5] * 4), (7, [1.0] * 4), (7, [1.0] * 4), (200, None), (300, [float("nan")] * 4), (None, [1.0] * 4), (400, [1.0, None, 1.0, 1.0])]
    spark.createDataFrame(vs, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, topk.op1_topk(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(topk.SQL).fetchall())
