"""Fingerprints and their components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tubula.llm import simhash


def brute_print(text):
    raw = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, print). Smallest doc_id of each row's component."""
    x = np.array([p for _, p in rows], np.uint64)
    lab = list(range(len(rows)))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
    out: dict[int, int] = {}
    for k in range(len(rows)):
        if k not in out:
            todo, seen = [k], {k}
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            low = min(rows[j][0] for j in seen)
            out |= dict.fromkeys(seen, low)
    return [out[k] for k in lab]


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \t\n", "one", "Two Words", "ein \x0b Wort  mehr", "é 日本語 🙂 É", "x" * 70_000 + " y z", "a b c " * 9000, " lead", "trail ", "\x1c\x85 c d e f"]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [brute_print(t) for t in texts]
    cut = pa.array(["skip this", *texts], pa.string()).slice(1)
    assert simhash.fingerprints(cut).tolist() == [brute_print(t) for t in texts]
    assert simhash.fingerprints(pa.array([], pa.string())).tolist() == []


def test_the_code_covers_and_anchors_are_all_within_reach():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    for x, s in zip(half, simhash.syndrome(half), strict=True):
        own = {int(x ^ m) for m in simhash.MASKS[s, : simhash.N_MASKS[s]]}
        want = set()
        for i in range(-1, 32):
            for j in range(i + 1 if i >= 0 else -1, 32):
                y = int(x) ^ (1 << i if i >= 0 else 0) ^ (1 << j if j >= 0 and j != i else 0)
                if not simhash.syndrome(np.array([y], np.uint64))[0]:
                    want.add(y)
        assert own == want and any((int(x) ^ y).bit_count() <= simhash.RADIUS for y in own)


def _check(spark, prints, head):
    rows = [(k, p) for k, p in enumerate(prints)]
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "print long")
    links = [(np.int64(r.src).view(np.uint64), np.int64(r.dst).view(np.uint64)) for r in simhash._links(frame, head).collect()]
    assert all(int(a ^ b).bit_count() <= 3 for a, b in links)
    root = {p: p for p in set(prints)}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[find(int(a))] = find(int(b))
    low: dict[int, int] = {}
    for k, p in rows:
        low[find(p)] = min(low.get(find(p), k), k)
    assert [low[find(p)] for p in prints] == brute_components(rows)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [0, (1 << 64) - 1, 7, *base]
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    _check(spark, prints, simhash.HEAD)
    # one dense cluster, walked by pivots and dealt out over parts
    dense = [base[0] ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) ^ (rng.getrandbits(6) << 40) for _ in range(1500)]
    _check(spark, dense, simhash.HEAD)
    _check(spark, dense + prints, 40)


def test_components_of_odd_rows(spark):
    texts = ["same words here now", "same  words HERE now", None, "", "  ", "short", "short", "quite another text with many words", "x y z " * 20_000]
    rows = [(5, texts[0]), (3, texts[1]), (8, None), (7, ""), (9, "  "), (2, "short"), (None, "short"), (2, "short"), (None, texts[7]), (1, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("print", "n", "low", "anchor", "cell", "component", "fingerprint")})
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=str)
    prints = [(simhash.LAST if i is None else i, brute_print(t)) for i, t in rows]
    want = [(i, f"{p:016x}", None if c == simhash.LAST else c) for (i, _), (_, p), c in zip(rows, prints, brute_components(prints), strict=True)]
    assert got == sorted(want, key=str) and {r[1] for r in got if r[0] in (7, 8, 9)} == {"0" * 16}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, simhash.op13_simhash_dedup(spark, sf).collect()))
    assert got == sorted((i, f"{p:016x}", c) for (i, p), c in zip(rows, brute_components(rows), strict=True))
