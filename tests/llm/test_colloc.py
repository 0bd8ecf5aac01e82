"""Automata of n-gram counts and collocations against brute force and DuckDB."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tubula.llm import colloc

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def grams(texts):
    out = collections.Counter()
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return out


def brute(rows, least=10, share=50, top=2000):
    out = []
    for lang in {g or "und" for g, _ in rows}:
        f = grams(t for g, t in rows if (g or "und") == lang)
        c = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n, found = sum(a for p, a in f.items() if len(p) == 1), []
        for p, a in c.items():
            if len(p) == 2 and any(100 * b >= share * a for q, b in c.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, x, y = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, k + 1, p.decode(), -a, x, y, n, -s) for k, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def counted(g):
    names = [None, *(w.decode() for w in g.words.to_pylist())]
    return {tuple(names[x] for x in row if x): n for *row, n in zip(g.a.tolist(), g.b.tolist(), g.c.tolist(), g.n.tolist(), strict=True)}


def of(texts):
    words, piece, _ = colloc.word_pieces(pa.array(texts, pa.string()))
    return colloc.count_grams(words, piece, len(words))


def test_automata_keep_counts_and_share_states():
    texts = ["A b c, d e\tf. a b c!", None, "", "x", "x y", "é ü\x85 ß; \x0b日本 語 a b", "..", "q " * 50, "to be or not to be"]
    g = of(texts)
    assert counted(g) == grams(texts)
    m = colloc.CountAutomaton.of(g)
    back = colloc.CountAutomaton.from_bytes(m.to_bytes())
    assert counted(back.grams()) == grams(texts) and len(back.grams()) == len(g)
    order = list(zip(*(x.tolist() for x in (back.grams().a, back.grams().b, back.grams().c)), strict=True))
    assert order == sorted(order)
    # equal continuations are one state: 40 words lead to "of the", "of" to "the", "the" to nothing
    same = colloc.CountAutomaton.of(of([f"w{k} of the." for k in range(40)]))
    assert len(set(same.to1.tolist())) == 3 and len(same.word2) == 2 and len(same.word3) == 1
    f = grams(texts)
    asked = [p for p in f if len(p) < 3] + [("nothing",), ("a", "nothing"), ("nothing", "a"), ("c", "a")]
    got = back.compose(pa.array([p[0].encode() for p in asked]), pa.array([p[1].encode() if len(p) > 1 else b"" for p in asked]))
    assert got.tolist() == [f[p] for p in asked]
    assert len(colloc.CountAutomaton.from_bytes(colloc.CountAutomaton.of(of([])).to_bytes()).grams()) == 0


def test_union_and_cuts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    parts = [of(texts[k::4]) for k in range(4)]
    whole = colloc.unite(parts)
    assert counted(whole) == grams(texts)
    cuts = [(b"", b""), (b"a", b"c"), (b"b", b""), (b"cc", b"a"), (b"d", b"zz"), (b"z", b"z")]
    at = [0, *colloc._cut(whole, cuts), len(whole)]
    pieces = [whole.rows(slice(a, b)).narrow() for a, b in zip(at[:-1], at[1:], strict=True)]
    key = lambda p: (p[0].encode(), p[1].encode() if len(p) > 1 else b"")
    for k, p in enumerate(pieces):
        low, high = cuts[k - 1] if k else (b"", b""), cuts[k] if k < len(cuts) else (b"\xff", b"")
        assert all(low <= key(x) < high for x in counted(p))
        fragment = colloc.CountAutomaton.from_bytes(colloc.CountAutomaton.of(p).to_bytes()).grams()
        assert {x: n for x, n in counted(fragment).items() if n} == counted(p)
    back = [g.rows(g.n > 0) for g in (colloc.CountAutomaton.of(p).grams() for p in pieces)]
    assert counted(colloc.unite(back)) == grams(texts)
    assert len(colloc.unite([of([]), of([])])) == 0


def test_very_many_words_are_ordered_without_packing(monkeypatch):
    a, b = of(["a b c. b c d"]), of(["b c d, c a b"])
    monkeypatch.setattr(colloc, "BITS", 1)
    assert counted(colloc.unite([a, b])) == grams(["a b c. b c d", "b c d, c a b"])


@pytest.mark.parametrize("small", [False, True])
def test_collocations_by_brute_force(spark, monkeypatch, small):
    if small:  # many shards, ranges and salts
        for name, value in (("SHARD_ENTRIES", 60), ("RANGE_ENTRIES", 40), ("STEP", 4), ("CHUNK_WORDS", 50), ("TEXT_BYTES", 300), ("BROADCAST_PARTS", 0)):
            monkeypatch.setattr(colloc, name, value)
    rng = random.Random(5)
    words = ["new", "york", "City", "of", "the", "big", "é", "\x01x"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, [9, 9, 5, 5, 20, 1, 1, 1], k=40)) + rng.choice([".", "", "\n"])) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, ". , ;"), ("fr", "one two"), ("en", "hot pair " * 3000), ("und", "new york " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({c: F.lit("clash") for c in ("a", "n", "w1", "part", "automaton", "words", "first", "score", "rank")})
    got = colloc.collocations(docs)
    assert got.columns == list(NAMES) and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert sorted(map(tuple, colloc.collocations(docs, 3, 80, 7).collect())) == brute(rows, 3, 80, 7)
    assert colloc.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_000_000
    row = spark.createDataFrame([(a, a + 1, a + 7)], "a long, l long, r long")
    up, down = colloc._exact(F.lit(1_000_000), F.col("a"), F.col("a")), colloc._exact(F.col("l"), F.col("r"))
    got = row.withColumns({"u": up, "d": down}).select(F.expr("u div d")).first()[0]
    assert got == 1_000_000 * a * a // ((a + 1) * (a + 7))


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({colloc.OP11_SQL})").fetchall()
    assert sorted(map(tuple, colloc.op11_collocations(spark, sf).collect())) == sorted(want) and np.unique([r[0] for r in want]).size == 4


def test_stored_automata_are_small_and_whole():
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(300)) for _ in range(200)]
    words, piece, _ = colloc.word_pieces(pa.array(texts))
    g = colloc.count_grams(words, piece, len(words))
    for part in (g, g.rows(slice(0, 0)).narrow(), g.rows(slice(0, 1)).narrow()):
        a = colloc.CountAutomaton.of(part)
        b = colloc.CountAutomaton.from_bytes(a.to_bytes())
        assert b.words.equals(a.words) and all(np.array_equal(getattr(a, k), getattr(b, k)) for k in a.FIELDS)
    a = colloc.CountAutomaton.of(g)
    plain = sum(len(pa.compress(colloc._small(np.diff(x, prepend=0) if k in a.ASCENDING else x).tobytes(), codec="zstd", asbytes=True)) for k in a.FIELDS for x in [getattr(a, k)])
    assert len(a.to_bytes()) < 0.9 * plain
