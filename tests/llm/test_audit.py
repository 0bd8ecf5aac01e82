"""Filters in every order against brute force and DuckDB."""

from __future__ import annotations

import itertools
import re

import duckdb
from pyspark.sql import functions as F

from tubula.llm import audit

NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows, k):
    i, t, _ = rows[k]
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    same = any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows)
    return {c for c, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), same), strict=True) if x}


def brute(rows, labels):
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    found = [fails(rows, k) for k in range(len(rows))]
    out, sums = [], {}
    for part in {s or "" for _, _, s in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [k for k in left if f in found[k]]
                late = [k for k in own if f in found[k] and k not in left]
                left = [k for k in left if f not in found[k]]
                lost = [sum(rows[k][0] is not None and rows[k][0] in s for k in gone) for s in (good, toxic)]
                out.append([part, "".join(order), step + 1, len(left), len(gone), len(late), sum(found[k] == {f} for k in own), *lost])
                sums[part, f] = sums.get((part, f), 0) + len(gone)
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


def test_every_order_by_brute_force(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, "a"), (2, words, "a"), (2, words, "b"), (None, words, None), (None, words, ""), (3, None, "a"), (4, "", "b"), (5, "short # text", "b"), (6, words.upper(), "a"), (7, "same " * 90, "a")]
    rows += [(8, "Same " * 40_000 + "|", "b"), (9, "é" * 99 + "A" * 6, "b"), (10, words + " \x0b", "c"), (1, words, "a"), (11, "$ " + words, "b"), (-3, "$ " + words, "b"), (12, "A b " * 30, "a")]
    labels = [(1, 1, 0), (3, 0, 1), (5, 1, 1), (5, 0, 0), (7, 1, None), (8, None, 1), (99, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("row", "part", "digest", "words", "A", "n", "prefix", "filter", "good", "toxic", "quality")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("clash") for c in ("part", "row", "source", "n")})
    got = audit.filter_audit(docs, known)
    assert got.columns == list(NAMES) and [t for _, t in got.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)
    assert audit.filter_audit(docs.limit(0), known).count() == 0
    assert sorted(map(tuple, audit.filter_audit(docs, known.limit(0)).collect())) == brute(rows, [])


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({audit.OP12_SQL})").fetchall()
    assert sorted(map(tuple, audit.op12_filter_audit(spark, sf).select(*NAMES).collect())) == sorted(want)


def test_no_ids_survivors_or_labels_are_broadcast(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("short $ "), F.col("id") % 90).alias("text"), F.lit("a").alias("source"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    plans, real = [], audit.stored
    monkeypatch.setattr(audit, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    rows, ids = audit.failing_ids(docs)
    plans.clear()  # of the first doc_ids of equal texts, their digests bound the size of what is broadcast
    found = audit.transitions(rows, ids, labels)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    assert found.filter("filter is null and prefix = 0").first()["n"] == 400
