"""Stages of the corpus pipeline against brute-force versions, on rows with nulls, copies and shared ids."""

from __future__ import annotations

import collections
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_corpora import _brute
from tubula.llm import pieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def texts(rng, n):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)) for _ in range(n)]


def seen(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("shared", [False, True])
def test_exact_and_near_stages(spark, shared):
    rng = random.Random(3)
    base = texts(rng, 6)
    near = [" ".join([*t.split(), "more", "words"]) for t in base[:3]]
    rows = [(i, t, "s") for i, t in enumerate([*base, *near, base[0], base[0].replace(" ", "  "), "short one", ""])]
    if shared:  # one id with different texts, a repeated row, rows without an id
        rows += [(2, "another text altogether with some words", "s"), (0, base[0], "s"), (None, "", "s"), (None, base[5], "s"), (7, texts(rng, 1)[0], "s")]
    docs = frame(spark, rows)
    exact = seen(cp.exact_dedup(spark, docs, ""))
    want = {}
    for i, t, _ in rows:
        key = " ".join((t or "").replace("\t", " ").split(" ")) if t else ""
        key = " ".join(key.split()) if key.strip() else key
        if key not in want or (i is None, i) < (want[key][0] is None, want[key][0]):
            want[key] = (i, t)
    assert sorted((" ".join((t or "").split()) for _, t in exact.elements())) == sorted(want) and sum(exact.values()) == len(want)
    assert {(i, " ".join((t or "").split())) for i, t in exact} == {(i, k) for k, (i, _) in want.items()}
    stay = sorted(((i, t) for i, t in exact.elements()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    labels, sizes = _brute([t for _, t in stay], 5, 80)
    near_rows = seen(cp.near_dedup(spark, frame(spark, [(i, t, "s") for i, t in stay]), ""))
    groups = collections.defaultdict(list)
    for k, label in enumerate(labels):
        groups[label].append(stay[k])
    assert sum(near_rows.values()) == len(groups)
    for group in groups.values():
        kept = [r for r in group if near_rows[r]]
        assert len(kept) == 1 and kept[0][0] == group[0][0]


def test_toxic_rows_go_and_rows_that_share_their_id_stay(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8)))
    rows, labels = [], []
    for i in range(300):
        own = [word() for _ in range(40)]
        if i % 4 == 0:
            own.insert(rng.randrange(len(own)), rng.choice(["grumpf", "bzdork", "quazzy"]))
        rows.append((i, " ".join(own), "s"))
        labels.append((i, 0, int(i % 4 == 0)))
    rows += [(8, " ".join(word() for _ in range(40)), "s"), (None, None, "s")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    scores = toxicity.toxic_scores(docs.withColumn("row_id", F.monotonically_increasing_id()), spark.read.parquet(f"{tmp_path}/labels.parquet"), True)
    left = cp.toxicity(spark, docs, str(tmp_path))
    assert left.columns == cp.COLUMNS and left.count() == scores.filter("predicted = 0").count()
    got = seen(left)
    assert got[rows[-2][:2]] == 1 and got[rows[-1][:2]] == 1 and sum(got[r[:2]] for r in rows[:300] if r[0] % 4 == 0) <= 3 and sum(got[r[:2]] for r in rows[:300] if r[0] % 4) >= 220


@pytest.mark.parametrize("shared", [False, True])
def test_mix_stage_repeats_whole_rows(spark, shared):
    rng = random.Random(7)
    rows = [(i if not shared else i // 2, " ".join(["w"] * rng.randrange(1, 40)) + f" t{i}", rng.choice(["a", "b", None])) for i in range(300)]
    got = seen(cp.mix(spark, frame(spark, rows), ""))
    assert set(got) <= {r[:2] for r in rows} and max(got.values()) <= 3
    size = lambda r: len(r[1].split())
    total, own = sum(map(size, rows)), {s: sum(size(r) for r in rows if r[2] == s) for s in ("a", "b", None)}
    for s, weight in (("a", 1), ("b", 2), (None, 3)):
        taken, want = sum(got[r[:2]] * size(r) for r in rows if r[2] == s), total * weight / 6
        assert want < 3 * own[s] and abs(taken - want) <= 0.02 * want + 40


def test_pieces_stage_and_empty_tables(spark):
    rows = [(1, "hello world", "s"), (1, "hello world", "s"), (2, None, "s"), (3, "  odd  spaces ", "s")]
    ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = cp.pieces(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(ref.encode(t or ""))) for i, t, _ in rows) and all(r["round_trip"] and r["parity"] for r in got)
    none = frame(spark, [])
    for stage in (cp.exact_dedup, cp.near_dedup, cp.mix, cp.pieces):
        assert stage(spark, none, "").count() == 0


def test_whole_pipeline_on_given_tables(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "parity"} <= set(out.columns) and out.count() > 50 and out.filter("not parity or not round_trip").count() == 0
