"""Every operator on whole tables with nulls, empty and very long texts, repeated rows, shared ids, clashing columns
and no rows, against brute force or exact round trips."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tubula.llm import dedup, htmltext, langid, lm, media, mixing, neardup, pieces, tokencounts, toxicity
from tubula.llm.common import fold

LONG = "word " * 60_000
TEXTS = [(1, "Hello world\nsecond line"), (1, "Hello world\nsecond line"), (1, "other text, same id"), (2, None), (3, ""), (4, "\n\n"), (5, " " * 30_000 + "x"), (6, LONG), (7, "é 日本語 🙂\nend"), (None, "no id")]
CLASH = ["row", "rep", "key", "size", "word", "posting", "node", "digest", "media", "section", "ids", "held_out", "n", "cell", "owner", "component", "rate"]


def docs(spark, rows=TEXTS):
    out = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return out.withColumns({c: F.lit("clash") for c in CLASH})


def data(path):
    with open(path, "rb") as f:
        return f.read()


def test_sections_of_a_table(spark):
    vocabulary = data(tokencounts.VOCABULARY)
    encoding, size = tokencounts._encoding(vocabulary)
    want = collections.Counter()
    for i, t in TEXTS:
        raw, spans, low = (t or "").encode(), [], 0
        for part in (t or "").splitlines(keepends=True) if "\n" in (t or "") else [t or ""]:
            spans.append((low, low + len(part.encode())))
            low += len(part.encode())
        ids = [] if not raw else [x for x in tokencounts.encode(encoding, t)]
        counts, chars, low = [0] * len(spans), [], 0
        for x in ids:
            a, b = low, low + int(size[x])
            low = b
            held = [max(0, min(b, v) - max(a, u)) for u, v in spans]
            counts[held.index(max(held))] += 1
        for k, (u, v) in enumerate(spans):
            chars.append((i, k, len(raw[:u].decode()), len(raw[:v].decode()), float(counts[k]), len(ids)))
        want.update(chars)
    got = collections.Counter(tuple(r[c] for c in ("doc_id", "section", "start_char", "end_char", "n_tokens", "doc_tokens")) for r in tokencounts.section_tokens(docs(spark), vocabulary).collect())
    assert got == want and tokencounts.section_tokens(docs(spark, []), vocabulary).count() == 0
    with pytest.raises(ValueError, match="rule"):
        tokencounts.section_tokens(docs(spark), vocabulary, "none")


def test_media_of_a_table(spark):
    def want(t):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])

    stored = media.texts_to_media(docs(spark)).collect()
    assert sorted(media.decode_png(r["media"]).tobytes()[: r["n_bytes"]] for r in stored) == sorted((t or "").encode() for _, t in TEXTS)
    rows = media.media_features(media.texts_to_media(docs(spark))).collect()
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want(t) for _, t in TEXTS)
    # equal texts have equal values, whatever their row
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"], r["media_bytes"]) for r in rows}) == len({t or "" for _, t in TEXTS})
    assert media.media_features(media.texts_to_media(docs(spark, []))).count() == 0


def test_pieces_of_a_table(spark):
    model = data(pieces.MODEL)
    ref = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = pieces.piece_report(docs(spark), model).collect()
    want = [(i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), len(t or "")) for i, t in TEXTS for ids in [ref.encode(t or "")]]
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["n_chars"]) for r in rows), key=key) == sorted(want, key=key)
    assert all(r["round_trip"] and r["parity"] for r in rows)
    back = pieces.decode_pieces(pieces.encode_pieces(docs(spark), model), model).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=key) == sorted(((i, t or "") for i, t in TEXTS), key=key)
    assert pieces.piece_report(docs(spark, []), model).count() == 0 and pieces.encode_pieces(docs(spark, []), model).count() == 0


def test_pages_of_a_table(spark):
    rows = [(1, "u", "<p>One</p>"), (1, "u", "<p>One</p>"), (2, None, None), (3, "v", ""), (None, "w", "plain"), (4, "x", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = htmltext.extract_pages(pages).collect()
    want = [(1, "u", "One"), (1, "u", "One"), (2, None, ""), (3, "v", ""), (None, "w", "plain"), (4, "x", LONG.strip())]
    assert sorted(map(str, ((r["page_id"], r["url"], r["text"]) for r in got))) == sorted(map(str, want)) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


def test_languages_of_a_table(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.train_profiles(given.filter(fold("doc_id", 4) != 2))
    held = given.filter(fold("doc_id", 4) == 2).select("doc_id", F.lit(True).alias("held_out"), "text", "lang")
    truth = {r["doc_id"]: r["lang"] for r in held.filter("length(text) > 40 and lang is not null").collect()}
    rows = {r["doc_id"]: r for r in langid.detect_language(held.drop("lang"), profiles).collect()}
    assert sum(rows[i]["lang_pred"] == lang for i, lang in truth.items()) >= 0.98 * len(truth)
    # out-of-place distances by brute force, from counts of the training texts
    for text in list({r["doc_id"]: r for r in held.limit(20).collect()}.values()):
        if not text["text"]:
            continue
        own = langid.ranked(langid.grams(langid.letters(text["text"]))).tolist()
        apart = {}
        for lang, profile in profiles.items():
            place = {g: k for k, g in enumerate(profile.tolist())}
            apart[lang] = sum(abs(place[g] - k) if g in place else langid.TOP for k, g in enumerate(own))
        if own:
            assert apart[rows[text["doc_id"]]["lang_pred"]] == min(apart.values())
    odd = langid.detect_language(docs(spark).select("doc_id", F.lit(False).alias("held_out"), "text"), profiles).collect()
    assert len(odd) == len(TEXTS) and sum(r["lang_pred"] == "und" for r in odd) == 3
    assert langid.train_profiles(docs(spark, [])) == {}


def test_other_operators_on_odd_tables(spark):
    d = docs(spark)
    exact = dedup.exact_duplicates(d).collect()
    assert len(exact) == len(TEXTS) and sum(r["kept"] for r in exact) == len({" ".join((t or "").split("\n")).replace("  ", " ") if (t or "").strip() else (" " if t else "") for _, t in TEXTS})
    near = neardup.near_components(d, 3, 85).collect()
    assert len(near) == len(TEXTS) and sorted(r["n_shingles"] for r in near)[:3] == [0, 0, 0]
    scored = lm.hmm_scores(d).collect()
    assert len(scored) == len(TEXTS) and {r["n_tokens"] for r in scored if r["doc_id"] in (2, 3, 4)} == {1} and all(r["n_known"] <= r["n_tokens"] for r in scored)
    mixed = mixing.mix_sources(d).collect()
    assert len(mixed) == len(TEXTS) and sum(r["size"] for r in mixed) == sum(len((t or "").split()) for _, t in TEXTS)
    labels = spark.createDataFrame([(1, 0, 1), (7, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    toxic = toxicity.toxic_scores(d, labels).collect()
    assert len(toxic) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in toxic)
