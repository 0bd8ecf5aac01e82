"""Operator 10: language identification by rank-order profiles.

A profile is the ``TOP`` most frequent letter n-grams (1 to 3 characters; words are lower-cased, runs of
other characters become one mark that also stands at both ends) of all training texts of a language,
in order of frequency. A text's own most frequent n-grams are compared to each profile by the
out-of-place distance: the sum of rank differences, with ``TOP`` for an n-gram that a profile lacks.

Defined results: ``und`` with score 0 for a null text, one without letters, or when nothing could be
learned; ties go to the language that sorts first; n-grams of equal count are ranked by their code, so
runs agree; rows with a null lang aren't learned from; whole texts are used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tubula.llm.common import fold, read, slices

TOP = 400
BITS = np.uint64(21)
MARK = 32


def _letter_table() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or MARK for what isn't a letter."""
    table = np.full(0x10000, MARK, np.uint64)
    for c in range(0x10000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the text's letters, lower-cased, with one MARK between words and at both ends.
    Characters beyond the basic plane count as letters if Python says so."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = _LETTERS[0][np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        low[i] = points[i] if chr(points[i]).isalpha() else MARK
    low = np.concatenate([[MARK], low, [MARK]]).astype(np.uint64)
    return low[np.concatenate([[True], (low[1:] != MARK) | (low[:-1] != MARK)])]


def grams(low: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 characters of a letter sequence but the lone mark."""
    two = low[:-1] << BITS | low[1:]
    three = two[:-1] << BITS | low[2:]
    return np.concatenate([low[low != MARK], two, three])


def ranked(codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes in order of falling count, then rising code."""
    code, n = np.unique(codes, return_counts=True)
    return code[np.lexsort((code, -n))[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a partition by language; their number is bounded by the alphabets."""
    counts: dict[str, dict[int, int]] = {}
    for batch in slices(batches, "text", 4 << 20):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(letters(text))
        for lang, parts in by_lang.items():
            own = counts.setdefault(lang, {})
            code, n = np.unique(np.concatenate([grams(p) for p in parts]), return_counts=True)
            for c, k in zip(code.tolist(), n.tolist(), strict=True):
                own[c] = own.get(c, 0) + k
        if sum(map(len, counts.values())) > 1_000_000:
            yield from _flushed(counts)
            counts = {}
    yield from _flushed(counts)


def _flushed(counts: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        code = np.array(list(own), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(own), "gram": pa.array(code, pa.int64()), "n": pa.array(list(own.values()), pa.int64())})


def train_profiles(docs: DataFrame, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles of all languages of docs (text, lang): ``top`` codes each."""
    counts = docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list] = {}
    for r in counts.withColumn("place", place).filter(F.col("place") <= top).select("lang", "gram", "place").collect():
        found.setdefault(r["lang"], []).append((r["place"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64).view(np.uint64) for lang, rows in sorted(found.items())}


def classifier(profiles: dict[str, np.ndarray], top: int = TOP):
    """A function from a text to (language, score)."""
    names = list(profiles)
    codes = np.unique(np.concatenate(list(profiles.values()))) if names else np.zeros(0, np.uint64)
    place = np.full((len(names), len(codes) + 1), -1, np.int64)
    for i, own in enumerate(profiles.values()):
        place[i, np.searchsorted(codes, own)] = np.arange(len(own))

    def classify(text: str | None) -> tuple[str, float]:
        if not names or not text or len(low := letters(text)) < 3:
            return "und", 0.0
        own = ranked(grams(low), top)
        at = np.searchsorted(codes, own)
        at = np.where((at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == own), at, len(codes))
        there = place[:, at]
        apart = np.where(there < 0, top, np.abs(there - np.arange(len(own)))).sum(1)
        best = int(apart.argmin())
        rest = np.delete(apart, best).min() if len(names) > 1 else top * len(own)
        return names[best], float(min(1.0, max(0.0, 0.5 + 0.5 * (rest - apart[best]) / max(1, rest))))

    return classify


def detect_language(docs: DataFrame, profiles: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """docs: doc_id, held_out, text. Adds lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(profiles, top)
        for batch in slices(batches, "text"):
            found = [classify(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with profiles of those whose crc32(doc_id) mod 4 isn't 2."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    profiles = train_profiles(docs.filter(~F.col("held_out")).select("text", "lang"))
    return detect_language(docs.select("doc_id", "held_out", "text"), profiles)
