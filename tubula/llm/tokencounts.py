"""Operator 3: token counts of sections by offset-mapped attribution.

A text is encoded once, as a whole. The tokens of a byte-level vocabulary spell the text's bytes, so
running sums of their lengths map every token to a span of bytes, and the starts of UTF-8 characters map
bytes to characters. Sections are character spans in order (here the lines of the text, each with the
newline that ends it); spans of tokens and sections are joined by binary search on their borders.

A token that crosses borders is allocated by an explicit rule: ``start`` (the section of its first
byte), ``largest`` (the section that holds most of its bytes, the first on ties) or ``split`` (shares
by bytes). Under each rule the sections' counts sum to the text's tokens.

Defined results: a null or empty text has one section without tokens; a text may have runs of white space
of any length; a text that ends with a newline
has no empty section after it; special-token strings are ordinary text; an empty table gives no rows;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import read, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text before merging: a fixed value that belongs to it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on are encoded apart: the pattern would look back through them.
LONG_RUN = 10_000
_RUNS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_RUN)
RULES = ("start", "largest", "split")
_BUILT: dict[bytes, tuple] = {}


def _encoding(data: bytes):
    """Encoding and token lengths in bytes, once for each Python worker."""
    key = hashlib.sha256(data).digest()
    if key not in _BUILT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _BUILT[key] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return _BUILT[key]


def encode(encoding, text: str) -> np.ndarray:
    """Ids of a whole text. A long run of white space is one match of the pattern but for its last
    character, which goes with what follows; at the end of the text it is one match. So the text falls
    apart there without a change of its ids."""
    parts, low = [], 0
    for run in _RUNS.finditer(text):
        high = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoding.encode_to_numpy(text[low : run.start()], disallowed_special=()))
        parts.append(np.array(encoding._encode_single_piece(text[run.start() : high]), np.uint32))
        low = high
    parts.append(encoding.encode_to_numpy(text[low:], disallowed_special=()))
    return np.concatenate(parts).astype(np.int64)


def line_spans(data: bytes) -> np.ndarray:
    """Byte borders of the lines of a text: a first 0, then each line's end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate([[0], ends, [len(data)]] if not len(ends) or ends[-1] != len(data) else [[0], ends]).astype(np.int64)


def attribute(token_ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section under a rule, and the number of tokens that cross a border into or out of it."""
    sections = len(borders) - 1
    starts = np.concatenate([[0], token_ends[:-1]]).astype(np.int64)
    first = np.searchsorted(borders[1:-1], starts, side="right")
    last = np.searchsorted(borders[1:-1], token_ends - 1, side="right")
    inside = first == last
    counts = np.bincount(first[inside], minlength=sections).astype(np.float64)
    crossing = np.zeros(sections, np.int64)
    for a, b, k, m in zip(starts[~inside].tolist(), token_ends[~inside].tolist(), first[~inside].tolist(), last[~inside].tolist(), strict=True):
        held = np.minimum(borders[k + 1 : m + 2], b) - np.maximum(borders[k : m + 1], a)
        crossing[k : m + 1] += held > 0
        if rule == "start":
            counts[k] += 1
        elif rule == "largest":
            counts[k + int(held.argmax())] += 1
        else:
            counts[k : m + 1] += held / (b - a)
    return counts, crossing


def _count(data: bytes, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(data)
        for batch in slices(batches, "text", 2 << 20):
            rows: dict[str, list] = {c: [] for c in ("section", "start_char", "end_char", "n_tokens", "crossing", "doc_tokens")}
            repeat = []
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                raw = text.encode()
                ids = encode(encoding, text)
                ends, borders = np.cumsum(size[ids]), line_spans(raw)
                if len(ids) and ends[-1] != len(raw):
                    raise ValueError("the tokens don't spell the text")
                counts, crossing = attribute(ends, borders, rule)
                # characters before a byte: bytes that don't continue a character
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[borders]
                n = len(counts)
                for c, v in zip(rows, (np.arange(n), chars[:-1], chars[1:], counts, crossing, np.full(n, len(ids))), strict=True):
                    rows[c].append(v)
                repeat.append(n)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), repeat)))} | {c: pa.array(np.concatenate(v)) for c, v in rows.items()})

    return run


def section_tokens(docs: DataFrame, data: bytes, rule: str = "largest") -> DataFrame:
    """docs: doc_id, text. One row per section: doc_id, section, start_char, end_char, n_tokens (double),
    crossing (tokens that cross one of its borders), doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(data, rule), "doc_id long, section long, start_char long, end_char long, n_tokens double, crossing long, doc_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by lines, crossing tokens to the line with most of their bytes."""
    with open(VOCABULARY, "rb") as f:
        data = f.read()
    return section_tokens(read(spark, sf_dir, "documents"), data)
