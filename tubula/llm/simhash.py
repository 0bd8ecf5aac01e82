"""Operator 13: near duplicates by SimHash fingerprints that meet at the anchors of a covering code.

1. Each text gives a 64-bit fingerprint: bit by bit the majority over the XXH64 values of its word shingles,
   repeats included. Texts with one fingerprint are one row from here on, so copies never meet as pairs.
2. Of two fingerprints that differ in at most 3 bits, one 32-bit half differs in at most 1. In each half the
   anchors are a covering code: the words whose first 31 bits are in the Hamming code of that length. The code
   is perfect, so each half lies within ``RADIUS`` = 1 of an anchor, and it leaves 2^27 anchors a half. A
   fingerprint goes to every anchor within covering radius plus threshold, 1 + 1, of either half: 17 copies
   a half at most, 16.5 on average.
3. At an anchor those within the covering radius are compared with all that came there (whole fingerprints,
   at most 3 bits apart). Small groups are compared by shifts along the sorted rows. A larger one is walked
   pivot by pivot, each compared only with what isn't in its component yet, and returns a spanning forest, not
   its pairs. An anchor with more than ``HEAD`` fingerprints is dealt out by hash into parts, and each pair of
   parts is a group of its own, so no task holds more than two parts.
4. The links make components (star steps); each takes the smallest doc_id of its texts.

No link is lost: if x and y differ in at most 1 bit of a half, the anchor nearest to x in that half is within 1
of x and within 2 of y.

Defined results: null and empty texts and texts of white space have the fingerprint 0, which is linked like any
other; a text with fewer words than a shingle has its whole sequence as one; rows that share a doc_id are texts
of their own, each linked by its own fingerprint; a null doc_id is larger than any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import discard, read, slices, stored
from tubula.operators.components import star_components

#: Words of a shingle, seed of the hash, bits that linked fingerprints may differ in.
WIDTH, SEED, BITS = 3, 42, 3
#: Covering radius of the anchors in a half, and bits that one half of a linked pair may differ in.
RADIUS, HALF_BITS = 1, BITS // 2
#: Fingerprints at one anchor that are compared in one task, and groups that are compared by shifts.
HEAD, SMALL = 8192, 32
#: Bytes of text that are hashed at once.
TEXT_BYTES = 2 << 20
#: Anchors with too many fingerprints that may be broadcast (a few MB).
BROADCAST_ROWS = 200_000
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Fingerprint of each text (unsigned 64 bits)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    word = ~_BLANK[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    begins[inner] = word[inner]
    # words one space apart, so that a shingle is one range of bytes
    space = np.zeros(len(raw), bool)
    space[1:] = ~word[1:] & word[:-1]
    kept = word | space
    clean = memoryview(np.where(word, _LOWER[raw], np.uint8(32))[kept].tobytes())
    first = np.flatnonzero(begins)
    start = np.cumsum(kept)[first] - 1
    length = np.diff(np.append(np.cumsum(word)[first] - 1, word.sum()))
    end = start + length
    low = np.searchsorted(first, at[:-1])
    n_words = np.searchsorted(first, at[1:]) - low
    n = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(n)), n)
    begin = low[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    last = begin + np.minimum(n_words[owner], WIDTH) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(clean[a:b], SEED) for a, b in zip(start[begin].tolist(), end[last].tolist(), strict=True)), np.uint64, len(owner))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        heads = (np.cumsum(n) - n)[some]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int64), heads)
            out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text")).view(np.int64))], ["doc_id", "print"])


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome of the Hamming code the flips that lead to an anchor within RADIUS + HALF_BITS, and
    how many there are. Bit k - 1 has the syndrome k; bit 31 isn't checked."""
    flip = lambda k: 1 << (k - 1) if k else 0
    rows = []
    for s in range(32):
        near = [flip(s), flip(s) | 1 << 31]
        near += [flip(i) | flip(i ^ s) for i in range(1, 32) if s and i < i ^ s]
        rows.append([m for m in near if m.bit_count() <= RADIUS + HALF_BITS])
    most = max(map(len, rows))
    return np.array([r + [0] * (most - len(r)) for r in rows], np.uint64), np.array([len(r) for r in rows])


MASKS, N_MASKS = _masks()


def syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the numbers (1 to 31) of the bits that are set."""
    s = np.zeros(len(half), np.int64)
    for k in range(1, 32):
        s ^= np.where(half >> np.uint64(k - 1) & np.uint64(1), k, 0)
    return s


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with their anchors: bit 32 tells the half, the bits below it the word of the code."""
    for big in batches:
        for low in range(0, big.num_rows, 20_000):
            x = big.column("print").slice(low, 20_000).to_numpy().view(np.uint64)
            for side in (0, 1):
                half = x >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)
                s = syndrome(half)
                row = np.repeat(np.arange(len(x)), N_MASKS[s])
                nth = np.arange(len(row)) - np.repeat(np.cumsum(N_MASKS[s]) - N_MASKS[s], N_MASKS[s])
                anchor = half[row] ^ MASKS[s[row], nth] | np.uint64(side << 32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(x[row].view(np.int64))], ["anchor", "print"])


def _near_anchor(x: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    half = np.where(anchor >> np.uint64(32), x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))
    return np.bitwise_count(half ^ (anchor & np.uint64(0xFFFFFFFF))) <= RADIUS


def forest(x: np.ndarray, pivot: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning forest of the links between pivots and all fingerprints of one group. What is in a pivot's
    component already isn't compared with it."""
    root = np.arange(len(x))
    src, dst = [], []
    for p in np.flatnonzero(pivot):
        left = np.flatnonzero(root != root[p])
        hit = left[np.bitwise_count(x[left] ^ x[p]) <= BITS]
        if len(hit):
            roots, first = np.unique(root[hit], return_index=True)
            src += [int(x[p].view(np.int64))] * len(roots)
            dst += x[hit[first]].view(np.int64).tolist()
            root[np.isin(root, roots)] = root[p]
    return src, dst


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and part; the last group of a batch may go on in the next one."""
    held: list[pa.RecordBatch] = []

    def links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        anchor, cell, x = (table.column(c).to_numpy() for c in ("anchor", "cell", "print"))
        x, code = x.view(np.uint64), anchor.view(np.uint64)
        fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])])
        first = np.flatnonzero(fresh)
        n = np.diff(np.append(first, len(x)))
        pivot = _near_anchor(x, code)
        src, dst = [], []
        group = np.repeat(np.arange(len(n)), n)
        row = np.flatnonzero(((n > 1) & (n <= SMALL))[group])
        for k in range(1, SMALL):
            row = row[row + k < len(x)]
            row = row[group[row] == group[row + k]]
            if not len(row):
                break
            hit = row[(np.bitwise_count(x[row] ^ x[row + k]) <= BITS) & (pivot[row] | pivot[row + k])]
            src.append(x[hit].view(np.int64))
            dst.append(x[hit + k].view(np.int64))
        for g in np.flatnonzero(n > SMALL):
            own = slice(first[g], first[g] + n[g])
            a, b = forest(x[own], pivot[own])
            src.append(np.array(a, np.int64))
            dst.append(np.array(b, np.int64))
        none = np.zeros(0, np.int64)
        ends = np.unique(np.stack([np.concatenate([*side, none]) for side in (src, dst)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, cell = batch.column("anchor").to_numpy(), batch.column("cell").to_numpy()
        same = (anchor == anchor[-1]) & (cell == cell[-1])
        at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if at or held and (held[-1].column("anchor")[0].as_py(), held[-1].column("cell")[0].as_py()) != (anchor[0], cell[0]):
            whole, held = [*held, *([batch.slice(0, at)] if at else [])], []
            yield links(whole)
        held.append(batch.slice(at))
    if held:
        yield links(held)


def _links(prints: DataFrame, head: int) -> DataFrame:
    """Links (src, dst) that connect all distinct fingerprints (column print) at most BITS apart."""
    rows = prints.select("print").mapInArrow(_anchored, "anchor long, print long")
    hot = stored(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > head).select("anchor", F.ceil(F.col("n") / head).alias("parts")), "simhash-hot")
    many = hot.count()
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    if many:
        small = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
        part = F.pmod(F.xxhash64("print"), F.col("parts"))
        # a pair of parts (i, j), i <= j, is a cell; each row goes to the cells of its part
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q")
        dealt = rows.drop("cell").join(small, "anchor").select("anchor", "print", "parts", part.alias("p"), other).select("anchor", "print", (F.least("p", "q") * F.col("parts") + F.greatest("p", "q") + 1).alias("cell"))
        rows = rows.join(small.select("anchor"), "anchor", "left_anti").unionByName(dealt)
    return stored(rows.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_compare, "src long, dst long"), "simhash-links")


def simhash_components(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fingerprint (16 hex digits), component_id, one row per input row.
    ``head``: fingerprints of one anchor that a task compares at once."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = stored(docs.mapInArrow(_prints, "doc_id long, print long"), "simhash-prints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    links = _links(classes, head)
    label = stored(star_components(links).withColumnRenamed("node", "print"), "simhash-labels")
    discard(links)
    lowest = label.join(classes, "print").groupBy("component").agg(F.min("low").alias("component_id"))
    linked = label.join(lowest, "component").select("print", "component_id")
    copies = classes.filter("n > 1").join(label.select("print"), "print", "left_anti").select("print", F.col("low").alias("component_id"))
    out = prints.join(linked.unionByName(copies), "print", "left")
    real = lambda c: F.nullif(c, F.lit(LAST))
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), real(F.coalesce("component_id", "doc_id")).alias("component_id"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return simhash_components(read(spark, sf_dir, "documents"))
