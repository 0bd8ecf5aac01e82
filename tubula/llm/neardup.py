"""Operator 5: near duplicates by an inverted join on signature coordinates.

1. Each text gives the set of its distinct word shingles (64-bit hashes) and a MinHash signature of
   ``COORDINATES`` values. Texts with the same set form a class, so copies never meet as pairs; a class
   gets a number, and classes are what is joined.
2. Every (coordinate, value) of a class is a posting. A link needs collisions in at least
   ``matches_needed`` coordinates. Postings that only one class has can't collide, so a class with too
   few shared postings is skipped, and of the others only the prefix is merged: the rarest shared
   postings, as many as leave one short of the threshold behind. Any pair above the threshold meets in a
   prefix.
3. Posting lists are merged in sorted order, each list once. The first class of a list, the one with the
   longest posting lists in all, is its centre;
   collisions of all others with it are counted on short signatures (one byte a coordinate, which can
   only add collisions). Those with enough collisions are skipped from then on, the first one that is
   left is the next centre, and so on: stars, not all pairs. The number of coordinates in which short
   signatures differ is a distance, so of two classes that collide often enough the first one that is
   skipped has a centre that both are within twice the limit of: no candidate is lost. Of a list longer
   than ``HEAD`` a part of that size (by hash) is merged first; its centres meet the others by a join,
   and only those that no centre skips are merged in the next round.
4. Pairs of a centre and a class within twice the limit are confirmed on the full sets; links make
   components.
5. The classes around one centre may link across components. They go into blocks, and blocks are
   multiplied: each class is held as its difference from the centre's set, and common elements of two
   differences give the exact size of the intersection. A component that fills blocks of its own isn't
   compared with itself, and a pair of blocks returns the components that it joins, not the pairs; so a
   large group of near copies costs one star and a few products.

MinHash can miss a link: with 64 coordinates and a threshold 3.5 standard deviations below the mean,
a pair just at the limit is missed with a probability of about 1/4000, pairs above it less. Confirmed
links are exact.

Defined results: null and empty texts have an empty set, n_shingles 0 and are linked with nothing; a
text with fewer words than a shingle has its whole sequence as one; rows that share a doc_id are texts
of their own, each linked by its own set; a null doc_id is larger than any other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import mix64, read, slices, split_words, stored, word_codes
from tubula.operators.components import star_components

COORDINATES = 64
#: Texts in a block, and bytes of differences in it.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Classes of one posting list that a task merges at once.
HEAD = 4096
#: Classes whose ids may be broadcast (32 MB); beyond that the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_RNG = np.random.default_rng(7)
_FACTOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def matches_needed(percent: int, coordinates: int = COORDINATES) -> int:
    """Collisions that a pair with the given similarity has, but for 3.5 standard deviations."""
    s = percent / 100
    return max(1, math.floor(coordinates * s - 3.5 * math.sqrt(coordinates * s * (1 - s))))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = split_words(texts)
    code, distinct = word_codes(words)
    own = np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)
    h = own[code] if len(code) else np.zeros(0, np.uint64)
    full = max(0, len(h) - width + 1)
    mixed = np.zeros(full, np.uint64)
    for i in range(width):
        mixed = mix64(mixed * _STEP + h[i : i + full])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(mixed[a : b - width + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = mix64(x * _STEP + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    low = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 8192):
        part = shingles[i : i + 8192, None] * _FACTOR + _SHIFT
        low = np.minimum(low, (part.min(0) >> np.uint64(32)).astype(np.uint32))
    return low


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    **({"row_id": batch.column("row_id")} if "row_id" in batch.schema.names else {}),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([_digest(s) for s in sets], pa.binary()),
                    "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return run


def _fixed(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    data = pa.concat_arrays([column]).cast(pa.binary()) if len(column) else column
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1] if len(column) else [0, 0]
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = _fixed(batch.column("sig"), COORDINATES, "<u4").astype(np.int64)
            posting = sig | np.arange(COORDINATES, dtype=np.int64) << 32
            yield pa.RecordBatch.from_pydict({"posting": posting.ravel(), "node": np.repeat(batch.column("node").to_numpy(), COORDINATES)})


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with short signatures."""
    for batch in batches:
        if batch.num_rows:
            sig = np.ascontiguousarray(_fixed(batch.column("sig"), COORDINATES, "<u4").astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in sig], pa.binary())], ["node", "short"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_pydict({"digest": pa.array([_digest(s) for s in sets], pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def merge_lists(posting: np.ndarray, node: np.ndarray, short: np.ndarray, needed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Centres of whole posting lists, sorted by posting, with the classes within twice the limit of them
    (posting, centre, class). A centre comes with itself, and with others only if it skips one: a pair that
    collides often enough has a centre that skips one of the two, or is a centre and skips the other."""
    near = max(0, 2 * needed - COORDINATES)
    left = np.arange(len(posting))
    while len(left):
        first = np.flatnonzero(np.concatenate([[True], posting[left[1:]] != posting[left[:-1]]]))
        centre = left[np.repeat(first, np.diff(np.append(first, len(left))))]
        hits = (short[centre] == short[left]).sum(1)
        skipped = np.add.reduceat(hits >= needed, first)
        alone = np.repeat(skipped == 1, np.diff(np.append(first, len(left))))
        close = (hits >= near) & ~(alone & (centre != left))
        yield posting[left[close]], node[centre[close]], node[left[close]]
        left = left[hits < needed]


def _merge(needed: int):
    """Rows (posting, node, short) come sorted; a list's end may lie in a later batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def merged(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            own = [table.column(c).to_numpy() for c in ("posting", "node")]
            short = np.concatenate([_fixed(c, COORDINATES, "u1") for c in table.column("short").chunks])
            for p, a, b in merge_lists(*own, short, needed):
                if len(p):
                    yield pa.RecordBatch.from_pydict({"posting": p, "a": a, "b": b})

        for batch in batches:
            if batch.num_rows:
                posting = batch.column("posting").to_numpy()
                at = int(np.searchsorted(posting, posting[-1]))
                if at or held and held[-1].column("posting")[0].as_py() != posting[0]:
                    whole = [*held, *([batch.slice(0, at)] if at else [])]
                    held = []
                    yield from merged(whole)
                held.append(batch.slice(at))
        if held:
            yield from merged(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collisions of classes with centres."""
    for batch in batches:
        if batch.num_rows:
            hits = (_fixed(batch.column("short"), COORDINATES, "u1") == _fixed(batch.column("short_a"), COORDINATES, "u1")).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("posting", "a", "b")), pa.array(hits, pa.int32())], ["posting", "a", "b", "hits"])


def _confirm(percent: int):
    """Whether pairs reach the similarity on their full sets, and how b differs from a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set_a"):
            out: list[tuple] = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                apart = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(apart)) // 2
                out.append((100 * both >= percent * (len(x) + len(y) - both), len(x), len(x) - both, len(y) - both, apart.tobytes()))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], ["a", "b", "linked", "n_a", "removed", "added", "apart"])

    return run


def _common(apart: list[np.ndarray], split: int, chunk: int = 16384) -> np.ndarray:
    """Sizes of the intersections of the first ``split`` sorted sets with the others, by products of
    incidence matrices over chunks of the elements that several sets have."""
    flat, owner = np.concatenate(apart), np.repeat(np.arange(len(apart)), [len(x) for x in apart])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner, at = owner[n[at] > 1], at[n[at] > 1]
    _, at = np.unique(at, return_inverse=True)
    out = np.zeros((split, len(apart) - split), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at.max(initial=-1)) + 1, chunk):
        a, b = np.searchsorted(at, [low, low + chunk])
        has = np.zeros((len(apart), chunk), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        out += has[:split] @ has[split:].T
    return out


def _joined(percent: int):
    """Components that links between two blocks around one centre join, without detours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for left, right, n in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "n_a")), strict=True):
                (ca, ra, pa_), (cb, rb, pb) = (tuple(np.array([r[c] for r in own], np.int64) for c in ("component", "removed", "added")) for own in (left, right))
                common = _common([np.frombuffer(r["apart"], "<u8") for r in left + right], len(left)).astype(np.int64)
                both = n - ra[:, None] - rb[None] + common
                sizes = (n - ra + pa_)[:, None] + (n - rb + pb)[None]
                i, j = np.nonzero((100 * both >= percent * (sizes - both)) & (ca[:, None] != cb[None]))
                root: dict[int, int] = {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    return x

                for x, y in np.unique(np.stack([ca[i], cb[j]], 1), axis=0).tolist():
                    if (p := find(x)) != (q := find(y)):
                        root[max(p, q)] = min(p, q)
                        src.append(x)
                        dst.append(y)
            yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with what _confirm says. The set of a centre of many pairs is read once for each of
    them; the join's skewed side is split by adaptive execution."""
    other = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = other.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return stored(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long, linked boolean, n_a long, removed long, added long, apart binary"), "near-stars")


def _met(blocks: DataFrame, key: str, *more: str) -> DataFrame:
    """Pairs of blocks (key, block, own) of one key, each block with itself too."""
    other = blocks.select(key, F.col("block").alias("block2"), F.col("own").alias("right"))
    return blocks.select(key, "block", F.col("own").alias("left"), *more).join(other, key).filter("block <= block2")


def _stars(prefix: DataFrame, needed: int, head: int) -> DataFrame:
    """Distinct pairs (centre, class) at most twice the limit apart. prefix: node, short, fame (lengths of all
    its posting lists, summed), longest (of its lists), lists (array of df, posting)."""
    schema = "posting long, a long, b long"
    rows = prefix.select("node", "short", "fame", F.explode("lists").alias("l")).select("l.posting", "l.df", "node", "short", "fame")
    chosen = lambda k: F.pmod(F.xxhash64("node", "posting", F.lit(k)), F.col("df")) < head
    merge = lambda df: df.repartition("posting").sortWithinPartitions("posting", F.desc("fame"), "node").select("posting", "node", "short").mapInArrow(_merge(needed), schema)
    if not prefix.filter(F.col("longest") > head).limit(1).count():
        return merge(rows).filter("a <> b").select("a", "b").distinct()
    near = stored(merge(rows.filter(chosen(0))), "near-heads")
    out, rest = near, rows.filter(~chosen(0))
    short = prefix.select("node", "short")
    for k in itertools.count(1):
        centres = near.filter("a = b").select("posting", "a").join(short.select(F.col("node").alias("a"), F.col("short").alias("short_a")), "a")
        met = stored(rest.withColumnRenamed("node", "b").join(centres, "posting").select("posting", "a", "b", "short", "short_a").mapInArrow(_meet, f"{schema}, hits int"), "near-met")
        out = out.unionByName(met.filter(F.col("hits") >= max(0, 2 * needed - COORDINATES)).select("posting", "a", "b"))
        skipped = met.filter(F.col("hits") >= needed).select("posting", F.col("b").alias("node")).distinct()
        left = stored(rest.join(skipped, ["posting", "node"], "left_anti").select("posting", "node", "short", "fame"), "near-left")
        if not left.limit(1).count():
            return out.filter("a <> b").select("a", "b").distinct()
        rest = stored(left.join(left.groupBy("posting").agg(F.count(F.lit(1)).alias("df")), "posting"), "near-left")
        near = stored(merge(rest.filter(chosen(k))), "near-heads")
        out, rest = out.unionByName(near), rest.filter(~chosen(k))


def _around(stars: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Edges (src, dst) between components that links among the classes around one centre join."""
    own = stars.select("a", F.col("b").alias("node"), "n_a", "removed", "added", "apart").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = stored(own.groupBy("a", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("apart")).alias("bytes")), "near-counts")
    big = (F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES)
    tally = counts.groupBy("a").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.when(~big, F.col("n")).otherwise(0)).alias("small_n"), F.sum(F.when(~big, F.col("bytes")).otherwise(0)).alias("small_bytes")).filter("parts > 1")
    many = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES))
    placed = counts.join(tally, "a").select("a", "component", big.alias("big"), F.when(big, many("n", "bytes")).otherwise(many("small_n", "small_bytes")).alias("blocks"))
    block = F.struct(F.when(F.col("big"), F.col("component")).alias("own"), F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).alias("part"))
    blocks = own.join(placed, ["a", "component"]).groupBy("a", block.alias("block")).agg(F.first("n_a").alias("n_a"), F.collect_list(F.struct("component", "removed", "added", "apart")).alias("own"))
    met = _met(stored(blocks, "near-blocks"), "a", "n_a").filter("not (block.own <=> block2.own and block.own is not null)")
    return stored(met.select("left", "right", "n_a").mapInArrow(_joined(percent), "src long, dst long"), "near-bridges")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, head: int = HEAD, rows: bool = False) -> DataFrame:
    """docs: doc_id, text. Links documents whose shingle sets have a Jaccard similarity of at least
    ``percent`` / 100 and returns doc_id, n_shingles, component_id, kept, component (a number that tells
    components apart even where they share an id, NULL for empty sets), one row per input row. ``head``:
    classes of a posting list that are merged at once. rows: docs have a row_id (long), which comes back."""
    own = ["row_id"] if rows else []
    docs = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    needed = matches_needed(percent)
    texts = stored(docs.mapInArrow(_describe(width), f"doc_id long, {'row_id long, ' if rows else ''}n_shingles long, digest binary, sig binary"), "near-signatures")
    classes = texts.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    postings = classes.select("node", "sig").mapInArrow(_postings, "posting long, node long")
    shared = postings.join(postings.groupBy("posting").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "posting")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "posting"))).alias("lists")).filter(F.size("lists") >= needed)
    fame = F.aggregate("lists", F.lit(0).cast("long"), lambda a, x: a + x["df"])
    lists = lists.select("node", fame.alias("fame"), F.slice("lists", F.lit(1), F.size("lists") - needed + 1).alias("lists")).withColumn("longest", F.element_at("lists", -1)["df"])
    prefix = stored(lists.join(classes.select("node", "sig").mapInArrow(_short, "node long, short binary"), "node"), "near-prefix")

    pairs = stored(_stars(prefix, needed, head), "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(ends.join(classes.select("node", "doc_id", "digest"), "node"), "near-wanted")
    few = wanted.count() <= BROADCAST_IDS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    sets = docs.select("doc_id", "text").join(small(wanted.select("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(width), "digest binary, shingles binary")
    sets = stored(sets.join(small(wanted.select("digest", "node")), "digest").select("node", "shingles").dropDuplicates(["node"]), "near-sets")

    stars = _confirmed(pairs, sets, percent)
    label = stored(star_components(stars.filter("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))), "near-labels")
    bridges = _around(stars, label, percent)
    if bridges.limit(1).count():
        label = stored(star_components(label.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(bridges)), "near-labels")

    members = label.join(classes.select("node", "doc_id", "digest"), "node")
    lowest = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = members.join(lowest, "component").select("digest", "component_id", "component")
    alone = classes.join(label.select("node"), "node", "left_anti").select("digest", F.col("doc_id").alias("component_id"), F.col("node").alias("component"))
    out = texts.select("doc_id", *own, "n_shingles", "digest").join(named.unionByName(alone), "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    real = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return out.select(real("doc_id"), *own, "n_shingles", real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"), "component")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, similarity 0.85."""
    return near_components(read(spark, sf_dir, "documents"), 3, 85).drop("component")
