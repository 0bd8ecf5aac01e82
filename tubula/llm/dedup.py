"""Operator 2: exact duplicates through an extendible-hash index on shared files.

The index has three parts. *Entries* (Parquet in the shared folder): one row per document with the
hash of its normalised text; rows that a map task already knows to be copies (same bytes, same slice)
carry no text, so a group of copies that holds a third of all rows moves one text per slice. The
*directory* maps the leading bits of a hash to a bucket. It doubles until an average bucket holds at most
half of what it may, so its depth follows the bytes and a bucket's number is a shift of the hash; what a
bucket holds is then counted, and those that are still overfull are split further, by as many bits as
their bytes need. *Owner tasks* hold whole buckets, that is ranges of the hash, each of about the same
bytes, walk them in hash order, chain the distinct texts of one hash and compare bytes. A single hash that
overfills a bucket can't be split by bits: its entries go through a first round of owners by salt, and
their chain heads, one text for each salt, meet in a second one.

Defined results: a null text counts as empty; texts are compared after each run of ASCII white space
became one space, so " a" and "a" differ; a null doc_id sorts last; where several rows share the
smallest doc_id, exactly one of them is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import read, slices, stored

#: Bytes of text that a bucket may hold.
BUCKET_BYTES = 16 << 20
#: Owner tasks hold one bucket each up to this number of buckets, then so many bytes at least.
MOST_TASKS, TASK_BYTES = 20_000, 256 << 20
#: Split buckets and hot hashes that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
LAST = (1 << 63) - 1
ENTRY = "doc_id long, {rows}sha256 string, key long, rep long, is_rep boolean, n long, size long, text binary"


def normalise(texts: pa.Array) -> pa.Array:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=r"[ \x09-\x0D]+", replacement=" ")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 36
    for batch in slices(batches, "text"):
        texts = normalise(batch.column("text")).cast(pa.binary()).to_pylist()
        ids = pc.fill_null(batch.column("doc_id"), LAST).to_pylist()
        digests = [hashlib.sha256(t).digest() for t in texts]
        chains: dict[bytes, list[list[int]]] = {}
        for row, (digest, text) in enumerate(zip(digests, texts, strict=True)):
            chain = chains.setdefault(digest, [])
            for group in chain:
                if texts[group[0]] == text:
                    group.append(row)
                    break
            else:
                chain.append([row])
        rep, is_rep, n = [0] * len(texts), [False] * len(texts), [0] * len(texts)
        for chain in chains.values():
            for group in chain:
                head = min(group, key=lambda r: (ids[r], r))
                is_rep[head], n[head] = True, len(group)
                for row in group:
                    rep[row] = number + head
        number += len(texts)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                **({"row_id": batch.column("row_id")} if "row_id" in batch.schema.names else {}),
                "sha256": [d.hex() for d in digests],
                "key": pa.array([int.from_bytes(d[:8], signed=True) for d in digests], pa.int64()),
                "rep": pa.array(rep, pa.int64()),
                "is_rep": pa.array(is_rep),
                "n": pa.array(n, pa.int64()),
                "size": pa.array([len(t) for t in texts], pa.int64()),
                "text": pa.array([t if r else None for t, r in zip(texts, is_rep, strict=True)], pa.binary()),
            }
        )


def global_depth(total: int, capacity: int) -> int:
    """Bits that the directory looks at: it doubles while its buckets are more than half full on average."""
    depth = 0
    while total > capacity << depth >> 1:
        depth += 1
    return depth


def owner_tasks(depth: int, total: int) -> int:
    """Tasks over the buckets of the directory."""
    return min(1 << depth, max(MOST_TASKS, total // TASK_BYTES))


def _cell(depth: int) -> Column:
    """Bucket of a hash: its leading bits."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def _routed(heads: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Heads with owner (task), and salts (more than 1 for a hash that overfills a bucket); the number of
    owners. Overfull buckets are split by more bits, each part has an owner of its own."""
    total = heads.agg(F.sum(F.col("size") + 64)).first()[0] or 0
    depth = global_depth(total, capacity)
    tasks = owner_tasks(depth, total)
    placed = heads.withColumn("cell", _cell(depth))
    own = F.floor(F.col("cell") * tasks / (1 << depth)).cast("long")
    size = F.sum(F.col("size") + 64).alias("bytes")
    over = stored(placed.groupBy("cell").agg(size).filter(F.col("bytes") > capacity), "dedup-overfull")
    few = over.count()
    if not few:
        return placed.select("key", "rep", "n", "doc_id", "text", own.alias("owner"), F.lit(1).cast("long").alias("salts")), tasks
    small = (lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df)
    keys = stored(placed.join(small(over.select("cell"), few), "cell", "left_semi").groupBy("cell", "key").agg(size), "dedup-keys")
    hot = stored(keys.filter(F.col("bytes") > capacity).select("key", F.ceil(F.col("bytes") / capacity).alias("salts")), "dedup-hot")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rest") * 2.0 / capacity))).cast("int")
    split = keys.filter(F.col("bytes") <= capacity).groupBy("cell").agg(F.sum("bytes").alias("rest")).filter(F.col("rest") > capacity).select("cell", bits.alias("bits"))
    split = stored(split, "dedup-split")
    routed = placed.join(small(hot, hot.count()), "key", "left").join(small(split, split.count()), "cell", "left")
    # parts and salts go round the owners, next to their bucket's one
    part = F.coalesce(F.expr(f"shiftrightunsigned(shiftleft(key, {depth}), 64 - bits)"), F.lit(0))
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("rep"), F.col("salts"))).otherwise(0)
    parts = split.agg(F.coalesce(F.sum(F.expr("shiftleft(1L, bits)")), F.lit(0))).first()[0] + hot.agg(F.coalesce(F.sum("salts"), F.lit(0))).first()[0]
    return routed.select("key", "rep", "n", "doc_id", "text", F.pmod(own + part + salt, F.lit(tasks + parts)).alias("owner"), F.coalesce("salts", F.lit(1)).alias("salts")), tasks + parts


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their keys. Chains the distinct texts of one key and gives each entry
    the head of its chain link, the smallest doc_id and the number of members."""
    key: int | None = None
    chain: list[dict] = []

    def closed() -> Iterator[pa.RecordBatch]:
        for link in chain:
            n = len(link["reps"])
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": pa.array(link["reps"], pa.int64()),
                    "head": pa.array([link["keep"][1]] * n, pa.int64()),
                    "keep_id": pa.array([None if link["keep"][0] == LAST else link["keep"][0]] * n, pa.int64()),
                    "group_size": pa.array([link["size"]] * n, pa.int64()),
                }
            )

    for batch in batches:
        out = []
        ids = pc.fill_null(batch.column("doc_id"), LAST).to_pylist()
        for k, rep, n, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "rep", "n")), ids, batch.column("text"), strict=True):
            if k != key:
                out += closed()
                key, chain = k, []
            view = text.as_buffer()
            for link in chain:
                if link["text"].equals(view):
                    break
            else:
                # a copy of the bytes: a view would hold the whole batch
                chain.append(link := {"text": pa.py_buffer(view.to_pybytes()), "keep": (doc_id, rep), "size": 0, "reps": []})
            link["keep"], link["size"] = min(link["keep"], (doc_id, rep)), link["size"] + n
            link["reps"].append(rep)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    yield from closed()


OWNED = "rep long, head long, keep_id long, group_size long"


def _owned(rows: DataFrame, owners: int) -> DataFrame:
    """Owner tasks: each holds the rows of its number in the order of their hashes."""
    return rows.repartitionById(owners, F.col("owner").cast("int")).sortWithinPartitions("key").select("key", "rep", "n", "doc_id", "text").mapInArrow(_owner, OWNED)


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, rows: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. rows:
    docs have a row_id (long), which comes back."""
    own = ["row_id"] if rows else []
    entries = stored(docs.select(F.col("doc_id").cast("long"), *own, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_entries, ENTRY.format(rows="row_id long, " if rows else "")), "dedup-entries")
    routed, owners = _routed(entries.filter("is_rep"), bucket_bytes)
    index = stored(_owned(routed, owners), "dedup-index")
    salted = routed.filter("salts > 1")
    if salted.limit(1).count():
        again = (
            salted.select("key", "rep", "text", F.pmod(F.xxhash64("key"), F.lit(owners)).alias("owner"))
            .join(index.groupBy("head").agg(F.first("keep_id").alias("doc_id"), F.first("group_size").alias("n")), F.col("rep") == F.col("head"))
        )
        second = stored(_owned(again, owners), "dedup-index").select(F.col("rep").alias("head"), F.col("head").alias("head2"), F.col("keep_id").alias("keep2"), F.col("group_size").alias("size2"))
        index = index.join(second, "head", "left").select("rep", F.coalesce("head2", "head").alias("head"), F.when(F.col("head2").isNull(), F.col("keep_id")).otherwise(F.col("keep2")).alias("keep_id"), F.coalesce("size2", "group_size").alias("group_size"))
    return entries.select("doc_id", *own, "rep", "is_rep", "sha256").join(index, "rep").select(
        "doc_id",
        *own,
        "keep_id",
        "group_size",
        (F.col("is_rep") & (F.col("rep") == F.col("head"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
