"""Operator 12: what quality filters do to each other, in every order, from relations of failing ids.

1. One pass over the texts writes the id table of each filter: the rows that fail it, a folder per filter. Rows
   have numbers of their own, so shared or missing doc_ids do no harm. What fails no filter leaves no id behind;
   it is only counted.
2. What survives a prefix depends on which filters it holds, not on their order, so the prefixes of all 120 orders
   are 32 sets. The failing rows, once for each set, are anti-joined with the ids that fail a filter of the set:
   these are each prefix's survivors.
3. For each filter f a semi-join of the survivors of every prefix without f with f's id table gives what f removes
   there, with its part and labels; an anti-join of f's ids under each prefix with the prefix's survivors gives
   what f finds removed already (redundant).
4. Counts by part and prefix are small. Orders are looked up in them: step k of an order is the transition from the
   set of its first k - 1 filters.

All joins of these steps are on the row number, which is unique on one side and occurs at most 32 times on the other: no
key is hot, whatever the sources are. They sort and merge: the files of ids, and of survivors even more, are so small
that Spark would broadcast millions of rows. Labels come to their rows by an inner join, which rows without a doc_id
don't enter. Parts are counted with partial aggregation.

Filters (words are maximal runs without ASCII white space): A under 50 words; B under 65 % distinct words; C over
5 % capitals A-Z; D a character of ``#$%&*|``; E the text of a smaller doc_id (equal SHA-256 digests count as
equal texts).

Defined results: a null text counts as empty (it fails A, and E behind an equal one); a null source is the part ''
together with the empty source; a null doc_id is larger than any other and has no label; rows that share a doc_id
are counted one by one and aren't copies of each other, as none is smaller; where labels repeat a doc_id, a label
holds if one of its rows has it; an empty table has no part and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.functions.runtime import spread
from tubula.llm.common import WS, read, stored

FILTERS = "ABCDE"
#: Least words, least percentage of distinct words, largest percentage of capitals, characters that mark code.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Sets of filters; a set is a number with a bit for each filter.
SETS = 1 << len(FILTERS)
LAST = (1 << 63) - 1


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _own_failures() -> dict[str, Column]:
    """Conditions that a text alone decides, on columns text and words."""
    n = F.size("words")
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
        "C": 100 * (F.length("text") - F.length(F.translate("text", CAPITALS, ""))) > MOST_CAPITALS * F.length("text"),
        "D": F.col("text").rlike(MARKS),
    }


def failing_ids(docs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """docs: doc_id, text, source. Returns the rows (row, doc_id, part) and for each filter its id table (row, part)
    of the rows that fail it, all stored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WS), ""))
    seen = stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in _own_failures().items()]), "audit-rows")
    order = F.coalesce("doc_id", F.lit(LAST))
    first = seen.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    failing = {k: seen.filter(k) for k in "ABCD"} | {"E": seen.join(first, "digest").filter(order > F.col("first"))}
    return seen.select("row", "doc_id", "part"), {k: stored(df.select("row", "part"), f"audit-ids-{k}") for k, df in failing.items()}


def transitions(rows: DataFrame, ids: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """rows and ids as failing_ids returns them, labels: doc_id, quality, toxic. Returns part, prefix (set of
    filters), filter (its number, NULL for what the prefix leaves), n (rows that survive the prefix), removed,
    redundant, good_lost, toxic_lost; only what isn't zero."""
    flag = lambda c: F.max(F.col(c) == 1).alias(c)
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    fails = None
    for k, own in ids.items():
        own = own.select("row", F.lit(_bit(k)).alias("bit"))
        fails = own if fails is None else fails.unionByName(own)
    marked = rows.select("row", "doc_id").join(spread(known.filter("quality or toxic")), "doc_id").select("row", "quality", "toxic")
    some = rows.join(spread(fails.select("row")), "row", "left_semi").join(spread(marked), "row", "left").select("row", "part", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    under = some.withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit(SETS - 1))))
    left = under.alias("u").join(spread(fails).alias("f"), F.expr("u.row = f.row and u.prefix & f.bit != 0"), "left_anti")
    left = stored(left, "audit-survivors")

    zero = F.lit(0).cast("long")
    names = ("n", "removed", "redundant", "good_lost", "toxic_lost")

    def counted(df: DataFrame, number: int | None, **values: Column) -> DataFrame:
        found = df.groupBy("part", "prefix").agg(*[v.cast("long").alias(c) for c, v in values.items()])
        return found.select("part", "prefix", F.lit(number).cast("int").alias("filter"), *[F.col(c) if c in values else zero.alias(c) for c in names])

    one = F.count(F.lit(1))
    clean = rows.join(spread(fails.select("row")), "row", "left_anti").withColumn("prefix", F.lit(SETS))
    out = counted(left, None, n=one).unionByName(counted(clean, None, n=one))
    for k, own in ids.items():
        number = FILTERS.index(k)
        before = F.lit([s for s in range(SETS) if not s & _bit(k)])
        removed = left.filter(F.col("prefix").bitwiseAND(_bit(k)) == 0).join(spread(own.select("row")), "row", "left_semi")
        late = own.withColumn("prefix", F.explode(before)).join(spread(left.select("row", "prefix")), ["row", "prefix"], "left_anti")
        out = out.unionByName(counted(removed, number, removed=one, good_lost=F.count_if("good"), toxic_lost=F.count_if("toxic")))
        out = out.unionByName(counted(late, number, redundant=one))
    return out


def _steps() -> str:
    """The steps of all orders as JSON: order, step, set before, filter."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            out.append({"filter_order": "".join(order), "step": k + 1, "prefix": before, "filter": FILTERS.index(name)})
            before |= _bit(name)
    return json.dumps(out)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text, source; labels: doc_id, quality, toxic. Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part, order of the filters and step."""
    found = stored(transitions(*failing_ids(docs), labels), "audit-counts")
    names = ("removed", "redundant", "good_lost", "toxic_lost")
    cells = found.filter("filter is not null").groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in names])
    # of the orders of all filters, |S|! (4 - |S|)! come to a filter straight after the set S
    orders = F.lit([math.factorial(s.bit_count()) * math.factorial(max(0, len(FILTERS) - 1 - s.bit_count())) for s in range(SETS)])
    share = F.col("removed") * F.element_at(orders, F.col("prefix") + 1)
    own = cells.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("prefix") * len(FILTERS) + F.col("filter"), F.struct(*names)))).alias("cells"),
        *[F.coalesce(F.sum(F.when(F.col("filter") == k, share)), F.lit(0)).alias(f"shapley_{name}") for k, name in enumerate(FILTERS)],
    )
    left = found.filter("filter is null").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("prefix", "n"))).alias("left"))
    steps = F.inline(F.from_json(F.lit(_steps()), "array<struct<filter_order: string, step: int, prefix: int, filter: int>>"))
    each = left.join(spread(own), "part", "left").select("part", "cells", "left", F.array(*[f"shapley_{k}" for k in FILTERS]).alias("shapley"), steps)
    bit = F.expr("shiftleft(1, filter)")
    n = lambda prefix: F.coalesce(F.try_element_at("left", prefix), F.lit(0))
    cell = lambda prefix, name: F.coalesce(F.try_element_at("cells", prefix * len(FILTERS) + F.col("filter"))[name], F.lit(0)).alias(name)
    others = F.lit(SETS - 1) - bit
    return each.select(
        "part",
        "filter_order",
        "step",
        (n(F.col("prefix").bitwiseOR(bit)) + n(F.lit(SETS))).alias("kept"),
        *[cell(F.col("prefix"), c) for c in names[:2]],
        cell(others, "removed").alias("unique_fails"),
        *[cell(F.col("prefix"), c) for c in names[2:]],
        F.coalesce(F.element_at("shapley", F.col("filter") + 1), F.lit(0)).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their labels."""
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT t.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x))::INT
    + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY x), false)::INT AS m
  FROM t LEFT JOIN known USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.name, b.name, g.name, h.name, i.name] AS names, [a.bit, b.bit, g.bit, h.bit, i.bit] AS bits
  FROM f a, f b, f g, f h, f i WHERE a.bit + b.bit + g.bit + h.bit + i.bit = 31 AND (a.bit | b.bit | g.bit | h.bit | i.bit) = 31),
s AS (SELECT array_to_string(names, '') AS filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prefix
  FROM o, unnest(range(1, 6)) AS u(step)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (m & (prefix | bit) = 0) AS kept, sum(n) FILTER (m & prefix = 0 AND m & bit <> 0) AS removed,
    sum(n) FILTER (m & prefix <> 0 AND m & bit <> 0) AS redundant, sum(n) FILTER (m = bit) AS unique_fails,
    sum(good) FILTER (m & prefix = 0 AND m & bit <> 0) AS good_lost, sum(toxic) FILTER (m & prefix = 0 AND m & bit <> 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r
"""
