"""Operator 11: phrase collocations from weighted acyclic automata.

1. *Shards.* Texts become words and pieces; the sorted n-grams of one to three words of a slice, with their
   counts, build an acyclic automaton: a path of words is an n-gram, the weight of its last arc the count. States
   are closed in sorted order and registered by their arcs (words, weights, targets), so equal continuations are
   one state. Slices are united until a shard is large, and shards are stored.
2. *Union by prefix range.* Every shard gives its n-grams at equal distances; their order cuts each language's
   n-grams into prefix ranges of about the same size. No two-word prefix is cut; one that fills several ranges is
   dealt over as many tasks by salt, whose sums meet in a second round. Shards are cut at the range borders, and a
   task unites the fragments of its range and sums weights. What is then below the least count can be neither a
   candidate nor a part of one and is left out, the rest is the range's automaton.
3. *Composition.* Candidates are the paths of two and three words. Their parts are requests; each goes to the
   range of its prefix, where it is composed with the range's automaton (walked arc by arc, states stay shared),
   which gives its count.
4. Scores are exact decimals; the lowest cut counts. Shorter candidates that a longer one holds often enough fall.

Defined results: a null text counts as empty, a null language is ``und``; counts are of all rows, so repeated rows
and shared ids count each time; a language without candidates has no rows; ties of all three keys can't be, as a
phrase is one row of its language; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tubula.llm.common import discard, mix64, read, slices, stored

#: Least count of a candidate; share (per cent) of a candidate's count at which a longer one makes it fall; rows a language.
LEAST, SHARE, TOP = 10, 50, 2000
#: Bytes of text, and words of one text, that are counted at once.
TEXT_BYTES, CHUNK_WORDS = 2 << 20, 1 << 20
#: N-grams of a shard, of a prefix range, and from one sampled key to the next.
SHARD_ENTRIES, RANGE_ENTRIES, STEP = 1_000_000, 2_000_000, 8192
#: Keys that the driver may hold to choose borders; with more of them each is kept with a lower probability.
MOST_KEYS = 1_000_000
#: Parts that may be broadcast to the candidates (tens of MB).
BROADCAST_PARTS = 200_000
#: Bits of a word's number in a packed n-gram.
BITS = 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 within a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Grams:
    """Sorted distinct n-grams with counts. words: sorted byte strings; a, b, c: places in it plus one, with 0 for
    no word; n: counts."""

    def __init__(self, words: pa.Array, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray):
        self.words, self.a, self.b, self.c, self.n = words, a, b, c, n

    def __len__(self) -> int:
        return len(self.a)

    def rows(self, at: np.ndarray | slice) -> Grams:
        return Grams(self.words, self.a[at], self.b[at], self.c[at], self.n[at])

    def narrow(self) -> Grams:
        """With only the words that occur."""
        used = np.zeros(len(self.words) + 1, bool)
        for x in (self.a, self.b, self.c):
            used[x] = True
        used[0] = False
        place = np.cumsum(used).astype(np.int32)
        place[0] = 0
        return Grams(self.words.take(pa.array(np.flatnonzero(used) - 1)), place[self.a], place[self.b], place[self.c], self.n)


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 2 * BITS | b.astype(np.int64) << BITS | c.astype(np.int64)


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and the place (from 1) of each given one."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def word_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts in a row (lower-cased), the piece that each lies in, and its text's place."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = _KIND[raw]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[1:-1][at[1:-1] < len(raw)]
    begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    owner = np.searchsorted(at, start, side="right") - 1
    piece = np.cumsum(kind == 2)[start] + owner
    offsets = np.append(np.cumsum(word)[start] - 1, word.sum()).astype(np.int64)
    values = _LOWER[raw[word]]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(values)]), piece, owner


def count_grams(words: pa.Array, piece: np.ndarray, new: int) -> Grams:
    """N-grams of up to three words that start in the first ``new`` words and stay within a piece."""
    distinct, w = _ranked(words)
    w = w.astype(np.int64)
    one = w[:new]
    pair = np.flatnonzero(piece[:-1] == piece[1:])
    pair = pair[pair < new]
    triple = np.flatnonzero(piece[:-2] == piece[2:])
    triple = triple[triple < new]
    code, n = np.unique(np.concatenate([one << 2 * BITS, w[pair] << 2 * BITS | w[pair + 1] << BITS, w[triple] << 2 * BITS | w[triple + 1] << BITS | w[triple + 2]]), return_counts=True)
    low = (1 << BITS) - 1
    return Grams(distinct, (code >> 2 * BITS).astype(np.int32), (code >> BITS & low).astype(np.int32), (code & low).astype(np.int32), n).narrow()


def unite(parts: list[Grams]) -> Grams:
    """Union of n-grams; counts of equal ones are summed."""
    if len(parts) == 1:
        return parts[0]
    words, place = _ranked(pa.concat_arrays([p.words for p in parts]))
    low, columns = 0, ([], [], [])
    for p in parts:
        own = np.concatenate([[np.int32(0)], place[low : low + len(p.words)]])
        low += len(p.words)
        for out, x in zip(columns, (p.a, p.b, p.c), strict=True):
            out.append(own[x])
    a, b, c = (np.concatenate(x) for x in columns)
    n = np.concatenate([p.n for p in parts])
    if len(words) < 1 << BITS:
        code = _packed(a, b, c)
        order = np.argsort(code, kind="stable")
        code = code[order]
        fresh = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    else:
        order = np.lexsort((c, b, a))
        fresh = np.zeros(len(order), bool)
        for x in (a[order], b[order], c[order]):
            fresh[1:] |= x[1:] != x[:-1]
        fresh[:1] = True
    first = np.flatnonzero(fresh)
    return Grams(words, a[order][first], b[order][first], c[order][first], np.add.reduceat(n[order], first) if len(first) else n[:0])


def _register(size: np.ndarray, *labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States with ``size`` arcs each, arcs in a row. Returns each state's number, equal ones having the same, and
    the arcs of the numbered states in order. States are told apart by a hash and then arc by arc."""
    arcs, owner = int(size.sum()), np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    h = np.zeros(arcs, np.uint64)
    for x in labels:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h)])
    state = mix64(total[start + size] - total[start] + size.astype(np.uint64))
    _, first, number = np.unique(state, return_index=True, return_inverse=True)
    model = first[number]
    same = size == size[model]
    at = np.minimum(start[model[owner]] + np.arange(arcs) - start[owner], max(arcs - 1, 0))
    for x in labels:
        same[owner[x != x[at]]] = False
    kept = np.zeros(len(size), bool)
    kept[first] = True
    kept |= ~same
    place = np.cumsum(kept) - 1
    return np.where(same, place[model], place), np.flatnonzero(kept[owner])


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


class CountAutomaton:
    """Acyclic automaton over words: root arcs (word, weight, target), then two layers of shared states with arcs
    (state, word, weight[, target]) in order of state and word. An n-gram's count is the weight of its last arc; an
    arc that is there only for what follows it weighs 0."""

    FIELDS = ("word1", "n1", "to1", "state2", "word2", "n2", "to2", "state3", "word3", "n3")
    #: Fields in ascending order, stored as differences.
    ASCENDING = ("word1", "state2", "state3")
    #: Fields that ascend within a state.
    WITHIN = {"word2": "state2", "word3": "state3"}

    def __init__(self, words: pa.Array, **arrays: np.ndarray):
        self.words = words
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    @staticmethod
    def of(g: Grams) -> CountAutomaton:
        """From sorted n-grams; a missing first word of a longer one gets an arc of weight 0."""
        lack = np.flatnonzero(np.concatenate([[True], g.a[1:] != g.a[:-1]]) & (g.b > 0)) if len(g) else np.zeros(0, np.int64)
        a, b, c, n = (np.insert(x, lack, y) for x, y in ((g.a, g.a[lack]), (g.b, 0), (g.c, 0), (g.n, 0)))
        one, two, three = (np.flatnonzero(x) for x in (b == 0, (b > 0) & (c == 0), c > 0))
        size3 = np.bincount(np.searchsorted(two, three) - 1, minlength=len(two))
        to2, arcs3 = _register(size3, c[three], n[three])
        size2 = np.bincount(np.searchsorted(one, two) - 1, minlength=len(one))
        to1, arcs2 = _register(size2, b[two], n[two], to2)
        owner3, owner2 = np.repeat(to2, size3)[arcs3], np.repeat(to1, size2)[arcs2]
        return CountAutomaton(g.words, word1=a[one], n1=n[one], to1=to1, state2=owner2, word2=b[two][arcs2], n2=n[two][arcs2], to2=to2[arcs2], state3=owner3, word3=c[three][arcs3], n3=n[three][arcs3])

    def grams(self) -> Grams:
        """All n-grams in order."""

        def below(target: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            low, high = np.searchsorted(state, target), np.searchsorted(state, target, side="right")
            size = high - low
            return size, np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())

        size2, arc2 = below(self.to1, self.state2)
        size3, arc3 = below(self.to2[arc2], self.state3)
        up2 = np.repeat(np.arange(len(size2)), size2)
        up3 = np.repeat(np.arange(len(size3)), size3)
        total = len(self.word1) + len(arc2) + len(arc3)
        at2 = up2 + 1 + np.arange(len(arc2)) + (np.cumsum(size3) - size3)
        at3 = up2[up3] + up3 + 2 + np.arange(len(arc3))
        at1 = np.arange(len(self.word1)) + np.cumsum(size2) - size2
        at1 += np.concatenate([[0], np.cumsum(size3)])[np.cumsum(size2) - size2]
        a, b, c, n = (np.zeros(total, t) for t in (np.int32, np.int32, np.int32, np.int64))
        a[at1], n[at1] = self.word1, self.n1
        a[at2], b[at2], n[at2] = self.word1[up2], self.word2[arc2], self.n2[arc2]
        a[at3], b[at3], c[at3], n[at3] = self.word1[up2[up3]], self.word2[arc2[up3]], self.word3[arc3], self.n3[arc3]
        return Grams(self.words, a, b, c, n)

    def compose(self, first: pa.Array, second: pa.Array) -> np.ndarray:
        """Counts of one- and two-word phrases (second is empty for one word); 0 for those that aren't there."""
        place = lambda x: pc.fill_null(pc.index_in(x.cast(pa.large_binary()), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        if not len(self.word1):
            return np.zeros(len(first), np.int64)
        w, v, both = place(first), place(second), pc.greater(pc.binary_length(second), 0).to_numpy(zero_copy_only=False)
        arc = np.minimum(np.searchsorted(self.word1, w), len(self.word1) - 1)
        found = (self.word1[arc] == w) & (w > 0)
        out = np.where(found & ~both, self.n1[arc], 0)
        if len(self.word2):
            key = self.state2.astype(np.int64) << 32 | self.word2
            want = self.to1[arc].astype(np.int64) << 32 | v
            arc2 = np.minimum(np.searchsorted(key, want), len(key) - 1)
            out = np.where(found & both & (v > 0) & (key[arc2] == want), self.n2[arc2], out)
        return out

    def to_bytes(self) -> bytes:
        size = pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        arrays = [_small(size), *(_small(self._apart(k)) for k in self.FIELDS)]
        head = np.array([len(arrays), *[x for y in arrays for x in (y.itemsize, len(y))]], np.int64)
        # all first bytes of an array's numbers, then all second ones: these are smaller compressed
        planes = (x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
        data = b"".join([head.tobytes(), *planes, b"".join(self.words.to_pylist())])
        return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)

    def _apart(self, k: str) -> np.ndarray:
        """Numbers of a field, as what they add to the one before where they ascend (words: within a state)."""
        x = getattr(self, k)
        if k in self.ASCENDING:
            return np.diff(x, prepend=0)
        if k in self.WITHIN:
            state = getattr(self, self.WITHIN[k])
            return np.where(np.diff(state, prepend=-1) == 0, np.diff(x, prepend=0), x)
        return x

    @staticmethod
    def from_bytes(data: bytes) -> CountAutomaton:
        data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        count = int(np.frombuffer(data, np.int64, 1)[0])
        shape = np.frombuffer(data, np.int64, 2 * count, 8).reshape(count, 2)
        at, arrays = 8 + 16 * count, []
        for width, n in shape.tolist():
            plane = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n)
            arrays.append(np.ascontiguousarray(plane.T).view(f"<u{width}")[:, 0].astype(np.int64) if n else np.zeros(0, np.int64))
            at += width * n
        offsets = np.concatenate([[0], np.cumsum(arrays[0])]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(arrays[0]), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:])])
        fields = {k: np.cumsum(x) if k in CountAutomaton.ASCENDING else x for k, x in zip(CountAutomaton.FIELDS, arrays[1:], strict=True)}
        for k, state in CountAutomaton.WITHIN.items():
            x, first = fields[k], np.flatnonzero(np.diff(fields[state], prepend=-1) != 0)
            total = np.cumsum(x)
            fields[k] = total - np.repeat((total - x)[first], np.diff(np.append(first, len(x))))
        return CountAutomaton(words, **fields)


SHARD = "lang string, entries long, words long, first array<binary>, second array<binary>, automaton binary"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Automata of this task's texts by language."""
    open_: dict[str, list] = {}

    def closed(lang: str) -> Iterator[pa.RecordBatch]:
        parts, words = open_.pop(lang)
        g = unite(parts)
        at = np.arange(STEP // 2, len(g), STEP)
        names = np.array([b"", *g.words.to_pylist()], object)
        row = {"lang": [lang], "entries": [len(g)], "words": [words], "first": [names[g.a[at]].tolist()], "second": [names[g.b[at]].tolist()], "automaton": [CountAutomaton.of(g).to_bytes()]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("lang", pa.string()), ("entries", pa.int64()), ("words", pa.int64()), ("first", pa.list_(pa.binary())), ("second", pa.list_(pa.binary())), ("automaton", pa.binary())]))

    for batch in slices(batches, "text", TEXT_BYTES):
        langs = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.column("text").filter(pc.equal(langs.indices, k))
            words, piece, _ = word_pieces(own)
            for low in range(0, len(words), CHUNK_WORDS):
                new = min(CHUNK_WORDS, len(words) - low)
                g = count_grams(words.slice(low, new + 2), piece[low : low + new + 2], new)
                held = open_.setdefault(lang, [[], 0])
                held[0].append(g)
                held[1] += new
                if sum(map(len, held[0])) > SHARD_ENTRIES:
                    yield from closed(lang)
        if sum(len(g) for parts, _ in open_.values() for g in parts) > 2 * SHARD_ENTRIES:
            for lang in list(open_):
                yield from closed(lang)
    for lang in list(open_):
        yield from closed(lang)


#: Borders of a language's ranges (pairs of words in order), and the number of salts of each range, the first one
#: being before the first border.
Borders = dict[str, tuple[list[tuple[bytes, bytes]], list[int]]]


def borders(shards: DataFrame) -> Borders:
    """Cuts the sampled keys of each language evenly. A language with less than a range has no entry."""
    keys = shards.filter("size(first) > 0").select("lang", F.explode(F.arrays_zip("first", "second")).alias("k")).select("lang", "k.first", "k.second")
    count = keys.count()
    if count > MOST_KEYS:
        keys = keys.filter(F.rand(1) < MOST_KEYS / count)
    every = max(1, round(RANGE_ENTRIES / STEP * min(1, MOST_KEYS / max(count, 1))))
    found: dict[str, list[tuple[bytes, bytes]]] = {}
    for lang, a, b in keys.toLocalIterator():
        found.setdefault(lang, []).append((bytes(a), bytes(b)))
    out: Borders = {}
    for lang, own in found.items():
        own.sort()
        cuts, salts = [], [1]
        for key in own[every::every]:
            if cuts and cuts[-1] == key:
                salts[-1] += 1
            else:
                cuts.append(key)
                salts.append(1)
        if cuts:
            out[lang] = (cuts, salts)
    return out


def _cut(g: Grams, cuts: list[tuple[bytes, bytes]]) -> list[int]:
    """First n-gram of each range after the first one."""
    names = g.words.to_pylist()
    out = []
    for a, b in cuts:
        k = bisect_left(names, a)
        low = int(np.searchsorted(g.a, k + 1))
        if k < len(names) and names[k] == a and b:
            high = int(np.searchsorted(g.a, k + 1, side="right"))
            low += int(np.searchsorted(g.b[low:high], bisect_left(names, b) + 1))
        out.append(low)
    return out


FRAGMENT = "lang string, part long, salt long, salts long, automaton binary"


def _fragments(limits: Borders):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("automaton").to_pylist(), strict=True):
                cuts, salts = limits.get(lang, ([], [1]))
                g = CountAutomaton.from_bytes(data).grams()
                at = [0, *_cut(g, cuts), len(g)] if cuts else [0, len(g)]
                number = zlib.crc32(data)  # the same when a task runs again
                for part, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if high > low:
                        own = g.rows(slice(low, high)).narrow()
                        yield pa.RecordBatch.from_pydict({"lang": [lang], "part": [part], "salt": [number % salts[part]], "salts": [salts[part]], "automaton": pa.array([CountAutomaton.of(own).to_bytes()], pa.binary())})

    return run


def _united(least: int):
    """Rows come in order of language, part and salt. The fragments of one of them become one automaton; where it
    has all of its range, counts below ``least`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, fresh = None, [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            if key:
                g = unite(held)
                if key[3] == 1:
                    g = g.rows(g.n >= least).narrow()
                if len(g):
                    yield pa.RecordBatch.from_pydict({"lang": [key[0]], "part": [key[1]], "salt": [key[2]], "salts": [key[3]], "automaton": pa.array([CountAutomaton.of(g).to_bytes()], pa.binary())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "part", "salt", "salts")]
            for k, row in enumerate(zip(*columns, strict=True)):
                if row != key:
                    yield from closed()
                    key, held, fresh = row, [], 0
                g = CountAutomaton.from_bytes(batch.column("automaton")[k].as_py()).grams()
                held.append(g.rows(g.n > 0))
                fresh += len(g)
                if fresh > max(RANGE_ENTRIES // 2, len(held[0]) // 2):
                    held, fresh = [unite(held)], 0
        yield from closed()

    return run


def count_automata(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, Borders]:
    """docs: lang, text. Returns the automata of the prefix ranges (lang, part, automaton) with all n-grams of up to
    three words that occur ``least`` times, the number of words of each language (lang, n) and the ranges' borders."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shards = stored(docs.mapInArrow(_shards, SHARD), "colloc-shards")
    limits = borders(shards.select("lang", "first", "second"))
    words = stored(shards.groupBy("lang").agg(F.sum("words").alias("n")), "colloc-words")
    key = ["lang", "part", "salt"]
    union = lambda df: df.repartition(*key).sortWithinPartitions(*key, "salts").mapInArrow(_united(least), FRAGMENT)
    once = stored(union(shards.select("lang", "automaton").mapInArrow(_fragments(limits), FRAGMENT)), "colloc-ranges")
    discard(shards)
    done = once.filter("salts = 1")
    if any(s > 1 for _, salts in limits.values() for s in salts):
        rest = once.filter("salts > 1").withColumns({"salt": F.lit(0).cast("long"), "salts": F.lit(1).cast("long")})
        done = stored(done.unionByName(union(rest)), "colloc-ranges")
        discard(once)
    return done.select("lang", "part", "automaton"), words, limits


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("automaton").to_pylist(), strict=True):
            g = CountAutomaton.from_bytes(data).grams()
            names = pa.concat_arrays([pa.array([b""], pa.large_binary()), g.words]).cast(pa.binary()).cast(pa.string())
            for low in range(0, len(g), 100_000):
                own = g.rows(slice(low, low + 100_000))
                own = own.rows((own.b > 0) & (own.n > 0))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(own), pa.string()), **{f"w{k}": names.take(pa.array(x)) for k, x in ((1, own.a), (2, own.b), (3, own.c))}, "a": pa.array(own.n)})


def _routed(limits: Borders):
    """Phrases with the range that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = []
            for lang, a, b in zip(*(batch.column(c).to_pylist() for c in ("lang", "p1", "p2")), strict=True):
                cuts = limits.get(lang, ([],))[0]
                key = (a.encode(), b.encode())
                at = bisect_left(cuts, key)
                part.append(at + (at < len(cuts) and cuts[at] == key))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], [*batch.schema.names, "part"])

    return run


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of language and part; a range's automaton comes before the phrases."""
    key, automaton = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, part = batch.column("lang"), batch.column("part").to_numpy()
        code = lang.dictionary_encode().indices.to_numpy()
        fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])])
        first = np.flatnonzero(fresh)
        for low, high in zip(first, [*first[1:], batch.num_rows], strict=True):
            own = (lang[int(low)].as_py(), part[low])
            if batch.column("automaton")[int(low)].is_valid:
                key, automaton, low = own, CountAutomaton.from_bytes(batch.column("automaton")[int(low)].as_py()), low + 1
            if high > low and key == own:
                asked = batch.slice(low, high - low)
                n = automaton.compose(asked.column("p1").cast(pa.binary()), asked.column("p2").cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([asked.column("lang"), asked.column("p1"), asked.column("p2"), pa.array(n)], ["lang", "p1", "p2", "f"])


def part_counts(automata: DataFrame, parts: DataFrame, limits: Borders) -> DataFrame:
    """Counts f of distinct phrases (lang, p1, p2; p2 is empty for one word) in the automata of their ranges."""
    asked = parts.mapInArrow(_routed(limits), "lang string, p1 string, p2 string, part long").withColumn("automaton", F.lit(None).cast("binary"))
    none = F.lit("")
    both = asked.unionByName(automata.withColumns({"p1": none, "p2": none}))
    rows = both.repartition("lang", "part").sortWithinPartitions("lang", "part", F.col("automaton").isNull())
    return rows.select("lang", "part", "p1", "p2", "automaton").mapInArrow(_composed, "lang string, p1 string, p2 string, f long")


def _exact(*factors: Column) -> Column:
    out = factors[0].cast("decimal(38,0)")
    for x in factors[1:]:
        out = (out * x.cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """docs: lang, text. Returns lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two or
    three words that occur at least ``least`` times."""
    automata, words, limits = count_automata(docs, least)
    found = stored(automata.mapInArrow(_candidates, "lang string, w1 string, w2 string, w3 string, a long"), "colloc-candidates")
    none = F.lit("")
    cut = lambda k, p1, p2, q1, q2: F.struct(F.lit(k).alias("k"), p1.alias("p1"), p2.alias("p2"), q1.alias("q1"), q2.alias("q2"))
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    cuts = F.when(w3 == "", F.array(cut(1, w1, none, w2, none))).otherwise(F.array(cut(1, w1, none, w2, w3), cut(2, w1, w2, w3, none)))
    each = found.select("lang", "w1", "w2", "w3", "a", F.explode(cuts).alias("cut")).select("lang", "w1", "w2", "w3", "a", "cut.*")
    sides = F.explode(F.array(F.struct(F.col("p1"), F.col("p2")), F.struct(F.col("q1").alias("p1"), F.col("q2").alias("p2"))))
    parts = each.select("lang", sides.alias("s")).select("lang", "s.p1", "s.p2").distinct()
    counts = stored(part_counts(automata, parts, limits), "colloc-parts")
    known = F.broadcast(counts) if counts.count() <= BROADCAST_PARTS else counts
    left = known.withColumnRenamed("f", "l")
    right = known.select("lang", F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("f").alias("r"))
    scored = each.join(left, ["lang", "p1", "p2"]).join(right, ["lang", "q1", "q2"])
    scored = scored.withColumns({"_up": _exact(F.lit(1_000_000), F.col("a"), F.col("a")), "_down": _exact(F.col("l"), F.col("r"))}).withColumn("score", F.expr("_up div _down"))
    best = scored.groupBy("lang", "w1", "w2", "w3").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    longer = found.filter(w3 != "").select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(w2.alias("w1"), w3.alias("w2")))).alias("p"))
    longer = longer.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("within")).withColumn("w3", none)
    kept = best.join(longer, ["lang", "w1", "w2", "w3"], "left").filter(F.coalesce(100 * F.col("within") < share * F.col("b.a"), F.lit(True)))
    kept = kept.select("lang", F.concat_ws(" ", "w1", "w2", F.nullif("w3", none)).alias("phrase"), "b.a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
w AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM split),
t AS (SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, w1, '' AS w2, '' AS w3, count(*) AS a FROM t GROUP BY lang, w1
  UNION ALL SELECT lang, w1, w2, '', count(*) FROM t WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, w1, w2, w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE w2 = '' GROUP BY lang),
c AS (SELECT * FROM f WHERE w2 <> '' AND a >= 10),
cuts AS (
  SELECT *, 1 AS cut, w1 AS l1, '' AS l2, w2 AS r1, w3 AS r2 FROM c
  UNION ALL SELECT *, 2, w1, w2, w3, '' FROM c WHERE w3 <> ''),
s AS (
  SELECT c.lang, c.w1, c.w2, c.w3, c.a, c.cut, l.a AS l, r.a AS r,
    ((1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.w1 = c.l1 AND l.w2 = c.l2 AND l.w3 = ''
  JOIN f r ON r.lang = c.lang AND r.w1 = c.r1 AND r.w2 = c.r2 AND r.w3 = ''),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, cut) = 1),
m AS (
  SELECT lang, w1, w2, max(a) AS a FROM (
    SELECT lang, w1, w2, a FROM c WHERE w3 <> '' UNION ALL SELECT lang, w2, w3, a FROM c WHERE w3 <> '') GROUP BY lang, w1, w2),
named AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 || CASE WHEN b.w3 = '' THEN '' ELSE ' ' || b.w3 END AS phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN m ON m.lang = b.lang AND m.w1 = b.w1 AND m.w2 = b.w2 AND b.w3 = '' WHERE m.a IS NULL OR 100 * m.a < 50 * b.a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN n USING (lang) WHERE rank <= 2000
"""
