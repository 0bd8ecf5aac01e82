"""Operator 6: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Instances are the words of a text (A-Z lower-cased, cut at ASCII white space, stripped of marks inside,
with runs of single letters joined, so that "i d i o t" and "i.d.i.o.t" are instances too). The kernel
of two instances counts their common subsequences of three characters, gaps allowed, each occurrence
weighted by DECAY to the power of its span, and is normalised; a word with characters put in still
shares most weighted subsequences with the plain word.

Training (multiple-instance): texts have labels, words don't. Equal texts with equal labels count once.
Document frequencies of words in the distinct toxic and clean training texts, counted over all of them, and
the number of different contexts (so that parts that texts share don't count twice) pick landmarks and the first witnesses; each round fits a linear SVM on Nystroem features of witnesses (also with characters put in) against words
of clean texts, and chooses the words of toxic texts that the model likes best as the next witnesses.
This SVM only screens: it says which words a text is judged by. The second SVM is trained on labelled texts.
The kernel of two texts is the sum of the kernels of their screened distinct words, so a text's Nystroem vector is
the sum of its words' vectors and landmarks stay as short as words. Beside it stand the best screened margin, the
sums of margins above three levels, and those sums against the number of words (one look-alike in a long clean text
is no insult, one in a short text may be). A logistic curve over the SVM's margin, fitted on margins
of texts that the SVM was not trained on (FOLDS parts by a hash of the text), gives the score.

Scoring a word needs no landmark loop: both SVMs are linear in the kernel's feature space, so the landmark
weights collapse into two tables of weights by subsequence code. All words of all texts are scored.

Defined results: null and empty texts have no words and get the floor's score (clean); without both
labels among training rows every score is 0; repeated rows get equal scores; inputs of a score are the
text alone; a null doc_id has no label; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import WS, fold, per_row, read, slices, split_words, stored, word_codes

#: Decay of the kernel, the widest span of a subsequence, and the longest run of characters in an instance.
DECAY, SPAN, LONGEST = 0.6, 5, 24
#: Landmarks, and at most so many words of either kind that the SVM is fitted on.
LANDMARKS, WITNESSES, CLEAN_WORDS, ROUNDS = 256, 600, 4000, 3
#: Different contexts that a witness has at least; a count, so the rule is alike at every size.
CONTEXTS = 2
#: Words above the odds limit that may be broadcast; with more, their contexts are joined by shuffle.
BROADCAST_WORDS = 200_000
#: Labels that may be broadcast (64 MB); with more, the labelled texts are joined by shuffle and stored.
BROADCAST_LABELS = 4_000_000
#: About so many clean texts, and half as many toxic ones, chosen by a hash of the text, are what the SVM on texts
#: and its curve are fitted on: a documented bound on labelled rows.
FIT_TEXTS = 6000
#: Parts of these texts; the curve sees each part by an SVM that was trained on the others.
FOLDS = 5
#: Words with at least this screening margin are a text's words in the SVM on texts.
SCREEN = -0.2
#: Margins below this count as this; no word of a clean text needs a finer value.
FLOOR = -1.0
#: Sums of margins above these levels describe a text.
LEVELS = (0.0, 0.5, 0.9)
LETTER_BITS = 6
SIZE = 1 << (3 * LETTER_BITS)
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a + 1)]


def _letter_codes() -> np.ndarray:
    """Code points of the basic plane to 6 bits: 1 and 2 are a word's ends, a-z have codes of their own,
    all other letters and digits share the rest by a hash; 0 is what isn't part of a word."""
    table = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = 3 + ord(ch) - ord("a")
        elif ch.isalnum():
            table[c] = 29 + zlib.crc32(ch.lower().encode("utf-8", "surrogatepass")) % 35
    return table


_TABLE: list[np.ndarray] = []


def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all words in a row, each between a start and an end code, and where they start.
    Words longer than LONGEST are cut into overlapping pieces by _pieces() before."""
    if not _TABLE:
        _TABLE.append(_letter_codes())
    points = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points > 0xFFFF, 63, _TABLE[0][np.minimum(points, 0xFFFF)])
    codes = np.where(points == 1, 1, np.where(points == 2, 2, codes))
    codes = codes[codes > 0]
    return codes.astype(np.int64), np.concatenate([np.flatnonzero(codes == 1), [len(codes)]])


def subsequences(codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: word numbers, subsequence codes and the weight of the span."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for a, b in GAPS:
        n = len(codes) - a - b
        if n > 0:
            same = word[:n] == word[a + b :]
            code = (codes[:n] << 2 * LETTER_BITS | codes[a : a + n] << LETTER_BITS | codes[a + b :])[same]
            yield word[:n][same], code, DECAY ** (a + b)


def features(words: list[str]) -> list[dict[int, float]]:
    """Normalised feature vector of each word, by subsequence code."""
    out: list[dict[int, float]] = [{} for _ in words]
    for word, code, weight in subsequences(*encode_words(words)):
        for w, c in zip(word.tolist(), code.tolist(), strict=True):
            out[w][c] = out[w].get(c, 0.0) + weight
    for x in out:
        norm = sum(v * v for v in x.values()) ** 0.5
        for c in x:
            x[c] /= norm
    return out


def kernel(a: list[dict[int, float]], b: list[dict[int, float]]) -> np.ndarray:
    """Normalised kernel between two lists of feature vectors."""
    columns: dict[int, list[tuple[int, float]]] = {}
    for j, y in enumerate(b):
        for c, v in y.items():
            columns.setdefault(c, []).append((j, v))
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(a):
        for c, v in x.items():
            for j, w in columns.get(c, ()):
                out[i, j] += v * w
    return out


@dataclass
class Model:
    """Weight of each subsequence code and offset of the screening SVM; the same table of the SVM on texts, its
    weights for the other features, and the curve's slope and offset."""

    weight: np.ndarray
    offset: float
    text_weight: np.ndarray | None = None
    rest: np.ndarray | None = None
    slope: np.ndarray | None = None


def word_margins(words: list[str], model: Model, floor: float = FLOOR) -> np.ndarray:
    """SVM margin of each word, at least ``floor``. A cheap bound rules most words out: the squares of
    single occurrences sum to no more than the squared norm."""
    codes, at = encode_words(words)
    dot, low = np.zeros(len(words)), np.zeros(len(words))
    for word, code, weight in subsequences(codes, at):
        dot += weight * np.bincount(word, model.weight[code], len(words))
        low += weight * weight * np.bincount(word, minlength=len(words))
    out = np.full(len(words), floor)
    bound = dot / np.sqrt(np.maximum(low, 1e-12)) + model.offset
    near = np.flatnonzero((bound > floor) & (dot > 0) | (model.offset > floor) & (low > 0))
    if len(near):
        codes, at = encode_words([words[i] for i in near])
        parts = [(w * SIZE + c, np.full(len(w), g)) for w, c, g in subsequences(codes, at)]
        if parts:
            key, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            key, back = np.unique(key, return_inverse=True)
            square = np.bincount(back, value) ** 2
            norm = np.sqrt(np.bincount(key // SIZE, square, len(near)))
            out[near] = np.maximum(floor, dot[near] / np.maximum(norm, 1e-12) + model.offset)
    return out


def instances(batch_texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of all texts as numbers, the offsets of each text's words, and the distinct words without
    marks. Runs of at least three single letters become one word in place of the run's last letter."""
    words, at = split_words(batch_texts)
    code, distinct = word_codes(words)
    bare, distinct = word_codes(pc.replace_substring_regex(distinct, pattern=r"[^\p{L}\p{N}]+", replacement=""))
    code, names = bare[code] if len(code) else code, distinct.to_pylist()
    if len(names):
        single = (pc.utf8_length(distinct).to_numpy(zero_copy_only=False) == 1)[code]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        edges = np.flatnonzero(np.concatenate([[True], (single[1:] != single[:-1]) | (row[1:] != row[:-1]), [True]]))
        known = {w: i for i, w in enumerate(names)}
        runs = np.flatnonzero((np.diff(edges) >= 3) & single[edges[:-1]])
        for a, b in zip(edges[runs].tolist(), edges[runs + 1].tolist(), strict=True):
            joined = "".join(names[c] for c in code[a:b].tolist())
            if (place := known.setdefault(joined, len(names))) == len(names):
                names.append(joined)
            code[b - 1] = place
    return code, at, names


def _pieces(word: str) -> list[str]:
    """A long word as overlapping pieces, so that one insult inside it isn't drowned."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _best(values: np.ndarray, at: np.ndarray, floor: float) -> np.ndarray:
    """Largest value of each row; rows without values get the floor."""
    out = np.full(len(at) - 1, floor)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.maximum.reduceat(values, at[:-1][full])
    return out


@dataclass
class Described:
    """Texts as the SVM on texts sees them: features of all words, and which screened words (numbers
    in ``names``) each text holds, as pairs."""

    x: np.ndarray
    row: np.ndarray
    word: np.ndarray
    names: list[str]


def described(texts: pa.Array, model: Model) -> Described:
    """Features of each text: best margin, for each level the log of the sum of margins above it and the same
    against the number of words, and 1; with its screened distinct words (pieces of long words count as words)."""
    code, at, names = instances(texts)
    rows = len(at) - 1
    parts = [_pieces(w) for w in names]
    flat = [p for own in parts for p in own]
    starts = np.concatenate([[0], np.cumsum([len(own) for own in parts], dtype=np.int64)])
    piece = word_margins(flat, model)
    own = _best(piece, starts, FLOOR)
    margin = own[code] if len(code) else np.zeros(0)
    totals = [per_row(np.maximum(margin - level, 0), at) for level in LEVELS]
    logs = [x for total in totals for x in (np.log(total + 0.1), np.log((total + 0.1) / (np.diff(at) + 10.0)))]
    x = np.stack([_best(margin, at, FLOOR), *logs, np.ones(rows)], 1)
    near = np.flatnonzero(margin >= SCREEN)
    pair = np.unique(np.repeat(np.arange(rows), np.diff(at))[near] * max(1, len(names)) + code[near])
    row, word = pair // max(1, len(names)), pair % max(1, len(names))
    best = np.full(len(names), -1)
    order = np.argsort(piece, kind="stable")
    best[np.repeat(np.arange(len(names)), np.diff(starts))[order]] = order
    kept, word = np.unique(best[word] if len(word) else word, return_inverse=True)
    return Described(x, row, word, [flat[i] for i in kept.tolist()])


def text_scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Score and best screening margin of each text."""
    d = described(texts, model)
    total = np.bincount(d.row, word_margins(d.names, Model(model.text_weight, 0.0), -np.inf)[d.word], len(d.x)) if len(d.row) else np.zeros(len(d.x))
    return _curve(total + d.x @ model.rest, model.slope), d.x[:, 0]


def _curve(margin: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope[0] * margin + slope[1], -30, 30)))


def _gapped(words: list[str]) -> list[str]:
    """Each word with one character put in at two places, chosen by a hash."""
    out = []
    for w in words:
        for k in (0, 1):
            h = zlib.crc32(f"{k}{w}".encode())
            i = 1 + h % max(1, len(w) - 1)
            out.append(w[:i] + "xqzk"[h >> 8 & 3] + w[i:])
    return out


def spread(vectors: list[dict[int, float]], n: int) -> list[dict[int, float]]:
    """At most n landmarks that between them explain the kernel best: pivoted incomplete Cholesky."""
    k = kernel(vectors, vectors)
    left, rows, picked = np.diag(k).copy(), np.zeros((0, len(k))), []
    while len(picked) < min(n, len(vectors)) and left.max() > 0.05:
        i = int(left.argmax())
        row = (k[i] - rows[:, i] @ rows) / np.sqrt(left[i])
        rows, left = np.concatenate([rows, row[None]]), np.maximum(left - row * row, 0)
        left[i] = 0
        picked.append(i)
    return [vectors[i] for i in picked]


def fit_svm(x: np.ndarray, y: np.ndarray, n: np.ndarray, c: float = 2000.0, rounds: int = 60) -> np.ndarray:
    """Linear SVM on words; the last weight is the offset. n: how many texts hold the word, whose root is its
    weight; both classes weigh the same."""
    each = np.sqrt(np.maximum(n, 1.0))
    each = each / np.where(y > 0, each[y > 0].sum(), each[y < 0].sum()) * c * 50
    return squared_hinge(np.concatenate([x, np.ones((len(x), 1))], 1), y, each, rounds)


def fit_margin(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Linear SVM on texts (the last feature is 1); all texts weigh the same."""
    return squared_hinge(x, y, np.full(len(y), c))


def squared_hinge(x: np.ndarray, y: np.ndarray, each: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss by Newton steps on the primal; the last one is the offset."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-4

    def loss(v: np.ndarray) -> float:
        return float((each * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + (ridge * v * v).sum())

    for _ in range(rounds):
        on = y * (x @ w) < 1
        h = (x[on] * each[on][:, None]).T @ x[on] + np.diag(ridge)
        step, size = np.linalg.solve(h, (x[on] * each[on][:, None]).T @ y[on]) - w, 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a partition that hold each word, by label."""
    for batch in slices(batches, "text"):
        code, at, names = instances(batch.column("text"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        pair = np.unique(row * max(1, len(names)) + code)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[pair // max(1, len(names))] > 0
        word = pair % max(1, len(names))
        bad, good = np.bincount(word[toxic], minlength=len(names)), np.bincount(word[~toxic], minlength=len(names))
        yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()), "bad": pa.array(bad, pa.int64()), "good": pa.array(good, pa.int64())})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words beside each occurrence of a word, as one hash, each pair once a slice. A word that all its
    texts have from one source has few contexts; an insult has many."""
    for batch in slices(batches, "text"):
        code, at, names = instances(batch.column("text"))
        if not names:
            continue
        beside = np.array([zlib.crc32(w.encode()) for w in names], np.int64)[code]
        before, after = np.concatenate([[0], beside[:-1]]), np.concatenate([beside[1:], [0]])
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        before[1:][row[1:] != row[:-1]], after[:-1][row[1:] != row[:-1]] = 0, 0
        context = before << 31 ^ after
        order = np.lexsort((context, code))
        code, context = code[order], context[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (context[1:] != context[:-1])])[: len(code)]
        yield pa.RecordBatch.from_pydict({"word": pa.array(names, pa.string()).take(pa.array(code[new])), "context": pa.array(context[new], pa.int64())})


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """Labelled texts (text, toxic) without copies: digest, toxic, text. Texts that differ in white space
    alone have equal words and are copies; a text with both labels stays once with each."""
    digest = F.sha2(F.regexp_replace("text", WS, " "), 256)
    return stored(labelled.select(digest.alias("digest"), "toxic", "text").dropDuplicates(["digest", "toxic"]), "toxic-texts")


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve on text features (the last one is 1), by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def train(labelled: DataFrame) -> Model | None:
    """labelled: text, toxic (0/1, all training rows). None if one label is missing."""
    labelled = distinct_texts(labelled.filter("toxic is not null"))
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad_texts, good_texts = n.get(1, 0), n.get(0, 0)
    if not bad_texts or not good_texts:
        return None
    words = labelled.select("text", "toxic").mapInArrow(_document_frequency, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter((F.length("word") >= 3) & (F.length("word") <= LONGEST))
    words = stored(words, "toxic-words")
    odds = F.log((F.col("bad") + 0.2) / (bad_texts + 1.0)) - F.log((F.col("good") + 0.2) / (good_texts + 1.0))
    weight = odds * F.sqrt(F.col("bad"))
    suspects = words.filter((F.col("bad") >= 2) & (odds > 1.5))
    if suspects.count() <= BROADCAST_WORDS:
        suspects = F.broadcast(suspects)
    contexts = labelled.filter("toxic = 1").select("text").mapInArrow(_contexts, "word string, context long")
    toxic = contexts.join(suspects, "word").groupBy("word", "bad", "good").agg(F.countDistinct("context").alias("contexts")).filter(F.col("contexts") >= CONTEXTS)
    toxic = toxic.withColumn("bad", F.least("bad", "contexts")).filter(odds > 1.5).orderBy(F.desc(weight), "word").limit(WITNESSES).select("word", "bad", "good").collect()
    clean = words.filter("good > 0").orderBy(F.desc("good"), F.xxhash64("word"), "word").limit(CLEAN_WORDS // 2).collect()
    clean += words.filter("good > 0").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS // 2).collect()
    witnesses = [r["word"] for r in toxic if r["good"] == 0 or r["bad"] * good_texts > 20 * r["good"] * bad_texts]
    harmless = list(dict.fromkeys(r["word"] for r in clean if r["word"] not in set(witnesses)))
    if not witnesses or not harmless:
        return None
    marks = spread(features(witnesses), LANDMARKS * 3 // 4) + spread(features(harmless[: 4 * LANDMARKS]), LANDMARKS // 4)
    value, vector = np.linalg.eigh(kernel(marks, marks))
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    often = {r["word"] for r in toxic if r["bad"] >= max(3, bad_texts // 200)}
    seen = {r["word"]: r["good"] for r in clean} | {r["word"]: r["bad"] for r in toxic}
    model, hard = None, harmless
    chosen = [w for w in witnesses if w in often] or witnesses[:24]
    for k in range(ROUNDS):
        bad_words = chosen + _gapped(chosen)
        x = kernel(features(bad_words + hard), marks) @ root
        n = [seen[w] for w in chosen] + [seen[w] * 0.5 for w in chosen for _ in (0, 1)] + [seen[w] for w in hard]
        w = fit_svm(x, np.array([1.0] * len(bad_words) + [-1.0] * len(hard)), np.array(n, float))
        model = Model(_table(marks, root @ w[:-1]), float(w[-1]))
        if k < ROUNDS - 1:
            close = _candidates(words, model)
            seen |= {r["word"]: r["good"] for r in close}
            hard = list(dict.fromkeys(harmless + [r["word"] for r in close if r["word"] not in often]))
            margin = word_margins(witnesses, model, -9.0)
            chosen = [w for w, m in zip(witnesses, margin, strict=True) if m > 0 or w in often] or chosen
    return _fit_texts(labelled, model, marks, root, bad_texts, good_texts)


def _table(marks: list[dict[int, float]], alpha: np.ndarray) -> np.ndarray:
    """Landmark weights as one weight for each subsequence code."""
    table = np.zeros(SIZE)
    for a, mark in zip(alpha, marks, strict=True):
        for c, v in mark.items():
            table[c] += a * v
    return table


def _fit_texts(labelled: DataFrame, model: Model, marks: list[dict[int, float]], root: np.ndarray, bad_texts: int, good_texts: int) -> Model:
    """Train the SVM on texts and the curve over its margins, on at most about FIT_TEXTS * 1.5 distinct texts."""
    part = F.when(F.col("toxic") == 1, FIT_TEXTS / 2 / bad_texts).otherwise(FIT_TEXTS / good_texts)
    sample = labelled.filter(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < part * 1_000_000)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            d = described(batch.column("text"), model)
            phi = kernel(features(d.names), marks) @ root
            total = np.zeros((len(d.x), root.shape[1]))
            np.add.at(total, d.row, phi[d.word])
            yield pa.RecordBatch.from_pydict({"x": pa.array(np.concatenate([total, d.x], 1).tolist()), "toxic": batch.column("toxic"), "part": batch.column("part")})

    rows = sample.select("text", "toxic", F.pmod(F.xxhash64(F.lit("part"), "digest"), F.lit(FOLDS)).cast("int").alias("part")).mapInArrow(vectors, "x array<double>, toxic int, part int").collect()
    x, y, fold_of = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows]) * 2.0 - 1, np.array([r["part"] for r in rows])
    unseen, ready = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        rest, own = fold_of != k, fold_of == k
        if own.any() and (y[rest] > 0).any() and (y[rest] < 0).any():
            unseen[own], ready[own] = x[own] @ fit_margin(x[rest], y[rest]), True
    weights = fit_margin(x, y)
    if not ((y[ready] > 0).any() and (y[ready] < 0).any()):
        unseen, ready = x @ weights, np.ones(len(y), bool)
    model.slope = _logistic(np.stack([unseen[ready], np.ones(int(ready.sum()))], 1), (y[ready] > 0) * 1.0)
    model.text_weight = _table(marks, root @ weights[: root.shape[1]])
    model.rest = weights[root.shape[1] :]
    return model


def _candidates(words: DataFrame, model: Model) -> list:
    """Words of clean texts that the model finds most toxic: hard negatives, a bounded number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = word_margins(batch.column("word").to_pylist(), model)
            keep = pa.array(m > -0.7)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("word", "bad", "good")), pa.array(m).filter(keep)], ["word", "bad", "good", "m"])

    return words.mapInArrow(run, "word string, bad long, good long, m double").filter("good > 0").orderBy(F.desc("m"), "word").limit(CLEAN_WORDS).collect()


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs: doc_id, held_out, text, and row_id if rows are told apart by it. Returns doc_id, held_out, score,
    predicted, margin (and row_id)."""
    own = [c for c in ("doc_id", "held_out", "row_id") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            score, best = np.zeros(batch.num_rows), np.full(batch.num_rows, FLOOR)
            if model:
                score, best = text_scores(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(best)], [*own, "score", "predicted", "margin"])

    rows = ", row_id long" if "row_id" in own else ""
    return docs.select(*own, "text").mapInArrow(run, f"doc_id long, held_out boolean{rows}, score double, predicted int, margin double")


def toxic_scores(docs: DataFrame, labels: DataFrame, rows: bool = False) -> DataFrame:
    """Train on labelled rows whose crc32(doc_id) mod 5 isn't 0 and score all docs (doc_id, text). rows: docs
    have a row_id (long), which comes back with the scores."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), *(["row_id"] if rows else []))
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "toxic-labels")
    training = docs.filter(~F.col("held_out"))
    if known.count() <= BROADCAST_LABELS:
        training = training.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    else:
        training = stored(training.join(known, "doc_id").select("doc_id", "text", "toxic"), "toxic-training")
    return score_toxicity(docs, train(training))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the labels of the training rows."""
    return toxic_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
