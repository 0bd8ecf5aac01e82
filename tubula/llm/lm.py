"""Operator 1: language-model scores from a hidden Markov model trained with Baum-Welch.

The observations of the chain are word classes: each of the ``OWN`` most frequent training words (and
the end of a text) is a class of its own, all others fall into one of ``RARE`` classes by their last
two characters. A word's probability is the chain's probability of its class times the word's share of
the class, (c + 1) / (N_k + V_k + 1) with the class's token and word counts, so that an unseen word
has a probability too and all counts cover the whole training corpus.

Training: class-bigram counts of the whole corpus give a start (expectation-maximisation of the
two-step chain, on a matrix of fixed size), then every Baum-Welch pass reads all training texts, adds
up expected counts within each partition and sums them across partitions. Scoring: forward recursion
with scaling over the whole text, which is the exact likelihood.

Defined results: a null or empty text is one end token; an empty table gives no rows; without
training rows every count is 0 and the model is uniform; a null doc_id is a training row; equal texts
get equal scores, and rows that share a doc_id are scored each by its own text; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import fold, per_row, read, slices, split_words, stored, word_codes

#: The end of a text; no word holds white space.
END = "\n"
#: Words with a class of their own, and classes of the other words.
OWN, RARE = 383, 128
CLASSES = OWN + 1 + RARE
#: Words whose counts travel with each task; any other word has at most a 1/HOT share of all tokens.
HOT = 4096
STATES, START_ROUNDS = 8, 60
#: Baum-Welch passes go on until one finds that the pass before gained less than this per token (natural log).
GAIN = 0.005
#: Bytes of class sequences (two a token) that a task runs side by side.
STEP_BYTES = 4 << 20


def _rare_class(words: pa.Array) -> np.ndarray:
    """Class number of words without a class of their own."""
    code, tails = word_codes(pc.utf8_slice_codeunits(words, -2))
    return np.array([OWN + 1 + zlib.crc32(t.encode()) % RARE for t in tails.to_pylist()], np.int64)[code] if len(code) else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts; big sets are passed on in between."""
    parts, rows, texts = [], 0, 0

    def merged() -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for batch in slices(batches, "text"):
        words, _ = split_words(batch.column("text"))
        counts = pc.value_counts(words)
        parts.append(pa.table({"word": counts.field(0), "c": counts.field(1)}))
        rows, texts = rows + len(counts), texts + batch.num_rows
        if rows > 1_500_000:
            parts = [merged()]
            if (rows := parts[0].num_rows) > 800_000:
                yield from parts[0].to_batches()
                parts, rows = [], 0
    if texts:
        parts.append(pa.table({"word": [END], "c": pa.array([texts], pa.int64())}))
        yield from merged().to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all texts, with one END for each text. Columns: text."""
    return docs.select("text").mapInArrow(_count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Counts and the trained chain. Every part has a fixed size, whatever the corpus is."""

    tokens: int
    distinct: int
    own: dict[str, int]
    hot: dict[str, int]
    class_tokens: np.ndarray
    class_words: np.ndarray
    start: np.ndarray | None = None
    step: np.ndarray | None = None
    emit: np.ndarray | None = None
    #: What each pass found the log likelihood per token to have gained (the first has nothing to compare).
    gains: list[float] = field(default_factory=list)


def _tables(model: Model) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Hot words, their counts, and their own classes (-1: none)."""
    words = list(model.hot)
    return pa.array(words, pa.string()), np.array([model.hot[w] for w in words], np.int64), np.array([model.own.get(w, -1) for w in words], np.int64)


def _lookup(words: pa.Array, hot: pa.Array) -> np.ndarray:
    """Place of each word in hot, -1 if it isn't there."""
    return pc.fill_null(pc.index_in(words, value_set=hot), -1).to_numpy(zero_copy_only=False)


def _encode(model: Model):
    """Class sequences of texts, what hot words add to the sums of log counts, and the other words of each
    text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count, own = _tables(model)
        for batch in slices(batches, "text"):
            words, at = split_words(batch.column("text"))
            code, distinct = word_codes(words)
            place = _lookup(distinct, hot)
            cls = np.where(place >= 0, own[place] if len(own) else -1, -1)
            cls = np.where(cls >= 0, cls, _rare_class(distinct))
            c = np.where(place >= 0, count[place] if len(count) else 0, 0)
            log = np.log10(c + 1.0)
            end = model.hot.get(END, 0)
            rare = (place < 0)[code]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))[rare]
            pair, tf = np.unique(row * max(1, len(distinct)) + code[rare], return_counts=True)
            each = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(distinct)), minlength=batch.num_rows))])
            listed = lambda x, each=each: pa.ListArray.from_arrays(pa.array(each, pa.int32()), x)
            seq, own_log = cls[code], np.where(cls < OWN, log, 0)[code]
            body = seq.astype("<u2").tobytes()
            tail = np.array([OWN], "<u2").tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    "row": batch.column("row"),
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "n_tokens": pa.array(np.diff(at) + 1, pa.int64()),
                    "hot_log": per_row(log[code], at) + np.log10(end + 1.0),
                    "own_log": per_row(own_log, at) + np.log10(end + 1.0),
                    "hot_known": pa.array(per_row((c > 0)[code].astype(np.int64), at) + (end > 0), pa.int64()),
                    "seq": pa.array([body[2 * a : 2 * b] + tail for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    "rare": listed(distinct.take(pa.array(pair % max(1, len(distinct))))),
                    "tf": listed(pa.array(tf, pa.int32())),
                }
            )

    return run


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a batch's texts in a row, and where each text's start and end."""
    parts = [np.frombuffer(x, "<u2") for x in batch.column("seq").to_pylist()]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _by_step(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens step by step (first tokens of all texts, the longest text first, then second
    ones, and so on), and how many texts each step has."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    active = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
    step = np.repeat(np.arange(len(active)), active)
    rank = np.arange(len(step)) - np.repeat(np.cumsum(active) - active, active)
    return at[:-1][order][rank] + step, active


def _forward(classes: np.ndarray, active: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scales and, if asked for, scaled forward vectors of tokens in the order of _by_step."""
    by_class, kind = np.ascontiguousarray(emit.T), emit.dtype
    alpha_all, scale = np.empty((len(classes) if keep else 0, len(start)), kind), np.ones(len(classes), kind)
    alpha, low = None, 0
    for n in active.tolist():
        alpha = (np.broadcast_to(start, (n, len(start))) if alpha is None else alpha[:n] @ step) * by_class.take(classes[low : low + n], 0)
        scale[low : low + n] = s = alpha.sum(1)
        alpha /= s[:, None]
        if keep:
            alpha_all[low : low + n] = alpha
        low += n
    return scale, alpha_all


def forward(seq: np.ndarray, at: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion."""
    place, active = _by_step(at)
    logs = np.empty(len(seq))
    logs[place] = np.log(_forward(seq[place], active, start, step, emit, False)[0])
    return per_row(logs, at)


def expected_counts(seq: np.ndarray, at: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions in a row, summed over the sequences, and the log
    likelihood at the end. Vectors are kept in single precision; sums and likelihood aren't."""
    k = len(start)
    start, step, emit = (x.astype(np.float32) for x in (start, step, emit))
    place, active = _by_step(at)
    classes = seq[place]
    scale, alpha = _forward(classes, active, start, step, emit, True)
    by_class, xi = np.ascontiguousarray(emit.T), np.zeros((k, k))
    back = np.ascontiguousarray(step.T)
    beta_all = np.ones((len(classes), k), np.float32)
    ends = np.cumsum(active)
    beta = np.ones((0, k), np.float32)
    for t in range(len(active) - 2, -1, -1):
        low, high = ends[t], ends[t + 1]
        n = high - low
        beta = np.concatenate([beta, np.ones((n - len(beta), k), np.float32)]) if n > len(beta) else beta
        beta = beta * by_class.take(classes[low:high], 0)
        beta /= scale[low:high, None]
        before = low - active[t]
        xi += alpha[before : before + n].T @ beta
        beta = beta @ back
        beta_all[before : before + n] = beta
    alpha *= beta_all
    emitted = np.stack([np.bincount(classes, alpha[:, s], emit.shape[1]) for s in range(k)])
    first = alpha[: active[0]].sum(0, dtype=float) if len(active) else np.zeros(k)
    return np.concatenate([first, (xi * step).ravel(), emitted.ravel(), [np.log(scale.astype(float)).sum()]])


def _normal(x: np.ndarray, add: float) -> np.ndarray:
    return (x + add) / (x + add).sum(-1, keepdims=True)


def start_from_bigrams(pairs: np.ndarray, states: int = STATES, rounds: int = START_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chain fitted to class-bigram counts: each pair is a two-step sequence with its own start state."""
    rng = np.random.default_rng(1)
    emit = _normal(np.maximum(pairs.sum(0), pairs.sum(1))[None] * rng.uniform(0.5, 1.5, (states, len(pairs))), 1e-3)
    joint = _normal((rng.uniform(0.5, 1.5, (states, states)) + np.eye(states)).ravel(), 0).reshape(states, states)
    for _ in range(rounds):
        ratio = pairs / np.maximum(emit.T @ joint @ emit, 1e-300)
        left = ratio @ emit.T
        new_joint = joint * (emit @ left)
        emit = _normal(emit * (joint @ left.T + joint.T @ emit @ ratio), 1e-3)
        joint = _normal(new_joint.ravel(), 1e-6).reshape(states, states)
    return _normal(joint.sum(1), 1e-6), _normal(joint, 1e-6), emit


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in slices(batches, "seq", 4 << 20):
        seq, at = _sequences(batch)
        inner = np.ones(len(seq), bool)
        inner[at[1:] - 1] = False
        where = np.flatnonzero(inner)
        total += np.bincount(seq[where] * CLASSES + seq[where + 1], minlength=len(total))
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int32()), "n": pa.array(total[code], pa.int64())})


def _baum_welch(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STATES + STATES * STATES + STATES * CLASSES + 1)
        for batch in slices(batches, "seq", STEP_BYTES):
            total += expected_counts(*_sequences(batch), model.start, model.step, model.emit)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total)), pa.int32()), "x": total})

    return run


def train(docs: DataFrame, encoded_of, gain: float = GAIN) -> tuple[Model, DataFrame, DataFrame]:
    """Fit the model to docs (text). ``encoded_of(model)`` gives the stored class sequences (held_out,
    seq). Returns the model, those sequences and the stored word counts."""
    counts = stored(word_counts(docs), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    hot = {END: 0} | {r["word"]: r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(HOT).collect()}
    hot[END] = (counts.filter(F.col("word") == END).first() or {"c": 0})["c"]
    own = {w: k for k, w in enumerate([w for w in sorted(hot, key=lambda w: (-hot[w], w)) if w != END][:OWN])} | {END: OWN}
    model = Model(total["n"], total["v"], own, hot, np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        names = pa.array([w for w in own], pa.string())
        for batch in batches:
            cls, c = _rare_class(batch.column("word")), batch.column("c").to_numpy(zero_copy_only=False)
            rare = _lookup(batch.column("word"), names) < 0
            tokens += np.bincount(cls[rare], c[rare], CLASSES).astype(np.int64)
            words += np.bincount(cls[rare], minlength=CLASSES)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(CLASSES), pa.int32()), "n": tokens, "v": words})

    for r in counts.mapInArrow(classes, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        model.class_tokens[r["k"]], model.class_words[r["k"]] = r["n"], r["v"]
    encoded = encoded_of(model)
    training = encoded.filter(~F.col("held_out")).select("seq")
    pairs = np.zeros(CLASSES * CLASSES)
    for r in training.mapInArrow(_bigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        pairs[r["code"]] = r["n"]
    model.start, model.step, model.emit = start_from_bigrams(pairs.reshape(CLASSES, CLASSES))
    size, before = STATES + STATES * STATES + STATES * CLASSES, -np.inf
    while model.tokens:
        x = np.zeros(size + 1)
        for r in training.mapInArrow(_baum_welch(model), "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).collect():
            x[r["place"]] = r["x"]
        first, step, emit, (loglik,) = np.split(x, [STATES, STATES + STATES * STATES, size])
        model.start, model.step, model.emit = _normal(first, 0.01), _normal(step.reshape(STATES, STATES), 0.01), _normal(emit.reshape(STATES, CLASSES), 0.01)
        model.gains.append((loglik - before) / model.tokens)
        if model.gains[-1] < gain:
            break
        before = loglik
    return model, encoded, counts


def _likelihood(model: Model):
    """The chain's log10 probability, and what the words' shares of their classes divide by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.log10(model.class_tokens + model.class_words + 1.0)
        share[: OWN + 1] = 0
        for batch in slices(batches, "seq", STEP_BYTES):
            seq, at = _sequences(batch)
            loglik = forward(seq, at, model.start, model.step, model.emit)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "hot_log", "own_log", "hot_known")), pa.array(loglik / np.log(10)), pa.array(per_row(share[seq], at))],
                ["row", "doc_id", "held_out", "n_tokens", "hot_log", "own_log", "hot_known", "chain", "share"],
            )

    return run


def hmm_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Score all texts with a model of those whose crc32(doc_id) mod ``folds`` isn't ``held``.

    docs: doc_id, text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigram log10 probability), score (log10 probability of the text) and chain (the part that the
    hidden chain gives to the classes). Word counts reach the texts by a join on the word: hot words
    travel with the tasks, so no key of the join holds more than a 1/4096 share of the tokens.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"))
    sums = "row long, doc_id long, held_out boolean, n_tokens long, hot_log double, own_log double, hot_known long"

    def encoded_of(model: Model) -> DataFrame:
        numbered = docs.withColumn("row", F.monotonically_increasing_id())  # stored at once, so it stays
        return stored(numbered.mapInArrow(_encode(model), f"{sums}, seq binary, rare array<string>, tf array<int>"), "lm-classes")

    model, encoded, counts = train(docs.filter(~F.col("held_out")).select("text"), encoded_of)
    rare = (
        encoded.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.tf")
        .join(counts.hint("shuffle_hash"), "word")
        .groupBy("row")
        .agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum("tf").alias("rare_known"))
    )
    all_log = F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0))
    return (
        encoded.drop("rare", "tf").mapInArrow(_likelihood(model), f"{sums}, chain double, share double")
        .join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (all_log - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.distinct + 1.0)))).alias("base_score"),
            (F.col("chain") + all_log - F.col("own_log") - F.col("share")).alias("score"),
            "chain",
        )
    )


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored whole."""
    return hmm_scores(read(spark, sf_dir, "documents"))
