"""Operator 8: SentencePiece encoding and decoding through the tokenizers library.

The model file's protobuf is read field by field; from it come the normaliser (precompiled map, white
space removal, dummy prefix, metaspace mark), the model (unigram scores, or merges ordered by score for
a byte-pair model, both with byte fallback) and the decoder. Batches are encoded by the library's own
threads. A text is first cut before each run of metaspace marks, which no piece crosses (tested on the
vocabulary; a model with such pieces is encoded uncut). So each word's ids don't depend on its
neighbours, and a slice hands the library each distinct word once; texts with runs of spaces, spaces at
the ends or literal marks, and all texts of a model with a character map, are handed over whole.

Parity with the sentencepiece library is verified for every text and all ids: each word new to the memory,
and each text that is handed over whole, is encoded by both libraries; a difference raises an error. Each
new word is decoded by the library, too. The round trip is tested on every text: the bytes that its ids
spell must be those of the normalised text (the text itself for a model that removes no white space).

Defined results: null and empty texts have no ids; strings like ``<s>`` in a text are ordinary text;
invalid surrogates can't occur in Spark strings; repeated rows give equal results; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import read, slices, word_codes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
#: Bytes of text that are encoded at once, and strings that the library gets at once.
STEP_BYTES, CHUNK = 4 << 20, 4096
#: Words whose ids a Python worker remembers across slices; a full memory starts anew.
REMEMBERED = 400_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            if at + size > end:
                raise ValueError("the model file is cut off")
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class PieceModel:
    """What the model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse_model(data: bytes) -> PieceModel:
    """Read the protobuf of a SentencePiece model."""
    model = PieceModel()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 24:
                    model.suffix = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    if not model.pieces:
        raise ValueError("the model has no pieces")
    if model.kind not in (UNIGRAM, BPE) or model.suffix or any(k == USER for _, _, k in model.pieces):
        raise ValueError("only unigram and byte-pair models without user-defined pieces or suffix marks are supported")
    return model


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Merges of a byte-pair model: every cut of a piece into two pieces, the best-scored piece first."""
    known = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, UNUSED)}
    out = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            out += [(-score, known[piece], known[piece[:i]], known[piece[i:]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
    return [(x[4], x[5]) for x in sorted(out)]


def build(model: PieceModel):
    """The same tokenizer for the tokenizers library."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    # pieces that a text can't spell keep their place under a name that texts don't hold
    names = [p if kind in (NORMAL, BYTE) else f"\x00{i}\x00" for i, (p, _, kind) in enumerate(model.pieces)]
    if model.kind == UNIGRAM:
        core = models.Unigram([(n, s) for n, (_, s, _) in zip(names, model.pieces, strict=True)], model.unknown, model.byte_fallback)
    else:
        core = models.BPE(vocab={n: i for i, n in enumerate(names)}, merges=_merges(model), unk_token=names[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        # only spaces go, and marks that the text itself ends with
        steps += [normalizers.Replace(Regex("^ +"), ""), normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex(f"[ {MARK}]+$" if model.escape else " +$"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind == NORMAL):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    after = [decoders.Replace(MARK, " ")] if model.escape else []
    tokenizer.decoder = decoders.Sequence([*after, decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return tokenizer


@dataclass
class Tools:
    """What a Python worker keeps of a model: the tokenizer, the sentencepiece processor that it is compared
    with, the bytes that each id spells, whether its piece starts a word, and the words met so far."""

    tokenizer: object
    reference: object
    spelled: pa.Array
    begins: np.ndarray
    by_words: bool
    model: PieceModel
    slots: dict[str, int] = field(default_factory=dict)
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))


_BUILT: dict[bytes, Tools] = {}


def _spelled(model: PieceModel) -> pa.Array:
    """The bytes that each id adds to a decoded text: marks are spaces, control pieces are nothing."""
    out = []
    for piece, _, kind in model.pieces:
        if kind == BYTE:
            out.append(bytes([int(piece[3:5], 16)]))
        elif kind == CONTROL:
            out.append(b"")
        else:
            out.append((piece.replace(MARK, " ") if model.escape else piece).encode())
    return pa.array(out, pa.binary())


def _tools(data: bytes) -> Tools:
    """Tools of a model, once for each Python worker."""
    key = hashlib.sha256(data).digest()
    if key not in _BUILT:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        reference = sentencepiece.SentencePieceProcessor()
        reference.LoadFromSerializedProto(data)
        model = parse_model(data)
        tokenizer = build(model)
        by_words = tokenizer.pre_tokenizer is not None and model.dummy_prefix and model.escape and not model.charsmap
        # unknown marks would join the unknown characters of neighbouring words
        by_words = by_words and (model.byte_fallback or any(p == MARK and kind == NORMAL for p, _, kind in model.pieces))
        begins = np.array([p.startswith(MARK) and kind == NORMAL for p, _, kind in model.pieces])
        _BUILT[key] = Tools(tokenizer, reference, _spelled(model), begins, by_words, model)
    return _BUILT[key]


def _compared(tools: Tools, texts: list[str]) -> list[np.ndarray]:
    """Ids of strings that are encoded as they are, by both libraries; a difference is an error."""
    own = [e.ids for e in tools.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    want = tools.reference.encode(texts)
    if own != want:
        wrong = next((x, a, b) for x, a, b in zip(texts, own, want, strict=True) if a != b)
        at = next((i for i, (a, b) in enumerate(zip(*wrong[1:], strict=False)) if a != b), min(map(len, wrong[1:])))
        near = pc.binary_join(pa.array([tools.spelled.take(pa.array(wrong[1][max(0, at - 5) : at + 5], pa.int32())).to_pylist()], pa.list_(pa.binary())), b"")[0].as_py()
        raise ValueError(f"ids differ from the sentencepiece library near {near!r} in {wrong[0][:200]!r}")
    return [np.array(x, np.int32) for x in own]


def _whole(tools: Tools, texts: list[str]) -> list[np.ndarray]:
    """Ids of texts that aren't cut, in chunks: the library's result objects are large."""
    return [x for i in range(0, len(texts), CHUNK) for x in _compared(tools, texts[i : i + CHUNK])]


def _learn(tools: Tools, words: list[str]) -> None:
    """Add new words to the memory. They are encoded side by side, parted by spaces, a chunk a string; a
    word's ids start at a piece that starts with a mark. What the library decodes from them is compared, too."""
    chunks = [" ".join(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
    for i in range(0, len(chunks), THREADS):
        part = chunks[i : i + THREADS]
        flat = _compared(tools, part)
        if tools.tokenizer.decode_batch([x.tolist() for x in flat], skip_special_tokens=False) != part:
            raise ValueError(f"words don't come back from their ids: {part[0][:200]!r}")
        new = words[i * CHUNK : (i + THREADS) * CHUNK]
        ids = np.concatenate(flat)
        at = np.flatnonzero(tools.begins[ids])
        if len(at) != len(new):  # marks that the vocabulary doesn't have: word by word
            each = _whole(tools, new)
            ids = np.concatenate(each)
            at = np.cumsum([0, *map(len, each)])[:-1]
        first, known = len(tools.ids), len(tools.slots)
        tools.ids = np.concatenate([tools.ids, ids])
        tools.ends = np.concatenate([tools.ends, first + np.append(at[1:], len(ids))])
        tools.slots.update(zip(new, range(known, known + len(new)), strict=True))


def encode_texts(tools: Tools, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's ids start and end (one more offset than texts)."""
    odd = pc.match_substring_regex(texts, f"^ |  | $|^$|{MARK}").to_numpy(zero_copy_only=False) if tools.by_words else np.ones(len(texts), bool)
    words = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    code, distinct = word_codes(words.flatten())
    if len(tools.slots) > REMEMBERED:
        tools.slots, tools.ids, tools.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
    names = distinct.to_numpy(zero_copy_only=False).tolist()
    place = np.fromiter(map(tools.slots.get, names, itertools.repeat(-1)), np.int64, len(names))
    if len(new := np.flatnonzero(place < 0)):
        place[new] = np.arange(len(tools.slots), len(tools.slots) + len(new))
        _learn(tools, [names[i] for i in new.tolist()])
    slot = place[code]
    n = tools.ends[slot + 1] - tools.ends[slot]
    end = np.concatenate([[0], np.cumsum(n)])
    plain = tools.ids[np.repeat(tools.ends[slot] - end[:-1], n) + np.arange(end[-1])]
    edge = end[words.offsets.to_numpy() - words.offsets[0].as_py()]
    if not odd.any():
        return plain, edge
    hard = _whole(tools, texts.filter(pa.array(odd)).to_pylist())
    size = np.zeros(len(texts), np.int64)
    size[~odd], size[odd] = np.diff(edge), [len(x) for x in hard]
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.int32)
    place = np.repeat(~odd, size)
    out[place], out[~place] = plain, np.concatenate([*hard, np.zeros(0, np.int32)])
    return out, at


def normalised(tools: Tools, texts: pa.Array) -> pa.Array:
    """What the model makes of the texts before it cuts them, marks as spaces and without the first one."""
    model = tools.model
    if model.charsmap:
        texts = pa.array([tools.reference.normalize(t) for t in texts.to_pylist()], pa.string())
        texts = pc.replace_substring(texts, MARK, " ") if model.escape else texts
        return pc.replace_substring_regex(texts, "^ ", "") if model.dummy_prefix else texts
    if model.remove_extra:
        texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, "^ +", ""), " {2,}", " ")
        texts = pc.replace_substring_regex(texts, f"[ {MARK}]+$" if model.escape else " +$", "")
    return pc.replace_substring(texts, MARK, " ") if model.escape else texts


def spell(tools: Tools, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Decoded texts (bytes) of ids in a row, by the bytes that each piece spells."""
    lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), tools.spelled.cast(pa.large_binary()).take(pa.array(ids)))
    text = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
    return pc.replace_substring_regex(text, r"\A ", "") if tools.model.dummy_prefix else text


def _steps(data: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Slices with their texts and ids, all compared with the sentencepiece library."""
    for batch in slices(batches, "text", STEP_BYTES):
        texts = pc.fill_null(batch.column("text"), "")
        yield batch, texts, *encode_texts(_tools(data), texts)


def _encode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, ids, at in _steps(data, batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))})

    return run


def _decode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tools(data).tokenizer
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = tokenizer.decode_batch([x or [] for x in part.column("ids").to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string())})

    return run


def _report(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(data)
        for batch, texts, ids, at in _steps(data, batches):
            back, raw = spell(tools, ids, at), memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(np.diff(at), pa.int64()),
                    "ids_sha256": [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                    "round_trip": pc.equal(back, normalised(tools, texts).cast(pa.large_binary())),
                    "n_chars": pc.utf8_length(back.cast(pa.large_string())).cast(pa.int64()),
                    "parity": pa.array([True] * len(texts)),  # a difference has raised an error
                }
            )

    return run


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file, read on the driver from a local path; tasks get its bytes (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def encode_pieces(docs: DataFrame, data: bytes) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, ids."""
    return _texts(docs).mapInArrow(_encode(data), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, data: bytes) -> DataFrame:
    """encoded: doc_id, ids. Returns doc_id, text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(data), "doc_id long, text string")


def piece_report(docs: DataFrame, data: bytes) -> DataFrame:
    """Encode and decode every text (doc_id, text) in one pass. Returns doc_id, n_tokens, ids_sha256 (of
    32-bit little-endian ids), round_trip, n_chars (decoded), parity (compared with the sentencepiece library)."""
    return _texts(docs).mapInArrow(_report(data), "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, n_chars long, parity boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    data = model_bytes(spark)
    return piece_report(read(spark, sf_dir, "documents"), data)
