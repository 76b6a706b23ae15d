"""Token ids of documents in a binary format: frames of zstandard with a shared dictionary, and an offset index."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricegrid.llm.common import Kept, partitions, sent_by_value, stored

sent_by_value(__name__)

#: Documents that the dictionary is trained on, at most, and how long they may be, in bytes of text.
DICTIONARY_DOCUMENTS, DICTIONARY_TEXT_BYTES = 2000, 8192
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

#: Bytes of frames in a block, about: the unit that is written, read and searched.
BLOCK_BYTES = 4 << 20

#: Words and parts of words that a Python worker keeps the ids of.
KEPT_WORDS = 600_000

_MAGIC = b"TIDS0001"
_HEAD = "<8s32sIQ"  # then the index and the frames
_HEAD_BYTES = struct.calcsize(_HEAD)

_SPACE = re.compile(r"[ \t-\r]+")
_NOT_UNICODE_SPACE = re.compile("[\x1c-\x1f]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CACHE = Kept()

# Rules of a tokenizer under which a text's ids are those of its blank-separated words.
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _takes_words(rules: dict) -> bool:
    """Whether a tokenizer file has just the rules that ``_Words`` is written for."""
    normalizer, splitter = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps = splitter.get("pretokenizers") or []
    return (
        normalizer.get("normalizers") == _WORD_NORMALIZERS
        and [step.get("type") for step in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": _WORD_PATTERN}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and (steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == (False, False)
        and (rules["model"].get("type"), rules["model"].get("end_of_word_suffix"), rules["model"].get("dropout")) == ("BPE", "</w>", None)
        and rules.get("truncation") is None
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in rules.get("added_tokens") or [])
    )


class _Whole:
    """Ids of whole texts, by every rule of any tokenizer."""

    def __init__(self, tokenizer):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer = tokenizer

    def of(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes are their own letters, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(others)}


class _Words:
    """Ids of words by a tokenizer of words, each distinct one encoded once."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Letters below U+0130, with marks after them or not, go to the model of the tokenizer as they are after its
        normaliser and splitter: lower-cased, apart from the marks, in the byte-level alphabet. What may be more
        involved (digits, other scripts, special tokens) goes through all of it."""
        hard, words, parts = [], self.words, self.parts
        for word in new:
            stem = word.rstrip(_MARKS)
            if not stem.isalpha() or not stem.isascii() and max(stem) >= "\u0130":
                hard.append(word)
                continue
            low, tail = stem.lower(), word[len(stem) :]
            ids = parts.get(low)
            if ids is None:
                plain = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = parts[low] = array("I", [t.id for t in self.tokenizer.model.tokenize(plain)]).tobytes()
            if tail:
                marks = parts.get(tail)
                if marks is None:
                    marks = parts[tail] = array("I", self.tokenizer.encode(tail, add_special_tokens=False).ids).tobytes()
                ids += marks
            words[word] = ids
        for word, e in zip(hard, self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)):
            words[word] = array("I", e.ids).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        return self.joined([split(t) for t in texts])

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        words = self.words
        if len(self.parts) > KEPT_WORDS:
            self.parts.clear()
        if len(words) > KEPT_WORDS:
            words.clear()
        self.learn(list(set().union(*texts).difference(words)))
        return [b"".join(map(words.__getitem__, text)) for text in texts]


def split(text: str) -> list[str]:
    """Blank-separated words; Python's blanks are the tokenizer's but for four control characters."""
    return _SPACE.split(text) if _NOT_UNICODE_SPACE.search(text) else text.split()


def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        by_words = _takes_words(json.load(f))
    return (_Words if by_words else _Whole)(Tokenizer.from_file(path))


def encoded(texts: list[str], path: str, end_id: int) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit integers.

    Where neither the tokenizer's normaliser nor its splitter joins anything across white space, a text's ids are those
    of its blank-separated words, and each distinct word is encoded once. The file's rules tell; under any other
    rules texts are encoded whole.
    """
    if path not in _CACHE:
        _CACHE[path] = _encoder(path)
    end = struct.pack("<I", end_id)
    return [ids + end for ids in _CACHE[path].of(texts)]


def train_dictionary(documents: DataFrame, path: str, end_id: int, limit: int = DICTIONARY_DOCUMENTS) -> bytes:
    """A zstandard dictionary for the id arrays of short documents, from a bounded sample in the order of a hash."""
    short = documents.filter(F.octet_length("text").between(1, DICTIONARY_TEXT_BYTES)).select("text", F.xxhash64("doc_id", "text").alias("_h"))
    # About twice as many as needed are below this hash, so that few texts beside the sample leave their tasks.
    share = min(1.0, 2 * limit / max(1, short.count()))
    bound = min(int(share * 2.0**64) - (1 << 63), (1 << 63) - 1)
    sample = [r["text"] for r in short.filter(F.col("_h") <= bound).orderBy("_h", "text").limit(limit).collect()]
    arrays = encoded(sample, path, end_id)
    if sum(map(len, arrays)) < 64 * 1024:
        return b""  # too little to train on: frames stand alone
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:  # all the same
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def pack_block(frames: list[bytes], digest: bytes, first_token: int, lengths: list[int]) -> bytes:
    """magic, dictionary hash, documents, first token; then for each document its end offset and ids; then the frames."""
    ends = np.cumsum([len(f) for f in frames]).astype("<u8")
    head = struct.pack(_HEAD, _MAGIC, digest, len(frames), first_token)
    return head + ends.tobytes() + np.array(lengths, "<u8").tobytes() + b"".join(frames)


class Block:
    """Access to the documents of one block by their place, without reading the others."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, n, self.first_token = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.data, self.base = data, _HEAD_BYTES + 16 * n
        self.ends = np.frombuffer(data, "<u8", n, _HEAD_BYTES).astype(np.int64)
        self.lengths = np.frombuffer(data, "<u8", n, _HEAD_BYTES + 8 * n).astype(np.int64)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> bytes:
        start = self.base + (int(self.ends[k - 1]) if k else 0)
        raw = self.decompressor.decompress(self.data[start : self.base + int(self.ends[k])])
        if len(raw) != 4 * self.lengths[k]:
            raise ValueError("a frame has not the length that its index tells")
        return raw


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = 1, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, bytes]:
    """Writes the token blocks of ``documents`` and returns them, read back, with their dictionary.

    Needs doc_id and text. Every whole text is encoded (null: empty), ``end_id`` is appended, and documents follow each
    other in the order of doc_id, null first, then of a hash of the text. Blocks are rows of a table that Spark writes,
    so any store will do and a lost task leaves nothing behind: range (its place in the order of all blocks), number
    within it, doc_ids and the block itself, which holds its dictionary's hash, an index and one frame a document.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    shared = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    ranged = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        part, number, first, size = None, 0, 0, 0
        doc_ids: list = []
        frames: list[bytes] = []
        lengths: list[int] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([pack_block(frames, digest, first, lengths)], pa.binary()),
                ],
                ["range", "number", "n_tokens", "doc_ids", "block"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            for a in range(0, batch.num_rows, 500):
                piece = batch.slice(a, 500)
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoded(piece.column(1).to_pylist(), tokenizer_path, end_id)):
                    frame = compressor.compress(ids)
                    doc_ids.append(doc_id), frames.append(frame), lengths.append(len(ids) // 4)
                    size += len(frame)
                    if size >= block_bytes:
                        yield block()
                        number, first, size = number + 1, first + sum(lengths), 0
                        doc_ids, frames, lengths = [], [], []
        if frames:
            yield block()

    packed = ranged.select("doc_id", "text", F.spark_partition_id().alias("range")).mapInArrow(
        pack, "range int, number int, n_tokens bigint, doc_ids array<bigint>, block binary"
    )
    return stored(packed, "tokens"), dictionary


def read_tokens(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of every document, from its block alone.

    Blocks know their first id within their range; the ids of the ranges before it are summed from one row a range.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(dictionary)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, doc_ids, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                block = Block(raw, shared.value)
                starts = base + block.first_token + np.cumsum(block.lengths) - block.lengths
                for a in range(0, len(doc_ids), 256):
                    b = min(a + 256, len(doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[a:b], pa.int64()),
                            pa.array(starts[a:b], pa.int64()),
                            pa.array(block.lengths[a:b], pa.int64()),
                            pa.array([block.ids(k) for k in range(a, b)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    # One row a range: the number of partitions that wrote the blocks bounds what is broadcast.
    placed = blocks.join(F.broadcast(ranges), "range").select("base", "doc_ids", "block")
    return placed.mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_rows(documents: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``documents``, from the token blocks written and read back.

    A null or empty text has the end id only. Repeated rows are documents of their own. An empty table gives an empty
    result. Other columns are ignored.
    """
    ids = read_tokens(*write_tokens(documents, tokenizer_path, end_id))
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
