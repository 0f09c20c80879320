"""Token-id output: concatenated id arrays with Elias-Fano coded document boundaries.

A file block holds the ids of consecutive documents as little-endian unsigned
32-bit integers and, for the end of each document, an Elias-Fano sequence: the
low bits of each boundary packed, the high bits in unary, and the place of every
``SAMPLE``-th one bit, so that ``select(i)`` answers without a table of 64-bit
offsets. Boundaries are relative to the block; a block's own start is one number.
The documents' ascending keys are coded in the same way, less the block's first.

Documents are range-partitioned by key, sorted, encoded and packed in the same
task. Block starts come from sums by partition and a running sum inside it, so
no task sees all blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, stage
from tidemark.llm.words import word_pipeline

MAGIC = b"EFI2"
#: Every so many boundaries the place of a one bit is kept.
SAMPLE = 64
#: Documents and ids at which a block is closed.
BLOCK_DOCS, BLOCK_IDS = 1024, 1 << 20
#: Entries in a task's table of encoded words.
CACHE = 700_000
#: New words that go to the library as one text.
TOGETHER = 400
_WORDS = re.compile(r"[^ \n\t\r]+").findall
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
_ODD = re.compile("[\x1c-\x1f]").search


def split_words(text: str) -> list[str]:
    """Words between blanks. Python counts four control characters as blanks that the library doesn't."""
    return _WORDS(text) if _ODD(text) else text.split()



class EliasFano:
    """A non-decreasing sequence of integers below 2**63 in about 2 + log2(u/n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def select_high(self, i: int) -> int:
        """Place of the i-th one bit: from the sample before it, byte by byte."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = self.high[byte] & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th value, in time that doesn't depend on n."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        first, value = i * self.low_bits, self.select_high(i) - i << self.low_bits
        span = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return value | span & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """All values, as one vector operation."""
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        value = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            value |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return value.astype(np.int64)

    def dump(self) -> bytes:
        return struct.pack("<IIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, bits, low, high, samples = struct.unpack_from("<IIIII", raw)
        at = 20
        return cls(n, bits, raw[at : at + low], raw[at + low : at + low + high], np.frombuffer(raw, "<u4", samples, at + low + high))


#: Behind MAGIC: documents, documents with a null key (they come first), the first other key, bytes of both sequences.
_HEAD = struct.Struct("<IIqII")


def pack_block(keys: list[int | None], ids: list[bytes]) -> bytes:
    """One block of the file format from each document's key, ascending with nulls first, and its ids in bytes."""
    own = [k for k in keys if k is not None]
    base = own[0] if own else 0
    coded = EliasFano.build(np.array([k - base for k in own], np.uint64)).dump()
    ends = EliasFano.build(np.cumsum([len(x) // 4 for x in ids])).dump()
    return MAGIC + _HEAD.pack(len(ids), len(ids) - len(own), base, len(coded), len(ends)) + coded + ends + b"".join(ids)


class Block:
    """A stored block: ``key`` and ``span`` select one document's key and place, ``ids`` its ids. Another header or length is refused."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token-id block")
        self.n, self.nulls, self.base, keys, ends = _HEAD.unpack_from(raw, 4)
        at = 4 + _HEAD.size
        self.keys, self.ends = EliasFano.load(raw[at : at + keys]), EliasFano.load(raw[at + keys : at + keys + ends])
        self.body = memoryview(raw)[at + keys + ends :]
        if self.ends.n != self.n or self.keys.n + self.nulls != self.n or (self.ends.select(self.n - 1) * 4 if self.n else 0) != len(self.body):
            raise ValueError("the block's keys and boundaries don't fit its ids")

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.keys.select(i - self.nulls)

    def span(self, i: int) -> tuple[int, int]:
        """First id of document i and the one behind its last, counted in the block."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, i: int) -> memoryview:
        begin, end = self.span(i)
        return self.body[4 * begin : 4 * end]


class WordEncoder:
    """Ids from the ``tokenizers`` library; words that come again are encoded once where the file allows it.

    A file of the kind that ``word_pipeline`` knows drops white space and letter case before it merges, so the ids
    of a text are those of its blank-separated words in order, and a full stop or
    comma after a Latin letter (but for the one that becomes letter and mark in
    lower case) begins a new pre-token. Words are kept in two
    generations of ``CACHE`` entries: when the younger is full the older goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # with other pipelines words aren't independent, and with other special strings or patterns not cut as here: whole texts then
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.by_word = word_pipeline(spec) == known and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        last = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(last)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Encode new words; Latin letters alone are one pre-token, so many such words go in one text and are cut at word ends."""
        plain, rest = [], []
        for w in words:
            (plain if _LETTERS(w) else rest).append(w)
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            got = self.tokenizer.encode_batch_fast([" ".join(part[i : i + TOGETHER]) for i in range(0, len(part), TOGETHER)], add_special_tokens=False)
            ids = np.array([i for e in got for i in e.ids], "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, begin = ids.tobytes(), 0
            for w, end in zip(part, cut, strict=True):
                self.known[w] = raw[begin:end]
                begin = end
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() + end for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        # A-Z alone, and not where a special string could come of it
        words = [split_words(t if "<|" in t else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) for t in (x or "" for x in texts)]
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        ends: dict[str, str] = {}
        new: set[str] = set()
        for w in set().union(*[set(ws).difference(known) for ws in words]):
            if (x := older.get(w)) is not None:
                known[w] = x
                continue
            if w[-1] in ".," and len(w) > 1 and w[-2].isalpha() and w[-2] < "\u0250" and w[-2] != "İ" and "<|" not in w:
                ends[w] = w[:-1]
                new.add(w[-1])
                w = w[:-1]
            new.add(w)
        for w in [w for w in new if w in older]:
            known[w] = older[w]
        self._learn([w for w in new if w not in known])
        for w, core in ends.items():
            known[w] = known[core] + known[w[-1]]
        return [b"".join(map(known.__getitem__, ws)) + end for ws in words]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder in a Python worker, whatever tasks it runs."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_token_blocks(docs: DataFrame, path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` and write them as blocks in ascending ``key`` order; returns the written table.

    Columns: seq (blocks of one task count up from 0), part_key (first
    key of the task), n_docs, n_ids, payload (see ``Block``). A null text counts as empty, so it has the end id
    alone. Null keys sort first. Rows with equal keys are all written, ordered by text.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.repartitionByRange(parts, "k").sortWithinPartitions("k", "t")
    arrow = pa.schema([("part_key", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(path), b"" if end_id is None else struct.pack("<I", end_id)
        keys, ids, held, first, seq = [], [], 0, None, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((first, seq, len(keys), held, pack_block(keys, ids)), arrow, strict=True)], schema=arrow)

        for b in batches:
            got = b.column(0).to_pylist()
            for at in range(0, len(got), 256):
                for k, x in zip(got[at : at + 256], words.encode(b.column(1)[at : at + 256].to_pylist(), end), strict=True):
                    if not keys and not seq:
                        first = k
                    keys.append(k)
                    ids.append(x)
                    held += len(x) // 4
                    if len(keys) >= BLOCK_DOCS or held >= BLOCK_IDS:
                        yield block()
                        keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield block()

    return stage(rows.mapInArrow(run, "part_key long, seq long, n_docs long, n_ids long, payload binary"), "token-blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """part_key, seq, block_start: the ids in all blocks before. One sum a task, then a running sum inside each task's blocks."""
    light = blocks.select("part_key", "seq", "n_ids")
    # one row for each task that wrote: bounded by the number of shuffle partitions, not by documents
    order = Window.orderBy(F.col("part_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("part_key").agg(F.sum("n_ids").alias("total")).select(F.col("part_key").alias("p"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_ids").over(inner), F.lit(0))
    return light.withColumn("inside", inside).join(sums, F.col("part_key").eqNullSafe(F.col("p"))).select("part_key", "seq", (F.col("base") + F.col("inside")).alias("block_start"))


def read_token_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read written blocks: key, start, n_tokens, ids_crc32 of each document, from the stored bytes.

    Payloads are read where they lie; only the figures of each document are joined to block starts.
    """
    names = ("part_key", "seq", key, "inside", "n_tokens", "ids_crc32")
    arrow = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(raw)
                docs = range(block.n)
                ends = [block.ends.select(i) for i in docs]
                begins = [0, *ends[:-1]]
                crc = [zlib.crc32(block.body[4 * i : 4 * j]) for i, j in zip(begins, ends, strict=True)]
                cols = ([part] * block.n, [seq] * block.n, [block.key(i) for i in docs], begins, [j - i for i, j in zip(begins, ends, strict=True)], crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=arrow)

    got = blocks.select("part_key", "seq", "payload").mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
    at = block_starts(blocks).select(F.col("part_key").alias("p"), F.col("seq").alias("s"), "block_start")
    got = got.join(at, F.col("part_key").eqNullSafe(F.col("p")) & (F.col("seq") == F.col("s")))
    return got.select(key, (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
