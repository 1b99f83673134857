"""Token ids in binary files: each document is a Zstandard frame of its own, compressed with one shared dictionary.

A file holds a range of doc_ids in ascending order: a skippable frame with the dictionary, a frame a document, and a
skippable frame with the offset index (dictionary hash; doc_id, offset, length, number of ids; its own place).
A reader of one document needs the index, the dictionary and the document's own bytes.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, written
from .frames import DICTIONARY, INDEX, SEPARATOR, skippable, trained, write_frames

#: Documents of one file, about; there are as many files as shuffle partitions at least.
FILE_DOCS = 20_000
#: Characters of one file, about, so that a file's content fits in a task.
FILE_CHARS = 100_000_000
#: Documents from which the dictionary is trained, of at most so many characters each, and its size in bytes.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4000, 65536
#: Pieces that an encoder keeps twice at most: those it met since it last dropped some, and those before. About 200 bytes each.
_CACHE_PIECES = 300_000
#: Pieces that are encoded in one call.
_CALL_PIECES = 1_000
#: Text that is cut into pieces at a time.
RUN_BYTES = 1_000_000
#: An entry of the index; known is 0 for a null doc_id.
_ENTRY = np.dtype([("doc_id", "<i8"), ("known", "<u4"), ("length", "<u4"), ("offset", "<u8"), ("n_tokens", "<u8")])

#: Letters in whose runs byte-level BPE never starts a new piece: Latin and Cyrillic ones. Fixed values of its splitting rule: a
#: run of letters, with one space before, is a piece; an apostrophe and the letters after it may be one too.
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯЀ-ҁҊ-ӿ"
_WORD = rf"(?: |(?<![^\x00-&(-@\[-`{{-\x7f])(?<!\s\s))[{_LETTER}]++(?=[\x00-@\[-`{{-\x7f]|\Z)"
#: Words, and what lies between them. A text's pieces can be encoded one by one: the rule cuts at both ends of a word.
_PIECE = re.compile(rf"{_WORD}|(?:(?!{_WORD})(?: ?[{_LETTER}]++| ?[^ {_LETTER}]++| ))+")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Texts to ids, little-endian unsigned 32-bit.

    With byte-level BPE a text is cut into pieces; a new piece is encoded once, many in one call, and kept, from file to
    file, too. Texts with a special token, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        bytewise = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
        self.cuts = bytewise and not self.tokenizer.normalizer and isinstance(model, models.BPE) and not model.dropout
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.spaced = np.array([bool(t) and t.startswith("Ġ") for t in tokens], bool)  # how byte-level BPE writes a space

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _run(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 500):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 500], add_special_tokens=False)]
        return out

    def _run_joined(self, pieces: list[str], between: str) -> list[bytes]:
        """Pieces joined to one text and encoded in one call: lines of it, or words that each begin with their own space."""
        out = []
        for i in range(0, len(pieces), _CALL_PIECES):
            some = pieces[i : i + _CALL_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            if between:
                ends = np.append(np.flatnonzero(ids == self.line_feed[0]), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            else:
                starts = np.flatnonzero(self.spaced[ids])
                ends = np.append(starts[1:], len(ids))
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't keep pieces apart")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts or len(self.line_feed) != 1:
            return self._run(texts)
        pieces = [[t] if any(x in t for x in self.special) else _PIECE.findall(t) for t in texts]
        if len(self.kept) > _CACHE_PIECES:  # what was not met since the last time goes
            self.before, self.kept = self.kept, {}
        known, before = self.kept, self.before
        words, lines, others = [], [], []
        for p in set(itertools.chain.from_iterable(pieces)).difference(known):
            if p in before:
                known[p] = before[p]
            elif p[0] == " " and p[1:].isalpha():
                words.append(p)
            elif "\n" in p or p[-1].isspace() or p[:2].isspace() or (p[0] != " " and p[0].isspace()) or any(x in p for x in self.special):
                others.append(p)
            else:
                lines.append(p)
        for some, ids in ((words, self._run_joined(words, "")), (lines, self._run_joined(lines, "\n")), (others, self._run(others))):
            known.update(zip(some, ids, strict=True))
        out = [b"".join(map(known.__getitem__, parts)) for parts in pieces]
        for p in others:
            if len(p) > 40:
                del known[p]
        return out


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (place, number) of at most about RUN_BYTES of text; a longer text is a run of its own."""
    at = held = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > at and held + size > RUN_BYTES:
            yield at, k - at
            at, held = k, 0
        held += size
    if len(texts) > at:
        yield at, len(texts) - at


def _filed(path: str, end_id: int, dictionary: bytes):
    """A partition's sorted rows (doc_id, text) to the frames of one file: dictionary, documents, index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder, end = Encoder.of(path), struct.pack("<I", end_id)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        head = skippable(DICTIONARY, dictionary)
        at, entries = len(head) + len(SEPARATOR), []
        for batch in batches:
            for k, n in _runs(batch.column(1)):
                ids, texts = batch.column(0).slice(k, n).to_pylist(), batch.column(1).slice(k, n).to_pylist()
                frames = [] if entries else [head]
                for i, raw in zip(ids, encoder.encode([t or "" for t in texts]), strict=True):
                    frame = packer.compress(raw + end)
                    entries.append((i or 0, i is not None, len(frame), at, len(raw) // 4 + 1))
                    at += len(frame) + len(SEPARATOR)
                    frames.append(frame)
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
        if entries:
            index = hashlib.sha256(dictionary).digest() + np.array(entries, _ENTRY).tobytes() + struct.pack("<Q", at)
            yield pa.RecordBatch.from_arrays([pa.array([skippable(INDEX, index)], pa.binary())], names=["frame"])
        give_back()

    return run


class TokenFile:
    """One file's content: documents by their place in the index."""

    def __init__(self, content: bytes) -> None:
        self.data = memoryview(content)
        _, size = struct.unpack_from("<II", self.data, 0)
        dictionary = bytes(self.data[8 : 8 + size])
        at = struct.unpack_from("<Q", self.data, len(self.data) - len(SEPARATOR) - 8)[0]
        _, size = struct.unpack_from("<II", self.data, at)
        index = bytes(self.data[at + 8 : at + size])
        if index[:32] != hashlib.sha256(dictionary).digest():
            raise ValueError("the index belongs to another dictionary")
        self.index = np.frombuffer(index[32:], _ENTRY)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> bytes:
        e = self.index[k]
        return self.unpacker.decompress(self.data[int(e["offset"]) : int(e["offset"]) + int(e["length"])])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            if not (content := content.as_py()):
                continue
            f, start = TokenFile(content), 0
            for at in range(0, len(f.index), 1024):
                ids, known = f.index["doc_id"][at : at + 1024], f.index["known"][at : at + 1024]
                raw = [f.ids(k) for k in range(at, at + len(ids))]
                sizes = np.array([len(x) // 4 for x in raw], np.int64)
                ends = start + np.cumsum(sizes)
                start = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(ids)), pa.array(ids, mask=known == 0), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                    names=["file", "doc_id", "before", "n_tokens", "ids_crc32"],
                )


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> str:
    """Encodes docs (doc_id, text), end_id after each, and writes the files; returns the folder.

    Null and empty texts are the end id alone; an empty table has no files. Rows that repeat a doc_id, or have none
    (they come first), are documents of their own. tokenizer is a file of the tokenizers library that each executor
    reads at this path.
    """
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    share = max(1, int(2_000_000 * SAMPLE / max(n, 1)))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).where(F.length("text").between(1, SAMPLE_CHARS))
    sample = [r.text for r in chosen.select("text").limit(SAMPLE).collect()]
    dictionary = trained(Encoder.of(tokenizer).encode(sample), DICTIONARY_BYTES) if sample else b""
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_DOCS), -(-chars // FILE_CHARS))
    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    return write_frames(dealt.mapInArrow(_filed(tokenizer, end_id, dictionary), "frame binary"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start: ids of all documents before it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = written(files.mapInArrow(_read, "file string, doc_id long, before long, n_tokens long, ids_crc32 long"))
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("_n"), F.min("doc_id").alias("_first"), F.count("doc_id").alias("_known"))
    # one row a file: ranges don't overlap, so files are in order by their first id
    # those with null ids only lead, and one that also has others begins with them
    earlier = Window.orderBy(F.col("_known") > 0, "_first", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return found.join(starts, "file").select("doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
