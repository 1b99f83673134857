"""Binary files of Zstandard frames, written and read by Spark.

A row of the text writer is one frame, its line separator an empty skippable frame, so that a file is a plain
sequence of Zstandard frames: every decoder reads it, and Spark commits it on any file system it knows. The first
frame is skippable and holds the dictionary.
"""

from __future__ import annotations

import struct

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Fixed values of the Zstandard and WARC-Zstandard formats: skippable frames' magic numbers.
EMPTY, DICTIONARY, INDEX = 0x184D2A50, 0x184D2A5D, 0x184D2A5E
SEPARATOR = struct.pack("<II", EMPTY, 0)


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def write_frames(df: DataFrame, column: str = "frame") -> str:
    """Writes each partition's frames (binary) to one file, in order; returns the folder."""
    path = shared_dir(df.sparkSession)
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).text(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(content binary) of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def header(data: memoryview, at: int) -> tuple[int, int]:
    """Magic and content length of the skippable frame at this place; (0, 0) if there is another frame."""
    magic, size = struct.unpack_from("<II", data, at)
    return (magic, size) if magic & 0xFFFFFFF0 == EMPTY else (0, 0)


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of about size bytes; the samples themselves if they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]
