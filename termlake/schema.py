"""Fixed schemas. Nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

# What a user of a collection sees of a document.
DOCUMENT = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("ext", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("modified", T.LongType(), False),  # epoch milliseconds
    T.StructField("size", T.LongType(), False),
])
DOCUMENT_COLS = DOCUMENT.fieldNames()

# A raw file, as the ``binaryFile`` source gives it.
RAW_FILE = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

HIT_COLS = ["path", "filename", "ext", "size", "modified", "score", "snippet"]

# A stored document row is identified by its path, by which of several listed
# copies of that path it is (overlapping source folders in a full build), and by
# the build that wrote it.
KEY = ["path", "copy", "gen"]

# The two tokenized fields a plain word looks at.
TEXT_FIELDS = ("content", "filename")
# Fields that are indexed as they stand.
VERBATIM_FIELDS = ("ext", "path")
