"""File listing and file heads."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 20
CAPTURE_SUFFIXES = (".pcap", ".cap")


def file_kind(path: Column) -> Column:
    """pcap, parquet or text, by the ending of the name in any case."""
    name = F.lower(path)
    capture = reduce(lambda a, b: a | b, [F.endswith(name, F.lit(x)) for x in CAPTURE_SUFFIXES])
    return F.when(capture, "pcap").when(F.endswith(name, F.lit(".parquet")), "parquet").otherwise("text")


def list_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length) of the files below a folder, recursively; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", pattern).load(path).select("path", "length")


def find_flow_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Text files below a folder; those with "states" in their name hold state tables and are left out."""
    files = list_files(spark, path, pattern)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.where(~name.contains("states") & (file_kind(name) == "text"))


def open_file(uri: str):
    """Open a file of any filesystem Arrow knows, for reading in a task."""
    from pyarrow import fs

    # Spark writes local paths as file:/..., Arrow wants file:///...
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    filesystem, path = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(path)


def file_heads(files: DataFrame, lines: int = 2000) -> DataFrame:
    """(path, header, sample): first line and the next ``lines`` lines within the first megabyte of each file."""
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                with open_file(path) as f:
                    text = f.read(HEAD_BYTES).decode("utf-8", "replace")
                whole = text.split("\n")
                if len(text.encode("utf-8", "replace")) >= HEAD_BYTES:
                    whole = whole[:-1]
                whole = [x.rstrip("\r") for x in whole if x.strip()]
                rows.append((path, whole[0].lstrip("﻿") if whole else "", whole[1:lines + 1]))
            yield pd.DataFrame(rows, columns=["path", "header", "sample"])

    return files.select("path").mapInPandas(heads, "path string, header string, sample array<string>")
