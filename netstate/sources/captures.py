"""Packet captures (classic pcap): one row per packet, and files from rows.

A capture has no marks to split at. Each file is cut into ranges of bytes all the same, and every range looks for a run of
plausible record headers to start at, while the one before it finds where its own last record ends. Where both agree, and that
they do is checked for all ranges, the records are those that a walk from the first byte would find; a range that was wrong is
walked again from the right place. So no task ever reads a file as a whole.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netstate.schema import PACKET_SCHEMA
from netstate.session import discard, materialize
from netstate.sources.files import list_files, open_file

# Magic numbers of the format -> (byte order, ticks of a second).
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 10 ** 6), b"\xa1\xb2\xc3\xd4": (">", 10 ** 6),
          b"\x4d\x3c\xb2\xa1": ("<", 10 ** 9), b"\xa1\xb2\x3c\x4d": (">", 10 ** 9)}
FILE_HEADER, RECORD_HEADER = 24, 16
#: No record is longer; a run of so many plausible headers, at most a day apart, is taken for a border.
LONGEST, RUN, APART = 1 << 18, 5, 86_400
HEADS = "path string, length long, magic binary, linktype int"
RANGES = f"{HEADS}, piece long, start long, stop long"
WALKED = f"{RANGES}, entry long, exit long, packets long"


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, length in zip(batch["path"], batch["length"]):
            with open_file(path) as f:
                head = f.read(FILE_HEADER)
            if len(head) < FILE_HEADER or head[:4] not in MAGICS:
                raise ValueError(f"{path} is not a classic pcap file")
            (linktype,) = struct.unpack(MAGICS[head[:4]][0] + "I", head[20:24])
            rows.append((path, length, head[:4], linktype))
        yield pd.DataFrame(rows, columns=["path", "length", "magic", "linktype"])


def _border(data: bytes, order: str, ticks: int, whole: bool) -> int:
    """Offset of the first record of ``data``, by a run of plausible headers; -1 if there is none.

    ``whole``: the data end with the file, where a shorter run may end too.
    """
    at = np.frombuffer(data, dtype=np.uint8)
    n = len(at) - RECORD_HEADER + 1
    if n <= 0:
        return -1
    shifts = (0, 8, 16, 24) if order == "<" else (24, 16, 8, 0)

    def field(k: int) -> np.ndarray:
        return sum(at[k + i:k + i + n].astype(np.uint32) << np.uint32(s) for i, s in enumerate(shifts))

    fraction, captured, sent = field(4), field(8), field(12)
    likely = np.flatnonzero((fraction < ticks) & (captured <= LONGEST) & (captured <= sent) & (sent <= LONGEST) & (sent > 0))
    plausible = set(likely.tolist())
    for first in likely.tolist():
        place, seen = first, 0
        began, = struct.unpack_from(order + "I", data, first)
        while place in plausible and seen < RUN:
            second, = struct.unpack_from(order + "I", data, place)
            if abs(second - began) > APART:
                break
            place, seen = place + RECORD_HEADER + int(captured[place]), seen + 1
        if seen == RUN or (whole and seen and place == len(data)):
            return first
    return -1


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where the first record of each range begins (``entry``, found if it isn't given), where the next range's does, and how
    many there are. -1: not found."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            order, ticks = MAGICS[bytes(r.magic)]
            with open_file(r.path) as f:
                f.seek(r.start)
                data = f.read(r.stop - r.start + 2 * RUN * (RECORD_HEADER + 65_536))
            entry = r.entry
            if pd.isna(entry):
                ends = r.start + len(data) == r.length
                found = _border(data[:1 << 20], order, ticks, ends and len(data) <= 1 << 20)
                if found < 0 and len(data) > 1 << 20:               # packets longer than that, or none at all
                    found = _border(data, order, ticks, ends)
                entry = r.start + found if found >= 0 else -1
            at, packets = int(entry), 0
            while 0 <= at < r.stop and at + RECORD_HEADER <= r.length:
                captured, = struct.unpack_from(order + "I", data, at - r.start + 8)
                at, packets = min(at + RECORD_HEADER + captured, r.length), packets + 1
            rows.append((*r[:7], int(entry), at, packets))
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in WALKED.split(", ")])


def _ranges(heads: DataFrame, range_bytes: int) -> DataFrame:
    """All ranges of all files with their true borders."""
    size = F.lit(range_bytes)
    count = F.ceil(F.greatest(F.col("length") - FILE_HEADER, F.lit(1)) / size)
    start = F.col("piece") * size + FILE_HEADER
    cut = heads.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select(
        "*", start.alias("start"), F.least(start + size, "length").alias("stop"))
    tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    guessed = cut.withColumn("entry", F.when(F.col("piece") == 0, FILE_HEADER).cast("long"))
    walked = materialize(guessed.repartition(tasks, "path", "piece").mapInPandas(_walk, WALKED), "capture-ranges")
    names = [f.split()[0] for f in WALKED.split(", ")]
    while True:
        # a range is one short row here
        before = F.lag("exit").over(Window.partitionBy("path").orderBy("piece"))
        linked = walked.withColumn("_true", F.coalesce(before, F.lit(FILE_HEADER)))
        wrong = linked.where("_true <> entry")
        if wrong.isEmpty():
            return walked
        again = wrong.select(*names[:7], F.col("_true").alias("entry")).repartition(tasks, "path", "piece").mapInPandas(_walk, WALKED)
        mended = materialize(linked.where("_true = entry").select(*names).union(again), "capture-ranges")
        discard(walked)
        walked = mended


def _packets_of(r) -> pd.DataFrame:
    order, ticks = MAGICS[bytes(r.magic)]
    with open_file(r.path) as f:
        f.seek(r.entry)
        data = f.read(r.exit - r.entry)
    out, at, name = [], 0, r.path.rsplit("/", 1)[-1]
    for i in range(r.packets):
        sec, fraction, captured, _ = struct.unpack_from(order + "IIII", data, at)
        at += RECORD_HEADER
        out.append((name, r.first_packet + i, sec + fraction / ticks, r.linktype, data[at:at + captured]))
        at += captured
    return pd.DataFrame(out, columns=PACKET_SCHEMA.names)


def read_captures(spark: SparkSession, path: str, pattern: str = "*.{[pP][cC][aA][pP],[cC][aA][pP]}",
                  range_bytes: int = 8 << 20) -> DataFrame:
    """Packets of all captures below ``path``: capture, packet_no, ts, linktype, frame.

    A last record that the file cuts off keeps the bytes that are there.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield _packets_of(r)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = list_files(spark, path, pattern).repartition(tasks, "path").mapInPandas(_heads, HEADS)
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ranges = _ranges(heads, range_bytes).withColumn("first_packet", F.coalesce(F.sum("packets").over(before), F.lit(0)))
    return ranges.where("packets > 0").repartition(tasks, "path", "start").mapInPandas(read, PACKET_SCHEMA)


def write_captures(packets: DataFrame, folder: str) -> DataFrame:
    """Write one file a capture (capture, packet_no, ts, linktype, frame) and return (capture, packets).

    A file is written from its first packet to its last by one task, which holds a batch of rows only.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        name, sink, count, done = None, None, 0, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.capture != name:
                    if sink is not None:
                        sink.close()
                        done.append((name, count))
                    name, count = r.capture, 0
                    target = f"{folder}/{name}"
                    system, place = fs.FileSystem.from_uri(target if "://" in target else "file://" + target.removeprefix("file:"))
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(place)
                    sink.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, r.linktype))
                second, frame = int(r.ts), bytes(r.frame)
                sink.write(struct.pack("<IIII", second, round((r.ts - second) * 1e6), len(frame), max(1, len(frame))) + frame)
                count += 1
        if sink is not None:
            sink.close()
            done.append((name, count))
        yield pd.DataFrame(done, columns=["capture", "packets"])

    files = packets.repartition("capture").sortWithinPartitions("capture", "packet_no")
    return files.select(*PACKET_SCHEMA.names).mapInPandas(write, "capture string, packets long")


def capture_info(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture").agg(F.count("*").alias("packets"), F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts"))
