"""FASTQ as a Python data source: ``spark.read.format("fastq").load(folder or file)``.

Plain files, and gzip files made of blocks, are read in byte ranges of ``split_bytes``: a range finds its
first record by itself. Other gzip files are one partition each. ``n_reads`` stops each file early, which
is then one partition. ``read_no`` counts within a range; ``read_fastq`` numbers the reads of a lane.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "lane string, read_no long, header string, seq string, plus string, qual string, range_at long"
SPLIT_BYTES = 64 << 20
# How a gzip block with a size field begins, and that field's name.
BLOCK_HEAD, BLOCK_FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


@dataclass
class Range(InputPartition):
    """Records of a file whose header begins after ``start`` (from it on if that is 0) and not after ``end``."""

    path: str
    kind: str  # plain, blocks, gzip
    start: int
    end: int


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def plain_lines(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) from byte ``start`` on."""
    f.seek(start)
    for line in f:
        yield start, line
        start += len(line)


def block_size(head: bytes) -> int:
    """Bytes of the gzip block that ``head`` begins, 0 if it begins none."""
    return struct.unpack_from("<H", head, 16)[0] + 1 if head[:4] == BLOCK_HEAD and head[12:16] == BLOCK_FIELD else 0


def next_block(f, at: int) -> int | None:
    """Place of the first gzip block from ``at`` on; one that the next block or the end of the file confirms."""
    while True:
        f.seek(at)
        window = f.read(1 << 17)
        found = window.find(BLOCK_HEAD)
        while found >= 0:
            size = block_size(window[found : found + 18])
            if size:
                f.seek(at + found + size)
                after = f.read(18)
                if not after or block_size(after):
                    return at + found
            found = window.find(BLOCK_HEAD, found + 1)
        if len(window) < 1 << 17:
            return None
        at += len(window) - 18


def block_lines(f, start: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) from the first block at ``start`` or later; a position is a block's place times
    65,536 and the byte inside it."""
    at = next_block(f, start)
    rest, begun = b"", None
    while at is not None:
        f.seek(at)
        head = f.read(18)
        size = block_size(head)
        if not size:
            break
        data = zlib.decompress((head + f.read(size - 18))[18:-8], -15)
        begun = at << 16 if begun is None else begun
        done = 0
        while (end := data.find(b"\n", done)) >= 0:
            yield begun, rest + data[done : end + 1]
            rest, done = b"", end + 1
            begun = (at << 16) + done
        rest += data[done:]
        if not rest:
            begun = None
        at += size
    if rest:
        yield begun, rest


def records(lines: Iterator[tuple[int, bytes]], start: int, end: int) -> Iterator[list[str]]:
    """Records whose header begins in (start, end], from 0 on for the first range.

    The line that a range begins with may be the rest of one, and is its predecessor's. A header is a
    line with ``@`` whose next but one has ``+``: a quality line with ``@`` has a sequence there.
    """
    held: list[tuple[int, bytes]] = []

    def fill(n: int) -> bool:
        while len(held) < n:
            got = next(lines, None)
            if got is None:
                return False
            held.append(got)
        return True

    if start:
        if not fill(1):
            return
        held.pop(0)
        while True:
            if not fill(3):
                return
            if held[0][1][:1] == b"@" and held[2][1][:1] == b"+":
                break
            held.pop(0)
    while fill(1) and held[0][0] <= end:
        fill(4)
        yield [x.decode("utf-8").rstrip("\r\n") for _, x in held[:4]] + [""] * (4 - len(held))
        del held[:4]


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("n_reads", -1))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        files, root = self._files()
        info = files.get_file_info(root)
        found = [info] if info.is_file else [f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if not f.path.removesuffix(".gz").endswith((".fastq", ".fq")):
                continue
            kind = "plain"
            if f.path.endswith(".gz"):
                with files.open_input_file(f.path) as head:
                    kind = "blocks" if block_size(head.read(18).ljust(18, b"\0")) else "gzip"
            whole = kind == "gzip" or self.limit >= 0
            step = max(f.size, 1) if whole else self.split
            out += [Range(f.path, kind, at, f.size if whole else min(at + step, f.size)) for at in range(0, max(f.size, 1), step)]
        return out

    def read(self, partition):
        files, _ = self._files()
        p = partition
        lane = p.path.rsplit("/", 1)[-1].removesuffix(".gz").rsplit(".", 1)[0]
        if p.kind == "gzip":
            with io.BufferedReader(files.open_input_stream(p.path, compression="gzip")) as f:
                yield from self._rows(lane, p, records(((0, line) for line in f), 0, 0))
            return
        with io.BufferedReader(files.open_input_file(p.path), 1 << 20) as f:
            if p.kind == "plain":
                yield from self._rows(lane, p, records(plain_lines(f, p.start), p.start, p.end))
            else:  # a range ends where the next one's first block begins
                end = next_block(f, p.end)
                yield from self._rows(lane, p, records(block_lines(f, p.start), p.start, 1 << 62 if end is None else end << 16))

    def _rows(self, lane, p, got):
        for n, four in enumerate(got):
            if n == self.limit:
                return
            yield (lane, n, *four, p.start)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqDataSource)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads with ``read_no`` from 0 in each lane, however its file was split: ranges are counted, and what
    comes before a range is joined back."""
    register(spark)
    rows = spark.read.format("fastq").option("split_bytes", split_bytes).load(path)
    ends = rows.groupBy("lane", "range_at").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("lane").orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = ends.select("lane", "range_at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(ends, ["lane", "range_at"]).withColumn("read_no", F.col("read_no") + F.col("before")).select("lane", "read_no", "header", "seq", "plus", "qual")
