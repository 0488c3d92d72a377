"""Files as rows of bytes, and archives of newline-delimited records as rows of lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.sources.tables import ensure_checkpoints

#: The longest line that is read, in bytes.
LINE = 4 << 20
_BATCH = 5_000


def read_files(spark: SparkSession, folder: str, pattern: str | None = None, most: int = 16 << 20) -> DataFrame:
    """(path, bytes, data, failure) of the files of a folder and below it, at most ``most`` bytes of each.

    A longer file is a row with a failure and no data: a part of it would be taken for the whole.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)
    fits = F.col("length") <= most
    whole = found.filter(fits).select("path", F.col("length").alias("bytes"), F.col("content").alias("data"), F.lit(None).cast("string").alias("failure"))
    # the filter on length reaches the reader, so files that are too long aren't opened
    rest = found.filter(~fits).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("data"), F.lit("the file is too long").alias("failure"))
    return whole.unionByName(rest)


_LINES = "path string, member string, place bigint, line string, lines bigint, fault string"


def _lines_of(archive: zipfile.ZipFile, info: zipfile.ZipInfo, name: str, wanted: list[bytes]) -> Iterator[tuple]:
    """The rows of one member, read as a stream."""
    passed, place = 0, 0
    try:
        with archive.open(info) as member:
            while line := member.readline(LINE + 1):
                place += 1
                if len(line) > LINE:
                    while line and not line.endswith(b"\n"):
                        line = member.readline(LINE)
                    yield name, info.filename, place, None, 1, "the line is too long"
                    continue
                line = line.rstrip(b"\r\n")
                if wanted and not any(w in line for w in wanted):
                    passed += 1
                    continue
                yield name, info.filename, place, line.decode("utf-8", "replace"), 1, None
    except Exception as e:  # noqa: BLE001  a damaged member must not end the job
        yield name, info.filename, place, None, 0, f"the member cannot be read: {e}"[:200]
    if passed:
        yield name, info.filename, 0, None, passed, None


def _unreadable(name: str, e: Exception) -> tuple:
    return name, None, 0, None, 0, f"the archive cannot be opened: {e}"[:200]


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= _BATCH:
            yield pd.DataFrame(part, columns=names)
            part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def archive_lines(archives: DataFrame, needles: list[str] | None = None, path: str = "path", data: str = "content") -> DataFrame:
    """(path, member, place, line, lines, fault): the lines of all members of ZIP archives.

    A row is one line, or with ``needles`` stands for ``lines`` lines that hold none of them, which
    are counted but not carried. Lines of more than ``LINE`` bytes and members or archives that cannot
    be read have a fault in place of a line. Null data is an archive that cannot be read; folders in an
    archive are passed over. An archive is in one task; see :func:`folder_lines` for large ones.
    """
    wanted = [n.encode() for n in needles or []]
    names = [c.split()[0] for c in _LINES.split(", ")]

    def rows_of(name: str, body: bytes | None) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(bytes(body) if body is not None else b""))
        except (zipfile.BadZipFile, ValueError) as e:
            yield _unreadable(name, e)
            return
        for info in archive.infolist():
            if not info.is_dir():
                yield from _lines_of(archive, info, name, wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, body in zip(frame["path"], frame["data"], strict=True):
                yield from _frames(rows_of(name, body), names)

    return archives.select(F.col(path).alias("path"), F.col(data).alias("data")).mapInPandas(run, _LINES)


def folder_lines(spark: SparkSession, folder: str, pattern: str = "*.zip", needles: list[str] | None = None) -> DataFrame:
    """What :func:`archive_lines` gives for the archives of a folder that all executors have mounted.

    An archive can't be split, but its members can be read apart: only its directory is read first, and
    each member then is a stream of its own task, whatever its size. No archive is held in memory.
    """
    wanted = [n.encode() for n in needles or []]
    names = [c.split()[0] for c in _LINES.split(", ")]
    local = lambda path: unquote(urlsplit(path).path) if urlsplit(path).scheme in ("", "file") else path

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows: list[tuple] = []
            for path in frame["path"]:
                try:
                    with zipfile.ZipFile(local(path)) as archive:
                        rows += [(path, i) for i, info in enumerate(archive.infolist()) if not info.is_dir()]
                except (zipfile.BadZipFile, ValueError, OSError):
                    rows.append((path, -1))
            yield pd.DataFrame(rows, columns=["path", "number"])

    def rows_of(path: str, number: int) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(local(path)) as archive:
                yield from _lines_of(archive, archive.infolist()[number], path, wanted)
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            yield _unreadable(path, e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for path, number in zip(frame["path"], frame["number"], strict=True):
                yield from _frames(rows_of(path, number), names)

    ensure_checkpoints(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    listed = found.mapInPandas(members, "path string, number int").checkpoint()  # a row a member
    return listed.repartition(max(1, min(20_000, listed.count()))).mapInPandas(run, _LINES)
