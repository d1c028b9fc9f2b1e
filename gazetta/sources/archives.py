"""Archives read by ranges: the central directory tells where members are, and each member is a task's own read.

    found = directory(archives)                  # a row for each PDF, from the end of each file
    contents = member_contents(found)            # reads and unpacks the members' bytes only
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from gazetta.sources.assets import qualified
from gazetta.sources.sink import place

_FOUND = "archive string, path string, member string, position int, at long, packed long, size long, method int, flags int, crc long, error string"
#: Bytes of a member's own header before its name, and where it tells the lengths of the name and of what follows it.
HEADER, NAME, EXTRA = 30, 26, 28
#: Members that are handed on together, and bytes of theirs after which no more is added.
TOGETHER, BYTES = 1000, 8_000_000


def directory(archives: DataFrame) -> DataFrame:
    """A row for each PDF in archives (archive, path), in the archive's order from 1 on, with where it stands; one with an error for an archive that can't be read or has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _FOUND.split(", ")]
        for frame in frames:
            for archive, path in zip(frame["archive"], frame["path"], strict=True):
                rows, error = [], None
                try:
                    where, name = place(path)
                    with where.open_input_file(name) as file, zipfile.ZipFile(file) as z:  # reads the end of the file
                        own = [x for x in z.infolist() if not x.is_dir() and x.filename.lower().endswith(".pdf")]
                    rows = [(archive, path, x.filename, k, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.flag_bits, x.CRC, None) for k, x in enumerate(own, 1)]
                    error = None if rows else f"ZIP archive contains no PDFs: {archive}"
                except (zipfile.BadZipFile, RuntimeError, OSError, pa.ArrowInvalid) as e:
                    error = str(e)
                if error:
                    rows = [(archive, path, *[None] * (len(columns) - 3), error)]
                yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("position", "at", "packed", "size", "method", "flags", "crc")})

    spark = archives.sparkSession
    return archives.select("archive", qualified(spark, "path").alias("path")).mapInPandas(run, _FOUND)


def unpacked(raw: bytes, method: int, flags: int, crc: int) -> bytes:
    """A member's bytes; raises if they are encrypted, packed in an unknown way, or not what the directory says."""
    if flags & 1:
        raise RuntimeError("encrypted")
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise RuntimeError(f"compression method {method}")
    out = raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -zlib.MAX_WBITS)
    if zlib.crc32(out) != crc:
        raise RuntimeError("checksum differs")
    return out


def member_contents(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """archive, member, position, content and error of each row of directory. Members are dealt out one by one, so a large archive is many tasks' work; a file is read from a member's header to its end only."""

    def told(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["archive", "member", "position", "content", "error"]).astype({"position": "Int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for x in frame.itertuples(index=False):
                content, error = None, x.error
                if error is None:
                    try:
                        where, name = place(x.path)
                        with where.open_input_file(name) as file:
                            head = file.read_at(HEADER, int(x.at))
                            lengths = int.from_bytes(head[NAME : NAME + 2], "little") + int.from_bytes(head[EXTRA : EXTRA + 2], "little")
                            content = unpacked(file.read_at(int(x.packed), int(x.at) + HEADER + lengths), int(x.method), int(x.flags), int(x.crc))
                    except (RuntimeError, OSError, zlib.error, pa.ArrowInvalid) as e:
                        error = str(e)
                rows.append((x.archive, x.member, x.position, content, error))
                size += len(content or b"")
                if len(rows) == TOGETHER or size >= BYTES:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    dealt = found.repartition(tasks, "archive", "member") if tasks else found.repartition("archive", "member")
    return dealt.mapInPandas(run, "archive string, member string, position int, content binary, error string")
