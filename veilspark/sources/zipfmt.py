"""ZIP containers: directory listing, entry data, writing, and zlib streams of spaces at an exact length."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_END, _DIRECTORY, _LOCAL = b"PK\5\6", struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
#: The end record is searched in the file's last bytes: its own 22 and the longest comment.
_TAIL = 22 + 65_535
ENTRY = "name string, method int, time int, date int, crc long, csize long, usize long, data_offset long, ext_attr long"


class ZipError(ValueError):
    pass


@dataclass
class Entry:
    name: str
    method: int
    time: int
    date: int
    crc: int
    csize: int
    usize: int
    data_offset: int
    ext_attr: int
    source: memoryview = field(repr=False, compare=False, default=memoryview(b""))

    @property
    def raw(self) -> memoryview:
        return self.source[self.data_offset : self.data_offset + self.csize]

    def data(self) -> bytes:
        if self.method == 0:
            return bytes(self.raw)
        if self.method == 8:
            return zlib.decompressobj(-15).decompress(self.raw)
        raise ZipError(f"unsupported compression method {self.method} for {self.name}")

    def row(self) -> tuple:
        return (self.name, self.method, self.time, self.date, self.crc, self.csize, self.usize, self.data_offset, self.ext_attr)


def entries(content: bytes) -> list[Entry]:
    """The entries by the central directory; no ZIP64, and check sums aren't compared."""
    view = memoryview(content)
    end = content.rfind(_END, max(0, len(content) - _TAIL))
    if end < 0 or end + 22 > len(content):
        raise ZipError("not a ZIP file")
    count, at = struct.unpack_from("<H", content, end + 10)[0], struct.unpack_from("<L", content, end + 16)[0]
    out = []
    for _ in range(count):
        if content[at : at + 4] != b"PK\1\2" or at + _DIRECTORY.size > len(content):
            raise ZipError("bad central directory")
        _, _, _, _, method, time, date, crc, csize, usize, n_name, n_extra, n_comment, _, _, attr, local = _DIRECTORY.unpack_from(content, at)
        name = content[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        if content[local : local + 4] != b"PK\3\4":
            raise ZipError(f"bad local header for {name}")
        skip = sum(struct.unpack_from("<2H", content, local + 26))
        out.append(Entry(name, method, time, date, crc, csize, usize, local + 30 + skip, attr, view))
        at += 46 + n_name + n_extra + n_comment
    return out


@dataclass
class Item:
    """What to write: data is stored; with method, crc and usize it is taken as compressed already."""

    name: str
    data: bytes
    time: int = 0
    date: int = 0
    ext_attr: int = 0
    method: int = 0
    crc: int | None = None
    usize: int | None = None


def write(items: Iterable[Item]) -> bytes:
    """An archive without extra fields or comments; names beyond ASCII set the UTF-8 flag."""
    body, directory, n = bytearray(), bytearray(), 0
    for it in items:
        name = it.name.encode()
        flag = 0 if name.isascii() else 0x800
        crc = zlib.crc32(it.data) if it.crc is None else it.crc
        usize = len(it.data) if it.usize is None else it.usize
        directory += _DIRECTORY.pack(b"PK\1\2", 20, 20, flag, it.method, it.time, it.date, crc, len(it.data), usize, len(name), 0, 0, 0, 0, it.ext_attr, len(body)) + name
        body += _LOCAL.pack(b"PK\3\4", 20, flag, it.method, it.time, it.date, crc, len(it.data), usize, len(name), 0) + name + it.data
        n += 1
    return bytes(body + directory + struct.pack("<4s4H2LH", _END, 0, 0, n, n, len(directory), len(body), 0))


def blank_zlib(length: int) -> bytes | None:
    """A valid zlib stream of exactly so many bytes whose content is spaces, or None below 11 bytes.

    Stored blocks of at most 65,535 bytes cost 5 bytes each, the header 2 and the check sum 4.
    """
    room = length - 6
    if room < 5:
        return None
    blocks = -(-room // 65_540)
    left = room - 5 * blocks
    out = bytearray(b"\x78\x01")
    content = b" " * left
    for i in range(blocks):
        size = min(65_535, left) if i < blocks - 1 else left
        out += struct.pack("<BHH", i == blocks - 1, size, size ^ 0xFFFF) + b" " * size
        left -= size
    return bytes(out + struct.pack(">L", zlib.adler32(content)))


def crc32_seeded(content: bytes, seed: int = 0) -> int:
    return zlib.crc32(content, seed)


def list_entries(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, entry_idx, the fields of ENTRY, error): a row an entry; a file that is no archive has one row with its error."""

    @pandas_udf(f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ENTRY.split(','))},error:string>>")
    def run(contents: pd.Series) -> pd.Series:
        def one(c):
            try:
                return [dict(zip([x.split()[0] for x in ENTRY.split(",")], e.row())) | {"error": None} for e in entries(bytes(c))]
            except (ZipError, struct.error) as e:
                return [{"error": str(e)}]

        return contents.map(one)

    each = files.select(path, F.posexplode(run(F.col(content))).alias("entry_idx", "e"))
    return each.select(path, "entry_idx", "e.*")


def bundle(files: DataFrame, name: str, content: str, by: str) -> DataFrame:
    """(by, content): the files of each group in one archive, in order of names. An archive is one value, so a group must fit a task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name)
        return pd.DataFrame({by: [key[0]], "content": [write(Item(n, bytes(c)) for n, c in zip(pdf[name], pdf[content]))]})

    kind = files.schema[by].dataType.simpleString()
    return files.select(by, name, content).groupBy(by).applyInPandas(run, f"{by} {kind}, content binary")
