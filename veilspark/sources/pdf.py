"""PDF: document information and XMP streams, and copies in which both are blanked in place, so that no offset moves."""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

from .report import FormatError, Report, add_xmp, size_text
from .zipfmt import blank_zlib

#: Keys of the information dictionary (fixed values).
KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
_STRING = {key: re.compile(rf"/{key}\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)".encode(), re.S) for key in KEYS}
_METADATA = re.compile(rb"/Type\s*/Metadata")
_LENGTH = re.compile(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R)")
_FILTER = re.compile(rb"/Filter\s*/(\w+)")
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_SIGNS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Text(NamedTuple):
    key: str
    start: int
    end: int
    value: str


class Stream(NamedTuple):
    start: int
    length: int
    filter: str | None
    parms: bool


def decode(token: bytes) -> str:
    """A literal or hexadecimal string; UTF-16 if it says so, else Latin-1."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][0] < 56 else _SIGNS.get(m[1], m[1]), token[1:-1])
    if raw.startswith(b"\xfe\xff"):
        return raw[2 : len(raw) // 2 * 2].decode("utf-16-be", "replace")
    return raw.decode("latin-1")


def date_text(value: str) -> str:
    m = re.match(r"D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?", value)
    if not m:
        return value
    day = "-".join(x for x in m.group(1, 2, 3) if x)
    return f"{day} {m[4]}:{m[5] or '00'}" if m[4] else day


def texts(b: bytes) -> list[Text]:
    return [Text(key, *m.span(1), decode(m[1])) for key in KEYS for m in _STRING[key].finditer(b)]


def streams(b: bytes) -> list[Stream]:
    """Metadata streams: by their stated length, or up to the end keyword where the length is elsewhere."""
    out = []
    for m in _METADATA.finditer(b):
        head, word = b.rfind(b"obj", 0, m.start() + 3), b.find(b"stream", m.start())
        if head < 0 or word < 0:
            continue
        about = b[head:word]
        start = word + 6
        start += b[start : start + 1] == b"\r"
        start += b[start : start + 1] == b"\n"
        if stated := _LENGTH.search(about):
            length = int(stated[1])
        else:
            end = b.find(b"endstream", start)
            length = len(b[start : max(start, end)].rstrip(b"\r\n"))
        if length > 0 and start + length <= len(b):
            packed = _FILTER.search(about)
            out.append(Stream(start, length, packed[1].decode() if packed else None, b"/DecodeParms" in about))
    return out


def inspect(b: bytes) -> Report:
    report = Report("pdf")
    for t in texts(b):
        report.removable += t.end - t.start
        if t.value.strip():
            name = re.sub("([a-z])([A-Z])", r"\1 \2", t.key)
            report.add("Document info", name, date_text(t.value) if t.key.endswith("Date") else t.value[:200])
    for s in streams(b):
        report.removable += s.length
        data = b[s.start : s.start + s.length]
        blank = s.filter is None and not data.strip()
        report.add("Kept" if blank else "XMP", "XMP metadata stream", size_text(s.length) + (f", {s.filter}" if s.filter else "") + ", already blank" * blank)
        if s.filter is None and not blank:
            add_xmp(report, data.decode("utf-8", "replace"))
        elif s.filter == "FlateDecode":
            try:
                add_xmp(report, zlib.decompress(data).decode("utf-8", "replace"))
            except zlib.error:
                report.notes.append("An XMP stream doesn't decompress, so what it holds isn't shown.")
    report.encrypted = bool(re.search(rb"/Encrypt\b", b))
    if report.encrypted:
        report.notes.append("The file is encrypted; its metadata stays as it is.")
    if re.search(rb"/ObjStm\b", b):
        report.notes.append("Some objects are in compressed object streams, which are not opened: a cleaned copy may still hold metadata in them.")
    return report


def clean(b: bytes, report: Report) -> tuple[bytes, list[str]]:
    if report.encrypted:
        raise FormatError("encrypted PDF")
    out, changes, found = bytearray(b), [], texts(b)
    for t in found:
        out[t.start + 1 : t.end - 1] = b" " * (t.end - t.start - 2)
    if found:
        changes.append(f"Overwrote {len(found)} string{'s' * (len(found) > 1)} of the document information with spaces")
    for s in streams(b):
        size = size_text(s.length)
        if s.filter is None:
            out[s.start : s.start + s.length] = b" " * s.length
            changes.append(f"Overwrote an XMP stream of {size} with spaces")
        elif s.filter != "FlateDecode" or s.parms:
            changes.append(f"Left an XMP stream as it is, for its filter ({s.filter})")
        elif (blank := blank_zlib(s.length)) is None:
            changes.append("Left an XMP stream as it is, for its size")
        else:
            out[s.start : s.start + s.length] = blank
            changes.append(f"Put a compressed stream of spaces in the place of an XMP stream of {size}")
    return bytes(out), changes
