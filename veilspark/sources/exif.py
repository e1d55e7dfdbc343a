"""EXIF: the tag directories of a TIFF block."""

from __future__ import annotations

import struct

from .report import FormatError, Report, size_text

#: Tags that are reported, and the GPS tags that are read (fixed values of the EXIF standard).
TAGS = {
    0x010F: "Camera make", 0x0110: "Camera model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "Date and time", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "Date taken", 0x9004: "Date digitized",
    0x9010: "Time zone", 0x9286: "User comment", 0x927C: "Maker note", 0xA420: "Image unique ID", 0xA430: "Camera owner", 0xA431: "Body serial number", 0xA433: "Lens make", 0xA434: "Lens model",
    0xA435: "Lens serial number", 0x0201: "Embedded thumbnail",
}
LAT_REF, LAT, LON_REF, LON, ALT_REF, ALT, TIME, DIRECTION, DATE = 1, 2, 3, 4, 5, 6, 7, 16, 29
ORIENTATION, THUMBNAIL, EXIF, GPS, MAKER = 0x0112, 0x0201, 0x8769, 0x8825, 0x927C
BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SLONG, SRATIONAL = 1, 2, 3, 4, 5, 7, 9, 10
_WIDTH = {BYTE: 1, ASCII: 1, SHORT: 2, LONG: 4, RATIONAL: 8, UNDEFINED: 1, SLONG: 4, SRATIONAL: 8}
MOST_TAGS, MOST_DEPTH = 500, 3


def _ascii(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


class Tiff:
    """A TIFF block; offsets count from its start."""

    def __init__(self, block: bytes, report: Report):
        order = {b"II": "<", b"MM": ">"}.get(block[:2])
        if order is None or len(block) < 8:
            raise FormatError("not TIFF")
        self.block, self.order, self.report, self.seen = block, order, report, set()
        following = self.directory(self.number("L", 4), False, 0)
        if following > 8:
            self.directory(following, False, 1)

    def number(self, code: str, at: int) -> int:
        try:
            return struct.unpack_from(self.order + code, self.block, at)[0]
        except struct.error:
            return 0

    def value(self, kind: int, n: int, at: int):
        raw = self.block[at : at + _WIDTH.get(kind, 1) * n]
        if kind == ASCII:
            return _ascii(raw).strip()
        if kind in (BYTE, UNDEFINED):
            return _ascii(raw) if n <= 64 else f"({size_text(n)} of binary data)"
        if kind in (SHORT, LONG, SLONG):
            code = {SHORT: "H", LONG: "L", SLONG: "l"}[kind]
            many = list(struct.unpack(f"{self.order}{min(n, 16)}{code}", raw[: min(n, 16) * _WIDTH[kind]]))
            return many[0] if n == 1 else many
        if kind in (RATIONAL, SRATIONAL):
            code = "L" if kind == RATIONAL else "l"
            parts = struct.unpack(f"{self.order}{2 * min(n, 8)}{code}", raw[: 8 * min(n, 8)])
            return [a / b if b else 0 for a, b in zip(parts[::2], parts[1::2])]
        return None

    def directory(self, at: int, gps: bool, depth: int) -> int:
        """Reads a directory and those below it; returns the offset of the next one."""
        count = self.number("H", at)
        if depth > MOST_DEPTH or at < 8 or at + 2 > len(self.block) or at in self.seen or count > MOST_TAGS:
            return 0
        self.seen.add(at)
        found: dict[int, object] = {}
        raw_bytes: dict[int, bytes] = {}
        for entry in range(at + 2, at + 2 + 12 * count, 12):
            if entry + 12 > len(self.block):
                break
            tag, kind, n = self.number("H", entry), self.number("H", entry + 2), self.number("L", entry + 4)
            size = _WIDTH.get(kind, 1) * n
            place = entry + 8 if size <= 4 else self.number("L", entry + 8)
            if place + size > len(self.block):
                continue
            found[tag] = self.value(kind, n, place)
            raw_bytes[tag] = self.block[place : place + size]
            if not gps:
                self.report_tag(tag, n, place, found[tag], depth)
        if gps:
            self.report_place(found, raw_bytes)
        return self.number("L", at + 2 + 12 * count)

    def report_tag(self, tag: int, n: int, place: int, value, depth: int) -> None:
        if tag in (EXIF, GPS):
            self.directory(self.number("L", place), tag == GPS, depth + 1)
        elif tag == THUMBNAIL:
            self.report.add("EXIF", TAGS[tag], "present (can show the uncropped original)")
        elif tag == MAKER:
            self.report.add("EXIF", TAGS[tag], f"({size_text(n)} of camera-specific data, often including serial numbers)")
        elif tag in TAGS:
            if tag == ORIENTATION and isinstance(value, int):
                self.report.orientation = value
            self.report.add("EXIF", TAGS[tag], ", ".join(map(str, value)) if isinstance(value, list) else value)

    def report_place(self, found: dict, raw: dict[int, bytes]) -> None:
        def degrees(at: int, ref: int, negative: str) -> float | None:
            parts = found.get(at)
            if not isinstance(parts, list) or len(parts) < 3:
                return None
            return (parts[0] + parts[1] / 60 + parts[2] / 3600) * (-1 if found.get(ref) == negative else 1)

        lat, lon = degrees(LAT, LAT_REF, "S"), degrees(LON, LON_REF, "W")
        if lat is not None and lon is not None:
            self.report.add("GPS", "Location", f"{lat:.6f}, {lon:.6f} (latitude, longitude)", True)
        if isinstance(found.get(ALT), list):
            below = raw.get(ALT_REF, b"")[:1] == b"\1"  # a byte, 1 below sea level
            self.report.add("GPS", "Altitude", f"{found[ALT][0]:.1f} m" + " below sea level" * below)
        clock = found.get(TIME)
        if found.get(DATE) or isinstance(clock, list):
            hours = " " + ":".join(f"{int(x):02d}" for x in clock) if isinstance(clock, list) else ""
            self.report.add("GPS", "GPS date and time", f"{found.get(DATE) or ''}{hours}")
        if (way := found.get(DIRECTION)) is not None:
            way = way[0] if isinstance(way, list) else way
            self.report.add("GPS", "Direction", f"{int(way) if way == int(way) else way} degrees")


def inspect(block: bytes, report: Report) -> None:
    Tiff(block, report)


def minimal(orientation: int) -> bytes:
    """A JPEG segment of 36 bytes that says the orientation and nothing else."""
    body = b"Exif\0\0MM\0*" + struct.pack(">LHHHLHHL", 8, 1, ORIENTATION, SHORT, 1, orientation, 0, 0)
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
