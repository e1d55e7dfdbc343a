"""What inspecting a file yields, and the wordings that reports share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FINDING = "struct<section:string,name:string,value:string,risky:boolean>"
REPORT = f"kind string, findings array<{FINDING}>, notes array<string>, orientation int, encrypted boolean, authors map<string,int>, removable long, unsupported boolean"
CLEANED = "bytes binary, changes array<string>, error string"


class FormatError(ValueError):
    """The bytes aren't what their first bytes promise."""


@dataclass
class Report:
    kind: str
    findings: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    orientation: int = 1
    encrypted: bool = False
    authors: dict[str, int] = field(default_factory=dict)
    removable: int = 0
    unsupported: bool = False

    def add(self, section: str, name: str, value, risky: bool = False) -> None:
        self.findings.append({"section": section, "name": name, "value": None if value is None else str(value), "risky": risky})

    def row(self) -> dict:
        return dict(vars(self))


@dataclass(frozen=True)
class Options:
    keep_icc: bool = True
    drop_trailer: bool = True
    anonymize_authors: bool = True
    clear_dates: bool = False


def size_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB"


#: XMP properties and what they are called in a report (fixed values).
XMP = {
    "xmp:CreatorTool": "Creator tool", "dc:creator": "Creator", "dc:rights": "Rights", "dc:description": "Description", "dc:title": "Title", "dc:subject": "Keywords", "photoshop:City": "City",
    "photoshop:Country": "Country", "photoshop:Credit": "Credit", "photoshop:AuthorsPosition": "Author position", "Iptc4xmpCore:Location": "Location", "xmp:CreateDate": "Create date",
    "xmp:ModifyDate": "Modify date", "xmp:MetadataDate": "Metadata date", "xmpMM:DocumentID": "Document ID", "xmpMM:InstanceID": "Instance ID", "xmpMM:OriginalDocumentID": "Original document ID",
    "exif:GPSLatitude": "GPS latitude", "exif:GPSLongitude": "GPS longitude", "pdf:Producer": "Producer", "pdf:Keywords": "Keywords", "tiff:Make": "Camera make", "tiff:Model": "Camera model",
    "aux:SerialNumber": "Camera serial number", "aux:LensSerialNumber": "Lens serial number", "Iptc4xmpExt:PersonInImage": "Person in image",
}


def plain(xml: str) -> str:
    return re.sub("<[^>]+>", "", xml)


def add_xmp(report: Report, xml: str) -> None:
    """Each property once: as an attribute, else as an element, whose list items are joined."""
    for name, label in XMP.items():
        if m := re.search(f'{name}="([^"]*)"', xml):
            value = m[1]
        elif m := re.search(f"(?s)<{name}[^>]*>(.*?)</{name}>", xml):
            items = re.findall("(?s)<rdf:li[^>]*>(.*?)</rdf:li>", m[1])
            value = ", ".join(map(plain, items)) if items else plain(m[1])
        else:
            continue
        if value := value.strip():
            report.add("XMP", label, value[:200], "GPS" in label or "Person" in label)
