"""Content digests, checksums, verdicts and receipts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS = ("sha256", "sha1", "md5")
_MAKE = {"sha256": lambda c: F.sha2(c, 256), "sha1": F.sha1, "md5": F.md5}
#: Published vectors: algorithm, input, digest (fixed values).
VECTORS = (
    ("sha256", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    ("sha256", "abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
    ("sha1", "", "da39a3ee5e6b4b0d3255bfef95601890afd80709"),
    ("sha1", "abc", "a9993e364706816aba3e25717850c26c9cd0d89d"),
    ("md5", "", "d41d8cd98f00b204e9800998ecf8427e"),
    ("md5", "abc", "900150983cd24fb0d6963f7d28e17f72"),
)


def digest(content: Column, algorithm: str) -> Column:
    """Lower-case hex digest; an unknown algorithm raises when the plan is built."""
    if algorithm not in _MAKE:
        raise ValueError(f"unknown hash algorithm: {algorithm}")
    return _MAKE[algorithm](content.cast("binary"))


def digests(content: Column, algorithms=()) -> Column:
    """Map of algorithm to digest; none chosen means sha256. One scan feeds all."""
    return F.create_map(*[x for a in (algorithms or ("sha256",)) for x in (F.lit(a), digest(content, a))])


def normalize_hash(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9a-fA-F]", ""))


def verdict(hashes: Column, expected: Column) -> Column:
    """match, mismatch (a digest of that length differs), length-none, or null without an expected hash."""
    want, have = normalize_hash(expected), F.map_values(hashes)
    return (
        F.when(want == "", None).when(F.array_contains(have, want), "match")
        .when(F.exists(have, lambda h: F.length(h) == F.length(want)), "mismatch").otherwise("length-none")
    )


def hmac_sha256(key: bytes, message: Column) -> Column:
    """RFC 2104 over binary or string messages. The two padded keys become literals of the plan."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def adler32(content: Column) -> Column:
    """Adler-32 from its closed form over the bytes, on the JVM; for short contents (a sum over an array of bytes). files.adler32 is for long ones."""
    hexed = F.hex(content.cast("binary"))
    n = F.octet_length(content.cast("binary"))
    value = lambda i: F.conv(F.substring(hexed, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    byte = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("long").alias("i"), value(i).alias("v")))).otherwise(F.array().cast("array<struct<i:bigint,v:bigint>>"))
    a = F.aggregate(byte, F.lit(1).cast("long"), lambda s, x: (s + x["v"]) % 65521)
    b = F.aggregate(byte, F.lit(0).cast("long"), lambda s, x: (s + (n - x["i"]) * x["v"]) % 65521)
    return F.shiftleft((n + b) % 65521, 16) + a


def size_text(n: Column) -> Column:
    """Bytes in words: B, KB, MB, GB, TB by 1024; two decimals below 10, else one."""
    n = n.cast("double")
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB")):
        x = n / (1024.0 ** (i + 1))
        text = F.concat(F.when(x < 10, F.format_string("%.2f", x)).otherwise(F.format_string("%.1f", x)), F.lit(f" {unit}"))
        out = F.when(n >= 1024.0 ** (i + 1), text).otherwise(out)
    return out


def short_size_text(n: Column) -> Column:
    """Bytes in short words: B, or KB with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))


def local_stamp(ts: Column) -> Column:
    """Time of the session's zone with its offset."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'xxx")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmm")


def integrity(content: Column, algorithm: str = "sha384") -> Column:
    """Subresource integrity: the algorithm (sha256, sha384 or sha512) and the digest in base64."""
    if algorithm not in ("sha256", "sha384", "sha512"):
        raise ValueError(f"unknown integrity algorithm: {algorithm}")
    return F.concat(F.lit(f"{algorithm}-"), F.base64(F.unhex(F.sha2(content.cast("binary"), int(algorithm[3:])))))


def manifest_line(content: Column, path: Column) -> Column:
    return F.concat(F.sha2(content.cast("binary"), 256), F.lit("  "), path)


def receipt_json(generated: Column, files: Column, tool: str = "veilspark digests", version: str = "1") -> Column:
    """files: array of (name, size_bytes, last_modified, hashes, cross_check); indented by two spaces."""
    return F.to_json(F.struct(F.lit(tool).alias("tool"), F.lit(version).alias("version"), generated.alias("generated"), files.alias("files")), {"pretty": "true"})


def receipt_text(files: Column) -> Column:
    """The same as lines of text, files numbered from 1."""
    names = {"sha256": "SHA-256", "sha1": "SHA-1  ", "md5": "MD5    "}
    hash_lines = lambda f: F.filter(F.array(*[F.concat(F.lit(f"   {label}: "), F.element_at(f["hashes"], algo)) for algo, label in names.items()]), lambda x: x.isNotNull())
    part = lambda f, i: F.concat(
        F.array(F.concat((i + 1).cast("string"), F.lit(". "), f["name"]), F.concat(F.lit("   Size: "), f["size_bytes"].cast("string"), F.lit(" bytes")), F.concat(F.lit("   Last modified: "), f["last_modified"])),
        hash_lines(f), F.array(F.concat(F.lit("   Cross-check: "), f["cross_check"]), F.lit("")),
    )
    return F.array_join(F.flatten(F.transform(files, part)), "\n")
