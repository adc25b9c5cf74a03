"""EXIF and IPTC fields from the bytes of JPEG and TIFF files."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of tags of the main image (IFD0), of the EXIF and of the GPS directory.
IMAGE_TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x0100: "ImageWidth", 0x0101: "ImageLength",
    0x0213: "YCbCrPositioning", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo",
}
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength",
    0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDate"}
#: Bytes of a value by its type: byte, text, short, long, ratio, signed byte, undefined, signed short, signed long, signed ratio.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8}


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, payload) up to the image's own data."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA or size < 2:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def _told(raw: bytes, kind: int, order: str) -> str:
    if kind == 2:
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace").strip()
    if kind == 7:
        return raw.decode("ascii") if raw.isascii() and raw.strip(b"\0").decode("ascii").isprintable() else str(list(raw))
    size, signed = _SIZES[kind], kind in (6, 8, 9, 10)
    number = lambda b: int.from_bytes(b, order, signed=signed)
    values = []
    for at in range(0, len(raw) - size + 1, size):
        part = raw[at : at + size]
        if size == 8:
            a, b = number(part[:4]), number(part[4:])
            d = gcd(a, b) or 1
            values.append(str(a // d) if b // d == 1 else f"{a // d}/{b // d}")
        else:
            values.append(str(number(part)))
    return values[0] if len(values) == 1 else f"[{', '.join(values)}]"


def _directory(tiff: bytes, at: int, order: str, group: str, names: dict[int, str], out: dict[str, str], below: dict[int, tuple[str, dict[int, str]]]) -> None:
    count = int.from_bytes(tiff[at : at + 2], order)
    for entry in range(at + 2, min(at + 2 + 12 * count, len(tiff) - 11), 12):
        tag, kind, n = (int.from_bytes(tiff[entry + a : entry + b], order) for a, b in ((0, 2), (2, 4), (4, 8)))
        size = _SIZES.get(kind, 0) * n
        where = entry + 8 if size <= 4 else int.from_bytes(tiff[entry + 8 : entry + 12], order)
        if not size or where + size > len(tiff):
            continue
        out[f"{group} {names.get(tag, f'Tag 0x{tag:04X}')}"] = _told(tiff[where : where + size], kind, order)
        if tag in below:
            inner = below[tag]
            _directory(tiff, int.from_bytes(tiff[where : where + 4], order), order, *inner, out, {})


def exif_fields(data: bytes | None) -> dict[str, str]:
    """Names like 'Image Make' or 'EXIF FNumber' to texts: ratios as reduced fractions, several values in brackets; empty if there are none."""
    data, out = data or b"", {}
    tiff = data if data[:2] in (b"II", b"MM") else next((p[6:] for m, p in jpeg_segments(data) if m == 0xE1 and p[:6] == b"Exif\0\0"), b"")
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order and int.from_bytes(tiff[2:4], order) == 42:
        _directory(tiff, int.from_bytes(tiff[4:8], order), order, "Image", IMAGE_TAGS, out, {0x8769: ("EXIF", EXIF_TAGS), 0x8825: ("GPS", GPS_TAGS)})
    return out


def iptc_fields(data: bytes | None) -> dict[str, str]:
    """Numbers of the application record's datasets to texts, several of one number in brackets; empty ones are left out."""
    found: dict[int, list[str]] = {}
    for marker, p in jpeg_segments(data or b""):
        at = len(b"Photoshop 3.0\0") if marker == 0xED and p.startswith(b"Photoshop 3.0\0") else len(p)
        while p[at : at + 4] == b"8BIM" and at + 12 <= len(p):
            kind = int.from_bytes(p[at + 4 : at + 6], "big")
            name = p[at + 6] + 1
            at += 6 + name + name % 2
            size = int.from_bytes(p[at : at + 4], "big")
            block = p[at + 4 : at + 4 + size]
            at += 4 + size + size % 2
            i = 0
            while kind == 0x0404 and block[i : i + 1] == b"\x1c" and i + 5 <= len(block):
                record, number, n = block[i + 1], block[i + 2], int.from_bytes(block[i + 3 : i + 5], "big")
                if record == 2 and number and n and n < 0x8000:
                    found.setdefault(number, []).append(block[i + 5 : i + 5 + n].decode("utf-8", "replace"))
                i += 5 + n
    return {str(k): v[0] if len(v) == 1 else str(v) for k, v in sorted(found.items())}


def exif(content: str = "content") -> Column:
    """map<string,string> of the file's EXIF fields; empty for other bytes and null."""
    return F.pandas_udf(lambda c: pd.Series([exif_fields(x) for x in c]), "map<string,string>")(F.col(content))


def iptc(content: str = "content") -> Column:
    """map<string,string> of the file's IPTC fields, likewise."""
    return F.pandas_udf(lambda c: pd.Series([iptc_fields(x) for x in c]), "map<string,string>")(F.col(content))
