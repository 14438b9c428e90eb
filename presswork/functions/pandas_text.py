"""Arrow-batched functions for what the JVM has no expression for."""

from __future__ import annotations

import io
import ipaddress
import struct
from collections.abc import Iterator
from html import unescape as html_unescape
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

STRING = StringType()
SIZE = StructType().add("width", IntegerType()).add("height", IntegerType())


@F.pandas_udf(STRING)
def unescape(text: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return text.map(html_unescape, na_action="ignore")


@F.pandas_udf(STRING)
def casefolded(text: pd.Series) -> pd.Series:
    return text.str.casefold()


@F.pandas_udf(STRING)
def absolute_url(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", u or "") for b, u in zip(base, url)])


@F.pandas_udf(STRING)
def decoded(raw: pd.Series) -> pd.Series:
    """UTF-8, else GB18030, else Latin-1."""

    def one(data: bytes) -> str:
        for name in ("utf-8", "gb18030"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("latin-1")

    return raw.map(one, na_action="ignore")


def host_of(value: str | None) -> str:
    try:
        return (urlsplit(value or "").hostname or "").strip()
    except ValueError:
        return ""


def blocked_address(value: str | None) -> str:
    """Why an address must not be fetched ('' if it may): malformed, no host, or an address of the machine's own services
    (link-local or unspecified). Loopback and private hosts may be fetched, as feeds come from local bridges too; names are not resolved."""
    try:
        urlsplit(value or "")
    except ValueError:
        return "malformed"
    host = host_of(value)
    if not host:
        return "no host"
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return ""
    return "link-local" if ip.is_link_local or ip.is_unspecified else ""


def is_internal_address(value: str | None) -> bool:
    """The strict rule, for callers that fetch for others: no host, local names, or an address that is not public."""
    host = host_of(value)
    if not host or host == "localhost" or host.endswith((".localhost", ".internal", ".local")):
        return True
    try:
        return not ipaddress.ip_address(host).is_global
    except ValueError:
        return False


@F.pandas_udf(STRING)
def blocked_reason(url: pd.Series) -> pd.Series:
    return url.map(blocked_address)


@F.pandas_udf(BooleanType())
def is_internal_host(url: pd.Series) -> pd.Series:
    return url.map(is_internal_address)


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(code, payload) of a JPEG file's marker segments up to its image data.

    A marker is a byte 255 and its code; any number of bytes 255 may stand before it to fill up. The payload follows with its
    length in front, which counts its own two bytes.
    """
    stream = io.BytesIO(data)
    stream.seek(2)
    while True:
        if stream.read(1) != b"\xff":
            return
        code = stream.read(1)
        while code == b"\xff":
            code = stream.read(1)
        if code in (b"", b"\xda", b"\xd9"):  # the scan begins, or the file ends
            return
        head = stream.read(2)
        if len(head) < 2:
            return
        yield code[0], stream.read(int.from_bytes(head, "big") - 2)


#: The codes of the JPEG segments that state a frame's size: SOF0 to SOF15 without the three that define tables.
FRAMES = {*range(192, 208)} - {196, 200, 204}
#: Width and height in each format: the signature and its place, then the two numbers' struct format, their place and the bits that count.
HEADS = (
    (b"\x89PNG\r\n\x1a\n", 0, ">II", 16, 0xFFFFFFFF),
    (b"GIF8", 0, "<HH", 6, 0xFFFF),
    (b"VP8 ", 12, "<HH", 26, 0x3FFF),
)


def _packed_size(data: bytes) -> tuple[int, int] | None:
    """WebP's lossless and extended kinds: sizes less one in a row of bits, 14 of each behind a byte, or 24 of each behind four."""
    for kind, at, bits in ((b"VP8L", 21, 14), (b"VP8X", 24, 24)):
        if data[12:16] == kind and len(data) >= at - (-bits // 4):
            both = int.from_bytes(data[at : at + 6], "little")
            return both % (1 << bits) + 1, (both >> bits) % (1 << bits) + 1
    return None


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the head of a PNG, GIF, JPEG or WebP file; None for anything else."""
    data = data or b""
    found = None
    if data.startswith(b"\xff\xd8"):
        frame = next((x for code, x in _segments(data) if code in FRAMES and len(x) >= 5), None)
        found = (int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big")) if frame else None
    else:
        for signature, place, form, at, mask in HEADS:
            if data[place : place + len(signature)] == signature and len(data) >= at + struct.calcsize(form):
                found = tuple(n & mask for n in struct.unpack_from(form, data, at))
        if data.startswith(b"RIFF") and data[8:12] == b"WEBP":
            found = found or _packed_size(data)
    return found if found and all(found) else None


@F.pandas_udf(SIZE)
def image_size(head: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(h) or (None, None) for h in head], columns=["width", "height"]).astype("Int32")
