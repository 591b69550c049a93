"""Text and metadata of PDF files by the file format itself: objects, Flate streams, object streams, text operators.

Fonts with encodings of their own give the codes they hold, so such a text is wrong or empty; so
is a scanned page, which has no text.  An encrypted file gives its metadata's plain part alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
#: A token of a content stream: a string in brackets, a hexadecimal one, an array's ends, a number, a name, an operator.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|[-+]?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


@dataclass
class Pdf:
    pages: int = 0
    encrypted: bool = False
    info: dict[str, str] = field(default_factory=dict)
    text: str = ""


def _string(raw: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def escape(m: re.Match) -> bytes:
        code = m[1]
        if code[:1].isdigit():
            return bytes([int(code, 8) & 255])
        return b"" if code in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(code, code)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escape, raw[1:-1], flags=re.S)


def _decoded(data: bytes) -> str:
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("utf-8", "strict") if data.startswith(b"\xef\xbb\xbf") else data.decode("cp1252", "replace")


def _unpacked(head: bytes, data: bytes) -> bytes | None:
    """A stream's bytes: plain or Flate; None for other filters and broken data."""
    filters = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
    names = re.findall(rb"/(\w+)", filters[1]) if filters else []
    if not names:
        return data
    if names != [b"FlateDecode"]:
        return None
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return None


def _shown(content: bytes) -> str:
    """Text that a content stream shows: strings of Tj, TJ, ' and ", a new line for each move to another."""
    out, stack, in_array, line = [], [], False, []
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token == b"[":
            in_array, stack = True, []
        elif token == b"]":
            in_array = False
        elif token[:1] in b"(<":
            stack.append(_decoded(_string(token)))
        elif in_array or token[:1] in b"/+-.0123456789":
            if in_array and token[:1] in b"-." and float(token) < -200:  # a wide gap stands for a space
                stack.append(" ")
            elif not in_array and token[:1] != b"/":
                line.append(float(token))
        else:
            if token in (b"Tj", b"TJ"):
                out += stack
            elif token in (b"'", b'"'):
                out += ["\n", *stack]
            elif token in (b"T*", b"ET", b"Tm") or token in (b"Td", b"TD") and line[-1:] != [0.0]:
                out.append("\n")
            elif token in (b"Td", b"TD"):
                out.append(" ")
            stack, line = [], []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def read(content: bytes) -> Pdf | None:
    """A PDF file's pages, metadata and text; None where the bytes are no PDF file."""
    if b"%PDF-" not in content[:1024]:
        return None
    objects: dict[int, bytes] = {}
    for m in _OBJECT.finditer(content):
        objects[int(m[1])] = m[3]
    for body in list(objects.values()):  # objects inside object streams
        if re.search(rb"/Type\s*/ObjStm", body) and (stream := _STREAM.search(body)):
            inner = _unpacked(body[: stream.start()], stream[1])
            first, count = (re.search(rb"/%s\s+(\d+)" % k, body) for k in (b"First", b"N"))
            if inner and first and count:
                numbers = [int(x) for x in inner[: int(first[1])].split()[: 2 * int(count[1])]]
                starts = [*numbers[1::2], len(inner) - int(first[1])]
                for k, number in enumerate(numbers[::2]):
                    objects.setdefault(number, inner[int(first[1]) + starts[k] : int(first[1]) + starts[k + 1]])
    trailer = b" ".join([*re.findall(rb"trailer(.*?)startxref", content, re.S), *(b for b in objects.values() if re.search(rb"/Type\s*/XRef", b))])
    out = Pdf(pages=sum(bool(re.search(rb"/Type\s*/Page\b(?!s)", b)) for b in objects.values()), encrypted=b"/Encrypt" in trailer)
    if (named := re.search(rb"/Info\s+(\d+)\s+\d+\s+R", trailer)) and int(named[1]) in objects:
        body = objects[int(named[1])]
        for key in INFO:
            if found := re.search(rb"/%s\s*(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)" % key.encode(), body, re.S):
                out.info[key] = _decoded(_string(found[1])).strip()
    if not out.encrypted:
        shown = []
        for number in sorted(objects):
            stream = _STREAM.search(objects[number])
            head = objects[number][: stream.start()] if stream else b""
            if stream and not re.search(rb"/Subtype\s*/Image|/Type\s*/(?:XRef|ObjStm|Metadata)|/FontFile|/Length1\b", head):
                data = _unpacked(head, stream[1])
                if data and re.search(rb"\bBT\b", data):
                    shown.append(_shown(data))
        out.text = "\n".join(x for x in shown if x)
    return out
