"""Plain text as PDF files, in the forms that programs write: a table of objects, or compressed streams of objects; letters by
a Latin font, or all letters by a composite one; encrypted without a password or not. No fonts are embedded."""

from __future__ import annotations

import hashlib
import re
import zlib

from vellum.sources.pdf import PADDING, file_key, object_key, rc4, user_mark

#: Letters that take more than two bytes, or are none.
_TWO_BYTES = re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")

#: Lines of a page.
LINES = 30


def _hex(data: bytes) -> bytes:
    return b"<" + data.hex().encode() + b">"


def _unicode_map(letters: str) -> bytes:
    """A map of codes of two bytes to letters."""
    lines = [b"<%04x> <%04x>" % (ord(c), ord(c)) for c in sorted(set(letters))]
    blocks = b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(lines[i : i + 100]), b"\n".join(lines[i : i + 100])) for i in range(0, len(lines), 100))
    return b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap\n1 begincodespacerange <0000> <ffff> endcodespacerange\n" + blocks + b"endcmap end end"


def text_pdf(text: str, streams: bool = False, composite: bool = False, locked: bool = False) -> bytes:
    """The lines of a text that are not blank, ``LINES`` a page. Letters that the font lacks become question marks."""
    lines = [x for x in text.split("\n") if x.strip()]
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
    if composite:
        clean = lambda x: _TWO_BYTES.sub("?", x)
        shown = lambda x: _hex(clean(x).encode("utf-16-be"))
    else:
        shown = lambda x: _hex(x.encode("cp1252", "replace"))
    plain: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    bodies: dict[int, tuple[bytes, bytes]] = {}
    at = 5
    kids = []
    for page in pages:
        kids.append(b"%d 0 R" % at)
        plain[at] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R >>" % (at + 1)
        bodies[at + 1] = b"/Filter /FlateDecode", zlib.compress(b"BT /F1 11 Tf 50 800 Td\n" + b"\n".join(shown(x) + b" Tj 0 -24 Td" for x in page) + b"\nET")
        at += 2
    plain[2] = b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % (b" ".join(kids), len(kids))
    if composite:
        plain[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /DescendantFonts [] /ToUnicode 4 0 R >>"
        bodies[4] = b"/Filter /FlateDecode", zlib.compress(_unicode_map("".join(map(clean, lines))))
    else:
        plain[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    end = b"/Root 1 0 R"
    key = b""
    if locked:
        name, owner, rights = hashlib.md5(text.encode("utf-8", "replace")).digest(), hashlib.md5(PADDING).digest() * 2, -4
        key = file_key(owner, rights, name, 16, 3)
        lock, at = at, at + 1
        end += b" /Encrypt %d 0 R /ID [%s %s]" % (lock, _hex(name), _hex(name))
    out, place = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, head: bytes, body: bytes | None = None) -> None:
        place[n] = len(out)
        if body is not None:
            if key and b"/XRef" not in head:
                body = rc4(object_key(key, n, 0), body)
            head = b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, head))

    if locked:
        put(lock, b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P %d /O %s /U %s >>" % (rights, _hex(owner), _hex(user_mark(key, name, 3) + bytes(16))))
    for n, (head, body) in bodies.items():
        put(n, head, body)
    if not streams:
        for n, x in plain.items():
            put(n, x)
        start, size = len(out), at
        out.extend(b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % place[n] if n in place else b"0000000000 00000 f \n" for n in range(1, size)) + b"trailer\n<< /Size %d %s >>\n" % (size, end))
    else:
        numbers, offset, parts = [], 0, []
        for n, x in plain.items():
            numbers.append(b"%d %d" % (n, offset))
            parts.append(x + b" ")
            offset += len(x) + 1
        first = b" ".join(numbers) + b" "
        group, table = at, at + 1
        rows_of = lambda data: b"".join(b"\x02" + bytes((data[i + k] - (data[i - 7 + k] if i else 0)) & 255 for k in range(7)) for i in range(0, len(data), 7))
        put(group, b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % (len(plain), len(first)), zlib.compress(rows_of((first + b"".join(parts)).ljust(-(-(len(first) + offset) // 7) * 7))))
        inner = {n: i for i, n in enumerate(plain)}
        start = len(out)
        place[table] = start
        entries = b"".join(b"\x02" + group.to_bytes(4, "big") + inner[n].to_bytes(2, "big") if n in inner else b"\x01" + place[n].to_bytes(4, "big") + b"\0\0" if n in place else bytes(7) for n in range(table + 1))
        put(table, b"/Type /XRef /Size %d /W [1 4 2] %s /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % (table + 1, end), zlib.compress(rows_of(entries)))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % start)
    return bytes(out)
