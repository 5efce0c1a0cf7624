"""Text of PDF pages with the standard library: plain and Flate streams with predictors, object and cross-reference streams,
simple and composite fonts with Unicode maps of codes of one or more bytes, standard encryption without a password.

Enough for reports that programs write. Files that need a password or are encrypted by AES, other filters and scanned
pages give an error or no text; a full library is used in its place where there is one."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence

_TOKEN = re.compile(
    rb"%[^\r\n]*|(?P<name>/[^\x00\t\n\f\r /<>\[\]()%]*)|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<text>\()"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?=[\x00\t\n\f\r /<>\[\]()%]|$)|(?P<word>[^\x00\t\n\f\r /<>\[\]()%]+)"
)
#: Fixed values of the format: characters after a backslash.
_ESCAPED = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


#: Fixed value of the format: what stands for a missing password.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    """Encrypts and decrypts."""
    state, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        x = state[i]
        j = (j + x + k) & 255
        state[i], state[j] = state[j], x
    out, j, size = [], 0, len(data)
    places = [*range(1, 256), 0]
    while len(out) < size:  # a round of all places at a time
        for i in places[: size - len(out)]:
            x = state[i]
            j = (j + x) & 255
            state[i] = y = state[j]
            state[j] = x
            out.append(state[(x + y) & 255])
    return (int.from_bytes(data, "big") ^ int.from_bytes(bytes(out), "big")).to_bytes(size, "big")


def file_key(owner: bytes, rights: int, name: bytes, size: int, revision: int) -> bytes:
    """The key of a file without a password, from what the file says of its encryption."""
    key = hashlib.md5(PADDING + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + name).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


def user_mark(key: bytes, name: bytes, revision: int) -> bytes:
    """What a file holds to tell whether a key is right."""
    if revision < 3:
        return rc4(key, PADDING)
    mark = hashlib.md5(PADDING + name).digest()
    for i in range(20):
        mark = rc4(bytes(k ^ i for k in key), mark)
    return mark


def object_key(key: bytes, number: int, generation: int) -> bytes:
    return hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little")).digest()[: min(len(key) + 5, 16)]


def unpredicted(data: bytes, columns: int, pixel: int) -> bytes:
    """Rows of bytes from their differences to the left, above, or both; each row begins with the number of its kind."""
    above, out = bytearray(columns), bytearray()
    for at in range(0, len(data), columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(len(row)):
            left, up, corner = row[i - pixel] if i >= pixel else 0, above[i], above[i - pixel] if i >= pixel else 0
            if kind == 4:
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                near = (0, left, up, (left + up) // 2)[kind]
            row[i] = (row[i] + near) & 255
        out += row
        above = row + bytes(columns - len(row))
    return bytes(out)


class Name(str):
    """A name of the format."""


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string in brackets that begins before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        if c == 92 and at + 1 < len(data):
            at += 1
            if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
                continue
            if data[at] == 13:
                at += data[at + 1 : at + 2] == b"\n"
            elif data[at] != 10:
                out.append(_ESCAPED.get(data[at], data[at]))
            at += 1
            continue
        depth += (c == 40) - (c == 41)
        at += 1
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """The values of a stretch of syntax with the place behind each: numbers, names, strings, lists, mappings, words."""
    stack: list[list] = []
    while found := _TOKEN.search(data, at):
        at, kind = found.end(), found.lastgroup
        if kind is None:
            continue
        token = found[kind]
        if kind == "open":
            stack.append([token])
            continue
        if kind == "close":
            if not stack:
                continue
            first, *inner = stack.pop()
            value: object = inner if first == b"[" else {k: v for k, v in zip(inner[::2], inner[1::2], strict=False) if isinstance(k, Name)}
        elif kind == "text":
            value, at = _string(data, at)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", token)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "number":
            value = float(token) if b"." in token else int(token)
        else:
            value = (Name if kind == "name" else Word)(token.decode("latin-1").lstrip("/"))
        if stack:
            inner = stack[-1]
            if value == "R" and isinstance(value, Word) and len(inner) > 2:
                inner[-2:] = [Reference(inner[-2])]
            else:
                inner.append(value)
        else:
            yield value, at


class Reference(int):
    """The number of another object."""


class File:
    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF-"):
            raise ValueError("no PDF file")
        self.generation: dict[int, int] = {}
        self.key = b""
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for found in re.finditer(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b", data):
            n, (value, at) = int(found[1]), next(values(data, found.end()), (None, found.end()))
            self.objects[n], self.generation[n] = value, int(found[2])
            if isinstance(value, dict) and (body := re.compile(rb"\s*stream\r?\n").match(data, at)):
                size = value.get("Length")
                end = body.end() + size if isinstance(size, int) and not isinstance(size, Reference) else data.find(b"endstream", body.end())
                self.streams[n] = data[body.end() : end]
        ends = [next(values(data, found.end()), (None, 0))[0] for found in re.finditer(rb"\btrailer\b", data)] + [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "XRef"]
        for end in ends:
            if isinstance(end, dict) and "Encrypt" in end and not self.key:
                self.key = self._unlock(self.get(end["Encrypt"]), self.get(end.get("ID")))
        for n in [n for n, x in self.objects.items() if isinstance(x, dict) and x.get("Type") == "ObjStm"]:
            body, first = self.stream(n), self.objects[n]["First"]
            numbers = [v for v, _ in values(body[:first])]
            for k, at in zip(numbers[::2], numbers[1::2], strict=False):
                self.objects.setdefault(k, next(values(body, first + at), (None, 0))[0])

    def _unlock(self, told: object, names: object) -> bytes:
        if not isinstance(told, dict) or told.get("Filter") != "Standard" or told.get("V") not in (1, 2):
            raise ValueError("this kind of encryption is not supported")
        revision, name = told.get("R", 2), names[0] if isinstance(names, list) and names else b""
        key = file_key(told["O"], int(told["P"]), name, int(told.get("Length", 40)) // 8 if revision >= 3 else 5, revision)
        if user_mark(key, name, revision)[:16] != told["U"][:16]:
            raise ValueError("the file needs a password")
        return key

    def get(self, value: object) -> object:
        seen = 0
        while isinstance(value, Reference) and seen < 50:
            value, seen = self.objects.get(int(value)), seen + 1
        return value

    def stream(self, n: int) -> bytes:
        head, body = self.objects[n], self.streams.get(n, b"")
        if self.key and head.get("Type") != "XRef":
            body = rc4(object_key(self.key, n, self.generation[n]), body)
        filters = self.get(head.get("Filter")) or []
        filters = filters if isinstance(filters, list) else [filters]
        hints = self.get(head.get("DecodeParms"))
        hints = hints if isinstance(hints, list) else [hints] * len(filters)
        for name, hint in zip(filters, hints, strict=False):
            if name != "FlateDecode":
                raise ValueError(f"the filter {name} is not supported")
            body, hint = zlib.decompressobj().decompress(body), self.get(hint)
            if isinstance(hint, dict) and hint.get("Predictor", 1) > 1:
                if hint["Predictor"] < 10:
                    raise ValueError("this predictor is not supported")
                bits = hint.get("Colors", 1) * hint.get("BitsPerComponent", 8)
                body = unpredicted(body, (hint.get("Columns", 1) * bits + 7) // 8, max(1, bits // 8))
        return body

    def pages(self) -> Iterator[dict]:
        roots = [x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"]
        todo, seen = [(self.get(roots[-1].get("Pages")), {})] if roots else [], 0
        while todo and (seen := seen + 1) < 100_000:
            node, above = todo.pop(0)
            if not isinstance(node, dict):
                continue
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            if "Kids" in node:
                todo[:0] = [(self.get(k), own) for k in self.get(node["Kids"])]
            else:
                yield node | own

    def font(self, reference: object) -> tuple[list[tuple[int, int, int]], dict[int, str]]:
        """(ranges of codes as bytes, first and last; what codes mean) of a font; codes that are not listed are Latin letters."""
        font = self.get(reference)
        if not isinstance(font, dict):
            return [(1, 0, 255)], {}
        means: dict[int, str] = {}
        ranges: list[tuple[int, int, int]] = []
        if isinstance(font.get("ToUnicode"), Reference):
            held: list = []
            for value, _ in values(self.stream(int(font["ToUnicode"]))):
                if value == "endbfchar":
                    pairs = [x for x in held if isinstance(x, bytes)]
                    means |= {int.from_bytes(a, "big"): b.decode("utf-16-be", "replace") for a, b in zip(pairs[::2], pairs[1::2], strict=False)}
                elif value == "endcodespacerange":
                    pairs = [x for x in held if isinstance(x, bytes)]
                    ranges += [(len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(pairs[::2], pairs[1::2], strict=False)]
                elif value == "endbfrange":
                    for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                        for k in range(int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65535) + 1):
                            at = k - int.from_bytes(a, "big")
                            means[k] = to[at].decode("utf-16-be", "replace") if isinstance(to, list) else to[:-2].decode("utf-16-be", "replace") + chr(int.from_bytes(to[-2:], "big") + at)
                elif isinstance(value, Word):
                    held = []
                    continue
                held = [] if isinstance(value, Word) else [*held, value]
        if font.get("Subtype") != "Type0":
            return [(1, 0, 255)], means
        return sorted(ranges) or [(2, 0, 65535)], means


#: What codes of one byte mean by themselves.
LATIN = [bytes([c]).decode("cp1252", "replace") for c in range(256)]


def codes_of(x: bytes, ranges: list[tuple[int, int, int]]) -> Sequence[int]:
    """The codes of a string: from each place the shortest whose range it lies in, else of the shortest length."""
    if ranges[0] == (1, 0, 255):
        return x
    if ranges[0] == (2, 0, 65535) and len(x) % 2 == 0:
        return struct.unpack(f">{len(x) // 2}H", x)
    codes, at = [], 0
    while at < len(x):
        size = next((n for n, lo, hi in ranges if len(x) - at >= n and lo <= int.from_bytes(x[at : at + n], "big") <= hi), ranges[0][0])
        codes.append(int.from_bytes(x[at : at + size], "big"))
        at += size
    return codes


def page_text(file: File, page: dict) -> str:
    """The shown strings in their order; a move to another line is a line end, a wide gap a space."""
    contents = page.get("Contents")
    contents = contents if isinstance(contents, Reference) and not isinstance(file.get(contents), list) else file.get(contents)
    data = b"\n".join(file.stream(int(x)) for x in (contents if isinstance(contents, list) else [contents]) if isinstance(x, Reference))
    fonts = file.get((file.get(page.get("Resources")) or {}).get("Font")) or {}
    known: dict[str, tuple[list[tuple[int, int, int]], dict[int, str]]] = {}
    ranges, means = [(1, 0, 255)], {}
    out, held = [], []

    def show(x: bytes) -> None:
        out.append("".join([means[c] if c in means else LATIN[c] if c < 256 else "�" for c in codes_of(x, ranges)]))

    for value, _ in values(data):
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == "Tf" and held and len(held) > 1:
            name = str(held[-2])
            known.setdefault(name, file.font(fonts.get(name)))
            ranges, means = known[name]
        elif value in ("Td", "TD") and len(held) > 1 and held[-1] != 0 or value in ("T*", "'", '"', "Tm", "ET"):
            out.append("\n")
        if value in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
            show(held[-1])
        elif value == "TJ" and held and isinstance(held[-1], list):
            for x in held[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, (int, float)) and x < -200:
                    out.append(" ")
        held = []
    return "\n".join(line.rstrip() for line in "".join(out).split("\n") if line.strip())


def pages_of(data: bytes) -> list[str]:
    file = File(data)
    return [page_text(file, page) for page in file.pages()]
