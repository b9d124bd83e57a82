"""Text of PDF files, page by page in the order of the page tree.

Objects are found wherever they lie (plain or in object streams), the last one of a number
counts, so files whose cross references are damaged or in streams read the same.  Strings
become text by their font's ToUnicode map, else as Latin text.  Encrypted files and scanned
pages have no text here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_PICTURE = re.compile(rb"(?s)(?<!\S)BI\s*/.*?\sID\s.*?\sEI(?!\S)")  # within a page's operators; its bytes are no syntax
_CLOSERS = ("]", ">>")


class Name(str):
    """A name object, without its slash."""


class Ref(int):
    """The number of another object."""


class Keyword(str):
    """An operator or word of the syntax."""


def tokens(data: bytes, at: int = 0) -> Iterator[object]:
    """Names, numbers, strings (bytes), keywords and brackets of object or content syntax, as far as it can be read."""
    n = len(data)
    while at < n:
        c = data[at : at + 1]
        if c in _SPACE:
            at += 1
        elif c == b"%":
            at = next((k for k in (data.find(b"\n", at), data.find(b"\r", at)) if k >= 0), n)
        elif c == b"/":
            m = _TOKEN.match(data, at + 1)
            raw = m[0] if m else b""
            at += 1 + len(raw)
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        elif c == b"(":
            value, at = _literal(data, at + 1)
            yield value
        elif data[at : at + 2] in (b"<<", b">>"):
            yield Keyword(data[at : at + 2].decode())
            at += 2
        elif c == b"<":
            end = data.find(b">", at)
            end = n if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            at = end + 1
        elif c in _DELIMITERS:
            yield Keyword(c.decode())
            at += 1
        else:
            m = _TOKEN.match(data, at)
            at += len(m[0])
            word = m[0].decode("latin-1")
            if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", word):
                yield float(word) if "." in word else int(word)
            else:
                yield Keyword(word)


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses from behind its first one, and where it ends."""
    out, depth = [], 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at += len(octal[0])
            else:
                e = data[at : at + 2] if data[at : at + 2] == b"\r\n" else data[at : at + 1]
                out.append(b"" if e in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(e, e))
                at += len(e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out.append(c)
    return b"".join(out), at


def value(source: Iterator[object]) -> object:
    """The next value: a dict, a list, or what one token says; StopIteration at the end."""
    token = next(source)
    if token == "<<" and isinstance(token, Keyword):
        items = _until(source, ">>")
        return {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)}
    if token == "[" and isinstance(token, Keyword):
        return _until(source, "]")
    return token


def _until(source: Iterator[object], closer: str) -> list:
    out: list = []
    while True:
        try:
            v = value(source)
        except StopIteration:
            return out
        if isinstance(v, Keyword) and v in _CLOSERS:
            return out
        if isinstance(v, Keyword) and v == "R" and len(out) > 1 and all(type(x) is int for x in out[-2:]):
            number = out[-2]
            out[-2:] = [Ref(number)]
        else:
            out.append(v)


class Document:
    def __init__(self, raw: bytes):
        if b"%PDF" not in raw[:1024]:
            raise ValueError("no PDF file")
        self.raw, self.bodies = raw, {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", raw):
            self.bodies[int(m[1])] = m.end()
        self.packed: dict[int, object] = {}
        self.trailers = [t for t in (self._value(m.end()) for m in re.finditer(rb"\btrailer\b", raw)) if isinstance(t, dict)]
        for number in list(self.bodies):
            d = self.get(Ref(number))
            kind = d.get("Type") if isinstance(d, dict) else None
            if kind == "XRef":
                self.trailers.append(d)
            elif kind == "ObjStm":
                self._unpack(number, d)
        if any("Encrypt" in t for t in self.trailers):
            raise ValueError("the file is encrypted")

    def _value(self, at: int) -> object:
        try:
            v = value(source := tokens(self.raw, at))
            if type(v) is int:  # another object's number perhaps
                rest = [next(source, None), next(source, None)]
                return Ref(v) if rest[1] == "R" else v
            return v
        except StopIteration:
            return None

    def get(self, v: object) -> object:
        """What a reference stands for; other values are themselves."""
        for _ in range(20):
            if not isinstance(v, Ref):
                return v
            v = self._value(self.bodies[v]) if v in self.bodies else self.packed.get(v)
        return None

    def stream(self, number: int) -> bytes:
        """Decoded data of a stream object; empty if it is none or of an unknown filter."""
        d = self.get(Ref(number))
        at = self.raw.find(b"stream", self.bodies.get(number, len(self.raw)))
        if not isinstance(d, dict) or at < 0:
            return b""
        at += 6
        at += 2 if self.raw[at : at + 2] == b"\r\n" else 1
        size = self.get(d.get("Length"))
        if type(size) is not int or not re.match(rb"\s*endstream", self.raw[at + size : at + size + 20]):
            size = max(0, self.raw.find(b"endstream", at) - at)
        data = self.raw[at : at + size]
        filters = self.get(d.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
            elif self.get(f) in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""
        return data

    def _unpack(self, number: int, d: dict) -> None:
        data, first = self.stream(number), self.get(d.get("First"))
        heads = [x for x in tokens(data[:first]) if type(x) is int]
        for k, at in zip(heads[::2], heads[1::2], strict=False):
            if k not in self.bodies:  # a plain object of that number is a later one
                try:
                    self.packed[k] = value(tokens(data, first + at))
                except StopIteration:
                    continue

    def pages(self) -> Iterator[dict]:
        """Page objects in the order of the tree, with the resources they inherit."""
        roots = [self.get(t.get("Root")) for t in reversed(self.trailers) if "Root" in t]
        roots += [d for d in map(self.get, map(Ref, [*self.bodies, *self.packed])) if isinstance(d, dict) and d.get("Type") == "Catalog"]
        for root in roots:
            if isinstance(root, dict) and isinstance(self.get(root.get("Pages")), dict):
                yield from self._below(root["Pages"], {}, set())
                return
        # no catalogue is left: trees without a parent, in the order of the file
        seen: set = set()
        for number in map(Ref, sorted(self.bodies, key=self.bodies.get)):
            d = self.get(number)
            if isinstance(d, dict) and d.get("Type") == "Pages" and "Parent" not in d:
                yield from self._below(number, {}, seen)

    def _below(self, node: object, resources: dict, seen: set) -> Iterator[dict]:
        if isinstance(node, Ref):
            if node in seen:  # a tree that goes round
                return
            seen.add(node)
        d = self.get(node)
        if not isinstance(d, dict):
            return
        own = self.get(d.get("Resources"))
        resources = own if isinstance(own, dict) else resources
        kids = self.get(d.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                yield from self._below(kid, resources, seen)
        else:
            yield d | {"Resources": resources}

    def text(self, page: dict) -> str:
        """The page's shown strings, a space between."""
        contents = page.get("Contents")
        refs = self.get(contents) if isinstance(self.get(contents), list) else [contents]
        data = b"\n".join(self.stream(r) for r in refs if isinstance(r, Ref))
        return " ".join(t for t in self._shown(data, page["Resources"], 0) if t.strip())

    def _shown(self, data: bytes, resources: dict, depth: int) -> Iterator[str]:
        fonts, forms = (self.get(resources.get(k)) or {} for k in ("Font", "XObject"))
        maps: dict[str, ToUnicode] = {}
        font, stack, source = ToUnicode(b""), [], tokens(_PICTURE.sub(b" ", data))
        while True:
            try:
                v = value(source)
            except StopIteration:
                return
            if not isinstance(v, Keyword):
                stack.append(v)
                continue
            if v == "Tf" and len(stack) > 1:
                name = str(stack[-2])
                if name not in maps:
                    d = self.get(fonts.get(name))
                    ref = d.get("ToUnicode") if isinstance(d, dict) else None
                    maps[name] = ToUnicode(self.stream(ref) if isinstance(ref, Ref) else b"")
                font = maps[name]
            elif v in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                yield font.decode(stack[-1])
            elif v == "TJ" and stack and isinstance(stack[-1], list):
                yield "".join(font.decode(x) if isinstance(x, bytes) else " " * (x < -200) for x in stack[-1] if isinstance(x, bytes | int | float))
            elif v == "Do" and stack and depth < 5:
                ref = forms.get(str(stack[-1]))
                form = self.get(ref)
                if isinstance(ref, Ref) and isinstance(form, dict) and form.get("Subtype") == "Form":
                    yield from self._shown(self.stream(ref), self.get(form.get("Resources")) or resources, depth + 1)
            stack.clear()


class ToUnicode:
    """A font's map from codes to text; codes of one byte as Latin text where there is none."""

    def __init__(self, cmap: bytes):
        self.widths: set[int] = set()
        self.found: dict[bytes, str] = {}
        for kind, body in re.findall(rb"(?s)begin(codespacerange|bfchar|bfrange)(.*?)end\1", cmap):
            items = []
            source = tokens(body)
            while True:
                try:
                    items.append(value(source))
                except StopIteration:
                    break
            if kind == b"codespacerange":
                self.widths |= {len(x) for x in items if isinstance(x, bytes)}
            elif kind == b"bfchar":
                self.found |= {a: _utf16(b) for a, b in zip(items[::2], items[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            else:
                for a, z, to in zip(items[::3], items[1::3], items[2::3], strict=False):
                    for k in range(min(int.from_bytes(z) - int.from_bytes(a) + 1, 65536)):
                        code = (int.from_bytes(a) + k).to_bytes(len(a))
                        if isinstance(to, list):
                            self.found[code] = _utf16(to[k]) if k < len(to) else ""
                        else:
                            head, last = _utf16(to)[:-1], _utf16(to)[-1:]
                            self.found[code] = head + chr(ord(last) + k) if last else ""
        self.widths |= {len(c) for c in self.found}

    def decode(self, raw: bytes) -> str:
        if not self.found:
            return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
        out, at, widths = [], 0, sorted(self.widths)
        while at < len(raw):
            hit = next((w for w in widths if raw[at : at + w] in self.found), None)
            out.append(self.found[raw[at : at + hit]] if hit else "")
            at += hit or widths[-1]
        return "".join(out)


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


def pdf_pages(raw: bytes) -> list[tuple[int | None, str]]:
    """Pages with their numbers from 1; ValueError for a file without a page."""
    doc = Document(raw)
    pages = [(k, doc.text(p)) for k, p in enumerate(doc.pages(), 1)]
    if not pages:
        raise ValueError("no page")
    return pages
