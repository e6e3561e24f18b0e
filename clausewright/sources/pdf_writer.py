"""Plain PDF files from lines of text, as exports and as inputs of the reader."""

from __future__ import annotations

import zlib
from collections.abc import Callable

SIZE, LEADING, WIDTH, TOP = 10, 12, 500, 780


def _escaped(data: bytes) -> bytes:
    return data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")


def _content(lines: list[str], coded: Callable[[str], bytes], blank: bytes, by_word: bool) -> bytes:
    """One text object: a line after another, whole or word by word at its own place."""
    out = [b"BT /F1 %d Tf %d TL 1 0 0 1 40 %d Tm" % (SIZE, LEADING, TOP)]
    for line in lines:
        if not by_word:
            out.append(b"(" + _escaped(coded(line)) + b") Tj T*")
            continue
        # The blank is no glyph: the next word begins a third of an em further right.
        own = ("_" + coded(line).hex("_", len(blank))).replace("_" + blank.hex(), "> -333 <").replace("_", "")
        out.append(b"[<%s>] TJ T*" % own.encode())
    return b"\n".join([*out, b"ET"])


def _to_unicode(codes: dict[str, bytes]) -> bytes:
    listed = [b"<%s> <%s>" % (code.hex().encode(), char.encode("utf-16-be").hex().encode()) for char, code in codes.items()]
    parts = [b"%d beginbfchar\n%s\nendbfchar" % (len(p), b"\n".join(p)) for p in (listed[i : i + 100] for i in range(0, len(listed), 100))]
    return b"\n".join([b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange", *parts, b"endcmap end"])


def pdf_file(pages: list[list[str]], compact: bool = False, by_word: bool = False, broken: tuple[int, ...] = ()) -> bytes:
    """A PDF file with a page for each list of lines. compact: objects in compressed streams, as PDF 1.5 has them, and a
    composite font with a ToUnicode map; else a cross-reference table and, where it can spell the text, a simple font.
    by_word: words are placed one by one, without blanks. broken: pages (from 1) whose content cannot be decompressed."""
    chars = sorted(set("".join("".join(lines) for lines in pages)))
    simple = not compact and all(c.encode("cp1252", "ignore") for c in chars)
    codes = {c: c.encode("cp1252") if simple else (i + 1).to_bytes(2, "big") for i, c in enumerate(chars)}
    # A blank that no line has stands for itself: no code is zero.
    blank = codes.get(" ", b" " if simple else bytes(2))
    # A line at a time: two bytes of a code are a character's of UTF-16, whichever it is.
    places_of = {ord(c): i + 1 for i, c in enumerate(chars)}
    coded = (lambda text: text.encode("cp1252")) if simple else lambda text: text.translate(places_of).encode("utf-16-be", "surrogatepass")
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    streams: dict[int, tuple[bytes, bytes]] = {}
    if simple:
        objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [%s] >>" % b" ".join([b"%d" % WIDTH] * 256)
    else:
        objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Body /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
        objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Body /DW %d >>" % WIDTH
        streams[5] = (b"/Filter /FlateDecode", zlib.compress(_to_unicode(codes)))
    number, groups = 6, []
    for at in range(0, len(pages), 8):  # a tree of two levels, so that ranges of pages can be passed over
        group, kids = number, []
        number += 1
        for i, lines in enumerate(pages[at : at + 8], at + 1):
            data = _content(lines, coded, blank, by_word)
            packed = zlib.compress(data) if compact or i in broken else data
            streams[number + 1] = (b"/Filter /FlateDecode" if compact or i in broken else b"", b"\x00" * 8 + packed[8:] if i in broken else packed)
            objects[number] = b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R >>" % (group, number + 1)
            kids.append(b"%d 0 R" % number)
            number += 2
        objects[group] = b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
        groups.append(b"%d 0 R" % group)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(groups))
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    stream = lambda entries, data: b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), entries, data)
    for n, (entries, data) in sorted(streams.items()):
        put(n, stream(entries, data))
    if not compact:
        for n, body in sorted(objects.items()):
            put(n, body)
        start = len(out)
        rows = [b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(number)]
        out += b"xref\n0 %d\n%strailer\n<< /Size %d /Root 1 0 R >>\n" % (number, b"".join(rows), number)
    else:
        order, bodies, head, at = sorted(objects), [], [], 0
        for n in order:
            head.append(b"%d %d" % (n, at))
            bodies.append(objects[n] + b" ")
            at += len(bodies[-1])
        first = b" ".join(head) + b" "
        put(number, stream(b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(order), len(first)), zlib.compress(first + b"".join(bodies))))
        start = places[number + 1] = len(out)
        within = {n: i for i, n in enumerate(order)}
        rows = [b"\x02" + number.to_bytes(4, "big") + within[n].to_bytes(2, "big") if n in within else b"\x01" + places[n].to_bytes(4, "big") + b"\0\0" if n in places else bytes(7) for n in range(number + 2)]
        above, packed = bytes(7), b""
        for row in rows:  # the predictor that writers use: differences to the row above
            packed += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
            above = row
        put(number + 1, stream(b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >>" % (number + 2), zlib.compress(packed)))
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)
