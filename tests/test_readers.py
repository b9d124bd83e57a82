"""PDF files and web pages of many makes."""

import zlib

import pytest

from marginalia.sources import files
from marginalia.sources.pdf import pdf_pages


def pdf(objects, trailer="", head=b"%PDF-1.7\n"):
    """A file of (number, dict text, stream or None)."""
    out = [head]
    for n, d, data in objects:
        out.append(f"{n} 0 obj\n".encode())
        out.append(d.encode() if data is None else f"<< {d} /Length {len(data)} >>\nstream\r\n".encode() + data + b"\nendstream")
        out.append(b"\nendobj\n")
    return b"".join(out) + trailer.encode()


def packed(items):
    """An object stream's dict and data of (number, text)."""
    heads, body = [], ""
    for n, text in items:
        heads.append(f"{n} {len(body)}")
        body += text + " "
    head = " ".join(heads) + "\n"
    return f"/Type /ObjStm /N {len(items)} /First {len(head)} /Filter /FlateDecode", zlib.compress((head + body).encode())


def test_pages_come_in_the_order_of_the_tree():
    raw = pdf([
        (9, "<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", None),
        (5, "", b"BT (third) Tj ET"),
        (3, "<< /Type /Page /Contents [6 0 R 7 0 R] /Parent 4 0 R >>", None),
        (6, "/Filter /FlateDecode", zlib.compress(b"BT (first \\(o\\\nne\\)) Tj")),
        (7, "", b"[(spa) -30 (ced) -500 (out)] TJ ET"),
        (8, "<< /Type /Page /Parent 4 0 R >>", None),
        (4, "<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 2 >>", None),
        (2, "<< /Type /Pages /Kids [4 0 R 9 0 R 2 0 R] /Count 3 >>", None),
        (1, "<< /Type /Catalog /Pages 2 0 R >>", None),
    ], "trailer << /Root 1 0 R /Size 10 >>\nstartxref\n0\n%%EOF")
    assert pdf_pages(raw) == [(1, "first (one) spaced out"), (2, ""), (3, "third")]


def test_objects_in_streams_and_maps_of_fonts():
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <1EC7> <0002> <00480069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079007A>] endbfrange"
    d, data = packed([(1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, "<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 4 0 R /F2 7 0 R >> /XObject << /X 8 0 R >> >> >>"), (3, "<< /Type /Page /Contents 5 0 R >>"), (4, "<< /Type /Font /ToUnicode 6 0 R >>"), (7, "<< /Type /Font >>")])
    content = b"BT /F1 12 Tf <000100020010> Tj [<00110012> 0 <00200021>] TJ /F2 9 Tf (caf\\351) ' /X Do BI /W 1 ID \xff(\x00 EI (end) Tj ET"
    raw = pdf([(10, d, data), (5, "/Filter [/FlateDecode]", zlib.compress(content)), (6, "", cmap), (8, "/Subtype /Form /Resources << >>", b"(in a form) Tj"), (11, "/Type /XRef /Root 1 0 R /Filter /FlateDecode", zlib.compress(b"\0"))])
    assert pdf_pages(raw) == [(1, "ệHia bcxyz café in a form end")]


def test_a_later_object_of_a_number_counts():
    first = [(1, "<< /Type /Catalog /Pages 2 0 R >>", None), (2, "<< /Kids [3 0 R] >>", None), (3, "<< /Type /Page /Contents 4 0 R >>", None), (4, "", b"(old) Tj")]
    raw = pdf(first, "trailer << /Root 1 0 R >>\n") + pdf([(4, "", b"(new) Tj")], "trailer << /Root 1 0 R /Prev 1 >>", b"")
    assert pdf_pages(raw) == [(1, "new")]


@pytest.mark.parametrize("raw", [b"", b"no pdf", b"%PDF-1.4 nothing", pdf([(1, "<< /Type /Catalog >>", None)]), pdf([(1, "<< /Type /Catalog /Pages 2 0 R >>", None), (2, "<< /Kids [] >>", None)]), pdf([], "trailer << /Encrypt 3 0 R >>")])
def test_what_is_no_readable_file_raises(raw):
    with pytest.raises(ValueError):
        pdf_pages(raw)


TEXT = "This is a sentence of the story, with a comma, and it goes on for a while so that it counts. "
NAV = "<div><ul>" + "".join(f"<li><a href='/{k}'>Section number {k}</a></li>" for k in range(12)) + "</ul></div>"


def content(page):
    return " ".join(files.main_content(page))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='x'>{}</div>", "<div><div>{}</div></div>", "<main><section>{}</section></main>", "<table><tr><td>{}</td></tr></table>"])
def test_the_main_content_needs_no_article(wrap):
    story = "".join(f"<p>{TEXT * 2}part {k}</p>" for k in range(6))
    page = f"<body>{NAV}<div><p>Subscribe now</p></div>{wrap.format(story)}<div><p>Copyright, all rights</p><a href='/x'>more</a></div></body>"
    got = content(page)
    assert all(f"part {k}" in got for k in range(6)) and "Section number" not in got and "Subscribe" not in got and "Copyright" not in got


def test_parts_of_one_story_stay_together():
    parts = "".join(f"<section><h2>Head {k}</h2><p>{TEXT * 3}part {k}</p><p>{TEXT}</p></section>" for k in range(4))
    comments = "<article>" + "".join(f"<div><p>Nice {k}</p></div>" for k in range(5)) + "</article>"
    got = content(f"<body>{NAV}<article><h1>Title</h1>{parts}{comments}</article></body>")
    assert all(f"part {k}" in got and f"Head {k}" in got for k in range(4)) and "Title" in got


def test_broken_pages_end():
    assert files.main_content("") == [""] and files.main_content("<div><p>a") == ["<div><p>a"]
    page = "<div>" * 3000 + f"<p>{TEXT * 3}" + "</b></i></section>" * 3000
    assert TEXT.strip() in content(page)
    assert TEXT.strip() in content(f"<nav><p>{NAV}<div><p>{TEXT}</nav></nav><div><p>{TEXT * 3}</p></div>")
