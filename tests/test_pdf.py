"""PDF files written by hand: their lines, paragraphs, pages without text, and files that cannot be read."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from corpusloom.sources import pdf, readers
from corpusloom.sources.extract import ExtractionError

PLAIN = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /ccedilla /fi /uni20AC] >> >>"
WIDE = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [<< /Subtype /CIDFontType2 /DW 600 /W [3 [250 500] 10 12 700] >>] /ToUnicode 6 0 R >>"
MAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0004> <00E7> endbfchar 2 beginbfrange <000A> <000C> <0041> <0020> <0021> [<00660066> <D83DDE00>] endbfrange"


def stream(data: bytes, head: bytes = b"", flate: bool = True) -> bytes:
    body = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if flate else b"", head, body)


def made(pages: list[bytes], extra: bytes = b"", packed: bool = False, flate: bool = True) -> bytes:
    numbers = range(10, 10 + 2 * len(pages), 2)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [3 0 R] >>" % len(pages), 4: PLAIN, 5: WIDE}
    objects[3] = b"<< /Type /Pages /Resources << /Font << /F1 4 0 R /F2 5 0 R >> /XObject << /X 7 0 R >> >> /Kids [" + b" ".join(b"%d 0 R" % n for n in numbers) + b"] >>"
    streams = {6: stream(MAP), 7: stream(b"BT /F1 10 Tf 0 0 Td (na forma) Tj ET", b"/Subtype /Form /Matrix [1 0 0 1 50 100]")}
    for n, page in zip(numbers, pages):
        objects[n] = b"<< /Type /Page /Contents [%d 0 R] >>" % (n + 1)
        streams[n + 1] = stream(page, flate=flate)
    if packed:
        bodies, at, places = list(objects.items()), 0, []
        for n, body in bodies:
            places.append(b"%d %d" % (n, at))
            at += len(body) + 1
        head = b" ".join(places) + b" "
        streams[900] = stream(head + b"\n".join(b for _, b in bodies), b"/Type /ObjStm /N %d /First %d" % (len(bodies), len(head)))
        objects = {}
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in [*objects.items(), *streams.items()])
    return out + b"trailer << /Root 1 0 R " + extra + b" >>\n%%EOF"


def page(*rows: str, left: int = 50, top: int = 700) -> bytes:
    shown = b"".join(b"(%s) Tj T* " % r.encode("cp1252").replace(b"(", rb"\(").replace(b")", rb"\)") for r in rows)
    return b"BT /F1 10 Tf 12 TL %d %d Td " % (left, top) + shown + b"ET"


@pytest.mark.parametrize("packed", [False, True])
def test_operators_and_encodings(packed):
    shown = rb"""BT /F1 10 Tf 1 0 0 1 50 700 Tm [(Ca) -20 (f\001) -600 (\(a\)o)] TJ 0 -20 TD (linha \
dois) Tj T* <0203> Tj ET q 2 0 0 2 0 0 cm BT /F2 5 Tf 25 300 Td <000A000B000C000300040020 0021> Tj ET Q /X Do
BT /F1 10 Tf 50 50 Td (um) Tj 200 0 Td (longe) Tj (junto) ' ET % comment (x) Tj
BI /W 1 ID xx EI BT Tj Td ET"""
    found = pdf.lines(made([shown, b""], packed=packed))
    assert [t for *_, t in found[0]] == ["Café (a)o", "linha dois", "çfi", "ABC çff😀", "na forma", "um longe", "junto"]
    assert found[1] == []
    top, left, height, _ = found[0][3]
    assert (top, left, height) == (610, 50, 10)
    assert found[0][4][:2] == (110, 50)


def test_later_objects_stand_and_bad_files_say_why():
    file = made([page("antes")])
    assert pdf.lines(file + b"\n11 0 obj\n" + stream(page("depois"), flate=False) + b"\nendobj\n")[0][0][3] == "depois"
    with pytest.raises(ExtractionError) as e:
        pdf.lines(made([page("x")], b"/Encrypt 9 0 R"))
    assert e.value.code == "protected"
    for bad in (b"%PDF-1.4 nothing", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R >>"):
        with pytest.raises(ExtractionError) as e:
            pdf.lines(bad)
        assert e.value.code == "corrupt"
    looped = made([page("um")]).replace(b"/Kids [10 0 R]", b"/Kids [2 0 R 3 0 R 10 0 R]")
    assert [[t for *_, t in p] for p in pdf.lines(looped)] == [["um"]]


def test_pages_are_rows_of_the_layout_operator(spark):
    prose = ["Primeira linha do parágrafo com texto bastante longo para contar", "segunda linha do mesmo parágrafo", "terceira linha do mesmo"]
    spaced = page(*prose) + page("Outro parágrafo começa depois de um espaço grande na página", "e continua aqui", top=640)
    columns = page(*prose) + page("Nova coluna à direita", left=320, top=700)
    files = {
        "six": made([page(*prose)] * 6),
        "three": made([b"", b"q Q", page("7")]),
        "nine": made([page(*prose)] * 3 + [b""] * 3 + [page(*prose)] * 3, packed=True),
        "spaced": made([spaced, columns]),
        "locked": made([page("x")], b"/Encrypt 9 0 R"),
        "broken": b"%PDF-1.4 nothing",
        "false": b"no pdf",
    }
    rows = [(k, "pdf", hashlib.md5(v).hexdigest(), bytearray(v)) for k, v in files.items()] + [("again", "pdf", hashlib.md5(files["six"]).hexdigest(), bytearray(files["six"])), ("t", "txt", "t", bytearray(b"texto"))]
    df = spark.createDataFrame(rows, "name string, ext string, md5 string, content binary")
    found = {r.name: r for r in readers.extract_all(df).collect()}
    assert len(found) == len(rows)
    assert {k: (r.pages_total, r.pages_without_text) for k, r in found.items()} == {
        "six": (6, 0), "again": (6, 0), "three": (3, 3), "nine": (9, 3), "spaced": (2, 0), "locked": (None, None), "broken": (None, None), "false": (None, None), "t": (None, None)
    }
    assert {k: r.error for k, r in found.items() if r.error} == {"locked": "protected", "broken": "corrupt", "false": "corrupt"}
    assert found["t"].text == "texto" and found["three"].text == "7"
    one = "\n".join(prose)
    assert found["six"].text == "\n\n".join([one] * 6) == found["again"].text
    assert found["spaced"].text == one + "\n\nOutro parágrafo começa depois de um espaço grande na página\ne continua aqui\n\n" + one + "\n\nNova coluna à direita"
    ocr = spark.createDataFrame([(found["nine"].md5, 5, "Texto reconhecido na imagem da página cinco, com letras bastantes")], "md5 string, page int, text string")
    nine = readers.extract_all(df.where("name = 'nine'"), ocr).first()
    assert nine.pages_without_text == 2 and nine.text == "\n\n".join([one] * 3 + ["Texto reconhecido na imagem da página cinco, com letras bastantes"] + [one] * 3)
    assert readers.extract_all(df.where("false")).count() == 0
