from __future__ import annotations

import io
import zipfile

import books
import pytest

from corpusloom.sources import extract as ex
from corpusloom.sources import formats, readers


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def html_book(seed: int) -> str:
    parts = "".join(f"<h2>{t}</h2><h3>Ingredientes</h3><ul>{''.join(f'<li>{g}</li>' for g in goods)}</ul><p>{m}</p>" for t, goods, m in books.recipes(seed))
    return f"<html><head><title>x</title><script>var a='<p>no</p>';</script></head><body><nav><a>menu</a></nav>{parts}<table><tr><td>a</td><td>b</td></tr></table><footer>pe</footer></body></html>"


def files() -> dict[str, bytes]:
    text = books.recipe_text(4)
    docx_body = f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>SAL</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>2 g</w:t></w:r></w:p></w:tc></w:tr></w:tbl>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n\n"))
    odt = '<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:text><text:h>TITULO</text:h><text:p>um<text:s text:c="2"/>dois</text:p></office:text></office:body></office:document-content>'
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.html"/><item id="b" href="b.html"/><item id="c" href="gone.html"/></manifest><spine><itemref idref="b"/><itemref idref="c"/><itemref idref="a"/></spine></package>'
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'
    epub = {"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/c.opf": opf, "OEBPS/a.html": "<p>depois</p>", "OEBPS/b.html": "<h1>PRIMEIRO</h1>"}
    locked = {**epub, "META-INF/encryption.xml": '<e xmlns:x="http://www.w3.org/2001/04/xmlenc#"><x:EncryptionMethod Algorithm="http://www.w3.org/2001/04/xmlenc#aes128-cbc"/></e>'}
    return {
        "receitas.txt": text.encode("latin-1"), "receitas.md": text.encode(), "receitas.html": html_book(7).encode(), "receitas.htm": html_book(7).encode(),
        "receitas.docx": zipped({"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document {W}><w:body>{docx_body}</w:body></w:document>"}), "protegido.docx": formats.OLE + b"x" * 300,
        "receitas.odt": zipped({"mimetype": formats.CONTAINER_TYPES["odt"], "content.xml": odt}), "receitas.epub": zipped(epub), "drm.epub": zipped(locked),
        "receitas.rtf": rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}A\'e7\'e3o \u231?\par Fim\{\}}" + b" " * 200, "quebrado.pdf": b"%PDF-1.4" + b"x" * 300, "fingido.epub": b"PK" + b"x" * 300, ".oculto.txt": b"x" * 300, "planilha.xls": b"x" * 300,
    }


def test_texts():
    f = files()
    assert ex.extract("Açúcar e pão de ló".encode(), "txt").text == "Açúcar e pão de ló"
    assert "Modo de preparo" in ex.extract(f["receitas.txt"], "txt").text and ex.extract(f["receitas.md"], "md").text == books.recipe_text(4)
    page = ex.extract(f["receitas.html"], "html").text
    assert "menu" not in page and "var a" not in page and "pe" not in page.split("\n\n") and page.split("\n\n")[0] == books.recipes(7)[0][0] and page.endswith("a b")
    assert ex.extract(f["receitas.docx"], "docx").text.startswith("SAL 2 g\n\nEste livro")
    assert ex.extract(f["receitas.odt"], "odt").text == "TITULO\n\num  dois"
    assert ex.extract(f["receitas.epub"], "epub").text == "PRIMEIRO\n\ndepois"
    assert ex.extract(f["receitas.rtf"], "rtf").text.strip() == "Ação ç\nFim{}"


@pytest.mark.parametrize(("name", "ext", "code"), [("protegido.docx", "docx", "protected"), ("drm.epub", "epub", "protected"), ("fingido.epub", "epub", "corrupt"), ("quebrado.pdf", "pdf", "unsupported"), ("receitas.txt", "odt", "corrupt")])
def test_errors(name, ext, code):
    with pytest.raises(ex.ExtractionError) as e:
        ex.extract(files()[name], ext)
    assert e.value.code == code


def test_folder(spark, tmp_path):
    for name, content in files().items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "menor.txt").write_bytes(b"curto")
    found = readers.scan(spark, str(tmp_path))
    assert {r.name: r.ext for r in found.select("name", "ext").collect()} == {n: formats.extension_of(n) for n in [*files(), "menor.txt"] if not n.startswith(".")}
    texts = {r.name: (r.text, r.error) for r in readers.extract_text(readers.candidates(found)).collect()}
    assert "menor.txt" not in texts and texts["drm.epub"][1] == "protected" and texts["quebrado.pdf"][1] == "unsupported" and texts["receitas.md"][0].startswith("Este livro")
    cache = spark.createDataFrame([(r.md5, "guardado") for r in found.where("name = 'receitas.md'").collect()], "md5 string, text string")
    whole, new = readers.through_cache(readers.candidates(found).where("ext IN ('md', 'odt')"), cache)
    assert {r.name: r.text for r in whole.collect()} == {"receitas.md": "guardado", "receitas.odt": "TITULO\n\num  dois"}
    assert [r.text for r in new.collect()] == ["TITULO\n\num  dois"]


@pytest.mark.parametrize(("name", "ext"), [("a.PDF", "pdf"), ("x.htm", "html"), ("b.tar.gz", None), ("noext", None), (".txt", None), ("dir.d/file.md", "md")])
def test_extension(name, ext):
    assert formats.extension_of(name) == ext


def test_epub_paths_and_docx_cells():
    container = '<c xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/pkg/c.opf"/></rootfiles></c>'
    items = "".join(f'<item id="i{n}" href="{href}"/>' for n, href in enumerate(("../Text/a.html", "b%20c.html#part", "missing.html")))
    opf = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine><itemref idref="i0"/><itemref idref="i1"/><itemref idref="i2"/></spine></package>'
    epub = zipped({"mimetype": "application/epub+zip", "META-INF/container.xml": container, "OEBPS/pkg/c.opf": opf, "OEBPS/Text/a.html": "<p>first</p>", "OEBPS/pkg/b c.html": "<p>second</p>"})
    assert ex.extract(epub, "epub").text == "first\n\nsecond"
    cell = "<w:tc><w:p><w:r><w:t>2 eggs</w:t></w:r></w:p><w:p><w:r><w:t>3 cups flour</w:t></w:r></w:p></w:tc>"
    docx = zipped({"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document {W}><w:body><w:tbl><w:tr>{cell}<w:tc><w:p><w:r><w:t>mix</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    assert ex.extract(docx, "docx").text == "2 eggs\n3 cups flour mix"


def test_fold_is_one_over_the_plane(spark):
    from corpusloom.functions import text as tx

    letters = [chr(c) for c in range(0x80, 0x10000) if not 0xAC00 <= c < 0xE000]
    rows = ["x" + c + "y" for c in letters] + ["ﬁlé com ½ xícara, ＡＢＣ"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select("t", tx.fold(tx.F.col("t")).alias("f")).collect()
    differ = [hex(ord(r.t[1])) for r in got if r.f != tx.fold_py(r.t)]
    assert len(differ) < 60, differ  # letters newer than one side's Unicode tables
    assert tx.fold_py("ﬁlé com ½") == "file com 1⁄2" == got[-1].f[:12]
