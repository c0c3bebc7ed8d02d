"""Writers: text, JSON lines by view, CSV, EPUB, write-once text."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import map_rows


def write_views(df: DataFrame, path: str, view: str = "view_name") -> None:
    """JSON lines, one folder per view; replaces what is there."""
    df.write.mode("overwrite").partitionBy(view).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def book_text(title: str, author: str | None, chapters: list[tuple[str, list[str]]]) -> str:
    """A book as plain text: title, author, then headings and paragraphs."""
    out = [title, *([f"作者：{author}"] if author else []), ""]
    for heading, paragraphs in chapters:
        out += [heading, "", *paragraphs, ""]
    return "\n".join(out).rstrip() + "\n"


def book_epub(identifier: str, title: str, author: str | None, language: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """A valid EPUB 3 with one document per chapter and a navigation document; equal input gives equal bytes."""
    e = html.escape
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{e(head)}</title></head><body>{body}</body></html>'
    files = {"META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'}
    manifest, spine, nav = [], [], []
    for k, (heading, paragraphs) in enumerate(chapters):
        files[f"OEBPS/c{k:04d}.xhtml"] = page(heading, f"<h1>{e(heading)}</h1>" + "".join(f"<p>{e(p)}</p>" for p in paragraphs))
        manifest.append(f'<item id="c{k:04d}" href="c{k:04d}.xhtml" media-type="application/xhtml+xml"/>')
        spine.append(f'<itemref idref="c{k:04d}"/>')
        nav.append(f'<li><a href="c{k:04d}.xhtml">{e(heading)}</a></li>')
    files["OEBPS/nav.xhtml"] = page(title, f'<nav epub:type="toc"><ol>{"".join(nav)}</ol></nav>')
    files["OEBPS/book.opf"] = (
        f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{e(identifier)}</dc:identifier>'
        f'<dc:title>{e(title)}</dc:title><dc:language>{e(language)}</dc:language>{f"<dc:creator>{e(author)}</dc:creator>" if author else ""}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{"".join(manifest)}</manifest><spine>{"".join(spine)}</spine></package>'
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name], zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def _epubs(cols: dict[str, list]) -> Iterator[tuple]:
    for b, title, author, lang, chapters in zip(cols["book"], cols["title"], cols["author"], cols["lang"], cols["chapters"]):
        parts = [(c["title"] or "", [p for p in c["paragraphs"] or [] if p]) for c in chapters]
        yield b, book_epub(b, title or b, author, lang or "und", parts), book_text(title or b, author, parts)


def books_as_files(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """(book, epub, text) of every book: its chapters, ordered by id, as an EPUB and as plain text."""
    ch = chapters.where("book_id is not null").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_id", "title", "paragraphs"))).alias("chapters"))
    base = ch.join(books.select("book_id", F.col("identifier").alias("book"), "title", F.col("creator").alias("author"), "lang"), "book_id").select("book", "title", "author", "lang", "chapters")
    return map_rows(base, _epubs, "book string, epub binary, text string", 20)


def write_once(path: str, content: str) -> str:
    """Write a local artifact, or accept it if it is there with the same content; a different one is a ValueError. Returns its sha256."""
    import hashlib
    import os

    data = content.encode()
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() != data:
                raise ValueError(f"{path} holds something else")
    else:
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
    return hashlib.sha256(data).hexdigest()


def bar_chart(title: str, rows: list[tuple[str, float]], width: int = 640) -> str:
    """A bar chart as SVG; values from 0 on."""
    e = html.escape
    top = max((v for _, v in rows), default=0) or 1
    bars = "".join(f'<text x="0" y="{44 + 24 * k}" font-size="13">{e(label)}</text><rect x="200" y="{32 + 24 * k}" width="{max(0.0, v / top) * (width - 280):.1f}" height="16" fill="#4477aa"/><text x="{206 + max(0.0, v / top) * (width - 280):.1f}" y="{44 + 24 * k}" font-size="12">{v:.3g}</text>' for k, (label, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{44 + 24 * len(rows)}"><text x="0" y="18" font-size="16">{e(title)}</text>{bars}</svg>'


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows as a Markdown table; bars and line ends in cells are escaped."""
    cell = lambda v: ("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
