"""Document parsers as pluggable providers.

A provider turns a file's bytes into blocks.  ``text`` is built in; ``pdf`` uses
PyMuPDF and ``pdf_layout`` pdfminer where they are installed.  Parsing runs in
the tasks that read the files; a file that both providers fail on is a row with
its error, and the job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.language import preprocessed
from foliant.sources.documents import clean_field, pdf_date, title_or_name

Block = tuple  # page_number, text, x, y, width, height, font_name, font_size, font_flags
Provider = Callable[[bytes], list[Block]]

PARSED_SCHEMA = (
    "path string, status string, parser_used string, block_no int, page_number int, text string, x double, y double, width double, "
    "height double, font_name string, font_size double, font_flags int"
)


def parse_text(content: bytes) -> list[Block]:
    """Pages are separated by form feeds, blocks by line breaks."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    rows = []
    for page, body in enumerate(text.split("\f"), 1):
        for n, line in enumerate(body.split("\n")):
            if line.strip():
                rows.append((page, line.strip(), 72.0, 72.0 + 24.0 * n, min(6.0 * len(line.strip()), 468.0), 12.0, "Text", 11.0, 0))
    return rows


def parse_pdf(content: bytes) -> list[Block]:
    import fitz

    rows = []
    with fitz.open(stream=content, filetype="pdf") as document:
        if document.needs_pass or not document.page_count:
            raise ValueError("encrypted or empty document")
        for number, page in enumerate(document, 1):
            spans = (s for b in page.get_text("dict")["blocks"] for line in b.get("lines", ()) for s in line["spans"])
            for s in spans:
                if s["text"].strip():
                    x0, y0, x1, y1 = s["bbox"]
                    rows.append((number, s["text"].strip(), x0, y0, x1 - x0, y1 - y0, s["font"], float(s["size"]), int(s["flags"])))
    return rows


#: Layout parameters of the second PDF parser.
LAYOUT = {"char_margin": 2.0, "line_margin": 0.5, "word_margin": 0.1, "boxes_flow": 0.5}


def font_flags(name: str) -> int:
    """Flags from a font's name: 16 for bold, 64 for italic or oblique."""
    low = name.lower()
    return (16 if "bold" in low else 0) | (64 if "italic" in low or "oblique" in low else 0)


def character_runs(characters: list[tuple[str, str, float, float, float, float]], tolerance: float = 0.5) -> list[tuple]:
    """A line's characters (text, font, x, y, width, height) as runs of one font and height: (text, x, y, width, height, font, size, flags)."""
    runs: list[list] = []
    for c in characters:
        if runs and runs[-1][-1][1] == c[1] and abs(runs[-1][-1][5] - c[5]) < tolerance:
            runs[-1].append(c)
        else:
            runs.append([c])
    found = []
    for run in runs:
        text = "".join(c[0] for c in run).strip()
        if text:
            left, top = min(c[2] for c in run), min(c[3] for c in run)
            right, bottom = max(c[2] + c[4] for c in run), max(c[3] + c[5] for c in run)
            found.append((text, left, top, right - left, bottom - top, run[0][1], run[0][5], font_flags(run[0][1])))
    return found


def parse_pdf_layout(content: bytes) -> list[Block]:
    from io import BytesIO

    from pdfminer.high_level import extract_pages
    from pdfminer.layout import LAParams, LTAnno, LTChar, LTTextContainer, LTTextLine

    rows = []
    for number, page in enumerate(extract_pages(BytesIO(content), laparams=LAParams(**LAYOUT)), 1):
        for box in page:
            for line in box if isinstance(box, LTTextContainer) else ():
                if not isinstance(line, LTTextLine):
                    continue
                characters, last = [], None
                for c in line:
                    if isinstance(c, LTChar):
                        last = (c.get_text(), c.fontname, c.x0, page.height - c.y1, c.width, c.size)
                        characters.append(last)
                    elif isinstance(c, LTAnno) and last:  # a space between two characters
                        characters.append((c.get_text().replace("\n", " "), last[1], last[2] + last[4], last[3], 0.0, last[5]))
                rows += [(number, *run) for run in character_runs(characters)]
    return rows


#: Names of languages in the recogniser, by code.
OCR_LANGUAGES = {
    "en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "ru": "rus", "ja": "jpn", "zh": "chi_sim",
    "ko": "kor", "ar": "ara", "he": "heb", "fa": "fas", "hi": "hin", "th": "tha", "vi": "vie", "tr": "tur", "pl": "pol", "sv": "swe",
    "no": "nor", "da": "dan",
}
OCR_MODE = "--oem 3 --psm 6"

Recogniser = Callable[[bytes, str], str]


def recognised(content: bytes, language: str) -> str:
    """Text of an image: grey, twice the size, median of 3, equalised, read by the recogniser."""
    from io import BytesIO

    import pytesseract
    from PIL import Image, ImageFilter, ImageOps

    grey = ImageOps.grayscale(Image.open(BytesIO(content)))
    large = grey.resize((grey.width * 2, grey.height * 2), Image.Resampling.BICUBIC)
    ready = ImageOps.equalize(large.filter(ImageFilter.MedianFilter(3)))
    return pytesseract.image_to_string(ready, lang=OCR_LANGUAGES.get(language, "eng"), config=OCR_MODE)


def recognised_images(images: DataFrame, language: str = "en", recogniser: Recogniser = recognised) -> DataFrame:
    """(path, status, text) of images (path, content); the text is preprocessed as its language asks, an image that fails says why."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, "ok", recogniser(bytes(content), language)))
                except Exception as error:  # quarantined: the row says why
                    rows.append((path, f"{type(error).__name__}: {error}", None))
            yield pd.DataFrame(rows, columns=["path", "status", "text"])

    found = images.select("path", "content").mapInPandas(read, "path string, status string, text string")
    return found.withColumn("text", preprocessed(F.col("text"), F.lit(language)))


PROVIDERS: dict[str, Provider] = {"text": parse_text, "pdf": parse_pdf, "pdf_layout": parse_pdf_layout}


def parsed_files(files: DataFrame, primary: str = "pdf", fallback: str | None = "pdf_layout") -> DataFrame:
    """Blocks of files (path, content); a file without blocks is one row with its status."""
    chain = [(name, PROVIDERS[name]) for name in (primary, fallback) if name]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED_SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                status, rows = "no provider", []
                for name, provider in chain:
                    try:
                        rows = [(path, "ok", name, n, *block) for n, block in enumerate(provider(bytes(content)))]
                        status = "ok"
                        break
                    except Exception as error:  # quarantined: the row says why
                        status = f"{name}: {type(error).__name__}: {error}"
                yield pd.DataFrame(rows or [(path, status, None, *[None] * 10)], columns=names)

    return files.select("path", "content").mapInPandas(parse, PARSED_SCHEMA)


MetadataReader = Callable[[bytes], dict[str, str | None]]
METADATA_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "modification_date")


def pdf_metadata(content: bytes) -> dict[str, str | None]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        found = document.metadata or {}
    return {name: found.get({"creation_date": "creationDate", "modification_date": "modDate"}.get(name, name)) for name in METADATA_FIELDS}


def file_metadata(files: DataFrame, reader: MetadataReader = pdf_metadata) -> DataFrame:
    """(path, status, title, author, ... dates) of files (path, content): trimmed or null, dates as YYYY-MM-DD, a title from the name where there is none."""
    schema = ", ".join(["path string", "status string", *(f"{name} string" for name in METADATA_FIELDS)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found, status = reader(bytes(content)), "ok"
                except Exception as error:  # quarantined: the row says why
                    found, status = {}, f"{type(error).__name__}: {error}"
                rows.append((path, status, *(found.get(name) for name in METADATA_FIELDS)))
            yield pd.DataFrame(rows, columns=["path", "status", *METADATA_FIELDS])

    own = files.select("path", "content").mapInPandas(read, schema)
    fields = {name: clean_field(F.col(name)) for name in METADATA_FIELDS}
    fields |= {name: pdf_date(clean_field(F.col(name))) for name in ("creation_date", "modification_date")}
    fields["title"] = title_or_name(F.col("title"), F.element_at(F.split("path", "/"), -1))
    return own.withColumns(fields)
