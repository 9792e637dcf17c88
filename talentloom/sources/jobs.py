"""Job-text sources: plain text tables and folders of .docx files.

Both give one row per job: ``jd_id``, ``paragraphs`` (array of text, is_heading,
is_bullet), ``sections`` (array of name, text, in first-seen order), ``raw_text``
and the paragraph counts. A job text is one row, so the section split is array
work inside the row and needs no shuffle.
"""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom import settings as S
from talentloom.functions import scalars as fx

_MAX_CAPS_HEADING = 100


def _is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def _paragraph(text: Column, styled: Column) -> Column:
    heading = (styled | (_is_upper(text) & (F.length(text) < _MAX_CAPS_HEADING))) & (F.length(text) > 2)
    bullet = F.lit(False)
    for mark in S.BULLET_MARKS:
        bullet = bullet | text.startswith(mark)
    return F.struct(text.alias("text"), heading.alias("is_heading"), (~heading & bullet).alias("is_bullet"))


def _sections(paragraphs: Column) -> Column:
    """Cut the paragraphs at the headings; a repeated name keeps its last non-empty run."""
    count = F.size(paragraphs)
    positions = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    heads = F.filter(positions, lambda i: F.get(paragraphs, i - 1)["is_heading"])
    starts = F.concat(F.array(F.lit(0)), heads)
    ends = F.concat(heads, F.array(count + 1))

    def run(start: Column, end: Column) -> Column:
        title = F.get(paragraphs, start - 1)["text"]
        name = F.trim(F.regexp_replace(title, r"^[:#]+|[:#]+$", ""))
        body = F.slice(paragraphs, start + 1, end - start - 1)
        return F.struct(
            F.when(start == 0, F.lit(S.DEFAULT_SECTION)).otherwise(name).alias("name"),
            F.array_join(F.transform(body, lambda p: p["text"]), "\n").alias("text"),
        )

    runs = F.filter(F.zip_with(starts, ends, run), lambda r: r["text"] != "")
    def last_of_each(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda r: r["name"]))
        return F.transform(names, lambda n: F.try_element_at(
            F.filter(found, lambda r: r["name"] == n), F.lit(-1)))

    return fx.let(runs, last_of_each)


@fx.build_once
def _paragraph_column() -> Column:
    squeezed = F.transform("lines", lambda p: F.struct(
        fx.squeeze_spaces(p["text"]).alias("text"), p["styled"].alias("styled")))
    kept = F.filter(squeezed, lambda p: p["text"] != "")
    return F.transform(kept, lambda p: _paragraph(p["text"], p["styled"])).alias("paragraphs")


@fx.build_once
def _section_columns() -> list[Column]:
    return [_sections(F.col("paragraphs")).alias("sections"),
            F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n").alias("raw_text")]


def structure_jobs(lines: DataFrame) -> DataFrame:
    """From (jd_id, lines: array of text, styled) with folded text to structured job rows."""
    split = lines.select("jd_id", _paragraph_column()).select("*", *_section_columns())
    return split.select(
        "*",
        F.size("sections").alias("num_sections"),
        F.size("paragraphs").alias("num_paragraphs"),
        F.length("raw_text").alias("total_chars"),
    )


def jobs_from_text(texts: DataFrame, id_col: str = "jd_id", text_col: str = "text") -> DataFrame:
    """Structure a table of plain job texts; every line is a paragraph."""
    folded = fx.fold_unicode(F.coalesce(F.col(text_col), F.lit("")))
    lines = F.transform(F.split(folded, "\r?\n"), lambda t: F.struct(
        t.alias("text"), F.lit(False).alias("styled")))
    return structure_jobs(texts.select(F.col(id_col).alias("jd_id"), lines.alias("lines")))


def job_paragraphs(jobs: DataFrame) -> DataFrame:
    """One row per paragraph with its position (1 = first)."""
    return fx.element_rows(jobs, "paragraphs", "jd_id").select("jd_id", "pos", "element.*")


def job_sections(jobs: DataFrame) -> DataFrame:
    """One row per section with its position (1 = first)."""
    return fx.element_rows(jobs, "sections", "jd_id").select(
        "jd_id", "pos", F.col("element.name").alias("section"), F.col("element.text").alias("text"))


# -- .docx ---------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OFF = {"0", "false", "off", "none"}


def _heading_styles(archive: zipfile.ZipFile) -> set[str]:
    if "word/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("word/styles.xml"))
    found = set()
    for style in root.iter(f"{_W}style"):
        name = style.find(f"{_W}name")
        label = "" if name is None else name.get(f"{_W}val", "")
        if "Heading" in label or label.startswith("heading "):
            found.add(style.get(f"{_W}styleId", ""))
    return found


def _run_text(run: ElementTree.Element) -> str:
    parts = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
    return "".join(
        (node.text or "") if node.tag == f"{_W}t" else parts.get(node.tag, "") for node in run
    )


def _docx_lines(content: bytes) -> list[dict]:
    """Body paragraphs of one document: folded text and the bold/heading-style flag."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        headings = _heading_styles(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for para in body.findall(f"{_W}p"):
        style = para.find(f"{_W}pPr/{_W}pStyle")
        runs = para.findall(f"{_W}r")
        bold = runs[0].find(f"{_W}rPr/{_W}b") if runs else None
        text = "".join(_run_text(r) for r in runs)  # direct runs: no text boxes, no tracked insertions
        styled = (style is not None and style.get(f"{_W}val") in headings) or (
            bold is not None and bold.get(f"{_W}val", "true").lower() not in _OFF)
        lines.append({"text": unicodedata.normalize("NFKD", text), "styled": bool(styled)})
    return lines


def _docx_row(content: bytes) -> tuple[list[dict] | None, str | None]:
    try:
        return _docx_lines(content), None
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, ValueError) as error:
        return None, f"{type(error).__name__}: {error}"


def _docx_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_docx_row(c) for c in batch["content"]]
        yield pd.DataFrame({"jd_id": batch["path"], "lines": [r[0] for r in rows], "error": [r[1] for r in rows]})


def scan_docx(spark: SparkSession, path: str) -> DataFrame:
    """(jd_id, lines, error) of every .docx below a folder; an unreadable file is a row with its error.

    Word's lock files (``~$name.docx``) are not taken.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "[!~]*.docx")
             .option("recursiveFileLookup", True).load(path).select("path", "content"))
    return files.mapInPandas(
        _docx_batches, "jd_id string, lines array<struct<text:string,styled:boolean>>, error string")


def jobs_from_docx(spark: SparkSession, path: str) -> DataFrame:
    """Structure every readable .docx below a folder; jd_id is the file path."""
    return structure_jobs(scan_docx(spark, path).where("error IS NULL").drop("error"))


def docx_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Path and error of the files that jobs_from_docx leaves out."""
    return scan_docx(spark, path).where("error IS NOT NULL").select("jd_id", "error")
