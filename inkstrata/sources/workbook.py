"""Spreadsheet workbooks as word tables, parsed with the standard library on the executors."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Namespaces of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
FIELDS = ["level", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text", "font_size"]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def parse_workbook(data: bytes):
    """Yield (sheet name, rows); a row is a list of (value, font size)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{MAIN}t")))
        sizes: list[float | None] = []
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            fonts = [f.find(f"{MAIN}sz") for f in root.iterfind(f"{MAIN}fonts/{MAIN}font")]
            fonts = [float(f.get("val")) if f is not None else None for f in fonts]
            for xf in root.iterfind(f"{MAIN}cellXfs/{MAIN}xf"):
                at = int(xf.get("fontId", 0))
                sizes.append(fonts[at] if at < len(fonts) else None)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(f"{REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{MAIN}row"):
                cells: list[tuple] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [(None, None)] * (at - len(cells))
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    value = None if v is None else v.text
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    style = int(c.get("s", 0))
                    cells.append((value, sizes[style] if style < len(sizes) else None))
                rows.append(cells)
            yield sheet.get("name"), rows


def read_workbooks(spark: SparkSession, path: str, *, skip_first_sheet: bool = False, skip_sheet: str = "p00", second_half: bool = False) -> DataFrame:
    """One row for each sheet row under the header: doc_id, page, row_no, the word columns as
    text, font_size of the first filled cell. ``second_half`` keeps the rows from the middle of each sheet on.
    A file that cannot be parsed gives one row with ``error`` set."""
    columns = ["doc_id", "page", "row_no", *FIELDS, "error"]

    def run(frames):
        for f in frames:
            for file, data in zip(f["path"], f["content"], strict=True):
                doc, out = file.rsplit("/", 1)[-1].rsplit(".", 1)[0], []
                try:
                    for n, (page, rows) in enumerate(parse_workbook(data)):
                        if page == skip_sheet or (skip_first_sheet and n == 0) or not rows:
                            continue
                        head = [str(v).strip().lower() if v is not None else "" for v, _ in rows[0]]
                        for i, row in enumerate(rows[1:], 1):
                            if second_half and i < (len(rows) // 2):
                                continue
                            r = dict.fromkeys(columns)
                            r |= {h: v for h, (v, _) in zip(head, row, strict=False) if h in FIELDS}
                            if "text" not in head:
                                r["text"] = next((v for v, _ in row if v), None)
                            r["font_size"] = next((s for v, s in row if v is not None and s is not None), None)
                            out.append(r | {"doc_id": doc, "page": page, "row_no": i})
                except Exception as e:  # a damaged file is a row, not a failed job
                    out = [dict.fromkeys(columns) | {"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(out, columns=columns)

    schema = "doc_id string, page string, row_no bigint, " + ", ".join(f"{c} {'double' if c == 'font_size' else 'string'}" for c in FIELDS) + ", error string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, schema)
