"""Write a table as export workbooks (XLSX), in tasks: a file per batch of rows.

The counterpart of the workbook reader in ``exports``, for handing tables to
people and for round-trip tests. Text becomes inline strings, numbers numeric
cells, nulls no cell. Names are unique to the task attempt; the returned
manifest, a written table, names the files of the attempts that counted.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from adlens.session import ship_package, staged_table

# --- Fixed values: the parts every workbook needs -------------------------------
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                           '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           '<Override PartName="/xl/workbook.xml" ContentType='
                           '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                           '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
                           '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
                   'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
                   'Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r='
                       '"http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                       '<sheet name="Export" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                  '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                                  'relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
# --- end of fixed values ----------------------------------------------------------


def column_name(i: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    name = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(ref: str, value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def workbook(header: list[str], rows: Iterator[tuple], styled_blanks: int = 0) -> bytes:
    """The bytes of a one-sheet workbook, with ``styled_blanks`` empty but formatted cells right of each row."""
    names = [column_name(i) for i in range(len(header) + styled_blanks)]
    body = []
    for n, row in enumerate([tuple(header), *rows], 1):
        cells = "".join(_cell(f"{c}{n}", v) for c, v in zip(names, row))
        body.append(f'<row r="{n}">{cells}' + "".join(f'<c r="{c}{n}" s="0"/>' for c in names[len(header):]) + "</row>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _PARTS.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        z.writestr("xl/worksheets/sheet1.xml", '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns='
                   '"http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(body)
                   + "</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, styled_blanks: int = 0) -> DataFrame:
    """Write ``df`` into ``folder``; returns the manifest (path, rows)."""
    from pyarrow import fs
    ship_package(df.sparkSession)
    files, base = fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            if len(pdf):
                name = f"export-{uuid.uuid4().hex}.xlsx"
                rows = pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)
                with files.open_output_stream(f"{base}/{name}") as f:
                    f.write(workbook(list(pdf.columns), rows, styled_blanks))
                yield pd.DataFrame([(f"{folder}/{name}", len(pdf))], columns=["path", "rows"])

    return staged_table(df.mapInPandas(run, "path string, rows long"), "workbooks")
