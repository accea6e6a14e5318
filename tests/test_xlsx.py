"""Workbooks are parsed as streams."""

import io
import subprocess
import sys
import zipfile

import pytest

from adlens.schema import REQUIRED_COLUMNS
from adlens.sources import exports, read_exports
from adlens.sources.workbooks import workbook
from adlens.sources.xlsx import SharedStrings, sheet_rows


def test_rows_then_the_widened_header():
    data = workbook(["a", "b", None], iter([("x", 1.5), (None, "y & <z>"), (), ("only",), (1, 2.0, "far")]), styled_blanks=2)
    got = dict(sheet_rows(io.BytesIO(data)))
    assert got == {0: ["a", "b", None], 1: ["x", "1.5"], 2: [None, "y & <z>"], 3: [], 4: ["only"], 5: ["1", "2", "far"]}
    assert [n for n, _ in sheet_rows(io.BytesIO(data))][-1] == 0


def test_shared_strings_and_dates():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook(["x"], iter(())))) as old, zipfile.ZipFile(out, "w") as z:
        for name in old.namelist():
            if "sheet1" not in name:
                z.writestr(name, old.read(name))
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>né</t></si><si><r><t>a</t></r><r><t>b</t></r></si><si><t/></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yy"/></numFmts>'
                                    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'
                   '<row><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c t="b"><v>1</v></c><c t="s"><v>2</v></c></row>'
                   "</sheetData></worksheet>")
    assert dict(sheet_rows(out)) == {0: ["né", "ab", None, None], 1: ["2024-01-01", "2024-01-01 12:00:00", "True", ""]}
    with pytest.raises(IndexError):
        SharedStrings(None)[0]


def test_memory_does_not_grow_with_the_sheet(workdir):
    program = f"""
import resource, sys, zipfile
from adlens.sources import workbooks, xlsx
def book(path, rows):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in workbooks._PARTS.items():
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for i in range(rows):
                f.write(("<row>" + f'<c t="inlineStr"><is><t>text of row {{i}}</t></is></c><c><v>{{i}}</v></c>' * 4 + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for rows in (2000, 80000):
    book("{workdir}/b.xlsx", rows)
    n = sum(1 for _ in xlsx.sheet_rows(open("{workdir}/b.xlsx", "rb")))
    assert n == rows, n
    print(peak())
"""
    done = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True)
    small, large = map(int, done.stdout.split())
    assert large - small < 8 << 10  # KB; the sheet's XML is 45 MB


def test_large_workbooks_are_read_in_place(spark, workdir, monkeypatch):
    monkeypatch.setattr(exports, "XLSX_IN_PLACE", 2000)
    for n in range(3):
        with open(f"{workdir}/{n} [x].xlsx", "wb") as f:
            f.write(workbook(REQUIRED_COLUMNS, iter([("2024-01-01", "2024-01-02", f"ad {i}") for i in range(50 * n + 1)])))
    open(f"{workdir}/broken.xlsx", "wb").write(b"PK" + b"x" * 5000)
    load = read_exports(spark, [workdir])
    assert {r.source_file: r.status for r in load.report.collect()} == {
        "0 [x].xlsx": "ok", "1 [x].xlsx": "ok", "2 [x].xlsx": "ok", "broken.xlsx": "unreadable"}
    counts = {r.source_file: r["count"] for r in load.table.groupBy("source_file").count().collect()}
    assert counts == {"0 [x].xlsx": 1, "1 [x].xlsx": 51, "2 [x].xlsx": 101}
