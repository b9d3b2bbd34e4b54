"""Statement files to records: delimited text and workbooks written here, read as one job."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ingest, mapping
from ledgerloom.sources import workbooks

WECHAT = "交易时间,交易类型,交易对方,商品,收/支,金额(元),支付方式,当前状态,交易单号,商户单号,备注\n2026-01-01 12:00:00,商户消费,某超市,苹果与牛奶,支出,58.00,建设银行储蓄卡(1234),支付成功,order10001,merchant10001,/\n"
SPLIT = "说明\n交易日期,收入,支出,币种\n,金额,金额,\n2026-09-01,,20,CNY\n2026-09-02,￥5,,CNY\n合计,5,20,\n交易日期,收入,支出,币种\n2026-09-03,xx,,CNY\n"
BOC = "记账日期,记账时间,币别,金额,余额,交易名称,渠道,网点名称,附言,对方账户名,对方卡号/账号,对方开户行\n2026-08-01,10:20:30,人民币,-20,100,网上快捷支付,a,b,午餐,张,1,c\n"

SHEET = """<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>收支</t></is></c><c r="D1" t="inlineStr"><is><t>币种</t></is></c><c r="E1" t="inlineStr"><is><t>流水号</t></is></c></row>
<row r="3"><c r="A3" s="1"><v>46266</v></c><c r="B3"><f>1+1</f><v>2</v></c><c r="C3" t="inlineStr"><is><t>支出</t></is></c><c r="D3" t="inlineStr"><is><t>CNY</t></is></c><c r="E3"><v>12345678</v></c></row>
<row r="4"><c r="A4" s="2"><v>46266.5</v></c><c r="B4"><v>3.5</v></c><c r="C4" t="inlineStr"><is><t>收入</t></is></c><c r="D4" t="inlineStr"><is><t>CNY</t></is></c><c r="E4" t="inlineStr"><is><t>0001</t></is></c></row>
</sheetData></worksheet>"""


def write_workbook(path, sheet=SHEET, extra=()):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="一月" sheetId="1" r:id="rId1"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        out.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>交易日期</t></si><si><t>金额</t></si></sst>")
        out.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        out.writestr("xl/worksheets/sheet1.xml", sheet)
        for name, content in extra:
            out.writestr(name, content)


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("statements")
    (folder / "a.csv").write_bytes(WECHAT.encode("gb18030"))
    (folder / "b.csv").write_bytes(WECHAT.encode("gb18030"))
    (folder / "c.csv").write_text(SPLIT)
    (folder / "d.csv").write_text(BOC)
    (folder / "e.csv").write_text("one note\n")
    (folder / "p.pdf").write_bytes(b"%PDF-1.4")
    write_workbook(folder / "w.xlsx")
    (folder / "z.xlsx").write_bytes(b"PK\x03\x04broken")
    return ingest.import_statements(spark, str(folder))


def by_name(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_files_and_their_status(imported):
    files = by_name(imported.files.collect())
    assert {n: (r.status, r.record_count, r.ready_count) for n, r in files.items()} == {
        "a.csv": ("completed", 1, 1),
        "b.csv": ("duplicate_file_skipped", 0, 0),
        "c.csv": ("partial", 3, 2),
        "d.csv": ("completed", 1, 1),
        "e.csv": ("failed", 0, 0),
        "p.pdf": ("failed", 0, 0),
        "w.xlsx": ("partial", 2, 1),
        "z.xlsx": ("failed", 0, 0),
    }
    names = {r.file_id: n for n, r in files.items()}
    issues = {(names[r.file_id], r.code, r.severity) for r in imported.issues.collect()}
    assert issues == {
        ("b.csv", "DUPLICATE_FILE", "warning"),
        ("c.csv", "AMOUNT_INVALID", "error"),
        ("c.csv", "AMOUNT_MISSING", "error"),
        ("c.csv", "DIRECTION_MISSING", "error"),
        ("e.csv", "SEGMENT_NOT_TABULAR", "warning"),
        ("e.csv", "NO_TRANSACTIONS", "error"),
        ("p.pdf", "PDF_LAYOUT_UNSUPPORTED", "error"),
        ("p.pdf", "NO_TRANSACTIONS", "error"),
        ("w.xlsx", "FORMULA_CELL", "error"),
        ("w.xlsx", "IDENTIFIER_NUMERIC", "error"),
        ("z.xlsx", "CORRUPT_WORKBOOK", "error"),
        ("z.xlsx", "NO_TRANSACTIONS", "error"),
    }


def test_records(imported):
    rows = {(r.path.rsplit("/", 1)[1], r.line): r for r in imported.records.collect()}
    wechat = rows["a.csv", 2]
    assert (wechat.source, wechat.profile, wechat.mapping_method, str(wechat.amount.normalize()), wechat.direction, wechat.currency, wechat.transaction_status) == ("微信", "wechat.export.v1", "profile", "58", "out", "CNY", "posted")
    assert (wechat.source_record_id, wechat.merchant_order_no, wechat.transaction_at, wechat.transaction_at_precision) == ("order10001", "merchant10001", "2026-01-01 12:00:00", "second")
    assert [(rows["c.csv", i].direction, rows["c.csv", i].parse_status) for i in (4, 5, 8)] == [("out", "ready"), ("in", "ready"), (None, "needs_review")]
    bank = rows["d.csv", 2]
    assert (bank.booking_at, bank.booking_at_precision, bank.direction, str(bank.signed_amount.normalize()), bank.balance) == ("2026-08-01 10:20:30", "second", "out", "-2E+1", "100")
    assert (bank.description, bank.hinted_fields) == ("午餐", ["description"]) and "渠道" not in bank.unmapped_headers and "网点名称" in bank.unmapped_headers
    assert [(f["index"], f.usage) for f in bank.source_fields][:2] == [(0, "mapped"), (1, "mapped")] and len(bank.source_fields) == 12
    first, second = rows["w.xlsx", 3], rows["w.xlsx", 4]
    assert (first.transaction_at, first.transaction_at_precision, first.source_record_id) == ("2026-09-01", "day", "12345678")
    assert (second.transaction_at, second.source_record_id, str(second.amount.normalize())) == ("2026-09-01 12:00:00", "0001", "3.5")


def test_every_row_is_kept_with_its_disposition(imported):
    rows = imported.raw_rows.where("path LIKE '%c.csv'").orderBy("line").collect()
    assert [r.disposition for r in rows] == ["preamble", "header", "header", "transaction", "transaction", "footer", "header", "transaction"]


def test_containers_with_too_much_inside(tmp_path):
    path = tmp_path / "bomb.xlsx"
    write_workbook(path, extra=[("xl/media/zeros", b"\0" * (workbooks.MOST_EXPANDED + 1))])
    assert path.stat().st_size < 2_000_000 and workbooks.container_issue(path.read_bytes()) == "ARCHIVE_TOO_LARGE"
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as out:
        out.writestr("a.txt", "x")
    assert workbooks.container_issue((tmp_path / "other.zip").read_bytes()) == "UNSUPPORTED_ARCHIVE"


def test_headers_are_inherited_along_pages(spark):
    schema = "file_id string, place int, segment_id string, page int, layout array<double>, width int, mapped boolean, dated boolean"
    rows = [("f", 1, "a", 1, [1.0, 9.0], 2, True, False), ("f", 2, "b", 2, [2.0, 8.0], 2, False, True), ("f", 3, "c", 3, [2.0, 9.0], 2, False, True), ("f", 4, "d", 5, [2.0, 9.0], 2, False, True), ("f", 5, "e", 6, [2.0, 9.0], 2, False, True), ("g", 1, "x", 1, [1.0], 1, False, True)]
    found = {r.segment_id: r.inherited for r in ingest.inherit_headers(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": None, "b": "a", "c": "a", "d": None, "e": None, "x": None}


MAPPED = "note\nd,v,k\n2026-01-01,5,J\n2026-01-02,6,x\n交易日期,金额,收/支\n2026-01-03,7,支出\n"


def test_mappings_of_a_user(spark, tmp_path):
    import hashlib

    (tmp_path / "m.csv").write_text(MAPPED)
    digest = hashlib.sha256(MAPPED.encode()).hexdigest()
    columns = {"transaction_at": 0, "amount": 1, "direction": 2}
    schema = f"sha256 string, segment string, {mapping.MAPPING}"

    def read(*said):
        given = spark.createDataFrame([(digest, s, *m) for s, *m in said], schema)
        found = ingest.import_statements(spark, str(tmp_path), mappings=given)
        return found, {r.code for r in found.issues.collect()}

    good = (2, columns, "USD", False, {" j": "in"}, "shop")
    found, codes = read(("*", 1, {}, None, None, None, None), ("csv", *good))
    rows = {r.line: r for r in found.records.collect()}
    assert {n: (r.profile, r.mapping_method, r.source, r.direction, r.currency) for n, r in rows.items()} == {
        3: ("user.confirmed.v1", "user_confirmed", "shop", "in", "USD"),
        4: ("user.confirmed.v1", "user_confirmed", "shop", None, "USD"),
        6: ("generic.v1", "exact_alias", "未知来源", "out", "CNY"),
    }
    assert {r.line: r.disposition for r in found.raw_rows.collect()} == {1: "preamble", 2: "header", 3: "transaction", 4: "transaction", 5: "header", 6: "transaction"}
    assert "MAPPING_INVALID" not in codes
    wrong = {
        "HEADER_LINE_MISSING": (9, *good[1:]),
        "COLUMN_UNKNOWN": (2, columns | {"colour": 1}, *good[2:]),
        "COLUMN_REPEATED": (2, columns | {"currency": 1}, *good[2:]),
        "FIELDS_MISSING": (2, {"transaction_at": 0}, *good[2:]),
        "DIRECTION_CODE_UNKNOWN": (2, columns, None, False, {"J": "up"}, None),
    }
    raw = ingest.csv_rows(ingest.read_files(spark, str(tmp_path))).withColumns({"sha256": F.lit(digest), "file_id": F.lit("f")})
    for problem, said in wrong.items():
        given = spark.createDataFrame([(digest, "csv", *said)], schema)
        of = mapping.confirmed_mappings(raw.withColumns({"segment": F.lit("csv"), "segment_id": F.lit("s")}), given)
        assert [r.problem for r in of.collect()] == [problem]
    found, codes = read(("*", *wrong["COLUMN_UNKNOWN"]))
    assert found.records.count() == 0 and {"MAPPING_INVALID", "HEADER_UNRECOGNIZED", "NO_TRANSACTIONS"} <= codes
    assert [r.problem for r in read(("csv", *good), ("csv", *good))[0].mappings.collect()] == ["SEGMENT_MAPPED_TWICE"]
