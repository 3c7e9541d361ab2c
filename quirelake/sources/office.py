"""Office packages, MIME archives, Markdown payloads and image headers as tables, and workbooks as a sink.

Files come in through Spark's binaryFile reader, so any store that Spark reads will do; a package is parsed whole in one
task, packages in parallel. Only the standard library is used for parsing."""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespaces of the package formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CT = "{http://schemas.openxmlformats.org/package/2006/content-types}"
STRICT = b"http://purl.oclc.org/ooxml/"
TRANSITIONAL = {b"http://purl.oclc.org/ooxml/wordprocessingml/main": W[1:-1].encode(), b"http://purl.oclc.org/ooxml/spreadsheetml/main": S[1:-1].encode(), b"http://purl.oclc.org/ooxml/drawingml/main": A[1:-1].encode(), b"http://purl.oclc.org/ooxml/officeDocument/relationships": R[1:-1].encode()}

#: A package with more unpacked bytes, or a larger ratio of unpacked to packed, is reported and not parsed.
MOST_BYTES, MOST_RATIO = 512 * 1024 * 1024, 200


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of all files below path that match pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def each(found: DataFrame, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """path and the rows that parse finds in each file, or one row with an error and nulls if it can't be parsed."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows, error = parse(bytes(data)), None
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, struct.error) as e:
                    rows, error = [(None,) * len(names)], f"{type(e).__name__}: {e}"
                out = pd.DataFrame(rows, columns=names, dtype=object)
                out.insert(0, "path", path)
                yield out.assign(error=error)

    return found.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def opened(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    size = sum(i.file_size for i in z.infolist())
    if size > MOST_BYTES or size > MOST_RATIO * max(1, sum(i.compress_size for i in z.infolist())) + 1_000_000:
        raise ValueError("package is too large unpacked")
    return z


def part(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if STRICT in data:
        for a, b in TRANSITIONAL.items():
            data = data.replace(a, b)
    return ET.fromstring(data)


# Packages ---------------------------------------------------------------------------------------------------------------


def manifest_rows(data: bytes) -> list[tuple]:
    z = opened(data)
    kinds: dict[str, str] = {}
    default: dict[str, str] = {}
    if "[Content_Types].xml" in z.namelist():
        for e in part(z, "[Content_Types].xml"):
            if e.tag == CT + "Override":
                kinds[e.get("PartName", "").lstrip("/")] = e.get("ContentType")
            else:
                default[e.get("Extension", "").lower()] = e.get("ContentType")
    seen: dict[str, int] = {}
    rows = []
    for i in z.infolist():
        n = seen.get(i.filename, 0)
        seen[i.filename] = n + 1
        raw = z.read(i)
        finding = "duplicate entry" if n else "unsafe path" if i.filename.startswith("/") or ".." in i.filename.split("/") else None
        rows.append((i.filename, n, kinds.get(i.filename) or default.get(i.filename.rpartition(".")[2].lower()), hashlib.sha256(raw).hexdigest(), len(raw), finding))
    return rows


def package_entries(found: DataFrame) -> DataFrame:
    """path, uri, occurrence, content_type, sha256, size, finding of every entry."""
    return each(found, manifest_rows, "uri string, occurrence long, content_type string, sha256 string, size long, finding string")


def relationship_rows(data: bytes) -> list[tuple]:
    z, rows = opened(data), []
    for name in z.namelist():
        if name.endswith(".rels"):
            owner = name.replace("_rels/", "").removesuffix(".rels")
            rows += [(owner, e.get("Id"), (e.get("Type") or "").rpartition("/")[2], e.get("Target"), e.get("TargetMode") or "Internal") for e in part(z, name)]
    return rows


def package_relationships(found: DataFrame) -> DataFrame:
    return each(found, relationship_rows, "owner string, rel_id string, type string, target string, mode string")


# Word processing --------------------------------------------------------------------------------------------------------


def paragraph_text(p: ET.Element, view: str = "accept") -> str:
    """Text with tabs and breaks; tracked insertions and deletions by the view (accept or reject). Field instructions
    are left out, their results kept."""
    gone = W + ("del" if view == "accept" else "ins")
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        if e.tag in (gone, W + "instrText", W + "pPr", W + "rPr"):
            return
        if e.tag in (W + "t", W + "delText"):
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif e.tag == W + "noBreakHyphen":
            out.append("‑")
        for x in e:
            walk(x)

    walk(p)
    return "".join(out)


def docx_rows(data: bytes, view: str = "accept") -> list[tuple]:
    """(scope, ord, kind, style, level, num_id, row, col, text) of all paragraphs in all stories."""
    z, rows = opened(data), []
    stories = [("body", "word/document.xml")]
    for name in sorted(z.namelist()):
        m = re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)(\d*)\.xml", name)
        if m:
            stories.append(({"header": "hdr", "footer": "ftr", "footnotes": "fn", "endnotes": "en", "comments": "cmt"}[m[1]] + m[2], name))
    for scope, name in stories:
        n = 0

        def walk(e: ET.Element, row: int | None, col: int | None, scope: str = scope) -> None:
            nonlocal n
            for x in e:
                if x.tag == W + "p":
                    pr = x.find(W + "pPr")
                    get = lambda path, pr=pr: None if pr is None or (v := pr.find("/".join(W + s for s in path.split("/")))) is None else v.get(W + "val")
                    style, level, num = get("pStyle"), get("numPr/ilvl"), get("numPr/numId")
                    kind = "h" if re.match(r"(?i)heading\s*\d|title", style or "") else "li" if num not in (None, "0") else "p"
                    rows.append((scope, n, kind, style, None if level is None else int(level), None if num is None else int(num), row, col, paragraph_text(x, view)))
                    n += 1
                elif x.tag == W + "tbl":
                    for i, tr in enumerate(x.iter(W + "tr")):
                        for j, tc in enumerate(tr.findall(W + "tc")):
                            walk(tc, i, j)
                elif x.tag not in (W + "pPr", W + "tblPr", W + "sectPr"):
                    walk(x, row, col)

        root = part(z, name)
        walk(root.find(W + "body") if scope == "body" else root, None, None)
    return rows


def docx_blocks(found: DataFrame, view: str = "accept") -> DataFrame:
    """Paragraphs of word-processing packages; view: tracked changes accepted or rejected."""
    return each(found, lambda data: docx_rows(data, view), "scope string, ord long, kind string, style string, level long, num_id long, row long, col long, text string")


# Spreadsheets -----------------------------------------------------------------------------------------------------------


def xlsx_rows(data: bytes) -> list[tuple]:
    """(sheet, row, col, ref, kind, value, formula) of all cells; a cell without an address stands right of the last one,
    a row without a number below the last."""
    z = opened(data)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in part(z, "xl/sharedStrings.xml").findall(S + "si")]
    targets = {e.get("Id"): e.get("Target", "") for e in part(z, "xl/_rels/workbook.xml.rels")}
    rows = []
    for sheet in part(z, "xl/workbook.xml").iter(S + "sheet"):
        target = targets[sheet.get(R + "id")]
        r = 0
        for row in part(z, target.lstrip("/") if target.startswith("/") else "xl/" + target).iter(S + "row"):
            r, c = int(row.get("r") or r + 1), 0
            for cell in row.findall(S + "c"):
                ref = cell.get("r") or ""
                c = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(re.sub(r"[^A-Z]", "", ref)))) or c + 1
                kind, v = cell.get("t") or "n", cell.findtext(S + "v")
                if kind == "s":
                    v = shared[int(v)] if v is not None else None
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in cell.iter(S + "t"))
                letters, k = "", c
                while k:
                    k, m = divmod(k - 1, 26)
                    letters = chr(65 + m) + letters
                if v is not None:
                    rows.append((sheet.get("name"), r, c, f"{letters}{r}", {"s": "string", "inlineStr": "string", "str": "string", "b": "boolean", "d": "date", "e": "error"}.get(kind, "number"), v, cell.findtext(S + "f")))
    return rows


def xlsx_cells(found: DataFrame) -> DataFrame:
    return each(found, xlsx_rows, "sheet string, row long, col long, ref string, kind string, value string, formula string")


def workbook(sheets: dict[str, tuple[list[str], list[list]]]) -> bytes:
    """A workbook of named sheets (header, rows); numbers, booleans and texts keep their type. Entries have a fixed time,
    so equal sheets give equal bytes."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)

        put("[Content_Types].xml", f'<Types xmlns="{CT[1:-1]}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        put("_rels/.rels", f'<Relationships xmlns="{REL[1:-1]}"><Relationship Id="rId1" Type="{R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{REL[1:-1]}">' + "".join(f'<Relationship Id="rId{i}" Type="{R[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (header, rows) in enumerate(sheets.values(), 1):
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{S[1:-1]}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(map(cell, row)) + "</row>" for r, row in enumerate([header, *rows], 1)) + "</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key, content: one workbook for each key, to be written by whatever sink takes binary rows. A workbook has at most
    1,048,575 data rows; a key with more gets more sheets."""
    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)[columns].astype(object).where(lambda d: d.notna(), None).values.tolist()
        rows = [[v.item() if hasattr(v, "item") else v for v in r] for r in rows]
        sheets = {f"Sheet{i // 1_048_575 + 1}": (columns, rows[i : i + 1_048_575]) for i in range(0, max(1, len(rows)), 1_048_575)}
        return pd.DataFrame({key: [k[0]], "content": [workbook(sheets)]})

    return df.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, content binary")


# Other formats ----------------------------------------------------------------------------------------------------------


def mht_rows(data: bytes) -> list[tuple]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    parts = [p for p in message.walk() if not p.is_multipart()]
    return [(i, p.get("Content-Location"), p.get_content_type(), len(b := p.get_payload(decode=True) or b""), hashlib.sha256(b).hexdigest(), b.decode(p.get_content_charset() or "utf-8", "replace") if p.get_content_maintype() == "text" else None) for i, p in enumerate(parts)]


def mht_parts(found: DataFrame) -> DataFrame:
    return each(found, mht_rows, "ord long, location string, content_type string, size long, sha256 string, text string")


def image_rows(data: bytes) -> list[tuple]:
    """(format, width, height) from the first bytes of a PNG, GIF, BMP or JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return [("png", *struct.unpack(">II", data[16:24]))]
    if data[:4] == b"GIF8":
        return [("gif", *struct.unpack("<HH", data[6:10]))]
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return [("bmp", w, abs(h))]
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                break
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return [("jpeg", w, h)]
            at += 2 + size
    raise ValueError("unknown image format")


def images(found: DataFrame) -> DataFrame:
    return each(found, image_rows, "format string, width long, height long")


def markdown_rows(text: str) -> list[tuple]:
    """(ord, kind, level, text) of a restricted Markdown: headings, bullets, numbered items, paragraphs. Tables, code
    fences, quotes and raw HTML are errors."""
    rows, para = [], []

    def close() -> None:
        if para:
            rows.append((len(rows), "p", 0, " ".join(para)))
            para.clear()

    for line in text.split("\n"):
        s = line.strip()
        if re.match(r"```|~~~|>|\||<[a-zA-Z/!]", s):
            raise ValueError(f"not supported: {s[:20]}")
        if m := re.match(r"(#{1,6})\s+(.*)", s):
            close()
            rows.append((len(rows), "h", len(m[1]), m[2]))
        elif m := re.match(r"([-*+]|\d+[.)])\s+(.*)", s):
            close()
            rows.append((len(rows), "li" if m[1] in "-*+" else "ol", (len(line) - len(line.lstrip())) // 2, m[2]))
        elif s:
            para.append(s)
        else:
            close()
    close()
    return rows


def markdown_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the blocks of a Markdown column, or an error."""
    src = df.select(F.col(key).cast("string").alias("path"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))
    return each(src, lambda b: markdown_rows(b.decode()), "ord long, kind string, level long, text string").withColumnRenamed("path", key)
