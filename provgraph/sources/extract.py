"""Extraction: what a file's content says of other files, its text, its pictures.

``extracted`` reads (path, content) a file at a time in Arrow batches and gives candidate claims, text
and metadata; a file that cannot be read gives a warning and nothing else.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import posixpath
import re
import struct
import warnings as _warnings
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.enums import REFERRED, TEXTS
from provgraph.functions.paths import directory
from provgraph.functions.text import REFERENCES, cleaned_reference

# Last names of calls that read or write files, with the place of the path among the
# arguments; None: the path is what the method is called on.
READS = {"read_text": None, "read_bytes": None, "read_csv": 0, "read_parquet": 0, "load": 0, "open": 0}
WRITES = {"write_text": None, "write_bytes": None, "to_csv": 0, "to_parquet": 0, "savefig": 0, "save": 0, "dump": None}
JS_READS, JS_WRITES = ("readFile", "readFileSync", "require", "import"), ("writeFile", "writeFileSync")
# Cell magics whose cell is still Python.
PYTHON_CELLS = ("time", "timeit", "capture", "prun", "debug", "python", "python3", "pypy")
# Bounds of archives that are opened: members, bytes of one, of all, and their ratio to what is packed.
MEMBERS, MEMBER_BYTES, ALL_BYTES, RATIO = 5000, 32 << 20, 256 << 20, 200

CANDIDATE = pa.struct([("source_path", pa.string()), ("target_path", pa.string()), ("relation", pa.string()), ("kind", pa.string()), ("adapter", pa.string()), ("signal_group", pa.string()), ("weight", pa.float64()), ("line", pa.int64()), ("cell", pa.int64())])
FORM = "path string, text string, encoding string, width long, height long, media array<string>, candidates array<struct<source_path:string,target_path:string,relation:string,kind:string,adapter:string,signal_group:string,weight:double,line:bigint,cell:bigint>>, warnings array<string>"


def tidy(path: str) -> str:
    """A path as it is indexed: forward slashes, no drive, no way above the top."""
    p = posixpath.normpath(re.sub(r"^[A-Za-z]:", "", path.replace("\\", "/"))).lstrip("/")
    while p.startswith("../"):
        p = p[3:]
    return "" if p in (".", "..") else p


def decoded(data: bytes) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, warning): Unicode by its mark, else UTF-8, else nothing."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"", "utf-8")):
        if data.startswith(mark):
            try:
                return data.decode(name), name, None
            except UnicodeDecodeError as e:
                return None, name if mark else None, f"text decode failed: {e.reason}"
    return None, None, "text decode failed"


# ---- Python


def plain_cell(source: str) -> str:
    """A notebook cell with lines that only IPython knows as ``pass``; every line keeps its number."""
    lines = source.split("\n")
    if head := re.match(r"\s*%%(\w+)", lines[0]):
        if head[1].lower() not in PYTHON_CELLS:
            return "\n".join(["pass"] * len(lines))
        lines[0] = "pass"
    out, open_ = [], 0
    for line in lines:
        bare = line.strip()
        if open_:  # what a magic goes on with
            open_ = max(0, open_ + _depth(line)) if not line.rstrip().endswith("\\") else max(1, open_ + _depth(line))
            out.append("pass")
        elif re.match(r"[%!]", bare) or re.match(r"[\w., ]+=\s*[%!](?!=)", bare) or re.fullmatch(r"[\w.\[\]'\"()]+\?{1,2}", bare):
            open_ = max(0, _depth(line)) or int(line.rstrip().endswith("\\"))
            out.append(line[: len(line) - len(line.lstrip())] + "pass")
        else:
            out.append(line)
    return "\n".join(out)


def _depth(line: str) -> int:
    held = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|#.*", "", line)
    return sum(held.count(x) for x in "([{") - sum(held.count(x) for x in ")]}")


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id] if isinstance(node, ast.Name) else parts))


class _Literals:
    """Strings that expressions are known to have without running them."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def value(self, node: ast.AST | None) -> str | None:
        match node:
            case ast.Constant(value=str(x)):
                return x
            case ast.Name(id=name):
                return self.names.get(name)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return self._joined([a, b])
            case ast.Call(func=f, args=[first, *_]) if _dotted(f) in ("Path", "pathlib.Path"):
                return self.value(first)
            case ast.Call(func=f, args=args) if _dotted(f) in ("os.path.join", "Path.joinpath"):
                return self._joined(args)
            case ast.JoinedStr(values=parts) if all(isinstance(p, ast.Constant) for p in parts):
                return "".join(p.value for p in parts)
        return None

    def _joined(self, nodes: list) -> str | None:
        parts = [self.value(n) for n in nodes]
        return "/".join(parts) if parts and all(parts) else None


def python_calls(source: str, path: str, cell: int | None = None) -> tuple[list[dict], str | None]:
    """Candidates from literal file calls of a Python source, and a warning if it does not parse."""
    try:
        with _warnings.catch_warnings():
            _warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"syntax parse failed: {e}"
    known, out = _Literals(), []
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (held := known.value(node.value)):
            known.names[node.targets[0].id] = held
        if not isinstance(node, ast.Call) or not (name := _dotted(node.func)):
            continue
        last = name.rpartition(".")[2]
        if name == "open":
            how = known.value(node.args[1]) if len(node.args) > 1 else "r"
            reads, place = not (how and set(how) & set("wax+")), 0
        elif last in READS:
            reads, place = True, READS[last]
        elif last in WRITES:
            reads, place = False, WRITES[last]
        else:
            continue
        on = node.func.value if isinstance(node.func, ast.Attribute) else None
        argument = on if place is None else node.args[place] if len(node.args) > place else None
        relation = "declares_read" if reads else "can_generate"
        row = {"relation": relation, "adapter": "python-ast", "signal_group": "static-callsite", "line": node.lineno, "cell": cell}
        if found := known.value(argument):
            ends = (tidy(found), path) if reads else (path, tidy(found))
            out.append(row | {"source_path": ends[0], "target_path": ends[1], "kind": "static-callsite", "weight": 0.65})
        else:  # told from the script on, for reads too
            out.append(row | {"source_path": path, "target_path": f"@unresolved/{path}:{node.lineno}:{name}", "kind": "unresolved-expression", "weight": 0.25})
    return out, None


def notebook_calls(text: str, path: str) -> tuple[list[dict], list[str]]:
    """Candidates of all code cells of a notebook, each with the number of its cell."""
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError) as e:
        return [], [f"notebook parse failed: {e}"]
    out, told = [], []
    for k, cell in enumerate(cells if isinstance(cells, list) else []):
        if isinstance(cell, dict) and cell.get("cell_type") == "code":
            source = cell.get("source", "")
            found, warning = python_calls(plain_cell("".join(source) if isinstance(source, list) else str(source)), path, k)
            out += found
            told += [warning] if warning else []
    return out, told


# ---- JavaScript

_TOKENS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|(?P<name>[^\W\d]\w*|\$[\w$]*)|(?P<other>\S)""", re.S)


def javascript_calls(source: str, path: str) -> list[dict]:
    """Candidates from literal file calls and local imports; comments and strings are no code."""
    tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKENS.finditer(source) if m.lastgroup]
    text = lambda k: re.sub(r"\\(.)", r"\1", tokens[k][1][1:-1], flags=re.S)
    literal = lambda k: k < len(tokens) and tokens[k][0] == "string" and not (tokens[k][1][0] == "`" and "${" in tokens[k][1])
    line = lambda k: source.count("\n", 0, tokens[k][2]) + 1
    base = {"adapter": "javascript", "cell": None}
    out, seen = [], set()
    for k, (group, word, _) in enumerate(tokens):
        if group != "name":
            continue
        after = k + 1
        if word in (*JS_READS, *JS_WRITES) and after < len(tokens) and tokens[after][1] == "(" and literal(after + 1):
            at, value = line(k), tidy(text(after + 1))
            if (word, value, at) not in seen:
                seen.add((word, value, at))
                ends = (path, value) if word in JS_WRITES else (value, path)
                out.append(base | {"source_path": ends[0], "target_path": ends[1], "relation": "can_generate" if word in JS_WRITES else "declares_read", "kind": "static-callsite", "signal_group": "static-callsite", "weight": 0.60, "line": at})
        if word in ("import", "export"):
            stop = next((j for j in range(after, len(tokens)) if tokens[j][0] == "string" or tokens[j][1] == ";"), len(tokens))
            if literal(stop) and text(stop).startswith(("./", "../")):
                value = tidy(posixpath.join(posixpath.dirname(path), text(stop)))
                out.append(base | {"source_path": value, "target_path": path, "relation": "imports", "kind": "static-import", "signal_group": "static-import", "weight": 0.55, "line": line(k)})
    return out


# ---- documents and pictures


def _members(data: bytes) -> zipfile.ZipFile:
    """An archive within the bounds; ValueError for any other."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    infos = archive.infolist()
    if len(infos) > MEMBERS or sum(i.file_size for i in infos) > ALL_BYTES:
        raise ValueError("archive too large")
    for i in infos:
        if i.file_size > MEMBER_BYTES or i.file_size > RATIO * max(1, i.compress_size):
            raise ValueError(f"archive member too large: {i.filename}")
        if i.filename.startswith(("/", "\\")) or ".." in i.filename.replace("\\", "/").split("/"):
            raise ValueError(f"archive member out of bounds: {i.filename}")
    return archive


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:4096].replace(b"\0", b"").upper():
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


def document(data: bytes, path: str) -> tuple[str, list[str], list[dict]]:
    """(text, digests of embedded media, references) of an office document or a book."""
    archive = _members(data)
    texts, media, links = [], [], []
    for name in sorted(archive.namelist()):
        low = name.lower()
        if low.endswith(".rels"):
            links += [x.get("Target") for x in _xml(archive.read(name)).iter() if x.get("Target") and x.get("TargetMode") == "External"]
        elif low.endswith((".xml", ".xhtml", ".html", ".htm")) and not low.startswith(("meta-inf/", "docprops/", "_rels/")) and not low.endswith(("styles.xml", "settings.xml", "theme1.xml", "[content_types].xml")):
            try:
                root = _xml(archive.read(name))
            except ElementTree.ParseError:
                continue
            paragraphs = [p for p in root.iter() if p.tag.rpartition("}")[2] in ("p", "h", "si", "h1", "h2", "h3")]
            texts += [t for p in paragraphs if (t := "".join(p.itertext()).strip())]
            links += [v for x in root.iter() for k, v in x.attrib.items() if k == "{http://www.w3.org/1999/xlink}href" and not v.startswith(("#", "Pictures/", "./Object"))]
        elif re.search(r"(^|/)(media|pictures|images?)/[^/]+$", low):
            media.append(hashlib.sha256(archive.read(name)).hexdigest())
    found = [{"source_path": path, "target_path": t, "relation": "references", "kind": "structured-external-link", "adapter": "document", "signal_group": "explicit-reference", "weight": 0.48, "line": None, "cell": None} for x in dict.fromkeys(links) if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x) and (t := tidy(posixpath.join(posixpath.dirname(path), x))) and t != path]
    return "\n".join(texts), sorted(set(media)), found


def pdf_text(data: bytes) -> str:
    """Text that the content streams of a PDF show as literal strings; no fonts are decoded."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body, MEMBER_BYTES)
        except zlib.error:
            pass
        for shown in re.findall(rb"\((?:\\.|[^\\()])*\)(?=[^()]*?(?:Tj|TJ|'))|\[(?:\((?:\\.|[^\\()])*\)|[^\]()])*\]\s*TJ", body, re.S):
            parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)", shown, re.S)
            out.append("".join(re.sub(rb"\\([()\\])", rb"\1", p).decode("latin-1") for p in parts))
    return "\n".join(out)


def picture_size(data: bytes) -> tuple[int | None, int | None]:
    """Width and height of a PNG or JPEG."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                at += 1
            elif 0xC0 <= data[at + 1] <= 0xC3:
                high, wide = struct.unpack(">HH", data[at + 5 : at + 9])
                return wide, high
            elif data[at + 1] == 0xFF:
                at += 1
            else:
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None


# ---- all files


def one(path: str, data: bytes) -> dict:
    """What one file gives."""
    row = dict.fromkeys(("path", "text", "encoding", "width", "height")) | {"path": path, "media": [], "candidates": [], "warnings": []}
    ext = posixpath.splitext(path)[1].lower().lstrip(".")
    try:
        if ext in ("docx", "pptx", "xlsx", "odt", "odp", "ods", "epub"):
            row["text"], row["media"], row["candidates"] = document(data, path)
        elif ext == "pdf":
            row["text"] = pdf_text(data)
        elif ext in ("png", "jpg", "jpeg"):
            row["width"], row["height"] = picture_size(data)
        elif ext in TEXTS:
            row["text"], row["encoding"], warning = decoded(data)
            told = [warning] if warning else []
            if row["text"] is not None and ext == "py":
                row["candidates"], bad = python_calls(row["text"], path)
                told += [bad] if bad else []
            elif row["text"] is not None and ext == "ipynb":
                row["candidates"], told = notebook_calls(row["text"], path)
            elif row["text"] is not None and ext in ("js", "jsx", "ts", "tsx", "mjs", "cjs"):
                row["candidates"] = javascript_calls(row["text"], path)
            row["warnings"] = told
    except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, ElementTree.ParseError, zlib.error, RuntimeError) as e:
        row["warnings"] = [f"{ext} metadata-only: {e}"[:200]]
    return row


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.string()), ("text", pa.string()), ("encoding", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("media", pa.list_(pa.string())), ("candidates", pa.list_(CANDIDATE)), ("warnings", pa.list_(pa.string()))]
    for batch in batches:
        for k in range(batch.num_rows):  # a file at a time: memory follows the largest one
            row = one(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in kinds], [n for n, _ in kinds])


def extracted(files: DataFrame) -> DataFrame:
    """(path, text, encoding, width, height, media, candidates, warnings) of files (path, content)."""
    return files.where("path is not null").select("path", "content").mapInArrow(_extract, FORM)


def candidates(found: DataFrame) -> DataFrame:
    """The candidate claims of ``extracted``, a row each."""
    return found.select(F.inline("candidates"))


def references(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, line, raw, target): literal references in texts (path, text), by line, each target once a line.

    Links, attributes, style sheets and quoted strings; anchors and other schemes are none, and what is
    left must end in a suffix of files. ``./`` and ``../`` are relative to the file; any other is, if only
    such a path is ``known`` (path), else it is relative to the top.
    """
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("at", "said"))
    raw = F.concat(*(F.regexp_extract_all("said", F.lit(p), F.lit(1)) for p in REFERENCES.values()))
    each = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(raw)).alias("raw"))
    cleaned = each.withColumn("clean", F.regexp_replace(cleaned_reference(F.trim(F.regexp_replace(F.trim("raw"), r"^<+|>+$", ""))), r"\\", "/")).where("clean is not null")
    cleaned = cleaned.where(F.lower(F.regexp_extract("clean", r"[^/]\.([A-Za-z0-9]+)$", 1)).isin(REFERRED))
    near = resolved_path(F.concat(directory(F.col("path")), F.lit("/"), F.col("clean")))
    out = cleaned.select("path", "line", "raw", near.alias("near"), resolved_path(F.col("clean")).alias("far"), F.col("clean").rlike(r"^\.\.?/").alias("relative"))
    if known is None:
        pick = F.when(F.col("relative"), F.col("near")).otherwise(F.col("far"))
    else:
        there = lambda name: known.select(F.col("path").alias(name), F.lit(True).alias(f"has_{name}")).distinct()
        out = out.join(there("near"), "near", "left").join(there("far"), "far", "left")
        pick = F.when(F.col("relative") | F.col("has_near").isNotNull() & F.col("has_far").isNull(), F.col("near")).otherwise(F.col("far"))
    return out.select("path", "line", "raw", pick.alias("target")).where("target <> path").dropDuplicates(["path", "line", "target"])


def resolved_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty steps; ``..`` at the top goes nowhere."""
    up = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x.isin("", "."), out).otherwise(F.concat(out, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), up), "/")
