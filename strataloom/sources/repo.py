"""A source tree as tables: files read by Spark, kept by path rules; extraction with one parse for each file."""

from __future__ import annotations

import ast
import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p

# Directories that are never walked.
EXCLUDED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", ".npm", ".yarn", ".pnp", ".pnpm-store", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    ".tox", ".nox", ".hypothesis", "target", ".gradle", ".m2", ".ivy2", "_build", "deps", ".build", "DerivedData", "Pods", ".dart_tool", ".stack-work",
    "dist-newstyle", ".cabal-sandbox", "dist", "build", ".next", ".nuxt", ".svelte-kit", ".astro", ".docusaurus", ".turbo", ".nx", ".rush", ".vercel", ".netlify",
    ".serverless", ".cache", ".parcel-cache", "coverage", ".nyc_output", "htmlcov", ".idea", ".vscode", ".vs", ".fleet", ".zed", ".history", ".ssh", ".aws", ".gnupg", "vendor",
]
# File names that look like secrets.
SECRET_NAMES = r"^(\.env(\..*)?|id_(rsa|ed25519|dsa)(\..*)?|.*\.(pem|key|crt)|\.pgpass|\.netrc)$"
MOST_BYTES = 2 << 20


def walk(spark: SparkSession, root: str, ignored: list[str] = ()) -> DataFrame:
    """(path, lang, size, modified_at, text): source files of the ten languages under root, by any path Spark reads.

    Excluded directories, secret-shaped names, files over 2 MB, paths under an ignored prefix and what the root's .gitignore,
    .ignore and .git/info/exclude leave out are left out. Bytes that aren't UTF-8 become U+FFFD. The driver lists directories
    and goes into none that is excluded; contents are read by the tasks.
    """
    folders, empty = _listing(spark, root)
    raw = spark.read.format("binaryFile").load(folders).select("path", "length", "modificationTime", "content") if folders else None
    # Scans leave out files without a byte, which still count; they come from the listing of their directories.
    none = spark.createDataFrame(empty, "path string, length long, modificationTime timestamp, content binary")
    raw = none if raw is None else raw.union(none)
    rows = raw.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    rows = rows.where(~_secret(F.col("path")) & (F.col("size") <= MOST_BYTES))
    for x in ignored:
        rows = rows.where(~F.col("path").startswith(x))
    rows = rows.where(~p.git_ignored(F.col("path"), _ignore_lines(spark, root)))
    lang = p.language(F.col("path"))
    return rows.where(lang.isNotNull()).select("path", lang.alias("lang"), "size", "modified_at", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """(path, reason): what walk() leaves out by name or size, as `secret` or `size`; no content is read."""
    folders, _ = _listing(spark, root)
    if not folders:
        return spark.createDataFrame([], "path string, reason string")
    rows = spark.read.format("binaryFile").load(folders).select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"))
    reason = F.when(_secret(F.col("path")), "secret").when(p.language(F.col("path")).isNotNull() & (F.col("size") > MOST_BYTES), "size")
    return rows.select("path", reason.alias("reason")).where("reason is not null")


def _secret(path):
    return F.lower(p.basename(path)).rlike(SECRET_NAMES)


def _relative(path, root: str):
    base = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(path, r"^.*?" + re.escape(base) + "/", "")


def _ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of the root's ignore files, which people write and which are short."""
    jvm, out = spark.sparkContext._jvm, []
    for name in (".gitignore", ".ignore", ".git/info/exclude"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            out += [r.value for r in spark.read.text(path.toString()).collect()]
    return out


def _listing(spark: SparkSession, root: str) -> tuple[list[str], list[tuple]]:
    """(folders with a file of some bytes, rows of the files of 0 bytes) under root, but not under excluded directories."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders, empty, todo = [], [], [top]
    while todo:
        here, full = todo.pop(), False
        for f in fs.listStatus(here):
            if f.isDirectory():
                if f.getPath().getName() not in EXCLUDED_DIRS:
                    todo.append(f.getPath())
            elif f.getLen():
                full = full or not f.getPath().getName().startswith(("_", "."))
            else:
                empty.append((f.getPath().toString(), 0, datetime.fromtimestamp(f.getModificationTime() / 1000), bytearray()))
        if full:
            folders.append(here.toString())
    return sorted(folders), empty


ROW = "row string, name string, kind string, line long, line_end long, enclosing string, target string, aux string, arity long, is_async boolean, is_override boolean, params array<struct<name: string, type: string, default_value: string>>, modifiers array<string>, return_type string, names array<struct<local: string, original: string>>, ok boolean"
_FIELDS = ["row", "name", "kind", "line", "line_end", "enclosing", "target", "aux", "arity", "is_async", "is_override", "params", "modifiers", "return_type", "names", "ok"]


def _row(row: str, **values) -> tuple:
    base = dict.fromkeys(_FIELDS) | {"row": row, "arity": -1, "is_async": False, "is_override": False, "params": [], "modifiers": [], "return_type": "", "names": [], "ok": True}
    return tuple((base | values)[f] for f in _FIELDS)


class _Python(ast.NodeVisitor):
    """Rows of one Python file: symbol, call, ref, extends, import, decorator."""

    def __init__(self, text: str):
        self.rows: list[tuple] = []
        self.stack: list[tuple[str, str]] = []
        self.lines = text.split("\n")

    def _enclosing(self) -> str | None:
        return self.stack[-1][0] if self.stack else None

    def _class(self) -> str | None:
        return self.stack[-1][0] if self.stack and self.stack[-1][1] == "class" else None

    def _define(self, node, kind: str, **values) -> None:
        self.rows.append(_row("symbol", name=node.name, kind=kind, line=node.lineno, line_end=node.end_lineno, enclosing=self._class(), **values))
        for d in node.decorator_list:
            call = d.func if isinstance(d, ast.Call) else d
            args = ast.unparse(d)[len(ast.unparse(call)) :].strip("()") if isinstance(d, ast.Call) else ""
            self.rows.append(_row("decorator", name=node.name, line=node.lineno, target=ast.unparse(call), aux=args))
        self.stack.append((node.name, "class" if kind == "class" else "function"))
        self.generic_visit(node)
        self.stack.pop()

    def visit_ClassDef(self, node) -> None:
        for b in node.bases:
            self.rows.append(_row("extends", name=node.name, line=node.lineno, target=ast.unparse(b).rpartition(".")[2]))
        self._define(node, "class")

    def visit_FunctionDef(self, node) -> None:
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        defaults = dict(zip([x.arg for x in [*a.posonlyargs, *a.args]][-len(a.defaults) or 10**6 :], a.defaults, strict=False)) | {k.arg: d for k, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d}
        params = [(x.arg, ast.unparse(x.annotation) if x.annotation else "", ast.unparse(defaults[x.arg]) if x.arg in defaults else "") for x in every]
        marks = [ast.unparse(d) for d in node.decorator_list]
        for x in [*[y.annotation for y in every], node.returns]:
            if x is not None:
                for n in ast.walk(x):
                    if isinstance(n, ast.Name):
                        self.rows.append(_row("ref", name=n.id, line=n.lineno, enclosing=node.name, aux="type_position"))
        self._define(
            node, "method" if self._class() else "function", arity=len(every), is_async=isinstance(node, ast.AsyncFunctionDef), is_override="override" in marks or "typing.override" in marks,
            params=params, modifiers=["async"] if isinstance(node, ast.AsyncFunctionDef) else [], return_type=ast.unparse(node.returns) if node.returns else "",
        )

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if name and self._enclosing():
            self.rows.append(_row("call", name=name, line=node.lineno, enclosing=self._enclosing()))
        for x in [*node.args, *[k.value for k in node.keywords]]:
            if isinstance(x, ast.Name):
                self.rows.append(_row("ref", name=x.id, line=x.lineno, enclosing=self._enclosing(), aux="fn_arg"))
        self.generic_visit(node)

    def visit_Dict(self, node) -> None:
        for x in node.values:
            if isinstance(x, ast.Name):
                self.rows.append(_row("ref", name=x.id, line=x.lineno, enclosing=self._enclosing(), aux="map_value"))
        self.generic_visit(node)

    def visit_List(self, node) -> None:
        for x in node.elts:
            if isinstance(x, ast.Name):
                self.rows.append(_row("ref", name=x.id, line=x.lineno, enclosing=self._enclosing(), aux="array_element"))
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        for n in ast.walk(node.annotation):
            if isinstance(n, ast.Name):
                self.rows.append(_row("ref", name=n.id, line=n.lineno, enclosing=self._enclosing(), aux="type_position"))
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for n in node.names:
            self.rows.append(_row("import", target=n.name, line=node.lineno, names=[]))

    def visit_ImportFrom(self, node) -> None:
        self.rows.append(_row("import", target="." * node.level + (node.module or ""), line=node.lineno, names=[(n.asname or n.name, n.name) for n in node.names if n.name != "*"]))


# Definitions, calls and imports of brace languages as line patterns, tried in this order.
_DEFS = [
    ("class", r"^\s*(?:(?:export|default|public|private|protected|internal|abstract|final|sealed|static|open|data|partial)\s+)*class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"^\s*(?:(?:export|public|private|internal|sealed|fun)\s+)*interface\s+([A-Za-z_$][\w$]*)"),
    ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_]\w*)"),
    ("enum", r"^\s*(?:(?:export|public|private|internal|pub(?:\([^)]*\))?|const)\s+)*enum\s+(?:class\s+)?([A-Za-z_]\w*)"),
    ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)"),
    ("struct", r"^\s*type\s+([A-Za-z_]\w*)\s+struct\b"),
    ("interface", r"^\s*type\s+([A-Za-z_]\w*)\s+interface\b"),
    ("module", r"^\s*module\s+([A-Z]\w*)"),
    ("method", r"^\s*func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\("),
    ("function", r"^\s*(?:(?:export|default|async|public|private|protected|internal|static|override|suspend|inline|open|abstract|final|virtual)\s+)*(?:function\*?|func|fun|fn|def)\s+(?:self\.)?([A-Za-z_$][\w$]*[?!]?)"),
    ("function", r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_]\w*)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    ("method", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|synchronized)\s+)+(?:[\w$<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;]*$"),
]
_DEFS = [(k, re.compile(x)) for k, x in _DEFS]
#: A method without modifiers, right within a class.
_MEMBER = re.compile(r"^\s+(?:[\w$<>\[\],.?]+\s+)?([A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^{;]+)?\{\s*$")
_CALL = re.compile(r"(?<![\w$.])(?:[\w$]+(?:\.|::|->|\?\.))*([A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "fun", "def", "match", "new", "super", "elsif", "unless", "when", "sizeof", "typeof", "await", "foreach", "using", "lock"}
_IMPORTS = [
    re.compile(r"""^\s*(?:import|export)\s+(type\s+)?(?:\*\s+as\s+\w+|\*|[\w$]+\s*,?\s*)?(?:\{([^}]*)\})?\s*(?:from\s*)?["']([^"']+)["']"""),
    re.compile(r"""^\s*(?:const|let|var)\s+()(?:\{([^}]*)\}|[\w$]+)\s*=\s*require\(["']([^"']+)["']\)"""),
    re.compile(r"""^\s*()()require(?:_relative|_once)?\s*\(?["']([^"']+)["']"""),
    re.compile(r"""^\s*()()(?:import|using|use|package)\s+([\w.:\\*]+)\s*;?\s*$"""),
    re.compile(r"""^\s*()()(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$"""),
]
_EXTENDS = re.compile(r"^\s*(?:[\w<>\s]*?)\b(?:class|interface|struct|trait)\s+([A-Za-z_$][\w$]*)[^:{<]*(?:<\s*(?!.*extends)([A-Z]\w*)\s*$|(?:extends|:)\s*([A-Za-z_$][\w$.]*))(?:[^{]*?implements\s+([\w$.,\s]+))?")
_IMPL = re.compile(r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z_]\w*)(?:<[^>]*>)?\s+for\s+([A-Za-z_]\w*)")


def _braced(text: str, lang: str) -> list[tuple]:
    """Rows of one file of a brace language, or Ruby, from its lines; strings and comments are blanked first."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S) if lang != "ruby" else re.sub(r"(?m)^\s*#[^\n]*", "", text)
    rows, open_, depth = [], [], 0
    lines = clean.split("\n")
    for i, line in enumerate(lines, 1):
        defined = None
        for kind, pattern in _DEFS:
            m = pattern.match(line)
            if m:
                defined = (kind, m[1])
                break
        outer = next((o for o in reversed(open_) if o[1] in ("class", "interface", "trait", "struct", "module", "impl")), None)
        if not defined and open_ and open_[-1] is outer:
            m = _MEMBER.match(line)
            defined = ("method", m[1]) if m and m[1] not in _NOT_CALLS else None
        if defined:
            kind, name = defined
            kind = "method" if kind == "function" and outer else kind
            args = re.search(r"\(([^)]*)\)", line[line.find(name) :])
            params = [(re.split(r"[:\s=]", a.strip())[0].lstrip("&*"), "", "") for a in args[1].split(",") if a.strip()] if args and kind in ("function", "method") else []
            rows.append([_row("symbol", name=name, kind=kind, line=i, line_end=i, enclosing=outer[0] if outer else None, arity=len(params) if kind in ("function", "method") else -1, is_async="async" in line.split("(")[0].split(), is_override=bool(re.search(r"\boverride\b|@Override", line + (lines[i - 2] if i > 1 else ""))), params=params), "symbol"])
            m = _EXTENDS.match(line)
            for base in [x.strip() for x in [m[2], m[3], *(m[4] or "").split(",")] if x and x.strip()] if m else []:
                rows.append([_row("extends", name=name, line=i, target=base.rpartition(".")[2]), ""])
        impl = _IMPL.match(line)
        if impl:
            rows.append([_row("extends", name=impl[2], line=i, target=impl[1]), ""])
        inside = defined[1] if defined and defined[0] in ("function", "method") else next((o[0] for o in reversed(open_) if o[1] in ("function", "method")), None)
        if inside:
            for m in _CALL.finditer(re.sub(r"""(["'`])(?:\\.|(?!\1).)*\1""", '""', line)):
                if m[1] not in _NOT_CALLS and not (defined and m[1] == defined[1]):
                    rows.append([_row("call", name=m[1], line=i, enclosing=inside), ""])
        for pattern in _IMPORTS:
            m = pattern.match(line)
            if m:
                names = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
                pairs = [(n.split(" as ")[-1].split(":")[-1].strip(), re.split(r" as |:", n)[0].replace("type ", "").strip()) for n in names]
                rows.append([_row("import", target=m[3], line=i, names=pairs, aux="re_export" if line.lstrip().startswith("export") else "type" if m[1] else ""), ""])
                break
        if lang == "ruby":
            opens = 1 if defined or re.match(r"^\s*(if|unless|while|until|case|begin|do)\b|.*\bdo(\s*\|[^|]*\|)?\s*$", line) else 0
            closes = 1 if re.match(r"^\s*end\b", line) else 0
        else:
            opens, closes = line.count("{"), line.count("}")
        if defined or impl:
            open_.append([(defined or ("", impl[2]))[1], defined[0] if defined else "impl", depth, len(rows) and next((k for k in range(len(rows) - 1, -1, -1) if rows[k][1] == "symbol"), None)])
        depth += opens - closes
        while open_ and depth <= open_[-1][2] and (closes or lang != "ruby" and not opens and line.rstrip().endswith(";")):
            name, _, _, at = open_.pop()
            if at is not None and rows[at][0][1] == name:
                fixed = list(rows[at][0])
                fixed[4] = i
                rows[at][0] = tuple(fixed)
    return [r for r, _ in rows]


def extract_text(lang: str, text: str) -> list[tuple]:
    """All rows of one file, and one `file` row that says whether it parsed."""
    if text is None:
        return [_row("file", ok=False)]
    if lang == "python":
        try:
            visitor = _Python(text)
            visitor.visit(ast.parse(text))
            return [*visitor.rows, _row("file")]
        except (SyntaxError, ValueError, RecursionError):
            return [_row("file", ok=False)]
    return [*_braced(text, lang), _row("file")]


def extract(files: DataFrame) -> DataFrame:
    """(path, lang, seq, <ROW>): every file is parsed once, and all kinds of rows come from that pass."""

    def run(pdfs):
        import pandas as pd

        for pdf in pdfs:
            out = [(path, lang, i, *r) for path, lang, text in zip(pdf.path, pdf.lang, pdf.text, strict=True) for i, r in enumerate(extract_text(lang, text))]
            yield pd.DataFrame(out, columns=["path", "lang", "seq", *_FIELDS]).astype({"seq": "int64"})

    return files.select("path", "lang", "text").mapInPandas(run, f"path string, lang string, seq long, {ROW}")
