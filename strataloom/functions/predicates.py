"""Predicates over paths, names and lines as column expressions; none is a user-defined function."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
TEST_DIRS = ["tests", "test", "__tests__", "spec", "specs"]
BUG_WORDS = ["fix", "fixed", "fixes", "fixing", "bug", "bugs", "error", "errors", "crash", "crashed", "crashes", "regression", "regressions"]
VENDOR_SEGMENTS = ["node_modules", "vendor", "third_party", "third-party", ".cargo", "bower_components"]
GENERATED_ENDS = [".pb.go", "_pb2.py", ".pb.cc", ".pb.h", ".gen.go", ".gen.ts", ".g.dart", ".freezed.dart", "_grpc.pb.go", ".g.cs"]
VENDOR_STARTS = ["node_modules/", "vendor/", "third_party/", "third-party/", ".cargo/", "bower_components/"]
VENDOR_INNER = ["/node_modules/", "/vendor/", "/third_party/", "/third-party/"]
NEXT_STEMS = ["route", "page", "layout", "loading", "error", "not-found", "template"]
CONFIG_ENDS = ["yaml", "yml", "toml", "json"]
CONFIG_SKIP_FILES = [
    ".golangci.yml", ".golangci.yaml", ".goreleaser.yml", ".goreleaser.yaml", ".eslintrc.json", ".eslintrc.yaml", ".eslintrc.yml",
    ".prettierrc.json", ".prettierrc.yaml", ".prettierrc.yml", ".stylelintrc.json", ".stylelintrc.yaml", ".stylelintrc.yml", ".babelrc.json",
    ".markdownlintrc.json", ".markdownlint.json", ".markdownlint.yaml", ".markdownlint.yml", ".travis.yml", ".travis.yaml", "dependabot.yml", "dependabot.yaml", "renovate.json",
]
CONFIG_SKIP_DIRS = [
    ".git", "node_modules", "target", "vendor", "dist", "build", ".github", ".gitlab", ".gitea", ".circleci", ".arbor", ".playwright-mcp",
    ".codegraph", ".code-review-graph", ".axon", ".gitnexus", ".gstack", ".idea", ".vscode",
]
EXTENSIONS = {
    "python": ["py"], "typescript": ["ts", "tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "go": ["go"], "rust": ["rs"],
    "java": ["java"], "kotlin": ["kt", "kts"], "csharp": ["cs"], "ruby": ["rb"], "php": ["php"],
}


def safe_ident(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_$.]+$")


def safe_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_$.:]+$") & (F.octet_length(name) <= 512)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    base = basename(path)
    return F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise("")


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def clean_path(path: Column) -> Column:
    """The path with . and .. resolved, as far as it goes."""
    step = lambda a, x: F.when((x == "") | (x == "."), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == "..", a).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def language(path: Column) -> Column:
    """The language of a path's extension; null if it is none of the ten."""
    ext = F.lower(extension(path))
    out = F.lit(None).cast("string")
    for lang, ends in EXTENSIONS.items():
        out = F.when(ext.isin(*ends), lang).otherwise(out)
    return out


def is_test_path(path: Column) -> Column:
    """Whether a path follows its language's test convention."""
    name, ext, st = basename(path), extension(path), stem(path)
    inside = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_DIRS)))
    js = st.endswith(".test") | st.endswith(".spec") | inside
    java = st.rlike(r"(Test|Tests|Spec|IT)$") | inside
    return (
        F.when(ext == "py", st.startswith("test_") | st.endswith("_test") | inside)
        .when(ext == "go", name.rlike(r".+_test\.go$"))
        .when(ext == "rs", st.endswith("_test") | inside)
        .when(ext.isin("ts", "tsx", "js", "jsx", "mjs", "cjs"), js)
        .when(ext == "java", java)
        .when(ext == "kt", java | path.rlike(r"(^|/)[^/]+Test/kotlin(/|$)"))
        .when(ext == "cs", st.rlike(r"(Test|Tests)$") | inside)
        .when(ext == "rb", st.rlike(r"(_spec|_test)$") | inside)
        .when(ext == "php", st.rlike(r"(Test|Tests)$") | inside)
        .otherwise(False)
    )


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_generated(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("/generated/") | p.startswith("generated/") | p.contains(".generated.") | _any([p.endswith(x) for x in GENERATED_ENDS])


def is_vendored(path: Column) -> Column:
    p = F.lower(path)
    return _any([p.startswith(x) for x in VENDOR_STARTS] + [p.contains(x) for x in VENDOR_INNER])


def vendored_warning(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_SEGMENTS)))


def is_framework_routed(path: Column) -> Column:
    """Whether a web framework finds the file by its place alone."""
    st = F.regexp_replace(basename(path), r"\.(tsx|ts|jsx|js|vue)$", "")
    script = F.lower(path).rlike(r"\.(tsx|ts|jsx|js)$")
    return (
        (path.rlike(r"(^|/)app(/|$)") & st.isin(*NEXT_STEMS))
        | path.rlike(r"(^|/)pages/api(/|$)")
        | (path.rlike(r"^([^/]*/)?pages(/|$)") & F.lower(path).rlike(r"\.(tsx|jsx)$"))
        | (path.rlike(r"(^|/)src/routes(/|$)") & st.startswith("+"))
        | path.rlike(r"(^|/)server/(api|routes)(/|$)")
        | (path.rlike(r"(^|/)app/routes(/|$)") & script)
    )


def is_dunder(name: Column) -> Column:
    return name.rlike(r"^__[A-Za-z0-9_]+__$")


def is_config(path: Column) -> Column:
    name = basename(path)
    skipped = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.array(*map(F.lit, CONFIG_SKIP_DIRS))) & path.contains("/")
    return ~name.isin(*CONFIG_SKIP_FILES) & ~skipped & (name.startswith(".env") | (name.contains(".") & F.substring_index(name, ".", -1).isin(*CONFIG_ENDS)))


def is_noise_doc(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"\.(md|rst|txt)$") | p.rlike(r"(^|/)docs/") | p.rlike(r"(^|/)changelog")


def has_token(text: Column, token: str) -> Column:
    """Whether text has the token with no identifier character beside it."""
    return text.rlike(r"(?<![A-Za-z0-9_])\Q" + token + r"\E(?![A-Za-z0-9_])")


def token_count(text: Column, token: str) -> Column:
    return F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])\Q" + token + r"\E(?![A-Za-z0-9_])"))


def string_has_token(line: Column, token: str) -> Column:
    """Whether a string literal of the line has the token."""
    literals = F.regexp_extract_all(line, F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)"""), F.lit(1))
    return F.exists(literals, lambda x: has_token(x, token))


def is_bug_subject(subject: Column) -> Column:
    return F.lower(subject).rlike(r"(?<![a-z0-9])(" + "|".join(BUG_WORDS) + r")(?![a-z0-9])")


def glob_matches(path: Column, glob: str) -> Column:
    """Workspace globs: exact, dir/* for one level, dir/** for any."""
    if glob.endswith("/**"):
        return path.startswith(glob[:-2])
    if glob.endswith("/*"):
        return path.startswith(glob[:-1]) & ~F.substring(path, len(glob), 1 << 20).contains("/") & (F.length(path) > len(glob) - 1)
    return path == glob


def lines(text: Column) -> Column:
    """The lines of a text; a closing line end makes no empty line."""
    text = F.regexp_replace(text, r"\r\n", "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def file_token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def shared_segments(a: Column, b: Column) -> Column:
    """How many leading path segments two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])


def identifiers(text: Column) -> Column:
    """Lower-case words of two or more identifier characters, each followed by its parts between underscores."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    parts = lambda w: F.when(w.contains("_"), F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: F.length(p) >= 2))).otherwise(F.array(w))
    return F.transform(F.flatten(F.transform(words, parts)), F.lower)


def camel_tail(name: Column) -> Column:
    return F.regexp_extract(name, r"([A-Z][^A-Z]*)$", 1)


def signature(name: Column, modifiers: Column, params: Column, return_type: Column) -> Column:
    """modifiers name(a: T = d, ...) -> type."""
    one = lambda p: F.concat(p["name"], F.when(p["type"] != "", F.concat(F.lit(": "), p["type"])).otherwise(""), F.when(p["default_value"] != "", F.concat(F.lit(" = "), p["default_value"])).otherwise(""))
    head = F.when(F.size(modifiers) > 0, F.concat(F.array_join(modifiers, " "), F.lit(" "))).otherwise("")
    tail = F.when(return_type != "", F.concat(F.lit(" -> "), return_type)).otherwise("")
    return F.concat(head, name, F.lit("("), F.array_join(F.transform(params, one), ", "), F.lit(")"), tail)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & e).cast("int")).alias("n"), (s["go"] & e).alias("go")), lambda s: s["n"])


def git_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the lines of an ignore file leave a path out; the last one that fits says so, and ! takes back."""
    out = F.lit(False)
    for line in patterns:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!")
        only_dirs, body = line.endswith("/"), line.strip("/")
        start = "^" if "/" in line.rstrip("/") else "^(?:.*/)?"
        parts = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
        regex = re.sub(r"/\*\*/|\*\*/|/\*\*|\*|\?|[^*?/]+|/", lambda m: parts.get(m[0]) or (m[0] if m[0] == "/" else re.escape(m[0])), body)
        out = F.when(path.rlike(f"{start}{regex}{'/.+' if only_dirs else '(?:/.*)?'}$"), not keep).otherwise(out)
    return out
