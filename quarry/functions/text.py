"""Text and path functions as column expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types by the end of the name.
FILE_TYPES = {".rs": "RUST", ".html": "HTML", ".htm": "HTML", ".proto": "PROTO", ".js": "JAVASCRIPT", ".ts": "JAVASCRIPT", ".mjs": "JAVASCRIPT", "BUILD": "BAZEL", ".py": "PYTHON", ".h": "C", ".c": "C", ".hpp": "CPP", ".cpp": "CPP"}
#: Lines, in a result, of a snippet; characters of one.
SNIPPET_LINES, SNIPPET_WIDTH = 7, 144


def normalized(word: Column) -> Column:
    """Lower case without _ and -."""
    return F.translate(F.lower(word), "_-", "")


def trigrams(line: Column) -> Column:
    """All runs of three characters; none of shorter texts. One pass of a regular expression: a
    substring for each place would walk the text anew each time. The second half of a surrogate
    pair begins nothing."""
    return F.regexp_extract_all(line, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))"), F.lit(1))


def tokens(text: Column, least: int = 4, stop: list[str] | None = None) -> Column:
    """Runs of letters, digits and _ of at least so many bytes, without stop words."""
    words = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}_]+"), lambda w: F.octet_length(w) >= least)
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def file_type(name: Column) -> Column:
    out = F.when(name == "WORKSPACE", "BAZEL").otherwise("OTHER")
    for suffix, kind in reversed(FILE_TYPES.items()):
        out = F.when(name.endswith(suffix), kind).otherwise(out)
    return out


# Names of test files, by the language of the file.
TEST_NAMES = {"RUST": r"tests?\.rs$", "PYTHON": r"__tests__|/tests/|/__snapshots__|/test_|\.ambr$", "JAVASCRIPT": r"\.jest\.js$|-test\.js$|-jest\.js$|\.test\.js$|\.test\.ts$|\.snap$|\.ambr$|/__tests__|/__snapshots__|_test/"}
OTHER_TESTS = r"__tests__|/tests/|__snapshots__"


def is_test(name: Column) -> Column:
    kind, out = file_type(name), name.rlike(OTHER_TESTS)
    for language, pattern in TEST_NAMES.items():
        out = F.when(kind == language, name.rlike(pattern)).otherwise(out)
    return out


def file_id(name: Column) -> Column:
    """A 64-bit id as text."""
    return F.xxhash64(name).cast("string")


# Words that aren't indexed, and the least bytes of one that is, by language.
STOP_WORDS = {
    "RUST": ["let", "mut", "for", "in", "while", "if", "self", "ref", "pub", "extern", "return"],
    "PYTHON": ["class", "def", "super", "import", "in", "is", "not", "or", "None", "from", "for", "self", "return", "if", "elif", "raise"],
    "PROTO": ["message", "string", "enum", "int", "bool", "int64", "int32", "uint64", "uint32", "repeated", "syntax", "rpc", "service", "returns"],
}


def keywords_of(kind: Column, text: Column) -> Column:
    """Words of a file of a type that are indexed."""
    out = tokens(text)
    for language, stop in STOP_WORDS.items():
        out = F.when(kind == language, tokens(text, 3, stop)).otherwise(out)
    return out


def is_ugly(content: Column) -> Column:
    """More than 200 bytes a line on average: generated or packed."""
    return F.octet_length(content) > 200 * F.size(F.split(content, "\n"))


def snippet(content: Column, line: Column) -> Column:
    """Seven lines from one on, each cut at 144 characters, blank ones at the head dropped."""
    cut = F.transform(F.slice(F.split(content, "\n"), line + 1, F.lit(SNIPPET_LINES)), lambda x: F.left(x, F.lit(SNIPPET_WIDTH)))
    full = F.filter(F.transform(cut, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(full) > 0, F.slice(cut, full[0] + 1, F.size(cut))).otherwise(F.array().cast("array<string>"))


def middle_cut(s: Column, width: int) -> Column:
    """Longer texts as their two ends with ... between, `width` characters, the odd one at the end."""
    side = (width - 3) // 2
    return F.when(F.length(s) > width, F.concat(F.left(s, F.lit(side)), F.lit("..."), F.right(s, F.lit(side + (width - 3) % 2)))).otherwise(s)


def parent_directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalized_path(path: Column) -> Column:
    """One leading slash, none doubled, none at the end."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", ""))


def path_depth(path: Column) -> Column:
    return F.size(F.split(F.regexp_replace(path, "^/|/$", ""), "/"))


def html_escaped(s: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s


def first_line(description: Column) -> Column:
    """A change's summary: its first line that isn't blank."""
    lines = F.filter(F.transform(F.split(description, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def squeezed(description: Column) -> Column:
    """A change's text with single blank lines and none at its ends."""
    return F.trim(F.regexp_replace(description, "\n{3,}", "\n\n"))


def query_argument(query: Column, name: str) -> Column:
    """A decoded argument of a query string; null where it is missing."""
    return F.try_url_decode(F.element_at(F.str_to_map(query, F.lit("&"), F.lit("=")), name))


def python_imports(content: Column) -> Column:
    """Dotted imports as file paths."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\s*(?:from\s+(\S+)\s+import|import\s+(\S+))"), F.lit(0))
    names = F.transform(found, lambda x: F.regexp_extract(x, r"^\s*(?:from|import)\s+(\S+)", 1))
    return F.transform(names, lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".py")))


def script_imports(content: Column) -> Column:
    """Imported files; a name without one of the endings stands for each file that it may mean."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\s*import\s(?:[^']*?)from\s+'([^']+)'"), F.lit(1))
    each = lambda x: F.when(x.rlike(r"\.(m?js|ts)$"), F.array(x)).otherwise(F.array(*(F.concat(x, F.lit(e)) for e in (".js", ".mjs", ".ts", "/index.js"))))
    return F.flatten(F.transform(found, each))
