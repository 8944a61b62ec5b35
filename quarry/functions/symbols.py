"""What a source file defines, where terms occur in it, and the build targets it declares.

Where a definition ends depends on nested braces or on indentation, which no column expression says;
so these are small functions of one text, run in Arrow batches over the files of each task."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.batches import in_arrow

#: How a definition's last line is found: braces after the match, braces only if one opens on the
#: same line, braces only if one opens before a statement or block ends, or indentation.
BRACES, ON_LINE, IF_BODY, INDENTED = "braces", "on line", "if body", "indented"


class Rule(NamedTuple):
    pattern: re.Pattern
    kind: str
    end: str | None = None
    #: where the search for braces begins, from the end of the match
    skip: int = 1
    #: whether a match ends the line's search
    last: bool = False
    #: groups that may hold the name, the first that matched; 0: the pattern's last group
    names: tuple[int, ...] = (0,)
    #: names that end the line's search without a definition
    never: tuple[str, ...] = ()


def _rule(pattern: str, kind: str, *rest: object, **more: object) -> Rule:
    return Rule(re.compile(pattern), kind, *rest, **more)


# What begins a definition, by language, in the order in which a line is searched.
RULES = {
    "RUST": [
        _rule(r"\s*(pub)?\s*(struct|enum|type)\s+(\w+)", "STRUCTURE", ON_LINE),
        _rule(r"\s*(pub)?\s*fn\s+(\w+)", "FUNCTION", IF_BODY),
        _rule(r"\s*impl(<.*?>)?\s+(\w+)(<.*?>)?(\s+for\s+(\w+))?", "STRUCTURE", IF_BODY, names=(5, 2)),
        _rule(r"\s*let\s*(mut)?\s+(\w+)", "VARIABLE"),
        _rule(r"\s*(pub)?\s*trait\s+(\w+)", "TRAIT", BRACES),
    ],
    "PYTHON": [
        _rule(r"\s*class\s+(\w+)[\(:]", "STRUCTURE", INDENTED),
        _rule(r"\s*def\s*(\w+)\(", "FUNCTION", INDENTED),
        _rule(r"\s*(\w+)\s+=\s+", "VARIABLE"),
    ],
    "JAVASCRIPT": [
        _rule(r"^\s*(export\s)?\s*(default\s)?\s*(const|let|var|static)?\s*(\w+)\s*[=:]\s*\([\w\s,=]*\)\s*[=-]>\s*\{", "FUNCTION", BRACES, -2, last=True),
        _rule(r"(\w+)\s*:", "VARIABLE"),
        _rule(r"\s*(export\s)?\s*(default\s)?\s*(class)\s+(\w+)", "STRUCTURE", ON_LINE, last=True),
        _rule(r"\s*(export\s)?\s*(default\s)?\s*(function)\s+(\w+)", "FUNCTION", BRACES, -2, last=True),
        _rule(r"^\s*(\w+)\([\w\s,=]*\)\s*\{", "FUNCTION", BRACES, -2, last=True, never=("for", "while", "if")),
        _rule(r"\s*(export\s)?\s*(default\s)?\s*(const|let|var|static)\s+(\w+)", "VARIABLE"),
    ],
    "PROTO": [
        _rule(r"^\s*message\s+(\w+)", "STRUCTURE", BRACES),
        _rule(r"^\s*(repeated\s)?\s*(\w+)\s+(\w+)\s*=", "VARIABLE"),
    ],
}
_BRACE, _STOP = re.compile("[\n{}]"), re.compile("[;{}]")


def closing_line(text: str, start: int = 0, opening: str = "{", closing: str = "}") -> int | None:
    """Lines from `start` to where as many braces have closed as opened; None if that never is."""
    sign = _BRACE if (opening, closing) == ("{", "}") else re.compile(f"[\n{re.escape(opening + closing)}]")
    line = depth = 0
    for m in sign.finditer(text, start):
        if m[0] == "\n":
            line += 1
        elif m[0] == opening:
            depth += 1
        else:
            depth -= 1
            if not depth:
                return line
    return None


def _indent(line: str) -> int:
    blank = line[: len(line) - len(line.lstrip("\t "))]
    return len(blank) + 7 * blank.count("\t")


def block_lines(lines: list[str], first: int = 0) -> int:
    """Lines after line `first` that are indented deeper than it, up to the last before one that
    isn't; blank lines count if deeper ones follow."""
    size = 0
    if lines:
        own = _indent(lines[first])
        for i, line in enumerate(islice(lines, first + 1, None), 1):
            if line.strip():
                if _indent(line) <= own:
                    break
                size = i
    return size


def _end(rule: Rule, text: str, lines: list[str], number: int, begin: int, found: int) -> int:
    """The last line's number of a definition whose line begins at `begin` and whose match ends at
    `found`; 0 where there is none."""
    line = lines[number]
    if rule.end == INDENTED:
        return number + block_lines(lines, number)
    if rule.end == ON_LINE and "{" not in line[found - begin :]:
        return 0
    if rule.end == IF_BODY and ((m := _STOP.search(text, found)) is None or m[0] != "{"):
        return 0
    down = closing_line(text, max(0, found + rule.skip))
    return number + down if down is not None else 0


def definitions(kind: str, text: str) -> Iterator[tuple[str, str, int, int]]:
    """(symbol, its kind, line, last line or 0), lines from 0, in the order of the file."""
    lines, begin = text.split("\n"), 0
    for number, line in enumerate(lines):
        for rule in RULES.get(kind, ()):
            done = False
            for m in rule.pattern.finditer(line):
                name = next((m[g] for g in rule.names if m[g]), None) if rule.names != (0,) else m[m.re.groups]
                if name not in rule.never:
                    yield name, rule.kind, number, _end(rule, text, lines, number, begin, begin + m.end()) if rule.end else 0
                if rule.last:
                    done = True
                    break
            if done:
                break
        begin += len(line) + 1


def file_definitions(files: DataFrame) -> DataFrame:
    """(filename, file_type, content) to (filename, symbol, symbol_type, line_number,
    end_line_number); null contents define nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(n, *d) for n, k, t in zip(*(part.column(c).to_pylist() for c in ("filename", "file_type", "content")), strict=True) for d in definitions(k, t or "")]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["filename", "symbol", "symbol_type", "line_number", "end_line_number"])

    return files.select("filename", "file_type", "content").mapInArrow(run, "filename string, symbol string, symbol_type string, line_number int, end_line_number int")


#: Fixed value: occurrences of a term that are noted in a text.
MOST_SPANS = 10
_WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def term_pattern(terms: list[str]) -> re.Pattern:
    """All terms, in either case of ASCII letters, and line ends; of several at a place the first."""
    return re.compile(b"(\n)" + b"".join(b"|(" + re.escape(t.encode()) + b")" for t in terms), re.I)


def spans(pattern: re.Pattern, data: bytes) -> Iterator[tuple[int, int, int, int, bool, bool]]:
    """(term, line, first byte, bytes, border, complete) of the first MOST_SPANS occurrences of
    each term: border if one of its ends isn't inside a word, complete if neither is."""
    line, left, seen = 0, pattern.groups - 1, [0] * (pattern.groups + 1)
    for m in pattern.finditer(data):
        if not left:
            return
        if m.lastindex == 1:
            line += 1
            continue
        seen[m.lastindex] += 1
        if seen[m.lastindex] > MOST_SPANS:
            continue
        left -= seen[m.lastindex] == MOST_SPANS
        a, b = m.span()
        first, last = a == 0 or data[a - 1] not in _WORD, b == len(data) or data[b] not in _WORD
        yield m.lastindex - 2, line, a, b - a, first or last, first and last


SPAN = "array<struct<term: int, line: int, start: long, size: int, border: boolean, complete: boolean>>"


_KIND = pa.list_(pa.struct([("term", pa.int32()), ("line", pa.int32()), ("start", pa.int64()), ("size", pa.int32()), ("border", pa.bool_()), ("complete", pa.bool_())]))


def _found(pattern: re.Pattern, texts: pa.Array) -> pa.Array:
    return pa.array([list(spans(pattern, t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in texts], _KIND)


def spans_of(content: str, terms: list[str]) -> Column:
    """The spans of each text as a column: all else in its row stays where it is. Called not
    deterministic, since a filter on it would look into each text once more."""
    pattern = term_pattern(terms)

    def read(texts: pa.Array) -> pa.Array:
        return _found(pattern, texts)

    return F.arrow_udf(read, SPAN).asNondeterministic()(content)


def with_spans(texts: DataFrame, key: str, content: str, terms: list[str]) -> DataFrame:
    """(key, spans) of each text; terms in their order of preference, none of them empty."""
    pattern = term_pattern(terms)
    of_key = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), _found(pattern, batch.column(content))], names=[key, "spans"])

    return in_arrow(texts.select(key, content), run, f"{key} {of_key}, spans {SPAN}")


# What declares a build target, its sources and what it depends on.
TARGET = re.compile(r'\w+\((?s:[^)]*?name\s*=\s*"(\w+)".*?)\)')
SOURCES, NEEDS = (re.compile(rf"{word}\s*=\s*\[((?s:.*?))\]") for word in ("srcs", "deps"))


class Target(NamedTuple):
    name: str
    canonical_name: str
    line_number: int
    files: list[str]
    dependencies: list[str]


def _items(pattern: re.Pattern, text: str) -> Iterator[str]:
    for listed in pattern.findall(text):
        yield from filter(None, (re.sub(r'^[\s"]+|[\s"]+$', "", x) for x in listed.split(",")))


def targets(filename: str, text: str) -> Iterator[Target]:
    """The targets of a build file. A target named as its folder is known by the folder alone."""
    folder = filename.rpartition("/")[0]
    own = f"//{folder}"
    for m in TARGET.finditer(text) if filename != "WORKSPACE" else ():
        needs = [own + x if x.startswith(":") else x if x.startswith("//") else f"{own}/{x}" for x in _items(NEEDS, m[0])]
        known = own if folder and folder.rpartition("/")[2] == m[1] else f"{own}:{m[1]}"
        yield Target(m[1], known, text.count("\n", 0, m.start()), [f"{folder}/{x}" for x in _items(SOURCES, m[0])], needs)


def build_targets(files: DataFrame) -> DataFrame:
    """(filename, content) of build files to filename and a target's fields."""
    names = ["filename", *Target._fields]
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *x) for n, t in zip(batch.column("filename").to_pylist(), batch.column("content").to_pylist(), strict=True) for x in targets(n, t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("filename", "content").mapInArrow(run, "filename string, name string, canonical_name string, line_number int, files array<string>, dependencies array<string>")
