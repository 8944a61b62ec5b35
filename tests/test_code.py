"""Definitions with their ends, spans, targets, imports, entities, ranked search and byte ranges on
small files with known results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions import symbols
from quarry.functions import text as T
from quarry.operators import diffs, graph
from quarry.plans import index, ranked

RUST = """
impl<T: std::clone::Clone + std::str::FromStr> Flag<T> {
    pub fn parse(&self, value: &str) -> Result<T, Error> {
        match value.parse() {
            Ok(x) => Ok(x),
            Err(_) => Err(Error::new(
                ErrorKind::InvalidData,
            )),
        }
    }
}

impl Flag<String> {
    pub fn path(&self) -> String {
        if value.starts_with() {
            Err(_) => ()
        };
    }
}
"""
TRAIT = """
    pub trait Parseable {
        fn validate(&self, &str) -> Result<(), Error>;
        fn usage(&self) -> &str;
    }
    pub struct Pair {
        a: u64,
    }
    struct Unit;
    let mut x = 5;
"""


def test_definitions_and_where_they_end() -> None:
    assert list(symbols.definitions("RUST", RUST)) == [("Flag", "STRUCTURE", 1, 10), ("parse", "FUNCTION", 2, 9), ("Flag", "STRUCTURE", 12, 18), ("path", "FUNCTION", 13, 17)]
    assert list(symbols.definitions("RUST", TRAIT)) == [("Parseable", "TRAIT", 1, 4), ("validate", "FUNCTION", 2, 0), ("usage", "FUNCTION", 3, 0), ("Pair", "STRUCTURE", 5, 7), ("Unit", "STRUCTURE", 8, 0), ("x", "VARIABLE", 9, 0)]
    python = "x = 1\nclass A(B):\n    y = 2\n\n    def f(self):\n        pass\n\n\ndef g():\n\treturn 3\n"
    assert list(symbols.definitions("PYTHON", python)) == [("x", "VARIABLE", 0, 0), ("A", "STRUCTURE", 1, 5), ("y", "VARIABLE", 2, 0), ("f", "FUNCTION", 4, 5), ("g", "FUNCTION", 8, 9)]
    script = "export class A {\n  run(a, b) {\n    if (a) {\n    }\n  }\n}\nfunction f() {\n}\nconst g = (x) => {\n};\nlet y = 1;\n"
    assert list(symbols.definitions("JAVASCRIPT", script)) == [("A", "STRUCTURE", 0, 5), ("run", "FUNCTION", 1, 4), ("f", "FUNCTION", 6, 7), ("g", "FUNCTION", 8, 9), ("y", "VARIABLE", 10, 0)]
    proto = "message M {\n  repeated string a = 1;\n  int64 b = 2;\n}\n"
    assert list(symbols.definitions("PROTO", proto)) == [("M", "STRUCTURE", 0, 3), ("a", "VARIABLE", 1, 0), ("b", "VARIABLE", 2, 0)]
    assert list(symbols.definitions("OTHER", RUST)) == [] == list(symbols.definitions("RUST", ""))
    assert symbols.closing_line("(a\n(b)\n)", 0, "(", ")") == 2 and symbols.closing_line("{{}") is None
    assert symbols.block_lines(["a:", "    b", "", "\tc", "d"]) == 3 and symbols.block_lines([]) == 0


def test_spans_have_borders_and_a_bound() -> None:
    p = symbols.term_pattern(["ab", "abc"])
    assert list(symbols.spans(p, b"ab xABy\nabc_ ab")) == [(0, 0, 0, 2, True, True), (0, 0, 4, 2, False, False), (0, 1, 8, 2, True, False), (0, 1, 13, 2, True, True)]
    assert len(list(symbols.spans(p, b"ab " * 50))) == symbols.MOST_SPANS and list(symbols.spans(p, b"")) == []


def test_build_targets() -> None:
    text = '\n\nrust_library(\n    name = "test",\n    srcs = ["lib.rs"],\n)\n\nrust_binary(\n    name = "ltui",\n    srcs = ["main.rs"],\n    deps = [\n        ":test",\n        "//util/x:y",\n        "z",\n    ],\n)\n'
    got = list(symbols.targets("home/test/BUILD", text))
    assert got[0] == ("test", "//home/test", 2, ["home/test/lib.rs"], [])
    assert got[1] == ("ltui", "//home/test:ltui", 7, ["home/test/main.rs"], ["//home/test:test", "//util/x:y", "//home/test/z"])
    assert list(symbols.targets("WORKSPACE", text)) == []


def test_imports_words_and_test_files(spark: SparkSession) -> None:
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()[0]
    assert value(T.python_imports(F.lit("from a.b import c\nimport d.e\nx = 1"))) == ["a/b.py", "d/e.py"]
    assert value(T.script_imports(F.lit("import { a }, x from './u/c.js';\nimport {\n a,\n b} from 'p/q'\n"))) == ["./u/c.js", "p/q.js", "p/q.mjs", "p/q.ts", "p/q/index.js"]
    assert value(T.keywords_of(F.lit("RUST"), F.lit("let mut foo = self.barbaz in ab"))) == ["foo", "barbaz"]
    assert value(T.keywords_of(F.lit("OTHER"), F.lit("let four fives"))) == ["four", "fives"]
    names = {"a/lib_test.rs": True, "a/testing.rs": False, "a/test_x.py": True, "a/x.test.ts": True, "a/tests/x.go": True, "a/x.py": False}
    assert {n: value(T.is_test(F.lit(n))) for n in names} == names


def test_entities_and_ranked_search(spark: SparkSession) -> None:
    texts = {"src/flag.rs": RUST, "third_party/flag_use.rs": "fn main() {\n  let parse = Flag::parse();\n}\n", "src/flag_test.rs": "fn check() { Flag::parse(); }", "lib/a.py": "class Flag:\n    pass\n"}
    files = spark.createDataFrame(list(texts.items()), "filename string, content string")
    built = index.build_index(files, spark.createDataFrame([("src/flag_test.rs", "src/flag.rs")], "filename string, target string"))
    found = {(r.name, r.kind, r.line_number) for r in built["entities"].where("filename = 'src/flag.rs'").collect()}
    assert found == {("Flag", "STRUCTURE", 1), ("Flag::parse", "FUNCTION", 2), ("Flag", "STRUCTURE", 12), ("Flag::path", "FUNCTION", 13)}
    rows = [(r["filename"], r["score"], r["start"]) for r in ranked.search(built, "flag parse").collect()]
    assert [r[0] for r in rows] == ["src/flag.rs", "src/flag_test.rs", "third_party/flag_use.rs"] or rows[0][0] == "src/flag.rs" and len(rows) == 3
    assert {r.filename for r in ranked.search(built, "flag lang:python").collect()} == {"lib/a.py"}
    assert {r.filename for r in ranked.search(built, "flag in:third").collect()} == {"third_party/flag_use.rs"}
    assert {r.filename for r in ranked.search(built, "parse f:test").collect()} == {"src/flag_test.rs"}
    assert {r.filename for r in ranked.search(built, "def:flag").collect()} >= {"src/flag.rs", "lib/a.py"}
    # the score of one file by hand: both terms in the text; the name has flag; 2 structures and a function defined
    q = ranked.parse("flag parse")
    c = ranked.verified(ranked.remaining(ranked.candidates(built, q), q), built["files"], q).where("filename = 'src/flag.rs'")
    r = ranked.score(c, q).first()
    assert (r.definite, r.border, r.complete, r.n_matches, r.position) == (3, 3, 3, 1, 8) and sorted(r.occurrences) == [2, 2]
    named = 10 + 100 * 4 / 11 + 10 + 50 * 8 / 11
    assert r.score == pytest.approx(2 * 12 + named + 10 * math.log2(r.page_rank) + 100 + 10 * 2 + 5 * 2 - 0.25 * 11)
    entity = built["entities"]
    assert {r.name for r in ranked.entities_for(entity, ranked.parse("parse")).collect()} == {"Flag::parse"}
    assert [r.keyword for r in ranked.suggested_entities(entity, ranked.parse("x fl")).collect()] == sorted(r.keyword for r in ranked.suggested_entities(entity, ranked.parse("fl")).collect())
    assert ranked.suggested_entities(entity, ranked.parse("def:fl")).count() == 0


def test_byte_ranges_are_applied(spark: SparkSession) -> None:
    rng = random.Random(4)
    pairs = [("a\nb\nc\nd\n", "a\nd\n"), ("a\nb\nc\nd\n", "z\na\nd\ne\nf\n"), ("", "z\na\n"), ("x", ""), ("é\n", "è\n\n"), ("a\r\nb", "a\nb")]
    pairs += [("".join(rng.choice("ab\n") for _ in range(rng.randint(0, 30))), "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 30)))) for _ in range(200)]
    for a, b in pairs:
        assert diffs.patched(a.encode(), diffs.byte_ranges(a.encode(), b.encode())) == b.encode()
    assert diffs.patched(b"\xff\x00", diffs.byte_ranges(b"\xff\x00", b"\xfe")) == b"\xfe"
    with pytest.raises(ValueError):
        diffs.patched(b"a", [(0, 5, "removed", b"")])
    given = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, old string, new string")
    made = diffs.byte_diffs(given, "old", "new", ["id", "old"])
    got = {r.id: bytes(r.data).decode() for r in diffs.apply_byte_diffs(made, "old", ["id"]).collect()}
    assert got == {i: b for i, (_, b) in enumerate(pairs)}


def test_versions_and_file_edges(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("NEW", 1, "a"), ("NEW", 2, "b")], "status string, id long, title string")
    updates = spark.createDataFrame([(1, "OPEN", 1), (1, "DONE", 2), (9, "OPEN", 1)], "id long, status string, at long")
    assert {tuple(r) for r in diffs.moved(rows, updates).collect()} == {("DONE", 1, "a"), ("NEW", 2, "b")}
    paths = spark.createDataFrame([("p",), ("q",)], "path string")
    files, blobs = spark.createDataFrame([("p", "s1")], "path string, sha string"), spark.createDataFrame([("s1", "d")], "sha string, data string")
    assert [tuple(r) for r in diffs.blobs_by_path(paths, files, blobs).collect()] == [("p", "s1", "d")]
    with pytest.raises(KeyError):
        diffs.blobs_by_path(paths, files, blobs, strict=True)
    configs = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 1, "z")], "name string, at long, config string")
    assert {tuple(r) for r in diffs.registry(configs, "name", "at").collect()} == {("a", 2, "y"), ("b", 1, "z")}
    assert {(r["name"], r["version"]) for r in diffs.published(configs, "name", "at").collect()} == {("a", 1), ("a", 2), ("b", 1)}
    sources = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c"), ("u", "a")], "target string, file string")
    edges = graph.file_edges(sources, spark.createDataFrame([("t", "u")], "target string, needs string"))
    assert {tuple(r) for r in edges.collect()} == {("a", "c"), ("b", "c"), ("b", "a")}
