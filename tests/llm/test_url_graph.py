"""Trust and distrust against a dense matrix, and the SQL on a linked graph."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.llm import urls


def dense(n: int, edges: set[tuple[int, int]], seed: np.ndarray, damping: float) -> np.ndarray:
    """Personalised PageRank whose dangling mass goes back to the seeds, by its fixed point."""
    m = np.zeros((n, n))
    for a, b in edges:
        m[b, a] = 1
    n_out = m.sum(0)
    v = seed / seed.sum()
    p = np.where(n_out > 0, m / np.maximum(n_out, 1), v[:, None])
    return np.linalg.solve(np.eye(n) - damping * p, (1 - damping) * v)


def test_scores_equal_a_dense_page_rank(spark: SparkSession) -> None:
    rng, n = random.Random(7), 300
    edges = {(rng.randrange(n), rng.randrange(60)) for _ in range(900)} | {(rng.randrange(60), rng.randrange(n)) for _ in range(300)}
    edges = {(a, b) for a, b in edges if a != b and a % 9}  # hosts divisible by 9 have no way out
    trust, distrust = (np.array([float(rng.random() < 0.1) * rng.randint(1, 5) for _ in range(n)]) for _ in range(2))
    hosts = spark.createDataFrame([(f"h{i}", float(trust[i]), float(distrust[i])) for i in range(n) if i % 3 or trust[i] or distrust[i]], "host string, trust0 double, distrust0 double")
    links = spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in edges], "src string, dst string")
    got = {int(r.host[1:]): (r.trust, r.distrust) for r in urls.host_scores(hosts, links, rounds=40, damping=0.6).collect()}
    want = dense(n, edges, trust, 0.6), dense(n, {(b, a) for a, b in edges}, distrust, 0.6)
    for i, (t, d) in got.items():
        assert t == pytest.approx(want[0][i], abs=1e-7) and d == pytest.approx(want[1][i], abs=1e-7)
    assert sum(t for t, _ in got.values()) == pytest.approx(1) == sum(d for _, d in got.values())


def pages(n: int = 1500) -> list[tuple]:
    rng, rows = random.Random(8), [(10**6, None, None), (10**6 + 1, "", "<a href='http://x.org/'>"), (10**6 + 2, "no scheme", None), (10**6 + 3, "http:///x", "")]
    for i in range(n):
        host = f"{rng.choice(['', 'www.', 'm.a.'])}{rng.choice('abcdefghijkl')}.example.{rng.choice(['com', 'net', 'org', 'co.uk'])}"
        path = rng.choice(["/en/1", "/es/2", "/fr/3", "/de/4", ""])
        links = "".join(f'<a href="https://{rng.choice("ABCDEFGHIJKLMNOP")}.example.{rng.choice(["com", "net", "org"])}/x">' for _ in range(rng.choice([0, 0, 1, 3])))
        rows.append((i, f"http://{host}{path}", links if rng.random() < 0.9 else None))
    return [*rows, *rows[:40]]


def test_sql_on_a_linked_graph(spark: SparkSession) -> None:
    rows = pages()
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = urls.judged(given.withColumns({c: F.lit("own") for c in ("host", "path", "rule", "ruled", "bad", "src")}))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    con = duckdb.connect()
    arrow = given.toArrow()  # noqa: F841
    con.execute("create view pages as select * from arrow")
    want = sorted(con.execute(urls.OP4_SQL).fetchall(), key=repr)
    assert got == want and len(got) == len(rows)
    by = [r[4] for r in got if r[5]]
    assert len(by) > 200 and {"allow", "block"} == set(by)  # the propagation decides these


def test_host_tree_ends_at_registered_domains(spark: SparkSession) -> None:
    hosts = [("a.b.example.com",), ("x.example.co.uk",), ("example.com",), ("localhost",), ("10.0.0.1",), ("a..b.com",), ("",)]
    found = {tuple(r) for r in urls.host_tree(spark.createDataFrame(hosts, "host string")).collect()}
    up = {("a.b.example.com", "b.example.com"), ("b.example.com", "example.com"), ("x.example.co.uk", "example.co.uk")}
    assert found == up | {(b, a) for a, b in up}
