"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from quillspark import registry
from quillspark.operators import search

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    ours = rows(found.columns, [tuple(r) for r in found.collect()])
    if name in registry.oracle_sql():
        result = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(found.columns)
        assert ours == rows(names, result.fetchall())


@pytest.mark.parametrize("name", ["eval_compare_summary", "eval_compare_reports"])
def test_runs_compared_over_more_vectors_than_a_slice(spark, monkeypatch, tmp_path, name):
    n = search.SLICE + 300
    rng = np.random.default_rng(5)
    points = rng.normal(size=(n, 8)).round(2)
    points[1::1598] = points[2::1598] = points[::1598]  # copies of every other query, of which the least id comes first
    labels = rng.integers(0, 10, n).tolist()
    table = [(i * 100 + (7 if i % 799 else 0), p.tolist(), label) for i, (p, label) in enumerate(zip(points, labels))]  # every 799th is a query
    made = search.best_of

    def few(*args):
        run = made(*args)

        def within(left, right):
            if len(left) > 1.2 * search.BUNDLE or len(right) > 1.2 * search.QUERY_BLOCK:
                raise ValueError("a cell of too many vectors or queries")
            return run(left, right)

        return within

    monkeypatch.setattr(search, "best_of", few)
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    ours = rows(found.columns, [tuple(r) for r in found.collect()])
    assert ours == rows([d[0] for d in result.description], result.fetchall())
    assert name == "eval_compare_summary" or len({r.change for r in found.collect()}) > 2


PAGE = '<!DOCTYPE html><html lang="en"><head><title>T</title></head><body><nav><ul><li><a href="/x">%s</a></li></ul></nav><article><h1>T</h1>%s</article></body></html>'
MENUS = [PAGE % ("this", ""), PAGE % ("of", ""), PAGE % ("Here", "")]
ODD = [
    *MENUS,
    PAGE % ("", '<h1></h1><img><img src="b.png" alt="picture of it"><table><tr><td>1</td></tr></table><div role="worse" aria-label=""></div><i id="e">x</i><i id="e">y</i><a href="#gone">of</a>'),
    PAGE % ("of", '<h2 id="nowhere">Deep</h2><p id="d">x'),
    PAGE.replace(' lang="en"', "").replace("h1>", "h4>") % ("of", ""),
    PAGE.replace("</body></html>", "") % ("of", "") + "<!-- no end",
    PAGE.replace("</article></body></html>", "") % ("of", "") + "<figure><a title='no end",
    "<script>no end",
    "no markup",
    "",
    None,
]


@pytest.mark.parametrize(("kinds", "more"), [(MENUS, []), (ODD, [(None, "<p>x</p>")])], ids=["menus", "odd"])
def test_accessibility_counts_of_pages_with_issues_of_their_own(spark, tmp_path, kinds, more):
    name = "page_accessibility_counts"
    pages = [(i, kinds[i // 660]) for i in range(660 * len(kinds))] + more  # every fault, and some pages without any, on each kind
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "vector_rank", "graph_rank", "retrieval_source", "score", "rank"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
