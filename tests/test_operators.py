"""Operators on small fixtures with known results."""

import json
import zipfile

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import chunk, context, conversation, evaluate, markup, quality, retrieve, search, sync
from quillspark.sources import files
from quillspark.sources import store as versions
from quillspark.streaming import sync as stream


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] or [(1,)], list(values) or ["x"]).select(column.alias("v")).first().v


# ---- functions


def test_text_functions(spark):
    assert one(spark, T.jtrim("a"), a="\t\n x y \x01") == "x y"
    assert one(spark, T.keywords("a"), a="덕수궁의 돌담길은 어디에서? The path, the PATH x") == ["덕수궁", "돌담길", "어디", "the", "path"]
    assert one(spark, T.normalize_match("a"), a="1. A-b  『C』!") == "1abc"
    assert one(spark, T.abbreviate("a", 5), a=" ab\r\ncd ef") == "ab cd..."
    assert one(spark, T.normalize_path("a"), a=" x\\y\\z.xhtml ") == "x/y/z.xhtml" and one(spark, T.normalize_path("a"), a="  ") is None
    assert [one(spark, T.source_type("a"), a=n) for n in ("x/nav.xhtml", "a_nav.xhtml", "c.xhtml", "c.opf", "c.bin")] == ["NAV", "NAV", "XHTML", "OPF", "UNKNOWN"]
    assert one(spark, T.media_source_type(F.col("a")), a="text/html; charset=utf-8") == "HTML"
    assert one(spark, T.rerank_weight("a"), a="그 장소는?") == 0.58 and one(spark, T.rerank_weight("a"), a="x") == 0.30


def test_lexical_boost(spark):
    boost = T.lexical_boost(F.col("q"), T.keywords("q"), F.col("t"), F.col("c"))
    assert abs(one(spark, boost, q="old palace wall", t="Palace", c="the palace wall") - (0.18 + 0.06 + 0.08 + 0.05)) < 1e-12
    assert one(spark, boost, q="책의 제목", t="x", c="『제목』") == pytest.approx(0.04 + 0.10)
    assert one(spark, boost, q="nothing here", t="", c="") == 0


def test_vector_functions(spark):
    a, b, zero = [3.0, 4.0], [4.0, 3.0], [0.0, 0.0]
    assert one(spark, V.cosine("a", "b"), a=a, b=b) == pytest.approx(0.96) and one(spark, V.cosine("a", "b"), a=a, b=zero) == 0
    assert one(spark, V.euclidean_score("a", "b"), a=a, b=a) == 1 and one(spark, V.manhattan("a", "b"), a=a, b=b) == 2
    assert one(spark, V.normalize("a"), a=a) == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="zero vector"):
        one(spark, V.normalize("a"), a=zero)


# ---- search and store


def test_topk_ties_zero_vectors_and_blocks(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)], i % 2) for i in range(12)] + [(50, [0.0, 0.0], 0)], "vec_id long, embedding array<double>, side int")
    found = search.topk(rows, rows.where("vec_id in (1, 50)"), 4, block=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in found] == [(1, 4, 1), (1, 7, 2), (1, 10, 3), (1, 2, 4), (50, 0, 1), (50, 1, 2), (50, 2, 3), (50, 3, 4)]
    scoped = search.topk(rows, rows.where("vec_id = 1"), 4, scope_col="side").orderBy("rank").collect()
    assert [r.id for r in scoped] == [7, 5, 11, 3]
    lost = rows.withColumn("side", F.when(F.col("vec_id") > 2, F.col("side"))).withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert {r.query_id for r in search.topk(lost, lost.where("vec_id in ('v1', 'v3', 'v4')"), 4, scope_col="side").collect()} == {"v3", "v4"}  # no scope, no results
    assert search.topk(rows, rows.where("vec_id = 50"), 4, minimum=0.0001).count() == 0
    assert search.topk(rows, rows.where("vec_id < 0"), 4).count() == 0
    assert search.topk(spark.createDataFrame([(9, [1.0])], "vec_id long, embedding array<double>"), rows.where("vec_id = 1"), 1).isEmpty()  # of another dimension


def brute_topk(vectors, queries, k, measure, minimum=None):
    out = []
    for q, w in queries:
        same = [(i, v) for i, v in vectors if w is not None and v is not None and len(v) == len(w) and i != q]
        if same:
            found = np.round(search.scores(np.array([v for _, v in same]), np.array([w]), measure)[:, 0], 9)
            best = sorted((-s, i) for (i, _), s in zip(same, found) if minimum is None or s >= minimum)[:k]
            out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


def spread_vectors(n=600, d=6):
    """Clusters, some far out, with zero vectors, many equal ones and ties."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, d)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=d) * 0.2).round(3).tolist()) for i in range(n)]
    return rows + [(n + i, [0.0] * d) for i in range(5)] + [(n + 10 + i, [1.0] * d) for i in range(120)] + [(n + 200, (centres[3] * 9).tolist())]


@pytest.mark.parametrize("measure", search.MEASURES)
def test_pruned_search_is_exact_and_skips(spark, measure):
    rows = spread_vectors()
    asked = rows[::40] + rows[601:603] + rows[611:613] + [rows[-1]]
    table, wanted = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, asked))
    report = {}
    for minimum in (None, 0.9 if measure == "cosine" else 0.4):
        found = search.topk(table, wanted, 7, measure, minimum=minimum, slice_size=32, block=4, report=report)
        got = sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect())
        assert got == brute_topk(rows, asked, 7, measure, minimum)
    assert 0 < report["met"] < 2 * report["all"]
    if measure in ("euclidean", "cosine"):
        close = [r for r in asked if r[0] < 600]
        report = {}
        search.topk(table, spark.createDataFrame(close, wanted.schema), 7, measure, slice_size=32, report=report).collect()
        assert report["met"] < 0.5 * report["all"]  # over half of the cells are skipped


def test_pruned_search_sends_a_query_once_to_a_bundle(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(2000)]  # without clusters, so that queries meet most rings
    asked, sent = rows[::5], []
    monkeypatch.setattr(search, "cut", lambda df, cut=search.cut: sent.append(cut(df)) or sent[-1])
    table, wanted = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, asked))
    report = {}
    found = search.topk(table, wanted, 7, "euclidean", slice_size=8, block=4, report=report)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect()) == brute_topk(rows, asked, 7, "euclidean")
    assert report["met"] > 0.3 * report["all"] > 10_000
    assert max(t.count() for t in sent) <= 7 * len(asked)  # one row for each query's bundle or result


@pytest.mark.parametrize("measure", search.MEASURES)
def test_rings_over_many_bundles(spark, monkeypatch, measure):
    monkeypatch.setattr(search, "BUNDLE", 50)
    monkeypatch.setattr(search, "TILE", 16)
    rows = spread_vectors(200)
    asked = rows[::20] + rows[201:203] + rows[211:213]
    table, wanted = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, asked))
    found = search.topk(table, wanted, 7, measure, slice_size=32)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect()) == brute_topk(rows, asked, 7, measure)


@pytest.mark.parametrize("measure", ["cosine", "manhattan"])
def test_pruned_search_sends_few_copies_at_once_and_has_one_pool_of_workers(spark, monkeypatch, measure):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).round(3).tolist()) for i in range(3000)]  # without clusters, so that queries meet most rings
    asked = rows[::10]
    table, wanted = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (rows, asked))

    def checked(run):
        def within(batches):
            for batch in run(batches):
                if len(batch.column(1).flatten()) > 2**19:
                    raise ValueError("too many copies at once")
                yield batch

        return within

    monkeypatch.setattr(search, "BUNDLE", 25)
    monkeypatch.setattr(type(table), "mapInArrow", lambda self, run, schema, put=type(table).mapInArrow: put(self, checked(run), schema))
    found = search.topk(table, wanted.coalesce(1), 7, measure, slice_size=32)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect()) == brute_topk(rows, asked, 7, measure)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()  # rows from Python, which need Python workers of their own


@pytest.mark.parametrize("measure", search.MEASURES)
def test_a_cell_of_any_size_is_searched_in_little_memory(measure):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    table = lambda n: pa.table({"id": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=4 * n)), 4).cast(pa.list_(pa.float64()))})
    left, right = table(30_000), table(300)
    tracemalloc.start()
    found = search.best_of(3, measure, None, True)(left, right)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(found) == 900
    assert peak < 30  # MB; scores of all pairs take 72


def test_search_over_mixed_dimensions_and_nulls(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 0.0]), (4, None), (5, [1.0, 0.1, 0.0]), (6, [2.0, 0.1]), (7, None), (8, [3.0])]
    table = spark.createDataFrame([(i, v, "s" if i % 2 else None) for i, v in rows], "vec_id long, embedding array<double>, scope string")
    got = lambda found: sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect())
    assert got(search.topk(table, table, 3)) == brute_topk(rows, rows, 3, "cosine")
    for i in (1, 3, 4):
        assert got(search.topk(table, table.where(F.col("vec_id") == i), 3)) == brute_topk(rows, [r for r in rows if r[0] == i], 3, "cosine")
    assert got(search.topk(table, table, 3, scope_col="scope")) == brute_topk([r for r in rows if r[0] % 2], [r for r in rows if r[0] % 2], 3, "cosine")


def test_filters(spark):
    rows = spark.createDataFrame([(1, "m", "en-US", {"a": "1"}, [1.0]), (2, "m", "de", {"a": "1"}, [1.0]), (3, "n", "en_us", {}, [1.0])], "id int, model string, language string, metadata map<string,string>, embedding array<double>")
    ids = lambda **k: sorted(r.id for r in rows.where(search.matches(**k)).collect())
    assert ids(language=["en_US"]) == [1, 3] and ids(model="m", metadata={"a": "1"}) == [1, 2] and ids(dimensions=2) == []


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "m", 1, 5), ("p", 2, "m", 1, 6)], "project_id string, id int, model string, version int, indexed_at int")
    new = spark.createDataFrame([("p", 1, "m", 3, 9), ("p", 1, "m", 2, 8)], rows.schema)
    assert sorted(map(tuple, search.upsert(rows, new).collect())) == [("p", 1, "m", 3, 9), ("p", 2, "m", 1, 6)]
    stays, n = search.delete(rows, F.col("id") == 1)
    assert stays.count() == 1 and n.first().deleted == 1
    search.partition_path(str(tmp_path / "s"), rows)
    assert spark.read.parquet(str(tmp_path / "s")).where("model = 'm'").count() == 2


# ---- chunks


def split_position(text: str, start: int, end: int) -> int:
    """Where to cut text[start:end]: after the last sentence end of its last 300 characters, else after the last white space there, else at end."""
    low = max(start + 1, end - 300)
    at = max(text.rfind(c, low, end) for c in ".!?。！？\n")
    if at < 0:
        at = max((i for i in range(low, end) if text[i].isspace()), default=-1)
    return at + 1 if at >= 0 else end


def split_long(text: str, longest: int = 2000) -> list[str]:
    """Parts of at most longest characters each; joined without white space they are the text without white space."""
    if len(text) <= longest:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + longest, len(text))
        if end < len(text):
            end = split_position(text, start, end)
        part = text[start:end].strip()
        if part:
            out.append(part)
        start = end
        while start < len(text) and text[start].isspace():
            start += 1
    return out


def test_split_long():
    text = "a" * 1800 + ". " + "b" * 500
    assert split_long(text) == ["a" * 1800 + ".", "b" * 500]
    assert [len(p) for p in split_long("x" * 4100)] == [2000, 2000, 100]
    assert split_long("y" * 2000) == ["y" * 2000] and len(split_long("y" * 2001)) == 2
    assert split_long("w " * 1500)[0] == ("w " * 1000).strip()
    long = "Some words. And more words, " * 400
    assert "".join("".join(split_long(long)).split()) == "".join(long.split()) and max(map(len, split_long(long))) <= 2000


def test_split_chunks(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "x" * 4500), (3, None)], "id int, content string")
    assert sorted((r.id, r.part_index, r.part_count) for r in chunk.split_chunks(rows).collect()) == [(1, 0, 1), (2, 0, 3), (2, 1, 3), (2, 2, 3), (3, 0, 1)]


def test_split_parts_equal_a_loop(spark):
    some = random.Random(2)
    texts = ["".join(some.choice(["word", " ", "\n", ". ", "é", "。", "　", "\x1c", "!", "x" * 40, " " * 30]) for _ in range(some.choice([5, 60, 600, 3000]))) for _ in range(60)] + [" " * 900, "x" * 900, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for longest in (40, 400):
        found = {}
        for r in chunk.split_chunks(rows, longest=longest).collect():
            found.setdefault(r.id, []).append((r.part_index, r.content))
        expected = {i: [t] if t is None else split_long(t, longest) for i, t in enumerate(texts)}
        assert {i: [t for _, t in sorted(v, key=lambda x: x[0])] for i, v in found.items()} == {i: v for i, v in expected.items() if v}


XHTML = """<html xmlns="http://www.w3.org/1999/xhtml"><head><title>T</title></head><body><h1 id="h">Head</h1><p>foo<b>bar</b></p><ul><li><p>x</p></li><li><div><p>lost</p></div>kept</li></ul>
<figure id="f"><img src="a.png" alt=""/><img src="b.png" alt="B"/><figcaption>Cap</figcaption></figure><blockquote>Q <img alt="no"/></blockquote><table><caption>C</caption><tr><th>1</th><td>2</td></tr></table><script>no</script></body></html>"""


def test_markup_chunks(spark):
    pages = spark.createDataFrame([(1, XHTML), (2, None)], "page_id long, html string")
    found = [(r.type, r.title, r.content) for r in markup.chunks(pages).orderBy("sequence").collect()]
    assert found == [("HEADING", "Head", "Head"), ("PARAGRAPH", "Head", "foo bar"), ("LIST_ITEM", "Head", "x"), ("LIST_ITEM", "Head", "kept"), ("IMAGE", "Head", "Cap"), ("IMAGE", "Head", "Cap"), ("ALT_TEXT", "Head", "B"), ("QUOTE", "Head", "Q"), ("TABLE", "Head", "C\n1 | 2")]


def test_style_rules():
    assert [r[4] for r in markup.css_rows('/* {x} */ a > b { content: "}"; color : red } @media x { p { y: z } }')] == ['a > b { content: "}"; color : red }', "@media x { p { y: z } }"]


# ---- synchronisation


def test_synchronize_is_idempotent(spark):
    rows = spark.createDataFrame([(i, "m", "p", f"s{i % 3}", f"h{i}", f"text {i}") for i in range(9)], "id int, model string, project_id string, source_path string, content_hash string, embedding_text string")
    embedder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    old = sync.embed(rows.where("id < 6"), embedder)
    new = rows.where("id > 0").withColumn("content_hash", F.when(F.col("id") == 2, "changed").otherwise(F.col("content_hash")))
    actions = {r.id: r.action for r in sync.plan(new, old).collect()}
    assert actions == {0: "DELETE", 1: "REUSE", 2: "EMBED", 3: "REUSE", 4: "REUSE", 5: "REUSE", 6: "EMBED", 7: "EMBED", 8: "EMBED"}
    after = sync.synchronize(new, old, embedder)
    assert sorted(r.id for r in after.collect()) == list(range(1, 9))
    assert {r.action for r in sync.plan(new, after).collect()} == {"REUSE"}
    assert {r.action for r in sync.plan(new, after, force=True).collect()} == {"EMBED"}
    assert [(r.project_id, r.source_path, r.n) for r in sync.missing_sources(new.where("source_path <> 's1'"), old).collect()] == [("p", "s1", 2)]


def test_embedding_falls_back_to_single_texts(spark):
    def embedder(texts):
        if "bad" in texts:
            raise ValueError
        return [[2.0, 0.0] for _ in texts]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], ["embedding_text"])
    assert {r.embedding_text: r.vector for r in sync.embed(rows, embedder).collect()} == {"a": [1.0, 0.0], "bad": None, "c": [1.0, 0.0]}
    with pytest.raises(Exception, match="ValueError"):
        sync.embed(rows, embedder, continue_on_error=False).collect()


def test_stream(spark, tmp_path):
    schema = "project_id string, id int, model string, source_path string, source_version long, content_hash string, embedding_text string"
    embedder = lambda texts: [[float(len(t)), 0.0] for t in texts]
    store = str(tmp_path / "store")

    def run(*rows):
        spark.createDataFrame([("p", i, "m", source, version, text, text) for i, source, version, text in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.synchronize_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"), embedder, bucket_rows=1).awaitTermination(120)
        return sorted((r.id, r.source_path, r.source_version, r.embedding_text) for r in stream.current_store(spark, store).collect())

    assert run((1, "a", 1, "one"), (2, "a", 1, "two"), (3, "b", 1, "x")) == [(1, "a", 1, "one"), (2, "a", 1, "two"), (3, "b", 1, "x")]
    assert run((1, "a", 2, "one"), (4, "a", 2, "four")) == [(1, "a", 2, "one"), (3, "b", 1, "x"), (4, "a", 2, "four")]  # the first half of a new version
    both = [(1, "a", 2, "one"), (2, "a", 2, "two!"), (3, "b", 1, "x"), (4, "a", 2, "four")]
    assert run((2, "a", 2, "two!")) == both  # the second half adds to it
    assert run((9, "a", 1, "late")) == both  # of an earlier version
    assert run((5, "c", 1, "new")) == [*both, (5, "c", 1, "new")]
    assert all(r.vector[0] == 1 for r in stream.current_store(spark, store).collect())
    last = versions.load(spark, store)
    assert len(last.buckets) > 2  # split, as they hold more than one record
    named = {p.rpartition("/part_bits")[0] for n in versions.versions(spark, store) for paths in versions.load(spark, store, n).buckets.values() for p in paths}
    assert {f"data/{p.name}" for p in (tmp_path / "store/data").iterdir() if any(p.glob("*/*/*.parquet"))} == named  # what no version names is gone


# ---- retrieval and context


def test_graph(spark):
    spine = spark.createDataFrame([("p", n, i, True) for i, n in enumerate(["cover.xhtml", "chapter1_1.xhtml", "chapter1_2.xhtml", "part2.xhtml", "quiz.xhtml"])], "project_id string, source_path string, position int, linear boolean")
    hits = spark.createDataFrame([(1, "p", "cover.xhtml", 1), (1, "p", "chapter1_1.xhtml", 2), (1, "p", "chapter1_2.xhtml", 3)], "query_id int, project_id string, source_path string, rank int")
    edges = retrieve.spine_edges(spine)
    assert [r.source_path for r in retrieve.graph_neighbors(hits, edges, 1).collect()] == ["chapter1_2.xhtml"]
    assert retrieve.graph_neighbors(hits, edges, None).collect() == []


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 30, 1), (1, 20, 2)], "query_id int, id int, rank int")
    found = {r.id: (round(r.score, 9), r.rank) for r in retrieve.fuse(a, b, 5).collect()}
    assert found == {20: (round(1 / 62, 9), 1), 10: (round(0.7 / 61, 9), 2), 30: (round(0.3 / 61, 9), 3)}
    swapped = {r.id: round(r.score, 9) for r in retrieve.fuse(b, a, 5, (0.3, 0.7)).collect()}
    assert swapped == {i: s for i, (s, _) in found.items()}


def test_merge_takes_the_graph_version_only_if_higher(spark):
    plain = spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.4)], "query_id int, id int, score double")
    graph = spark.createDataFrame([(1, 10, 0.5, 0.0), (1, 20, 0.4, 1.0), (1, 30, 0.1, 1.0)], "query_id int, id int, score double, graph_score double")
    assert [(r.id, r.score, r.origin) for r in retrieve.merge_graph(plain, graph, 0.2, 2).orderBy("rank").collect()] == [(20, 0.6, "VECTOR_GRAPH"), (10, 0.5, "VECTOR")]


def test_pack(spark):
    def included(lengths, budget):
        rows = spark.createDataFrame([(1, i + 1, "x" * n) for i, n in enumerate(lengths)], "query_id int, place int, block string")
        packed = context.pack(rows, budget, notice="[cut]")
        return [r.included for r in packed.orderBy("place").collect()], context.contexts(packed, "[cut]", budget).first()

    assert included([10, 10], 22)[0] == [True, True]  # fits exactly
    assert included([10, 10], 21)[0] == [True, False]
    flags, row = included([10, 50, 1], 30)
    assert flags == [True, False, False] and row.context == "x" * 10 + "\n\n[cut]" and (row.original_count, row.included_count, row.truncated) == (3, 1, True)
    flags, row = included([50], 20)
    assert flags == [False] and row.context == "[cut]"


# ---- evaluation and conversations


def test_evaluation(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "case_id int, source string")
    got = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "b", 3), (2, "x", 1)], "case_id int, source string, rank int")
    rows = evaluate.case_metrics(expected, got)
    assert sorted((r.case_id, r.hit, r.recall, r.reciprocal_rank) for r in rows.collect()) == [(1, True, 0.5, 0.5), (2, False, 0.0, 0.0)]
    base = spark.createDataFrame([("m", 0.8, 0.05), ("n", 0.02, 0.05), ("o", 0.5, 0.0)], "metric string, score double, tolerance double")
    now = spark.createDataFrame([("m", 0.75), ("n", 0.0)], "metric string, score double")
    checked = evaluate.regression(base, now)
    assert {r.metric: r.passed for r in checked.collect()} == {"m": True, "n": True, "o": False}
    assert evaluate.regression_verdict(checked.where("metric <> 'o'")).first().passed and not evaluate.regression_verdict(checked.where("false")).first().passed
    assert one(spark, evaluate.judge_score(F.col("a")), a='Sure: {"score": 0.7, "reason": "ok"} done') == 0.7 and one(spark, evaluate.judge_score(F.col("a")), a='{"score": 7}') is None
    applicable = {(r.case_id, r.metric) for r in evaluate.applicable_metrics(spark.createDataFrame([(1, "ANSWERABLE"), (2, "NO_ANSWER")], "case_id int, type string")).where("applicable").collect()}
    assert (1, "context_recall") in applicable and (2, "context_recall") not in applicable and (2, "no_answer_detection") in applicable
    missing = evaluate.compare(rows, rows.where("case_id = 1"))
    assert {r.case_id: r.change for r in missing.collect()} == {1: "STABLE_HIT", 2: "MISSING"}


def test_conversations(spark):
    talks = spark.createDataFrame([("c", "p"), ("d", "p")], "conversation_id string, project_id string")
    said = spark.createDataFrame([("c", "p"), ("c", "q"), ("e", "p")], "conversation_id string, project_id string")
    assert conversation.foreign(said, talks).count() == 2
    assert [r.conversation_id for r in conversation.by_project(talks.withColumn("updated_at", F.col("conversation_id")), "p").collect()] == ["d", "c"]


# ---- quality


def codes(spark, html, **options):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    return sorted(r.code for r in quality.accessibility(markup.elements(pages), with_info=True, **options).collect())


def test_accessibility_rules(spark):
    page = '<html lang="en"><body>%s</body></html>'
    assert codes(spark, page % "<h1>A</h1><h3>B</h3><h1> </h1>", rules=["heading"]) == ["HEADING_EMPTY", "HEADING_LEVEL_SKIPPED", "MULTIPLE_PRIMARY_HEADINGS"]
    assert codes(spark, page % "<h2>A</h2>", rules=["heading"]) == ["HEADING_ORDER_INVALID"] and codes(spark, page % "", rules=["heading"]) == ["HEADING_MISSING"]
    assert [codes(spark, f"<html {a}></html>", rules=["language"]) for a in ("", 'lang="e"', 'lang="und"', 'lang="en" xml:lang="de"', 'lang="zh-Hant-TW"')] == [["DOCUMENT_LANGUAGE_MISSING"], ["DOCUMENT_LANGUAGE_INVALID"], ["DOCUMENT_LANGUAGE_INVALID"], ["DOCUMENT_LANGUAGE_MISMATCH"], []]
    images = {'<img src="a">': ["IMAGE_ALT_MISSING"], '<img src="a" alt="">': ["IMAGE_ALT_EMPTY"], '<img src="a" alt="" role="none">': [], '<img alt="Image of x.png">': ["IMAGE_ALT_FILENAME_USED", "IMAGE_ALT_REDUNDANT_PREFIX", "IMAGE_SOURCE_MISSING"], f'<img src="a" alt="{"x" * 151}">': ["IMAGE_ALT_TOO_LONG"], '<figure><img src="a" alt="Cap"><figcaption>cap</figcaption></figure>': ["IMAGE_ALT_DUPLICATES_CAPTION"], '<a href="#"><img src="a" alt="" role="none"></a>': ["IMAGE_LINK_NAME_MISSING"], '<img src="a" alt="b" aria-hidden="true">': ["MEANINGFUL_IMAGE_HIDDEN"]}
    for html, expected in images.items():
        assert codes(spark, page % html, rules=["image"]) == expected, html
    assert codes(spark, page % '<a href="#x">Click  here</a><a href="#y" aria-label="fine"></a><p id="y">t</p><a></a>', rules=["link"]) == ["LINK_TARGET_MISSING", "LINK_TARGET_NOT_FOUND", "LINK_TEXT_AMBIGUOUS", "LINK_TEXT_EMPTY"]
    table = "<table>%s<tr><th%s>a</th><th scope='col'>b</th></tr><tr><td headers='q'>1</td><td colspan='2'>2</td></tr><tr><td>3</td></tr></table>"
    assert codes(spark, page % (table % ("", "")), rules=["table"]) == ["TABLE_CAPTION_MISSING", "TABLE_HEADER_REFERENCE_INVALID", "TABLE_HEADER_SCOPE_MISSING", "TABLE_STRUCTURE_COMPLEX"]
    assert codes(spark, page % "<table><tr><td>1</td></tr></table>", rules=["table"]) == ["TABLE_LAYOUT_USAGE"]
    aria = '<div role="bad"></div><nav role="navigation" aria-label=""></nav><a href="#" aria-hidden="true" id="i">x</a><p id="i" aria-labelledby="nope">x</p><div role="heading" aria-level="9"></div><div role="none" aria-label="x"></div>'
    assert codes(spark, page % aria, rules=["aria"]) == ["ARIA_ATTRIBUTE_INVALID", "ARIA_ATTRIBUTE_NOT_ALLOWED", "ARIA_HIDDEN_FOCUSABLE", "ARIA_LABEL_EMPTY", "ARIA_REFERENCE_INVALID", "ARIA_ROLE_INVALID", "DUPLICATE_ELEMENT_ID", "REDUNDANT_ARIA_ROLE"]
    counts = quality.issue_counts(quality.accessibility(markup.elements(spark.createDataFrame([(1, page % "<h1></h1>")], "page_id long, html string")))).first()
    assert (counts.errors, counts.passed) == (1, False)


def test_lists_of_images_and_tables(spark):
    found = markup.elements(spark.createDataFrame([(1, '<img id="i" alt="I" src="s"><img alt="x"><table id="t"><caption>C</caption></table><table id="u" aria-label="L"></table><table></table>')], "page_id long, html string"))
    spine = spark.createDataFrame([(1, 3)], "doc long, position int")
    assert [(r.id, r.title) for r in markup.list_of_images(found, spine).collect()] == [("i", "I")]
    assert sorted((r.id, r.title) for r in markup.list_of_tables(found, spine).collect()) == [("t", "C"), ("u", "L")]


def test_package_structure(spark):
    manifest = spark.createDataFrame([("p", "a", "chapter1_2.xhtml", "application/xhtml+xml", None), ("p", "b", "chapter1_1.xhtml", "application/xhtml+xml", None), ("p", "b", "x.png", "image/png", None), ("p", "n", "nav.xhtml", "application/xhtml+xml", "nav"), ("p", None, None, "", None)], "project_id string, id string, href string, media_type string, properties string")
    spine = spark.createDataFrame([("p", 0, "a"), ("p", 1, "n"), ("p", 2, "zz"), ("p", 3, "a")], "project_id string, position int, idref string")
    there = spark.createDataFrame([("p", "chapter1_2.xhtml"), ("p", "chapter1_1.xhtml"), ("p", "nav.xhtml"), ("p", "extra.xhtml")], "project_id string, path string")
    issues = quality.package_structure(manifest, spine, there)
    assert {r.code for r in issues.collect()} == {"MANIFEST_ID_MISSING", "MANIFEST_ID_DUPLICATED", "MANIFEST_HREF_MISSING", "MANIFEST_MEDIA_TYPE_MISSING", "MANIFEST_RESOURCE_MISSING", "SPINE_IDREF_DUPLICATED", "SPINE_MANIFEST_REFERENCE_MISSING", "SPINE_ORDER_INVALID", "SPINE_NAV_REFERENCE"}
    bad = '<package><metadata/><spine/></package>'
    packages = spark.createDataFrame([("a", None, None), ("b", "no.opf", None), ("c", "c.opf", "<package>"), ("d", "d.opf", "<other/>"), ("e", "e.opf", bad), ("f", "f.opf", "<package><manifest/><spine/></package>")], "project_id string, package_path string, xml string")
    kept = spark.createDataFrame([(p, f"{p}.opf") for p in "cdef"], "project_id string, path string")
    assert {(r.project_id, r.code) for r in quality.package_documents(packages, kept).collect()} == {("a", "PACKAGE_PATH_NOT_FOUND"), ("b", "PACKAGE_DOCUMENT_MISSING"), ("c", "PACKAGE_DOCUMENT_INVALID"), ("d", "PACKAGE_ELEMENT_MISSING"), ("e", "MANIFEST_MISSING")}
    checked = quality.composite(issues, spark.createDataFrame([(1, "WARNING")], "doc int, severity string"), spark.createDataFrame([("q", "INFO")], "project_id string, severity string"), spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, doc int"))
    assert {(r.project_id, r.warnings, r.accessibility, r.checker, r.valid) for r in checked.collect()} == {("p", 2, 1, 0, False), ("q", 0, 0, 1, True)}
    status = {r.path: r.status for r in quality.compare_manifest(there, manifest.where("href is not null")).collect()}
    assert status["extra.xhtml"] == "NOT_IN_MANIFEST" and status["x.png"] == "FILE_MISSING" and status["nav.xhtml"] == "MATCHED"
    items = manifest.where("href is not null").select("project_id", "href", "id")
    again = quality.upsert_items(items, spark.createDataFrame([("p", "nav.xhtml", "new")], items.schema)).orderBy("place").collect()
    assert [(r.href, r.id) for r in again][:2] == [("nav.xhtml", "new"), ("chapter1_1.xhtml", "b")]


def test_fix_plan(spark):
    text = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    issues = text([("p", str(i), f) for i, f in enumerate(["gone.xhtml", "OEBPS/Text/new.xhtml", "Text/loose.xhtml#x", "fine.css", "odd.bin", None, "absent.png"])], "project_id", "issue_id", "file")
    there = text([("p", f) for f in ("Text/new.xhtml", "Text/loose.xhtml", "fine.css", "odd.bin")], "project_id", "path")
    manifest = text([("p", "g", "Text/gone.xhtml"), ("p", "l", "Text/loose.xhtml"), ("p", "c", "fine.css")], "project_id", "id", "href")
    found = quality.fix_plan(issues, there, manifest, text([("p", "g")], "project_id", "idref"), text([("p", "gone.xhtml#top")], "project_id", "href"))
    steps = sorted((r.issue_id, r.fix_type, r.operation) for r in found.collect())
    assert steps == sorted([("0", "UPDATE_SPINE", "REMOVE"), ("0", "UPDATE_NAVIGATION", "REMOVE"), ("0", "UPDATE_MANIFEST", "REMOVE"), ("1", "UPDATE_MANIFEST", "ADD"), ("2", "UPDATE_SPINE", "ADD"), *((i, "MANUAL_REQUIRED", None) for i in "3456")], key=str)
    assert {r.fix_type for r in found.collect()} <= set(quality.FIX_TYPES)


def test_percentiles_within_ranges(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(g, v) for g, n in (("a", 3000), ("b", 7), (None, 40), ("c", 1)) for v in (rng.choice([rng.random(), 0.5, 0.25]) for _ in range(n))] + [("a", None), ("d", None)]
    found = {r.g: r for r in evaluate.latencies(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    for g in ("a", "b", None, "c"):
        values = sorted(v for h, v in rows if h == g and v is not None)
        assert [found[g][p] for p in ("p50", "p95", "p99")] == [values[max(1, math.ceil(len(values) * x)) - 1] for x in (0.5, 0.95, 0.99)], g
    assert found["d"].n == 0 and found["d"].p50 is None
    assert evaluate.latencies(spark.createDataFrame(rows, "g string, v double"), "v").first().n == 3048


def test_case_selection_and_document_deltas(spark):
    cases = spark.createDataFrame([("1", ["a"]), ("2", []), ("3", ["b"])], "case_id string, expected_documents array<string>")
    assert evaluate.select_cases(cases).count() == 2 and [r.case_id for r in evaluate.select_cases(cases, [" 3 ", "3"]).collect()] == ["3"]
    with pytest.raises(ValueError, match="'2', '9'"):
        evaluate.select_cases(cases, ["1", "2", "9"])
    run = lambda rows: spark.createDataFrame(rows, "case_id string, source string, rank int, retrieval_source string")
    old, new = run([("1", "a", 3, "VECTOR"), ("1", "x", 1, "VECTOR")]), run([("1", "a", 1, "HYBRID"), ("1", "g", 2, "VECTOR_GRAPH"), ("1", "a", 5, "VECTOR")])
    found = {r.source: (r.baseline_rank, r.candidate_rank, r.rank_delta, r.added, r.removed, r.is_expected, r.new_graph_candidate) for r in evaluate.document_deltas(old, new, spark.createDataFrame([("1", "a")], "case_id string, source string")).collect()}
    assert found == {"a": (3, 1, -2, False, False, True, False), "x": (1, None, None, False, True, False, False), "g": (None, 2, None, True, False, False, True)}


def test_typo_replies(spark):
    docs = spark.createDataFrame([(1, "a.b x\na.b a.b"), (2, "none")], "doc_id long, text string")
    reply = json.dumps({"issues": [{"original": "a.b", "suggestion": "ab", "type": "t", "reason": "r", "confidence": 0.9}, {"original": "x", "suggestion": "y", "confidence": 0.79}, {"original": "x", "suggestion": "x", "confidence": 1}, {"original": " ", "suggestion": "y", "confidence": 1}]})
    replies = spark.createDataFrame([(1, reply), (2, '{"issues": "no"}')], "doc_id long, reply string")
    found = quality.typo_replies(docs, replies.where("doc_id = 1"))
    assert sorted((r.start, r.end, r.line, r.suggestion) for r in found.collect()) == [(0, 3, 1, "ab"), (6, 9, 2, "ab"), (10, 13, 2, "ab")]
    with pytest.raises(Exception, match="no JSON object"):
        quality.typo_replies(docs, spark.createDataFrame([(1, "[]")], "doc_id long, reply string")).collect()


def test_conversations_are_made_once_and_touched(spark):
    schema = "conversation_id string, project_id string, title string, status string, created_at int, updated_at int"
    there = spark.createDataFrame([("a", "p", "A", "CLOSED", 1, 2)], schema)
    wanted = spark.createDataFrame([("a", "q", "X", 9), ("b", "p", "B", 5), ("b", "p", "B2", 6)], "conversation_id string, project_id string, title string, at int")
    made = conversation.get_or_create(there, wanted)
    assert sorted(map(tuple, made.collect())) == [("a", "p", "A", "CLOSED", 1, 2), ("b", "p", "B", "ACTIVE", 5, 5)]
    said = spark.createDataFrame([("b", 8), ("a", 1)], "conversation_id string, created_at int")
    assert sorted((r.conversation_id, r.updated_at) for r in conversation.touch(made, said).collect()) == [("a", 2), ("b", 8)]


def test_dispatch_by_kind(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>", "XHTML"), (2, "one\n\n two  three", "TEXT"), (3, "a { b: c }", "CSS"), (4, "?", "UNKNOWN"), (5, None, "MARKDOWN")], "page_id long, html string, kind string")
    assert sorted((r.doc, r.content) for r in markup.chunks(pages, kind_col="kind").collect()) == [(1, "x"), (2, "one"), (2, "two three"), (3, "a { b: c }")]


def test_modes(spark):
    assert [retrieve.mode(x) for x in (None, " hybrid ", "Vector_Graph")] == ["VECTOR_ONLY", "HYBRID", "VECTOR_GRAPH"]
    with pytest.raises(ValueError):
        retrieve.mode("other")


def test_pages_to_search(spark):
    """Pages to chunks with ids, embedded, searched by those ids within projects, and reranked."""
    pages = spark.createDataFrame([(i, f"<h1>Topic {i}</h1>" + "".join(f"<p>Passage {j} on topic {i}, number {i * j}.</p>" for j in range(4))) for i in range(6)], "page_id long, html string")
    rows = markup.chunks(pages).withColumn("source_path", F.concat(F.lit("p"), "doc", F.lit(".xhtml"))).withColumn("project_id", F.concat(F.lit("x"), F.col("doc") % 2))
    rows = rows.withColumn("id", chunk.chunk_id(F.col("source_path"), F.col("element_id"), F.col("type"), F.col("sequence"))).withColumn("model", F.lit("m"))
    assert chunk.duplicate_ids(rows).isEmpty()

    def embedder(texts):
        return [[float(sum(hash_of(w) % 16 == k for w in t.lower().split())) + 0.01 for k in range(16)] for t in texts]

    def hash_of(word):
        return sum(ord(c) * 31**i for i, c in enumerate(word))

    embedded = sync.embed(rows.withColumn("embedding_text", F.col("content")), embedder)
    asked = embedded.where("content like 'Passage 2%'")
    found = search.topk(embedded, asked, 3, id_col="id", vector_col="vector", scope_col="project_id")
    own = rows.select(F.col("id").alias("query_id"), "project_id")
    assert found.join(own, "query_id").join(rows.select("id", F.col("project_id").alias("there")), "id").where("project_id <> there").isEmpty() and found.count() == 18
    queries = asked.select(F.col("id").alias("query_id"), F.col("content").alias("query_text"))
    best = retrieve.rerank(found, rows, queries, 2)
    assert best.count() == 12 and best.where("score < vector_score").isEmpty()


def curly(texts: list[str], mark: str, pair: str) -> list[str]:
    """Straight marks of consecutive text nodes as curly ones; whether a quotation is open carries over from node to node."""
    out, is_open = [], False
    for text in texts:
        new = list(text)
        for i, c in enumerate(text):
            if c != mark:
                continue
            before, after = new[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
            if mark == "'" and before.isalnum() and after.isalnum():
                new[i] = "’"
                continue
            starts = not before or before.isspace() or before in "([{<“‘"
            ends = not after or after.isspace() or after in ".,!?;:)]}>”’"
            is_open = starts if starts != ends else not is_open
            new[i] = pair[0] if is_open else pair[1]
        out.append("".join(new))
    return out


def test_quotes_equal_a_loop(spark):
    some = random.Random(3)
    docs = [["".join(some.choice(["'", '"', "a", "1", " ", "(", "]", ".", "é", "...", "　", "“", "’"]) for _ in range(some.randrange(14))) for _ in range(some.randrange(1, 9))] for _ in range(150)]
    rows = spark.createDataFrame([(d, i, t, "x") for d, texts in enumerate(docs) for i, t in enumerate(texts)] + [(999, 0, None, "x")], "doc int, at int, text string, _n string")
    found = {}
    for r in quality.typography(rows, ["doc"], "at").collect():
        found.setdefault(r.doc, {})[r.at] = r.text
    assert found.pop(999) == {0: None}
    for d, texts in enumerate(docs):
        expected = [x.replace("...", "…") for x in curly(curly(texts, "'", "‘’"), '"', "“”")]
        assert [found[d][i] for i in range(len(texts))] == expected, texts


def test_typography_and_typos(spark):
    assert curly(['He said "', "don't", '" and "yes".'], '"', "“”") == ["He said “", "don't", "” and “yes”."]
    assert curly(["it's 'so' he"], "'", "‘’") == ["it’s ‘so’ he"]
    assert one(spark, quality.ellipsis("a"), a="a.... b.......") == "a…. b……."
    docs = spark.createDataFrame([(1, "aXaX\naX"), (2, None)], "doc_id long, text string")
    assert [(r.offset, r.line) for r in quality.typo_positions(docs, {"aX": "b"}).collect()] == [(0, 1), (2, 1), (5, 2)]
    with pytest.raises(ValueError):
        quality.typo_counts(docs, spark.createDataFrame([("a", "b"), ("c", "d")], "wrong string, right string"), largest=1)


def test_releases_and_categories(spark):
    rows = spark.createDataFrame([("1.2.0", 5), ("1.10.0", 3)], "version string, released_at int")
    accepted = lambda v: quality.accepts_release(rows, v).first().accepted
    assert accepted("1.3.0") and not accepted("1.2.0") and not accepted("1.10.0") and not accepted("x") and not accepted("1.1.9")
    assert [one(spark, quality.issue_category(F.col("f"), F.col("m")), f=f, m=m) for f, m in (("a.OPF", "itemref"), ("nav.xhtml", ""), ("c.css", ""), ("", "missing resource"), ("", ""))] == ["SPINE", "NAVIGATION", "STYLESHEET", "RESOURCE", "UNKNOWN"]


# ---- sources


def test_a_rule_that_fails_on_one_page(spark):
    pages = spark.createDataFrame([(1, "<html lang='en'><img src='a.png'></html>"), (2, "<html lang='en'><img src='b.png'><b>bad</b></html>"), (3, "<html lang='en'><i>x</i></html>")], "page_id long, html string")

    def judge(rows):
        for r in rows:
            if r["tag"] == "b":
                raise RuntimeError("can't judge bold")
            if r["tag"] == "i":
                yield r["seq"], "ITALIC"

    plain = {(r.doc, r.code) for r in quality.accessibility(markup.elements(pages), ["image"]).collect()}
    found = {(r.doc, r.code, r.severity) for r in quality.accessibility(markup.elements(pages), ["image"], more=[quality.page_rule(judge)]).collect()}
    assert {(d, c) for d, c, _ in found} == plain | {(2, "VALIDATION_FAILED"), (3, "ITALIC")} and {d for d, _ in plain} == {1, 2}


def test_sources(spark, tmp_path):
    (tmp_path / "text").mkdir()
    for name, content in (("a.xhtml", "<p>é</p>"), ("quiz.xhtml", "q"), (".hidden.txt", "h"), ("b.bin", "b")):
        (tmp_path / "text" / name).write_text(content)
    rows = files.text_files(spark, str(tmp_path / "text")).collect()
    assert [(r.relative_path, r.source_type, r.content) for r in rows] == [("a.xhtml", "XHTML", "<p>é</p>")]
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("a.opf", "<package/>")
        z.writestr("OEBPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata><title>B</title></metadata><manifest><item id="a" href="a.xhtml" media-type="m"/></manifest><spine><itemref idref="a" linear="no"/></spine></package>', zipfile.ZIP_DEFLATED)
    entries = files.archive_entries(spark, str(tmp_path))
    assert sorted((r.entry, r.stored, r.first) for r in entries.collect()) == [("META-INF/container.xml", True, False), ("OEBPS/content.opf", False, False), ("a.opf", True, False), ("mimetype", True, True)]
    parts = files.packages(entries)
    assert files.manifest(parts).first().href == "a.xhtml" and files.spine(parts).first().linear is False and files.metadata(parts).first().value == "B"
    seen = quality.inspect_archives(entries, parts).first()
    assert (seen.entries, seen.mimetype_valid, seen.mimetype_stored, seen.mimetype_first, seen.package_path, seen.package_present, seen.title, seen.n_manifest, seen.n_spine, seen.n_linear, seen.issue) == (4, True, True, True, "OEBPS/content.opf", True, "B", 1, 1, 0, None)
    assert files.fingerprints(spark, str(tmp_path)).count() == 1 and files.latest_artifact(spark, str(tmp_path)).first().path.endswith("x.epub")
    (tmp_path / "g.json").write_text(json.dumps({"name": "d", "projectId": "p", "cases": [{"id": "1", "question": "q", "expectedDocuments": ["a\\b.xhtml", "a/b.xhtml", "quiz.xhtml"]}, {"id": "2", "type": "NO_ANSWER", "question": "r"}]}))
    assert sorted((r.case_id, r.type, r.expected_documents) for r in files.golden_cases(spark, str(tmp_path / "g.json")).collect()) == [("1", "ANSWERABLE", ["a/b.xhtml"]), ("2", "NO_ANSWER", [])]
    files.write_json(spark.range(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_json(spark.range(1), str(tmp_path / "out"))


def test_references_of_some_names_only(spark):
    pages = spark.createDataFrame([(1, "<h1>a &amp;&lt; &quot;b&quot; &#65; &amp;amp; c&amp;&amp</h1>"), (2, None)], "page_id long, html string")
    text = lambda **more: [r.text for r in markup.headings(markup.elements(pages, **more)).collect()]
    assert text(references=("lt", "gt", "amp")) == ["a &< &quot;b&quot; &#65; &amp; c&&amp"]
    assert text() == ['a &< "b" A &amp; c&&']
