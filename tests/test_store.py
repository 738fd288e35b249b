"""The store of versions: splitting, conflicts, retries and projects that share ids."""

import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators import conversation, evaluate, search, sync
from quillspark.sources import releases
from quillspark.sources import store as versions

SCHEMA = "project_id string, id int, model string, source_path string, content_hash string, embedding_text string"


def chunks(spark, *rows):
    return spark.createDataFrame([(p, i, "m", s, text, text) for p, i, s, text in rows], SCHEMA)


def embedder(mark):
    return lambda texts: [[float(mark), float(len(t))] for t in texts]


def held(spark, folder):
    return sorted((r.project_id, r.id, r.embedding_text, round(r.vector[0] / r.vector[1] * len(r.embedding_text))) for r in versions.read(spark, folder).collect())


def test_two_projects_with_the_same_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    rows = [(p, i, "a.xhtml", f"{p}{i}") for p in "AB" for i in range(3)]
    sync.merge(spark, folder, chunks(spark, *rows), embedder(1))
    sync.merge(spark, folder, chunks(spark, *rows), embedder(2))
    assert held(spark, folder) == [(p, i, t, 1) for p, i, _, t in rows]  # all reused, none doubled
    sync.merge(spark, folder, chunks(spark, ("A", 0, "a.xhtml", "A0"), ("A", 1, "a.xhtml", "new"), ("C", 0, "b.xhtml", "C0")), embedder(3))
    assert held(spark, folder) == [("A", 0, "A0", 1), ("A", 1, "new", 3), ("B", 0, "B0", 1), ("B", 1, "B1", 1), ("B", 2, "B2", 1), ("C", 0, "C0", 3)]
    both = spark.createDataFrame([(p, 7, "m", "x", "h", "t") for p in "AB"], SCHEMA)
    assert {r.action for r in sync.plan(both, both).collect()} == {"REUSE"} and sync.plan(both, both).count() == 2
    stored = sync.embed(both, embedder(1))
    assert sync.synchronize(both, stored, embedder(2)).count() == 2
    assert sync.stale(both.where("project_id = 'B'"), stored).isEmpty()  # A's source isn't there, B's record is


def test_a_whole_project_loses_sources_that_are_gone(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    sync.merge(spark, folder, chunks(spark, ("A", 1, "a", "x"), ("A", 2, "b", "y"), ("B", 3, "b", "z")), embedder(1))
    sync.merge(spark, folder, chunks(spark, ("A", 1, "a", "x")), embedder(2))
    assert len(held(spark, folder)) == 3
    sync.merge(spark, folder, chunks(spark, ("A", 1, "a", "x")), embedder(2), complete=True)
    assert held(spark, folder) == [("A", 1, "x", 1), ("B", 3, "z", 1)]
    sync.merge(spark, folder, chunks(spark, ("A", 1, "a", "x")), embedder(5), replace=True)
    assert held(spark, folder) == [("A", 1, "x", 5), ("B", 3, "z", 1)]


def test_buckets_split_as_they_grow_and_one_source_by_its_keys(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    sync.merge(spark, folder, chunks(spark, *(("A", i, "one", f"t{i}") for i in range(40))), embedder(1), bucket_rows=8)
    first = versions.load(spark, folder)
    sync.merge(spark, folder, chunks(spark, *(("A", i, f"s{i}", f"t{i}") for i in range(40, 140))), embedder(1), bucket_rows=8)
    found = versions.load(spark, folder)
    assert len(first.buckets) < len(found.buckets) and len(held(spark, folder)) == 140
    touched = versions.buckets_of(found, chunks(spark, ("A", 50, "s50", "t")))
    assert 0 < len(touched) < len(found.buckets)
    # a source over the bound is split by keys, and all of its buckets are touched
    frame = spark.range(300).select(F.lit("A").alias("project_id"), F.col("id").cast("int"), F.lit("m").alias("model"), F.lit("one").alias("source_path"), F.lit(0.0).alias("x"))
    deep = versions.Version(0, {(33, v): [] for v in range(0)} | {(0, 0): []})
    hot = f"file://{tmp_path}/hot"
    one = versions.commit(spark, hot, deep, [(0, 0)], frame, ["id"], bucket_rows=100)
    while max(b for b, _ in one.buckets) <= versions.SOURCE_BITS:  # its hash's own bits part nothing
        full = [b for b, paths in one.buckets.items() if paths]
        one = versions.commit(spark, hot, one, full, versions.read(spark, hot, one, full), ["id"], bucket_rows=30)
    parts = [b for b, paths in one.buckets.items() if paths]
    assert len(parts) > 1 and set(versions.buckets_of(one, frame)) >= set(parts)
    assert versions.read(spark, hot).count() == 300


def test_of_two_writers_one_wins_and_the_other_begins_again(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    sync.merge(spark, folder, chunks(spark, ("A", 1, "a", "x")), embedder(1))
    base = versions.load(spark, folder)
    touched = list(base.buckets)
    rows = versions.read(spark, folder, base)
    versions.commit(spark, folder, base, touched, rows, list(sync.KEY))
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, base, touched, rows, list(sync.KEY))
    failed = []

    def write(mark, *rows):
        try:
            sync.merge(spark, folder, chunks(spark, *rows), embedder(mark), tries=10)
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(i + 2, ("A", 10 + i, f"s{i}", f"w{i}"), ("A", 1, "a", "x"))) for i in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert held(spark, folder) == [("A", 1, "x", 1)] + [("A", 10 + i, f"w{i}", i + 2) for i in range(3)]


def test_writers_of_different_buckets_both_commit(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    sync.merge(spark, folder, chunks(spark, *(("A", i, f"s{i}", f"t{i}") for i in range(16))), embedder(1), bucket_rows=2)
    base = versions.load(spark, folder)
    one, other = [b for b, paths in base.buckets.items() if paths][:2]
    for b in (one, other):
        versions.commit(spark, folder, base, [b], versions.read(spark, folder, base, [b]), list(sync.KEY))
    assert versions.load(spark, folder).number == base.number + 2 and len(held(spark, folder)) == 16


def test_a_file_is_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/d/1"
    assert versions.put_new(spark, path, "one") and not versions.put_new(spark, path, "two")
    assert versions.text_of(spark, path) == "one" and len(list((tmp_path / "d").iterdir())) <= 2


def test_nothing_to_merge(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert sync.merge(spark, folder, chunks(spark), embedder(1)).number == 0 and versions.read(spark, folder) is None


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), "conversation_id string, created_at int, content string")


def test_sequence_numbers_of_two_writers(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    conversation.append_to(spark, folder, messages(spark, ("a", 2, "second"), ("a", 1, "first"), ("b", 1, "other")))
    failed = []

    def write(name):
        try:
            conversation.append_to(spark, folder, messages(spark, *(("a", 10 + i, f"{name}{i}") for i in range(4))))
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    rows = sorted((r.sequence_no, r.content) for r in versions.read(spark, folder).where("conversation_id = 'a'").collect())
    assert [n for n, _ in rows] == list(range(1, 11)) and [c for _, c in rows[:2]] == ["first", "second"]
    assert sorted(c for _, c in rows[2:6]) in (["x0", "x1", "x2", "x3"], ["y0", "y1", "y2", "y3"])  # one writer's are together


def test_numbers_of_a_hot_conversation(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("conversation_id"), (F.col("id") * 7919 % 5003).alias("created_at"))
    old = spark.createDataFrame([("hot", 10)], "conversation_id string, sequence_no long")
    found = conversation.append(old, rows).where("conversation_id = 'hot'")
    got = sorted((r.created_at, r.sequence_no) for r in found.collect())
    assert [n for _, n in got] == list(range(11, 11 + len(got)))


def test_releases_are_written_all_or_none(spark, tmp_path):
    folder = str(tmp_path / "r")
    rows = lambda *ids: spark.createDataFrame([("p", i, f"v{i}") for i in ids], "project_id string, release_id string, version string").repartition(3)
    there = lambda: sorted(p.name for p in (tmp_path / "r").glob("*/releases/*"))
    releases.write(rows("1", "2"), folder)
    assert there() == ["1.json", "2.json"]
    for bad in (rows("3", "2"), rows("4", "4"), rows("5", "../6"), rows("7").withColumn("version", F.raise_error(F.lit("lost")).cast("string"))):
        with pytest.raises(Exception):
            releases.write(bad, folder)
        assert there() == ["1.json", "2.json"] and not list((tmp_path / "r/_drafts").glob("*"))
    releases.write(rows("3"), folder)
    found = releases.read(spark, folder, "project_id string, release_id string, version string", "p")
    assert sorted((r.release_id, r.version) for r in found.collect()) == [("1", "v1"), ("2", "v2"), ("3", "v3")]


def test_reports_with_cases_that_do_not_apply(spark):
    run = lambda *rows: spark.createDataFrame(list(rows), "case_id string, hit boolean, recall double, reciprocal_rank double, applicable boolean")
    old, new = run(("a", True, 1.0, 1.0, True), ("b", None, None, None, False), ("c", False, 0.0, 0.0, None)), run(("a", False, 0.0, 0.0, True), ("b", True, 1.0, 1.0, True), ("c", True, 1.0, 0.5, True))
    found = evaluate.compare_reports(old, new)
    assert {r.case_id: r.change for r in found.collect()} == {"a": "HIT_TO_MISS", "b": "NOT_APPLICABLE", "c": "NOT_APPLICABLE"}
    assert evaluate.compare_summary(found).first().not_applicable == 2
    for one, other, what in ((old, new.where("case_id <> 'a'"), "one report only"), (old.unionByName(old), new, "repeated"), (old, new.unionByName(run((" ", True, 1.0, 1.0, True))), "no id")):
        with pytest.raises(ValueError, match=what):
            evaluate.compare_reports(one, other)
    with pytest.raises(ValueError, match="datasets"):
        evaluate.compare_reports(old, new, ("x", "y"))


def test_orders_of_what_is_found():
    assert search.find_order() == ["project_id", "id", "model"] and search.find_order(model="m") == ["project_id", "id"] and search.find_order(model="m", project_id=1) == ["id"]
    assert search.find_order(source_path="s") == ["project_id", "sequence", "id"] and search.find_order(ids=0, project_id=1) == ["id", "model"]


def test_merge_moves_records_once_and_embeds_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "FILE_ROWS", 40)
    schema = "project_id string, source_path string, id long, model string, content_hash string, embedding_text string"
    old = [("A", f"s{i % 5}", i, "m", f"h{i}", f"old {i}") for i in range(300)] + [("B", "s1", i, "m", f"h{i}", f"B {i}") for i in range(20)]
    # s0 is not asked; of the others every 7th has changed, every 11th is gone; one has moved to another source, one is of a source not asked and comes with another too
    new = [(p, s, i, m, h + "+" if i % 7 == 0 else h, f"new {i}") for p, s, i, m, h, _ in old[:300] if s != "s0" and i % 11]
    new = [("A", "s2", *r[2:]) if r[2] == 1 else r for r in new] + [("A", "s3", 5, "m", "other", "new 5"), ("A", "s9", 999, "m", "h", "new 999")]
    folder, table = f"file://{tmp_path}/store", lambda rows: spark.createDataFrame(rows, schema)
    sync.merge(spark, folder, table(old), lambda texts: [[1.0, 0.0]] * len(texts))

    def second(texts):
        assert all(t.startswith("new") and (int(t[4:]) % 7 == 0 or int(t[4:]) in (5, 999)) for t in texts)
        return [[0.0, 1.0]] * len(texts)

    sync.merge(spark, folder, table(new), second)
    keys = {(p, i): h for p, _, i, _, h, _ in new}
    want = [(*r, 1.0) for r in old if r[0] == "B" or r[1] == "s0" or keys.get((r[0], r[2])) == r[4]]
    want += [(*r, 0.0) for r in new if r[2] % 7 == 0 or r[2] in (5, 999)]
    found = versions.read(spark, folder)
    assert sorted((*(r[c] for c in ("project_id", "source_path", "id", "model", "content_hash", "embedding_text")), r.vector[0]) for r in found.collect()) == sorted(want)
    gone = table(old[:300])
    assert 60 <= sync.maybe_in(gone, gone.where("id % 5 = 0"), ["project_id", "id"]).count() < 80
