"""The corpus pipeline against a plain version of each stage."""


import corpus_pipeline
from quillspark.llm import importance, pii

from .test_near_copies import brute_copies
from .test_operators import SF, brute_dedup, check_pieces


def test_pipeline(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in importance.keep_quality(docs, labels).collect()}
    assert 0 < len(rows) <= docs.count()
    rows = {i: t for i, t in rows.items() if {d: k for d, _, _, k, _ in brute_dedup(list(rows.items()))}[i]}
    gone = brute_copies(rows)
    assert gone
    rows = {i: t for i, t in rows.items() if i not in gone}
    model = pii.trained()
    for i, text in rows.items():
        _, spans = next(pii.find(model, [text]))
        for kind, a, b in sorted(spans, key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        rows[i] = text
    check_pieces(corpus_pipeline.run(spark, SF).collect(), rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def written(spark, folder, rows, labels):
    extra = [(i, t, "en", "s", 0, b"x", 1, "k", "g") for i, t in rows]
    spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, node binary, copy_of int, _keep_id string, `group` string").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  "), (4, base), (5, base + " x"), (5, base + " x"), (6, base.upper()), (None, "no id"), (None, "other"), (7, "one"), (7, "two three"), (8, "mail a@b.example.com now"), (9, "long " * 30_000)]
    folder = written(spark, tmp_path, rows, [(4, 1, 0), (None, 0, 0), (9, None, None)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    texts = sorted((str(r.doc_id), (r.text or "")[:24]) for r in kept.collect())
    assert texts == sorted([("2", ""), ("5", base[:24]), ("5", base[:24]), ("7", "one"), ("7", "two three"), ("8", "mail [EMAIL] now"), ("9", "long long long long long"), ("None", "no id"), ("None", "other")])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {2, 5, 7, 8, 9, None} and all(r.length > 0 for r in packed)


def test_very_long_white_space(spark, tmp_path):
    rows = [(1, f"some{' ' * 1_000_000}words"), (2, "x" + "\n" * 1_000_000), (3, "\t" * 1_000_000)]
    check_pieces(corpus_pipeline.run(spark, written(spark, tmp_path, rows, [])).collect(), dict(rows))


def test_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
