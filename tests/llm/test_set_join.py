"""The size-aware join against sets compared one by one."""

import random
import re

import pytest

from quillspark import llm
from quillspark.llm import set_join

SCHEMA = "doc_id long, text string, node string, size int, component_id string"


def shingles(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute(rows, per_cent=90):
    sets, where = [shingles(t) for _, t in rows], {}
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, of in enumerate(sets):
        counts = {}
        for x in of:
            for j in where.setdefault(x, []):
                counts[j] = counts.get(j, 0) + 1
            where[x].append(i)
        for j, both in counts.items():
            if 100 * both >= per_cent * (len(of) + len(sets[j]) - both):
                above[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows))


def families(seed=1):
    """Texts of 3 to 400 words with copies that differ in some words in places, at the front or at the end; equal sets of other texts; a hot passage."""
    some, rows = random.Random(seed), []
    passage = " ".join(some.choices("one two three four five six seven eight".split(), k=60))
    for n in [*range(3, 42), 60, 80, 120, 200, 400] * 2:
        words = [f"w{some.randrange(10**6)}" for _ in range(n)]
        rows.append(" ".join(words))
        for _ in range(6):
            other = list(words)
            for _ in range(some.randrange(0, 2 + n // 40)):
                other[some.choice([0, -1, some.randrange(len(other))])] = f"x{some.randrange(10**6)}"
            other = other[some.randrange(2) :] + [f"y{some.randrange(9)}"] * some.randrange(2)
            rows.append(" ".join(other).title() if some.random() < 0.3 else "  ".join(other))
        rows.append(f"{' '.join(words)}\n{passage}")
    return [(i, t) for i, t in enumerate(rows)]


def plain(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = llm.QUERIES["op13_ngram_jaccard"](spark, folder)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    assert plain(found) == brute(rows)


@pytest.mark.parametrize("light, block", [(None, 512), (0, 16), (18, 2)])
def test_families_at_every_boundary(spark, light, block):
    rows = families()
    expected = brute(rows)
    assert 100 < len({c for *_, c in expected}) < len(rows)
    table = spark.createDataFrame([(i, t, "n", 1, "c") for i, t in rows], SCHEMA)
    assert plain(set_join.join_sets(table, light=light, block=block)) == expected


def test_a_lower_similarity(spark):
    rows = families(2)
    table = spark.createDataFrame([(i, t, "n", 1, "c") for i, t in rows], SCHEMA)
    assert plain(set_join.join_sets(table, per_cent=80, light=12)) == brute(rows, 80)


def test_every_linked_pair_has_an_item_or_a_subset_in_common():
    """Sets of all sizes that differ as much as linked ones can."""
    import numpy as np

    some = np.random.default_rng(7)
    for per_cent in (80, 90):
        for a in range(1, 140):
            for b in range(a, set_join.partners(a, per_cent)[1] + 1):
                both = set_join.overlap(a, b, per_cent)
                if both > a:
                    continue
                numbers = np.unique(some.integers(0, 1 << 63, 2 * (a + b), np.uint64) * np.uint64(2))[: a + b - both]
                numbers = some.permutation(numbers)
                left, right = np.sort(numbers[:a]), np.sort(np.concatenate([numbers[:both], numbers[a:]]))
                assert len(right) == b
                assert set(set_join.list_items(left, per_cent)) & set(set_join.list_items(right, per_cent))
                if b <= 14:
                    common = set(set_join.subsets(left, per_cent)) & set(set_join.subsets(right, per_cent))
                    assert any(t >= both for t, _ in common)


def test_sets_with_many_bare_parts_still_meet():
    import numpy as np

    close = np.arange(100, dtype=np.uint64)  # all in the first part
    assert set(set_join.list_items(close, 90)) & set(set_join.list_items(close[:92], 90))


def test_the_boundary_follows_the_cost():
    few = set_join.boundary({a: 1 for a in range(1, 33)})
    assert 0 < few < 20
    assert set_join.boundary({}) == 0
    assert set_join.boundary({10: 100, 25: 0}) >= 10
    assert set_join.light_cost(30, 90) > set_join.heavy_cost(30, 90) and set_join.light_cost(5, 90) < set_join.heavy_cost(5, 90)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (5, "a  B"), (6, "one"), (7, long), (8, long + " end"), (9, long.replace("word7 ", "other ")), (10, "É b"), (11, "é b")]
    table = spark.createDataFrame([(i, t, "n", 1, "c") for i, t in rows], SCHEMA)
    assert plain(set_join.join_sets(table)) == brute(rows)


def test_rows_without_an_id(spark):
    table = spark.createDataFrame([(None, "a b c d", "n", 1, "c"), (None, "only here", "n", 1, "c"), (None, None, "n", 1, "c"), (3, "A b c d", "n", 1, "c")], SCHEMA)
    assert sorted(map(str, map(tuple, set_join.join_sets(table).collect()))) == sorted(map(str, [(None, 2, 3), (None, 1, None), (None, 0, None), (3, 2, 3)]))


def test_empty(spark):
    assert set_join.join_sets(spark.createDataFrame([], SCHEMA)).isEmpty()
