"""Near copies by five-word shingles against brute force."""

import random
import re
from collections import Counter

import pytest

from quillspark.llm import exact_dedup, near_copies

SCHEMA = "doc_id long, text string"


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def similar(a, b, least=0.8):
    return len(a & b) >= least * len(a | b)


def brute_copies(rows):
    """{id: smallest id that links reach} of the ids that go."""
    sets, holders, name = {i: shingles(t) for i, t in rows.items()}, {}, {}

    def root(x):
        while name.setdefault(x, x) != x:
            x = name[x]
        return x

    for i, mine in sets.items():
        for j in {j for s in mine for j in holders.get(s, ())}:
            if similar(mine, sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
        for s in mine:
            holders.setdefault(s, []).append(i)
    return {i: root(i) for i in rows if root(i) != i}


def found_copies(docs, **options):
    return {r.doc_id: r.copy_of for r in near_copies.copies(docs, **options).collect()}


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


def test_documents(spark):
    docs = exact_dedup.drop_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert found_copies(docs) == brute_copies(rows) != {}


def families(rng):
    """Tight families, a family around the limit, a chain whose ends are unlike, and texts that share a passage only."""
    rows = []
    for _ in range(2):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        rows += [edited(base, rng.randrange(4), rng) for _ in range(60)]
    base = [f"v{i}" for i in range(200)]
    rows += [edited(base, rng.randrange(1, 9), rng) for _ in range(120)]
    base = [f"c{i}" for i in range(400)]
    rows += [" ".join(base[3 * k : 3 * k + 250]) for k in range(50)]
    rows += [" ".join([*(f"p{i}" for i in range(150)), *(f"u{rng.randrange(10**9)}" for _ in range(100))]) for _ in range(40)]
    return dict(zip(rng.sample(range(10_000), len(rows)), rows))


@pytest.mark.parametrize(("block", "block_bytes"), [(2, 1 << 20), (16, 20_000), (512, 8 << 20)])
def test_groups_of_any_size_against_brute_force(spark, block, block_bytes):
    rows = families(random.Random(1))
    docs = spark.createDataFrame(list(rows.items()), SCHEMA).repartition(4)
    expected = brute_copies(rows)
    assert found_copies(docs, block=block, block_bytes=block_bytes) == expected
    assert not [i for i, t in rows.items() if t.startswith("p0 ") and i in expected]


def test_similarities_around_the_limit(spark):
    rng = random.Random(2)
    rows, expected = {}, {}
    for pair in range(120):
        base = [f"x{rng.randrange(10**6)}" for _ in range(400)]
        for k, text in enumerate((" ".join(base), edited(base, rng.randrange(1, 20), rng))):
            rows[2 * pair + k] = text
        if similar(shingles(rows[2 * pair]), shingles(rows[2 * pair + 1])):
            expected[2 * pair + 1] = 2 * pair
    docs = spark.createDataFrame(list(rows.items()), SCHEMA)
    assert 20 < len(expected) < 100
    assert found_copies(docs) == expected


def test_edges(spark):
    long = " ".join(f"l{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (None, long), (None, long), (7, long), (8, long + " end"), (9, "same row"), (9, "same row")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fp", "2 AS `group`", "3 AS _gone", "4 AS size")
    assert {(r.doc_id, r.copy_of) for r in near_copies.copies(docs).collect()} == {(2, 1), (3, 1), (5, 4), (8, 7)}
    kept = near_copies.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "None", "None", "7", "9", "9"])
    assert near_copies.drop_copies(docs.limit(0)).count() == 0


def test_rows_of_an_id_go_together(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(100)) for k in "ab")
    rows = [(1, one), (2, one + " x"), (2, one + " y"), (3, two), (3, one + " z"), (4, two + " x")]
    assert found_copies(spark.createDataFrame(rows, SCHEMA), block=2) == {2: 1, 4: 3}


def test_chains_of_prints_over_blocks(spark):
    rng = random.Random(4)
    fps = [0]
    for _ in range(199):  # most links lie between fingerprints whose blocks differ
        value = rng.choice(fps[-3:])
        for bit in rng.sample(range(512), rng.randrange(8, 14)):
            value ^= 1 << bit
        fps.append(value)
    payloads = [x.to_bytes(64, "big") + (1000).to_bytes(4, "big") for x in fps]
    rows = spark.createDataFrame([(7, bytearray(p[:64]), bytearray(p)) for p in payloads], "group long, node binary, payload binary")
    near = near_copies.near_prints((12, 64, 20))
    name = {p[:64]: p[:64] for p in payloads}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 12:
                x, y = name[payloads[i][:64]], name[payloads[j][:64]]
                name = {k: min(x, y) if v in (x, y) else v for k, v in name.items()}
    times = Counter(name.values())
    found = {bytes(r.node): bytes(r.component) for r in near_copies.spanned(rows, near, 8).collect()}
    assert found == {k: v for k, v in name.items() if times[v] > 1}


def test_members_of_one_component_do_not_meet_again(spark, monkeypatch):
    """Copies of one text move twice, whatever their number: none of them is a stray."""
    base = [f"w{i}" for i in range(300)]
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, edited(base, 1, rng)) for i in range(400)], SCHEMA)
    calls, real = [], near_copies.block_links
    monkeypatch.setattr(near_copies, "block_links", lambda rows, keys, near: calls.append((keys, rows.count())) or real(rows, keys, near))
    assert found_copies(docs, block=16) == {i: 0 for i in range(1, 400)}
    assert calls[-1] == (["group", "deal", "part"], 800)


def test_short_texts_at_the_limit(spark):
    rng = random.Random(5)
    rows = {}
    for pair in range(300):
        words = [f"s{rng.randrange(10**9)}" for _ in range(9)]
        rows[2 * pair], rows[2 * pair + 1] = " ".join(words[:8]), " ".join(words)
    docs = spark.createDataFrame(list(rows.items()), SCHEMA)
    assert found_copies(docs) == {i + 1: i for i in range(0, 600, 2)}
