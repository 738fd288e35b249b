"""Near copies by Jaccard similarity of word shingles: SimHash BK-trees find candidates, whole shingle sets decide.

Texts with one set of shingles are one node. A node has a fingerprint of BITS bits (the bitwise majority of bits mixed from its
shingles' XXH3) and min-hash keys, one for each of BANDS bands of ROWS values. Nodes that share a key are a shard; each is
looked up in a BK-tree of its shard within the radius. The components of the links found are candidate groups, within which whole
shingle sets are compared. Two texts are linked if both agree, and of each component of linked texts the one of smallest id stays.

At a similarity of 0.8 a pair shares no shard with probability 5e-5, and is farther apart than the radius with under 2e-5: an expected
0.151 of the bits differ, 0.1875 at worst for short texts, which have a radius of their own.

Both steps are one procedure, `spanned`, at every size: it gives the components that all links within the groups would give.
A group of over BLOCK members, or BLOCK_BYTES, is dealt into blocks, twice anew, and each block is spanned alone: copies of one text are
connected by that, each having been moved twice. Only members that are then outside the largest component of their
group meet all blocks of the group, and a link is sent on only if it joins two components. So a pair of one component is never
compared again, no pair of two components is left out, pairs are never sent on whole, and texts never leave the one
join that turns them into sets.

Defined results. Null text is the empty text; texts without words are copies of one another. A text shorter than a shingle is one shingle.
Rows without an id stay. Rows that share an id stay or go together; they go if each of their texts is a copy of one of smaller id.
An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, components, cut, per_worker, spread_join
from .simhash import BKTree

WORDS = 5
SIMILARITY = 0.8
BITS = 512
RADIUS = 112
SHORT = 64  # shingles; pairs with a text of at most so many have SHORT_RADIUS
SHORT_RADIUS = 144
BANDS = 25
ROWS = 5
BLOCK = 512
BLOCK_BYTES = 8 << 20
COLUMNS = 4096  # of a matrix of members by shingles
SEED = 42


def shingle_hashes(text: bytes, words: int = WORDS):
    """XXH3 of the distinct shingles, ascending."""
    import numpy as np
    import xxhash

    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    n, of = len(found), xxhash.xxh3_64_intdigest
    whole = b" ".join(found)
    if n <= words:
        return np.array([of(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - words]))
    return np.unique(np.array([of(whole[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], np.uint64))


def multipliers(n: int):
    import numpy as np

    numbers = np.random.default_rng(SEED).integers(0, 1 << 63, (2, n), np.uint64)
    return numbers[0] << np.uint64(1) | np.uint64(1), numbers[1]


def wide_fingerprint(hashes, bits: int = BITS) -> bytes:
    """Of the bits mixed from each hash, those that are set in over half the hashes."""
    import numpy as np

    factors, masks = per_worker(f"near_copies_bits_{bits}", lambda: multipliers(bits // 64))
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 4096):
        mixed = (hashes[i : i + 4096, None] ^ masks) * factors
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def band_keys(hashes, bands: int, rows: int) -> list[int]:
    import numpy as np
    import xxhash

    factors, masks = per_worker(f"near_copies_{bands}_{rows}", lambda: multipliers(bands * rows))
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048, None] ^ masks) * factors).min(axis=0))
    raw = least.tobytes()
    keys = np.array([xxhash.xxh3_64_intdigest(raw[8 * rows * i : 8 * rows * (i + 1)], i) for i in range(bands)], np.uint64)
    return keys.view(np.int64).tolist()


def node_name(hashes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node, fp (fingerprint, then the number of shingles in 4 bytes), keys (one for each band) of every row of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                nodes, fps, keys = [], [], []
                for text in byte_texts(part.column(1)):
                    hashes = shingle_hashes(text, words)
                    nodes.append(node_name(hashes))
                    fps.append(wide_fingerprint(hashes) + len(hashes).to_bytes(4, "big"))
                    keys.append(band_keys(hashes, bands, rows))
                arrays = [part.column(0), pa.array(nodes, pa.binary()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "fp", "keys"])

    return docs.mapInArrow(run, "doc_id long, node binary, fp binary, keys array<long>")


class Forest:
    """Union-find over names; join tells whether two were apart."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        while (above := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[above]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def near_prints(limits: tuple[int, int, int]):
    """A function of the payloads of a block (and of strays): for each stray, or member of the block, the members within the radius."""
    radius, short, short_radius = limits

    def split(payload: bytes) -> tuple[int, int]:
        return int.from_bytes(payload[:-4], "big"), int.from_bytes(payload[-4:], "big")

    def found(members: list[bytes], strays: list[bytes] | None):
        tree, sizes = BKTree(), []

        def look(value: int, size: int):
            wide = short_radius if size <= 2 * short else radius
            for j in tree.within(value, wide):
                if wide == radius or min(size, sizes[j]) <= short or (tree.values[j] ^ value).bit_count() <= radius:
                    yield j

        for payload in members:
            value, size = split(payload)
            if strays is None:
                yield look(value, size)
            tree.add(value)
            sizes.append(size)
        for payload in strays or ():
            yield look(*split(payload))

    return found


def near_sets(similarity: float):
    """The same for payloads that are shingle sets, by their Jaccard similarity: products of matrices of members by shared shingles."""

    def found(members: list[bytes], strays: list[bytes] | None):
        import numpy as np

        mine = [np.frombuffer(x, "<u8") for x in members]
        others = mine if strays is None else [np.frombuffer(x, "<u8") for x in strays]

        def table(sets):
            return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

        a, rows_a = table(mine)
        b, rows_b = (a, rows_a) if strays is None else table(others)
        if strays is None:
            names, times = np.unique(a, return_counts=True)
            shared = names[times > 1]
        else:
            shared = np.intersect1d(a, b)

        def columns(values, rows):
            at = np.searchsorted(shared, values)
            at[at == len(shared)] = 0
            known = shared[at] == values if len(shared) else np.zeros(len(values), bool)
            at, rows = at[known], rows[known]
            order = np.argsort(at, kind="stable")
            return at[order], rows[order]

        (at_a, rows_a), (at_b, rows_b) = columns(a, rows_a), columns(b, rows_b)
        both = np.zeros((len(others), len(mine)), np.float32)
        for low in range(0, len(shared), COLUMNS):
            width, part = min(COLUMNS, len(shared) - low), []
            for at, rows, n in ((at_a, rows_a, len(mine)), (at_b, rows_b, len(others))):
                i, j = np.searchsorted(at, (low, low + width))
                matrix = np.zeros((n, width), np.float32)
                matrix[rows[i:j], at[i:j] - low] = 1
                part.append(matrix)
            both += part[1] @ part[0].T
        size_a, size_b = np.array([len(x) for x in mine]), np.array([len(x) for x in others])
        enough = both + 1e-6 >= similarity * (size_b[:, None] + size_a[None] - both)
        for i, row in enumerate(enough):
            yield (j for j in np.flatnonzero(row).tolist() if strays is not None or j < i)

    return found


def block_links(rows: DataFrame, keys: list[str], near) -> DataFrame:
    """Links (a, b) between labels, that join those of each block. rows: keys, label, stray, payload.

    If a block has strays, each meets the block's other members and these do not meet one another; else all members meet.
    """

    def links(members, strays):
        forest = Forest()
        labels, payloads = zip(*members)
        for (label, _), found in zip(strays or members, near(list(payloads), [s[1] for s in strays] if strays else None)):
            for j in found:
                if forest.join(label, labels[j]):
                    yield label, labels[j]

    def run(batches):
        import pyarrow as pa

        now, members, strays = None, [], []

        def batch():
            found = list(links(members, strays)) if members and len(members) + len(strays) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for incoming in batches:
            columns = [incoming.column(i).to_pylist() for i in range(incoming.num_columns)]
            for *key, label, stray, payload in zip(*columns):
                if key != now:
                    yield batch()
                    now, members, strays = key, [], []
                (strays if stray else members).append((label, payload))
        yield batch()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "label", "stray", "payload").mapInArrow(run, "a binary, b binary")


def spanned(rows: DataFrame, near, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, links: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that all links within the groups, and the links (a, b) given, would connect with others. rows: group, node (once a group), payload."""

    def blocks(n: str, size: str):
        return F.greatest(F.ceil(F.col(n) / F.lit(float(block))), F.ceil(F.col(size) / F.lit(float(block_bytes)))).cast("int")

    def measured(found: DataFrame) -> DataFrame:
        return found.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("size"))

    sizes = cut(measured(rows).where("n > 1").withColumn("blocks", blocks("n", "size")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    known = cut(spread_join(rows, sizes.select("group", "blocks"), "group", sizes.select("group", "n"), total))
    plain = known.withColumn("label", F.col("node")).withColumn("stray", F.lit(False))
    deals = plain.withColumn("deal", F.explode(F.when(F.col("blocks") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    met = block_links(deals.withColumn("part", F.pmod(F.xxhash64("node", "deal"), "blocks")), ["group", "deal", "part"], near)
    found = cut(components(met if links is None else met.unionByName(links)))
    large = known.where("blocks > 1")
    if large.isEmpty():
        return found
    large = cut(large.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    main = large.groupBy("group", "label").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"))
    main = cut(main)
    total = main.agg(F.sum("n")).first()[0]
    strays = cut(spread_join(large, main.select("group", "main"), "group", main.select("group", "n"), total).where("label != main").drop("main"))
    if strays.isEmpty():
        return found
    counts = cut(measured(strays).withColumn("others", blocks("n", "size")))
    some = counts.agg(F.sum("n")).first()[0]
    queries = spread_join(strays, counts.select("group", "others"), "group", counts.select("group", "n"), some)
    queries = queries.withColumn("stray", F.lit(True)).withColumn("other", F.pmod(F.xxhash64("node", F.lit(2)), "others")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = spread_join(large, counts.select("group", "others"), "group", main.select("group", "n"), total)
    held = held.withColumn("stray", F.lit(False)).withColumn("part", F.pmod(F.xxhash64("node", F.lit(0)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    columns = ["group", F.col("part").cast("long"), F.col("other").cast("long"), "label", "stray", "payload"]
    met = block_links(queries.select(*columns).unionByName(held.select(*columns)), ["group", "part", "other"], near)
    joined = cut(components(met).select(F.col("node").alias("component"), F.col("component").alias("joined")))
    if joined.isEmpty():
        return found
    single = joined.select(F.col("component").alias("node"), "component").join(found.select("node"), "node", "left_anti")
    every = cut(found.unionByName(single))
    counts = every.groupBy("component").agg(F.count("*").alias("n"))
    named = spread_join(every, joined, "component", counts, every.count(), "left")
    return cut(named.select("node", F.coalesce("joined", "component").alias("component")))


def shingle_sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, payload (its distinct shingles' hashes) for the rows (doc_id, node) needed, from docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = []
                for node, text in zip(part.column(0).to_pylist(), byte_texts(part.column(1))):
                    hashes = shingle_hashes(text, words)
                    if node_name(hashes) == node:
                        rows.append((node, hashes.tobytes()))
                nodes, sets = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], ["node", "payload"])

    return docs.join(needed, "doc_id").select("node", "text").mapInArrow(run, "node binary, payload binary").dropDuplicates(["node"])


def classes(docs: DataFrame, words: int, similarity: float, limits: tuple[int, int, int], bands: int, rows: int, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """known (doc_id, node, ...) of every row, nodes (node, least id, n rows, ...), and linked (node, component) of the nodes that have a link."""
    known = cut(sketches(docs, words, bands, rows))
    nodes = cut(known.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    keyed = nodes.select(F.explode("keys").alias("group"), "node")
    shards = cut(keyed.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"))
    total = shards.agg(F.sum("n")).first()[0] or 0
    shared = spread_join(keyed, shards.select("group"), "group", shards, total)
    prints = shared.join(nodes.select("node", F.col("fp").alias("payload")), "node").select("group", "node", "payload")
    groups = spanned(prints, near_prints(limits), block, block_bytes)
    sets = shingle_sets(docs, groups.join(nodes.select("node", F.col("least").alias("doc_id")), "node").select("doc_id", "node"), words)
    members = sets.join(groups, "node").select(F.col("component").alias("group"), "node", "payload")
    return known, nodes, spanned(cut(members), near_sets(similarity), block, block_bytes)


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    limits: tuple[int, int, int] = (RADIUS, SHORT, SHORT_RADIUS), bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, copy_of of the ids that go: the smallest id of those that links reach."""
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known, nodes, linked = classes(docs, words, similarity, limits, bands, rows, block, block_bytes)
    named = nodes.select("node", "least", "n").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named)
    ids = named.groupBy("component").agg(F.min("least").alias("copy_of"), F.count("*").alias("n"))
    named = cut(spread_join(named, ids.select("component", "copy_of"), "component", ids.select("component", "n"), named.count()))
    of = spread_join(known.select("doc_id", "node"), named.select("node", "copy_of"), "node", named.select("node", "n"), known.count())
    found = of.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"), F.max("copy_of").alias("greatest"))
    return found.where("greatest < doc_id").select("doc_id", "copy_of")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    gone = copies(docs, id_col, text_col, **options).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
