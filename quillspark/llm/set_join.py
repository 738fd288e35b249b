"""Size-aware join of texts by the Jaccard similarity of their n-gram sets: subsets for small sets, inverted lists for large ones.

Texts of one set are one node. Sizes up to a boundary are light, the rest is heavy; the boundary is the one of least cost over the sizes that the table
has (`boundary`), by the keys that each way makes and the sets that it has to fetch.

Light sets that link share t members, t fixed by their sizes. Every light set enumerates its subsets of the sizes t that a partner can ask for; sets with
a subset in common overlap in t, which is proof and needs no look at the sets. Of the sets at a subset, each is linked to the smallest
whose size asks for no more than t: whatever two of them link, both link to that one. So a subset of n sets gives n - 1 links, and they are exact.

Heavy sets, and light ones that a heavy one can link to, are scanned through inverted lists. A list of single n-grams of a passage that many texts
share holds them all, so lists are kept for wider items: a set is cut by hash into as many parts as two linked sets of its class of
sizes can differ in members, and EMPTY more, and a part with its members is the item. Two linked sets have over EMPTY parts in common, of which one at least
has members, or both have over EMPTY parts without members, which then are items too. So every link is at some list, with no counts over the corpus, and texts that share
a passage only share none. Sets at a list are candidates; lists are closed to groups by stars, and within groups whole sets are compared in blocks,
as `near_copies.spanned` does, so pairs are never sent on.

Defined results. Null text is empty; a text without words has an empty set, size 0, and is linked with nothing: it is its own component. A text with
fewer words than an n-gram has one member, all of it. A row without an id links nothing; it gets the component of a row with an id and its set, or null. Repeated rows give repeated results;
rows that share an id but not a text are each their text's. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, components, cut, read, spread_join
from .near_copies import near_sets, node_name, shingle_hashes, shingle_sets, spanned

WORDS = 3
PER_CENT = 90
MOST_LIGHT = 32  # larger sets have too many subsets at any boundary
EMPTY = 2
GROWTH = 1.25  # of the classes of sizes
FETCH = 1.0  # cost of fetching a set, a member, in keys


def overlap(a: int, b: int, per_cent: int) -> int:
    """The least overlap of linked sets of a and b members."""
    return -(-per_cent * (a + b) // (100 + per_cent))


def partners(size: int, per_cent: int) -> tuple[int, int]:
    """The least and the largest size that a linked set can have."""
    return -(-per_cent * size // 100), 100 * size // per_cent


def subset_sizes(size: int, per_cent: int) -> range:
    low, high = partners(size, per_cent)
    return range(overlap(size, low, per_cent), min(size, overlap(size, high, per_cent)) + 1)


def classes_of(size: int, per_cent: int) -> list[tuple[int, int]]:
    """The classes (least size, number of parts) that a set signs for: its own, and the next if a set there can link."""
    low, out = 1, []
    while True:
        after = max(low + 1, int(low * GROWTH))
        if partners(size, per_cent)[1] < low:
            return out
        if size < after:
            most = 2 * (after - 1) * (100 - per_cent) // (100 + per_cent)  # members in which two linked sets can differ
            out.append((low, most + 1 + EMPTY))
        low = after


def light_cost(size: int, per_cent: int) -> float:
    return sum(comb(size, t) for t in subset_sizes(size, per_cent))


def heavy_cost(size: int, per_cent: int) -> float:
    return sum(parts for _, parts in classes_of(size, per_cent)) + FETCH * size


def boundary(counts: dict[int, int], per_cent: int = PER_CENT, most: int = MOST_LIGHT) -> int:
    """The largest light size, of least cost for so many sets of each size up to most. Light sets near the boundary are paid for twice."""

    def cost(x: int) -> float:
        near = partners(x + 1, per_cent)[0]
        return sum(n * ((light_cost(a, per_cent) if a <= x else 0) + (heavy_cost(a, per_cent) if a >= near else 0)) for a, n in counts.items() if a <= most)

    return min(range(most + 1), key=cost)


def list_items(hashes, per_cent: int) -> list[int]:
    """The items of a set's inverted lists: for each class, a digest of each part's members."""
    import numpy as np
    import xxhash

    items, of = [], xxhash.xxh3_64_intdigest
    raw = hashes.tobytes()
    for low, parts in classes_of(len(hashes), per_cent):
        edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        cuts = (8 * np.searchsorted(hashes, edges)).tolist()
        pieces = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)])]
        bare = pieces.count(b"") > EMPTY
        items += [of(piece, low << 24 | i) for i, piece in enumerate(pieces) if piece or bare]
    return np.array(items, np.uint64).view(np.int64).tolist()


def subsets(hashes, per_cent: int):
    """(size, digest) of the subsets of a light set."""
    from itertools import combinations

    import xxhash

    values = [h.to_bytes(8, "little") for h in hashes.tolist()]
    for t in subset_sizes(len(values), per_cent):
        for chosen in combinations(values, t):
            yield t, xxhash.xxh3_128_digest(b"".join(chosen), t)


def sketches(docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """doc_id, node (null without words), size, items (of sets over MOST_LIGHT), members (of the others) of every row of docs (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows = []
                for text in byte_texts(part.column(1)):
                    hashes = shingle_hashes(text, words)
                    if len(hashes) == 1 and not text.split():
                        rows.append((None, 0, None, None))
                    elif len(hashes) > MOST_LIGHT:
                        rows.append((node_name(hashes), len(hashes), list_items(hashes, per_cent), None))
                    else:
                        rows.append((node_name(hashes), len(hashes), None, hashes.tobytes()))
                kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "node", "size", "items", "members"])

    return docs.mapInArrow(run, "doc_id long, node binary, size long, items array<long>, members binary")


def light_links(nodes: DataFrame, light: int, per_cent: int) -> DataFrame:
    """Links (a, b) of the light sets. nodes: node, size, members."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = [(t, digest, node) for node, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for t, digest in subsets(np.frombuffer(raw, np.uint64), per_cent)]
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds)], ["t", "subset", "node"])

    small = nodes.where(F.col("size") <= light).select("node", "size", "members")
    keyed = cut(small.select("node", "members").mapInArrow(run, "t int, subset binary, node binary").join(small.select("node", "size"), "node"))
    least = cut(keyed.groupBy("subset", "t").agg(F.min(F.struct("size", "node")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = spread_join(keyed.select("subset", "node", "size"), least.select("subset", "t", "first"), "subset", least.select("subset", "n"), total)
    linked = met.where((F.col("node") != F.col("first.node")) & (per_cent * (F.col("first.size") + F.col("size")) <= (100 + per_cent) * F.col("t")))
    return linked.select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct()


def candidates(nodes: DataFrame, light: int, per_cent: int) -> DataFrame:
    """group, node of the sets that share a list with another, lists closed to groups. nodes: node, size, items, members."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [list_items(np.frombuffer(raw, np.uint64), per_cent) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "items"])

    near = partners(light + 1, per_cent)[0]
    small = nodes.where(F.col("size").between(near, MOST_LIGHT)).select("node", "members").mapInArrow(run, "node binary, items array<long>")
    lists = nodes.where(F.col("size") > MOST_LIGHT).select("node", "items").unionByName(small).select(F.explode("items").alias("item"), "node")
    shared = cut(lists.groupBy("item").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stars = spread_join(lists, shared.select("item", "first"), "item", shared.select("item", "n"), total)
    found = components(stars.select(F.col("node").alias("a"), F.col("first").alias("b")))
    return cut(found.select(F.col("component").alias("group"), "node"))


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, per_cent: int = PER_CENT, light: int | None = None, **blocks) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; light: the boundary, None to choose it by cost."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = cut(sketches(docs, words, per_cent))
    nodes = known.where("size > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("items").alias("items"), F.first("members").alias("members"))
    nodes = cut(nodes)
    if light is None:
        counts = nodes.where(F.col("size") <= MOST_LIGHT).groupBy("size").agg(F.count("*").alias("sets")).collect()  # one row a size at most
        light = boundary({r["size"]: r.sets for r in counts}, per_cent)
    proven = light_links(nodes, light, per_cent)
    groups = candidates(nodes, light, per_cent)
    named = groups.join(nodes.select("node", F.col("least").alias("doc_id")), "node")
    sets = shingle_sets(docs, named.select("doc_id", "node"), words)
    members = cut(sets.join(groups, "node").select("group", "node", "payload"))
    linked = spanned(members, near_sets(per_cent / 100), links=proven, **blocks)
    named = cut(nodes.select("node", "least", "n").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of = spread_join(named.select("node", "component"), ids.select("component", "component_id"), "component", ids.select("component", "n"), named.count())
    out = spread_join(known.select("doc_id", "node", "size"), cut(of.select("node", "component_id")), "node", nodes.select("node", "n"), known.count(), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sets(read(spark, sf_dir, "documents"))


QUERIES = {"op13_ngram_jaccard": op13_ngram_jaccard}
SQL: dict[str, str] = {}
