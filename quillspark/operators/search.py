"""Exact k-nearest-neighbour search, and the vector store's keyed operations.

Search: vectors are in slices and queries in blocks, both of bounded size, and a window picks the k best over all pairs that meet; a pair is a row of small matrix products that keeps the k best
of each query. With scopes, slices and blocks lie within each scope, so that a query meets only its own, and all of a scope meet. Without, slices are rings around pivots, and a query meets only
those that the triangle inequality doesn't rule out (`pruned`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, spread_join

MEASURES = ("cosine", "dot", "euclidean", "manhattan")
QUERY_BLOCK = 4096  # queries of a cell
SLICE = 32_768  # vectors of a cell
PIVOTS = 1024  # with RINGS, bounds what goes through the driver
RINGS = 32  # of a pivot with more vectors than a slice
BUNDLE = 8192  # vectors of the rings that one task takes together
TILE = 1024  # vectors of a matrix product
ASKED = 256  # queries of a matrix product
SENT = 2**19  # components of the queries' copies that are sent on together
DECIMALS = 9  # scores are rounded before they are ranked, so that the order of summation decides no tie


def matches(model: str | None = None, dimensions: int | None = None, metadata: dict[str, str] | None = None, vector: str = "embedding", **sets) -> Column:
    """Pre-filter: all kinds must hold; within a set (column=[values]) one value must. Languages compare lower-cased with - for _."""
    test = F.lit(True)
    if model is not None:
        test = test & (F.col("model") == model)
    if dimensions is not None:
        test = test & (F.size(vector) == dimensions)
    for key, value in (metadata or {}).items():
        test = test & F.coalesce(F.element_at("metadata", key) == value, F.lit(False))
    for name, values in sets.items():
        if values:
            if name == "language":
                test = test & F.lower(F.translate(name, "_", "-")).isin([v.replace("_", "-").lower() for v in values])
            else:
                test = test & F.col(name).isin(list(values))
    return test


def scores(vectors, queries, measure: str):
    """Score of each vector (row) for each query (column)."""
    import numpy as np

    if measure in ("cosine", "dot"):
        out = vectors @ queries.T
        if measure == "cosine":
            a, b = (vectors * vectors).sum(1), (queries * queries).sum(1)
            zero = (a <= 1e-12)[:, None] | (b <= 1e-12)[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.clip(out / np.sqrt(a)[:, None] / np.sqrt(b)[None, :], -1, 1)
            out[zero] = 0
        return out
    if len(vectors) < len(queries):
        return scores(queries, vectors, measure).T
    out = np.empty((len(vectors), len(queries)))
    for i, q in enumerate(queries):
        d = vectors - q
        out[:, i] = 1 / (1 + np.sqrt((d * d).sum(1))) if measure == "euclidean" else 1 / (1 + np.abs(d).sum(1))
    return out


def topk(
    vectors: DataFrame, queries: DataFrame, k: int = 8, measure: str = "cosine", minimum: float | None = None, include_rejected: bool = False, id_col: str = "vec_id", vector_col: str = "embedding",
    scope_col: str | None = None, exclude_self: bool = True, block: int = QUERY_BLOCK, slice_size: int = SLICE, report: dict | None = None,
) -> DataFrame:
    """query_id, id, score, rank (from 1; by score, then id) and accepted (score >= minimum) of each query's k best vectors.

    With scope_col a query meets only vectors of its own scope; a null scope meets nothing. A query meets only vectors of its own dimension, and
    null vectors and queries meet nothing. Ids keep their type. Rejected results are left out unless asked for. Null or non-finite components are an error.
    Without scopes, more vectors than a slice holds are searched by pivots (`pruned`); report, if given, gets how many of the slices queries have met.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure}")
    kind = vectors.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col).cast("array<double>")
    scope = F.concat_ws("|", F.size(vector), F.col(scope_col).cast("string")) if scope_col else F.size(vector).cast("string")
    there = vector.isNotNull() & (F.col(scope_col).isNotNull() if scope_col else F.lit(True))
    columns = [F.col(id_col).cast(kind).alias("id"), vector.alias("v"), scope.alias("scope")]
    rows, wanted = vectors.where(there).select(*columns), queries.where(there).select(*columns)
    least = minimum if not include_rejected else None
    some = wanted.groupBy("scope").agg(F.count("*").alias("asked"))
    sizes = some.limit(2).collect() if not scope_col else []
    if len(sizes) == 1:  # one dimension
        rows = rows.where(F.col("scope") == sizes[0].scope)
        total = rows.count()
        if total > slice_size:
            out = pruned(rows.select("id", "v"), wanted.select("id", "v"), total, k, measure, least, exclude_self, block, slice_size, kind, report)
        else:
            out = whole(rows, wanted, total, sizes[0].asked, k, measure, least, exclude_self, block, slice_size, kind)
    else:
        out = scoped(rows, wanted, some, k, measure, least, exclude_self, block, slice_size, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("accepted", F.lit(True) if minimum is None else F.col("score") >= minimum)


CELL = ["scope", "slice", "block"]


def _dealt(found: DataFrame, own: str, number: str, other: str, numbers: str) -> DataFrame:
    return found.withColumn(own, F.pmod(F.xxhash64("id"), number).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(numbers) - 1))).select(*CELL, "id", "v")


def whole(rows, wanted, total, some, k, measure, minimum, exclude_self, block, slice_size, kind) -> DataFrame:
    """Every query meets every vector of its scope; one scope."""
    counts = {"slices": F.lit(max(1, -(-total // slice_size))), "blocks": F.lit(max(1, -(-some // block)))}
    left, right = _dealt(rows.withColumns(counts), "slice", "slices", "block", "blocks"), _dealt(wanted.withColumns(counts), "block", "blocks", "slice", "slices")
    return left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInArrow(best_of(k, measure, minimum, exclude_self), f"query_id {kind}, id {kind}, score double")


def scoped(rows, wanted, some, k, measure, minimum, exclude_self, block, slice_size, kind) -> DataFrame:
    """Every query meets every vector of its scope; many scopes."""
    there = rows.groupBy("scope").agg(F.count("*").alias("n"))
    cells = cut(some.join(there, "scope"))  # scopes that have both
    cells = cells.withColumn("slices", F.ceil(F.col("n") / F.lit(float(slice_size))).cast("int")).withColumn("blocks", F.ceil(F.col("asked") / F.lit(float(block))).cast("int"))
    total, asked = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    split = cells.select("scope", "slices", "blocks")
    left = _dealt(spread_join(rows, split, "scope", cells.select("scope", "n"), total), "slice", "slices", "block", "blocks")
    right = _dealt(spread_join(wanted, split, "scope", cells.select("scope", F.col("asked").alias("n")), asked), "block", "blocks", "slice", "slices")
    return left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInArrow(best_of(k, measure, minimum, exclude_self), f"query_id {kind}, id {kind}, score double")


class Metric:
    """The space in which a measure's order is that of distances: unit vectors for cosine; for dot products one more component, which makes all vectors as long as the longest."""

    def __init__(self, measure: str, longest: float = 0.0) -> None:
        self.measure, self.longest = measure, longest

    def placed(self, v, query: bool):
        """Points of vectors; a zero vector under cosine has none and is left as it is."""
        import numpy as np

        if self.measure == "cosine":
            size = np.sqrt((v * v).sum(1))
            return v / np.where(size * size <= 1e-12, 1, size)[:, None]
        if self.measure == "dot":
            more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.longest**2 - (v * v).sum(1)))
            return np.hstack([v, more[:, None]])
        return v

    def distances(self, points, pivots):
        import numpy as np

        if self.measure == "manhattan":
            return np.stack([np.abs(points - p).sum(1) for p in pivots], axis=1)
        return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], axis=1)

    def nearest(self, points, pivots):
        """A near pivot of each point, and the distance from that. Which of almost equally near ones is open, the distance is exact."""
        import numpy as np

        if self.measure == "manhattan":
            found = self.distances(points, pivots)
            at = found.argmin(1)
            return at, found[np.arange(len(points)), at]
        at = (points @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1)
        return at, np.sqrt(((points - pivots[at]) ** 2).sum(1))

    def best_score(self, nearest, v):
        """The score of vectors at distances `nearest` (queries by rings) from queries v."""
        if self.measure == "cosine":
            return 1 - nearest * nearest / 2
        if self.measure == "dot":
            scale = self.longest**2 + (v * v).sum(1)[:, None]
            return (scale - nearest * nearest) / 2 + 1e-12 * scale  # which may cancel
        return 1 / (1 + nearest)


def pruned(rows, wanted, total, k, measure, minimum, exclude_self, block, slice_size, kind, report) -> DataFrame:
    """Every query meets the slices that can hold one of its k best vectors, by the triangle inequality.

    Each vector belongs to its nearest of some pivots, and to a ring of distances from it. A query first meets the rings that are nearest by their
    bounds and hold k vectors. What it finds there bounds its k-th score from below, and it then meets all other rings that may hold as good a score. Rings next to one another are bundled, so that
    small ones cost no task each: a query goes once to a bundle, with the numbers of the rings there that it meets, and vectors are moved once for each QUERY_BLOCK queries of their bundle (or block, if
    that is more). Vectors of bundles that no query wants are not moved; a ring of many vectors is several bundles. Pivots and the bounds of rings go through the driver: at most PIVOTS vectors and
    PIVOTS * RINGS rows, whatever the data.
    """
    import numpy as np
    import pyarrow as pa

    longest = 0.0
    if measure == "dot":
        longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    metric = Metric(measure, longest)
    few = min(PIVOTS, max(1, -(-2 * total // slice_size)))
    pivots = metric.placed(np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(few).collect()]), False)

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if not np.isfinite(v).all():
                    raise ValueError("vectors must be finite")
                at, away = metric.nearest(metric.placed(v, False), pivots)
                if measure == "cosine":  # zero vectors have a ring of their own
                    zero = (v * v).sum(1) <= 1e-12
                    at[zero], away[zero] = -1, 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(away)], ["id", "v", "pivot", "away"])

    placed = cut(rows.mapInArrow(near, f"id {kind}, v array<double>, pivot int, away double"))
    fractions = [i / RINGS for i in range(1, RINGS)]
    spans = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("away", fractions, 1000).alias("edges")).where(F.col("n") > slice_size)
    edges = {r.pivot: r.edges for r in spans.collect()}
    within = F.create_map(*(x for p, e in edges.items() for x in (F.lit(p), F.array(*map(F.lit, e))))) if edges else None
    ring = F.coalesce(F.size(F.filter(F.element_at(within, F.col("pivot")), lambda e: e < F.col("away"))), F.lit(0)) if edges else F.lit(0)
    placed = placed.withColumn("ring", F.when(ring > 0, ring).otherwise(0))
    rings = placed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).orderBy("pivot", "ring").collect()
    of, n = np.array([r.pivot for r in rings]), np.array([r.n for r in rings])
    low, high = np.array([r.low for r in rings]), np.array([r.high for r in rings])
    parts = -(-n // BUNDLE)
    base, room, bundles = [], 0, 0  # a ring's first bundle; room left in the last one
    for r, p in zip(rings, parts.tolist()):
        if p > 1 or r.n > room:
            base.append(bundles)
            bundles, room = bundles + p, 0 if p > 1 else BUNDLE - r.n
        else:
            base.append(bundles - 1)
            room -= r.n
    base = np.array(base)

    def bounds(v):
        """For queries v and rings: the best score that a ring can hold."""
        d = metric.distances(metric.placed(v, True), pivots)[:, of]
        nearest = np.maximum(0, np.maximum(d - high, low - d)) * (1 - 1e-9)
        best = metric.best_score(nearest, v)
        if measure == "cosine":
            best[:, of == -1] = 0
            best[(v * v).sum(1) <= 1e-12] = 0
        return best

    at_once = max(1, min(ASKED, 2**20 // len(rings), SENT // (bundles * pivots.shape[1])))  # bounds what a task holds

    def visits(again: bool):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for begin in range(0, batch.num_rows, at_once):
                    part = batch.slice(begin, at_once)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    if not np.isfinite(v).all():
                        raise ValueError("vectors must be finite")
                    best = bounds(v)
                    order = np.argsort(-best, axis=1, kind="stable")
                    held = np.cumsum(n[order], axis=1)
                    first = np.zeros(best.shape, bool)
                    np.put_along_axis(first, order, (held - n[order]) < k + exclude_self, axis=1)
                    if again:
                        floor = part.column(2).to_numpy(zero_copy_only=False)
                        floor = np.where(np.isnan(floor), -np.inf, floor)
                        floor = np.maximum(floor, -np.inf if minimum is None else minimum)
                        wants = ~first & (best >= (floor - 1e-9 * np.maximum(1, np.abs(floor)) * 4)[:, None])
                    else:
                        wants = first
                    q, r = np.nonzero(wants)
                    starts = np.flatnonzero(np.diff(q * bundles + base[r], prepend=-1))  # rings of a bundle are next to one another
                    met = pa.ListArray.from_arrays(pa.array(np.append(starts, len(r)).astype(np.int32)), pa.array(r.astype(np.int32)))
                    copies = parts[r[starts]]
                    several = np.repeat(np.arange(len(starts)), copies)
                    number = np.arange(len(several)) - np.repeat(np.cumsum(copies) - copies, copies)
                    who = pa.array(q[starts][several])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array((base[r[starts]][several] + number).astype(np.int32)), met.take(pa.array(several))], ["id", "v", "bundle", "rings"])

        return run

    layout = [[r.pivot for r in rings], [r.ring for r in rings], range(len(rings)), base.tolist(), parts.tolist()]
    layout = pa.table([pa.array(c, pa.int32()) for c in layout], ["pivot", "ring", "number", "base", "parts"])
    layout = F.broadcast(rows.sparkSession.createDataFrame(layout))  # from Arrow, as rows would start a second pool of Python workers
    bundled = placed.join(layout, ["pivot", "ring"]).withColumn("bundle", (F.col("base") + F.pmod(F.xxhash64("id"), "parts")).cast("int")).select("bundle", "number", "id", "v")
    schema, result = f"id {kind}, v array<double>, bundle int, rings array<int>", f"query_id {kind}, id {kind}, score double"
    cell = ["bundle", "block"]

    def met(asked: DataFrame) -> DataFrame:
        asked = cut(asked)
        wants = F.broadcast(asked.groupBy("bundle").agg(F.ceil(F.count("*") / F.lit(float(max(block, QUERY_BLOCK)))).cast("int").alias("blocks")))
        if report is not None:
            report["met"] = report.get("met", 0) + asked.agg(F.coalesce(F.sum(F.size("rings")), F.lit(0))).first()[0]
        left = bundled.join(wants, "bundle").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked.join(wants, "bundle").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        return left.select(*cell, "number", "id", "v").groupBy(*cell).cogroup(right.select(*cell, "rings", "id", "v").groupBy(*cell)).applyInArrow(best_of(k, measure, minimum, exclude_self), result)

    if report is not None:
        report["all"] = len(rings) * wanted.count()
    first = cut(met(wanted.mapInArrow(visits(False), schema)))
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("floor"))
    more = met(wanted.join(kth, "id", "left").select("id", "v", "floor").mapInArrow(visits(True), schema))
    return first.unionByName(more)


def best_of(k: int, measure: str, minimum: float | None, exclude_self: bool):
    """Of two tables of vectors and queries (id, v) the k best vectors of each query, by score, then id.

    Where queries have rings, a query meets only vectors whose number is among them. A product is of TILE vectors and ASKED queries, whatever the tables' sizes.
    """

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(table):
            column = table.column("v").combine_chunks()
            if len(pc.unique(pc.list_value_length(column))) > 1:
                raise ValueError("vectors of one cell must be of one dimension")
            flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            found = flat.reshape(len(table), -1) if len(table) else flat.reshape(0, 0)
            if not np.isfinite(found).all():
                raise ValueError("vectors must be finite")
            return found

        left = left.sort_by("id")
        ids, asked = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        vectors, wanted = matrix(left), matrix(right)
        if len(ids) and len(asked) and vectors.shape[1] != wanted.shape[1]:
            raise ValueError("vectors must be of the queries' dimension")
        places = np.arange(len(ids))  # in the order of ids
        rings = "rings" in right.column_names
        if rings:
            names, ring = np.unique(left.column("number").to_numpy(), return_inverse=True)
            places = np.argsort(ring, kind="stable")
        if exclude_self:
            known = ids.dictionary_encode(null_encoding="encode")
            code, own = known.indices.to_numpy(zero_copy_only=False), pc.fill_null(pc.index_in(asked, known.dictionary), -1).to_numpy(zero_copy_only=False)
        numbers, queries, values = [], [], []
        for begin in range(0, len(asked) if len(ids) else 0, ASKED):
            some = wanted[begin : begin + ASKED]
            best, at = np.full((len(some), k), -np.inf), np.full((len(some), k), len(ids))
            if rings:
                lists = right.column("rings").slice(begin, ASKED).combine_chunks()
                which, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
                there = np.searchsorted(names, flat)
                held = names[np.minimum(there, len(names) - 1)] == flat  # a part of a ring may have no vectors
                meets = np.zeros((len(some), len(names)), bool)
                meets[which[held], there[held]] = True
            for start in range(0, len(ids), TILE):
                tile = places[start : start + TILE]
                q = np.flatnonzero(meets[:, ring[tile[0]] : ring[tile[-1]] + 1].any(1)) if rings else np.arange(len(some))
                if not len(q):
                    continue
                found = np.round(scores(vectors[tile], some[q], measure), DECIMALS).T
                if rings:
                    found[~meets[q][:, ring[tile]]] = -np.inf
                if exclude_self:
                    found[own[begin : begin + ASKED][q][:, None] == code[tile]] = -np.inf
                if minimum is not None:
                    found[found < minimum] = -np.inf
                floor = best[q, k - 1]
                if len(tile) > k:
                    floor = np.maximum(floor, np.partition(found, len(tile) - k, axis=1)[:, len(tile) - k])
                i, j = np.nonzero((found >= floor[:, None]) & (found > -np.inf))
                if not len(i):
                    continue
                new, i, score = np.unique(i), np.searchsorted(np.unique(i), i), found[i, j]
                q = q[new]
                who, score, place = np.append(i, np.repeat(np.arange(len(q)), k)), np.append(score, best[q].ravel()), np.append(tile[j], at[q].ravel())
                order = np.lexsort((place, -score, who))
                each = np.bincount(who)
                order = order[np.arange(len(order)) - np.repeat(np.cumsum(each) - each, each) < k]
                best[q], at[q] = score[order].reshape(-1, k), place[order].reshape(-1, k)
            q, i = np.nonzero(best > -np.inf)
            numbers.append(at[q, i])
            queries.append(begin + q)
            values.append(best[q, i])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"query_id": asked.take(pa.array(join(queries, np.int64))), "id": ids.take(pa.array(join(numbers, np.int64))), "score": pa.array(join(values, np.float64))})

    return run


KEY = ["project_id", "id", "model"]


def newest(rows: DataFrame, by: list[str], order_col: str) -> DataFrame:
    """Of the rows of each key the one of the largest order_col (null is least), then of the largest other columns."""
    others = [f.name for f in rows.schema if f.name not in by and "map<" not in f.dataType.simpleString() and f.name != order_col]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(order_col, *others)).alias("_row")).select("_row.*")


def upsert(stored: DataFrame, incoming: DataFrame, order_col: str = "version", key: list[str] | None = None) -> DataFrame:
    """stored with incoming rows in place of those of the same key; of several incoming rows of a key the newest one."""
    key = key or KEY
    fresh = newest(incoming, key, order_col)
    return stored.join(fresh, key, "left_anti").unionByName(fresh)


def find_latest(stored: DataFrame, id_col: str = "id", time_col: str = "indexed_at") -> DataFrame:
    """For each id, over projects and models, the record indexed last."""
    return newest(stored, [id_col], time_col)


def find_order(ids: DataFrame | None = None, model: str | None = None, source_path: str | None = None, project_id=None) -> list[str]:
    """The columns by which what `find` gives for these arguments is listed: a source's records in its own order, others by project, id and model as far as these are open."""
    order = ["sequence", "id"] if source_path is not None else ["id"] if model is not None else ["id", "model"]
    return order if project_id is not None else [*([] if ids is not None else ["project_id"]), *order]


def find(stored: DataFrame, ids: DataFrame | None = None, model: str | None = None, source_path: str | None = None, project_id=None, ordered: bool = False) -> DataFrame:
    """The records of a store by ids (a DataFrame with column id), model, source path or project, whichever are given; all of them without any. Ordered: in the order of `find_order`."""
    out = stored
    for name, value in (("model", model), ("source_path", source_path), ("project_id", project_id)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    out = out if ids is None else out.join(ids.select("id").distinct(), "id", "left_semi")
    return out.orderBy(*find_order(ids, model, source_path, project_id)) if ordered else out


def delete(stored: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """The records that stay, and the number of deleted ones."""
    gone = F.coalesce(test, F.lit(False))
    return stored.where(~gone), stored.where(gone).agg(F.count("*").alias("deleted"))


def counts(stored: DataFrame, *by: str) -> DataFrame:
    return stored.groupBy(*by).agg(F.count("*").alias("n"))


def partition_path(folder: str, stored: DataFrame, mode: str = "overwrite") -> None:
    """The store as Parquet by project and model, so that a search reads its own partition only."""
    stored.write.partitionBy("project_id", "model").mode(mode).parquet(folder)


