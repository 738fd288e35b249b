"""A quality classifier by importance resampling.

Two generative models of hashed n-grams (words and punctuation, lower-cased, one and two in a row): the raw model
counts every n-gram of every document, the target model those of labelled good documents. That a word
comes again at once, or again after one token, is an n-gram of its own. A document's log weight is the sum over its n-grams of
the log ratio of the two models, divided by the square root of their number, else long documents
would have most of the weight by chance. Adding a Gumbel variate to the log weight over TEMPERATURE and keeping the k
largest samples k documents without replacement in proportion to exp(log weight / TEMPERATURE); the
variate is a hash of the id, so a rerun gives the same sample.

k is the number of documents whose log weight is above a cut that labelled rows fix: a third of them (by a
hash of the id) fits the target model, a third sets the cut, at which a lost good document counts as
COST_OF_LOSS kept bad ones, and a third is used for nothing, so that it can measure both. At most MOST_LABELS labelled rows, those of smallest hash, are used for
this; they are broadcast. All other counts and weights cover all documents and whole texts.
The k-th largest key is found by a radix selection, four rounds of at most 65,536 counts.

Defined results. Null text is the empty text, of log weight 0. A null label counts as none. Without labelled good rows
all weights are 0; without labelled bad rows everything is kept. Rows that repeat an id and text have one key and are
kept or dropped together, even if that makes more than k. An empty table gives an empty result.
Other columns pass through `keep_quality` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, per_worker, read, texts

BUCKETS = 1 << 16
MOST_LABELS = 20_000
PRIOR = 4.0  # added to a bucket's count under either model
COST_OF_LOSS = 10
TEMPERATURE = 1.0
SEED = 42
MEMO = 100_000
FITS, CUTS, MEASURES = range(3)  # parts of the labelled rows


class Hasher(dict):
    """Token to hash, odd for words, remembered up to MEMO tokens."""

    def __missing__(self, token: str) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), SEED) & ~1 | (token[0].isalnum() or token[0] == "_")
        if len(self) < MEMO:
            self[token] = found
        return found


def ngrams(found: list[str], buckets: int):
    """Bucket and text number of every n-gram of the texts."""
    import re

    import numpy as np

    split = per_worker("importance_split", lambda: re.compile(r"\w+|[^\w\s]+").findall)
    memo = per_worker("importance_memo", Hasher)
    tokens, ends = [], []
    for text in found:
        tokens += split(text.lower())
        ends.append(len(tokens))
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    owner = np.repeat(np.arange(len(found)), np.diff([0, *ends]))
    inner = np.nonzero(owner[1:] == owner[:-1])[0]
    pairs = h[inner] * np.uint64(0x9E3779B97F4A7C15) + h[inner + 1]
    pairs ^= pairs >> np.uint64(29)
    words = h & np.uint64(1) == 1
    again = [np.nonzero((h[d:] == h[:-d]) & (owner[d:] == owner[:-d]) & words[d:])[0] for d in (1, 2)]
    bucket = (np.concatenate((h >> np.uint64(1), pairs)) % np.uint64(buckets - 2)).astype(np.int64)
    repeats = np.repeat([buckets - 2, buckets - 1], [len(a) for a in again])
    return np.concatenate((bucket, repeats)), np.concatenate((owner, owner[inner], *(owner[a] for a in again)))


def chunks(batches, column: int = 1, most: int = 1 << 18, rows: int = 256):
    """Parts of record batches, of at most rows rows and about most characters of text (a longer text is alone), with the texts in a column."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            found = texts(part.column(column))
            begin = size = 0
            for i, text in enumerate(found):
                if size and size + len(text) > most:
                    yield part.slice(begin, i - begin), found[begin:i]
                    begin, size = i, 0
                size += len(text)
            if begin < len(found):
                yield part.slice(begin), found[begin:]


def log_weights(found: list[str], ratio, buckets: int):
    import numpy as np

    bucket, owner = ngrams(found, buckets)
    n = np.bincount(owner, minlength=len(found))
    return n, np.bincount(owner, weights=ratio[bucket], minlength=len(found)) / np.sqrt(np.maximum(n, 1))


def sort_keys(ids, weights, seed: int):
    """Gumbel keys of the rows as signed 64-bit integers that sort alike."""
    import numpy as np
    import xxhash

    u = np.array([xxhash.xxh64_intdigest(str(i).encode(), seed) for i in ids], np.uint64).astype(np.float64)
    keys = (weights / TEMPERATURE - np.log(-np.log((u + 0.5) / 2.0**64 * (1 - 2e-16)))).view(np.int64)
    return keys ^ ((keys >> 63) & 0x7FFFFFFFFFFFFFFF)


def model_counts(rows: DataFrame, buckets: int):
    """Raw and target count of each bucket, as arrays on the driver (their length is the parameter buckets)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch, found in chunks(batches):
            fits = np.array([q == 1 and p == FITS for q, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], bool)
            bucket, owner = ngrams(found, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[fits[owner]], minlength=buckets)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    import numpy as np

    sums = rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    return raw, target


def log_ratio(raw, target):
    import numpy as np

    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + PRIOR) / (expected + PRIOR))


def best_cut(rows: list[tuple[float, int]], cost: int = COST_OF_LOSS) -> float:
    """The weight that best divides labelled (weight, quality) rows; -inf without bad ones."""
    rows = sorted(rows)
    best, at = (0.0, float("-inf")), 0
    lost = rejected = 0
    while at < len(rows):
        weight = rows[at][0]
        while at < len(rows) and rows[at][0] == weight:
            lost += rows[at][1] == 1
            rejected += rows[at][1] == 0
            at += 1
        gain = rejected - cost * lost
        if gain > best[0]:
            best = (gain, (weight + rows[at][0]) / 2 if at < len(rows) else weight)
    return best[1]


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int | None, int]:
    """The k-th largest value of a long column without nulls, and how many of the rows equal to it are among the k largest."""
    if k < 1:
        return None, 0
    found = 0
    for shift in (48, 32, 16, 0):
        part = F.shiftright(column, shift)
        within = rows if shift == 48 else rows.where(F.shiftright(column, shift + 16) == found)
        for value, n in sorted(((r.part, r["count"]) for r in within.groupBy(part.alias("part")).count().collect()), reverse=True):
            found = value
            if k <= n:
                break
            k -= n
    return found, k


class Resampler:
    """A fitted model: ratio (log ratio by bucket), threshold (sort key of the last document kept), scores."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", buckets: int = BUCKETS, most_labels: int = MOST_LABELS, k: int | None = None, seed: int = SEED) -> None:
        self.id_col, self.text_col, self.buckets, self.seed = id_col, text_col, buckets, seed
        spark = docs.sparkSession
        order = F.xxhash64(F.col("doc_id"), F.lit(seed))
        known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(quality_col).cast("int").alias("quality")).dropna()
        known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(order, "doc_id").limit(most_labels).collect()
        known = spark.createDataFrame(known, "doc_id long, quality int").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)).cast("int"))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "doc_id", "left")  # at most most_labels rows
        self.ratio = log_ratio(*model_counts(rows, buckets))
        self.scores = cut(self._scored(rows))
        held = self.scores.where(f"quality is not null and part = {CUTS}").groupBy("doc_id").agg(F.avg("log_weight").alias("log_weight"), F.first("quality").alias("quality")).collect()  # an id once: at most most_labels rows
        self.cut = best_cut([(r.log_weight, r.quality) for r in held])
        self.k = self.scores.where(F.col("log_weight") > self.cut).count() if k is None else k
        self.threshold, self.ties = kth_largest(self.scores, "sort_key", self.k)

    def _scored(self, rows: DataFrame) -> DataFrame:
        shipped, buckets, seed = rows.sparkSession.sparkContext.broadcast(self.ratio), self.buckets, self.seed

        def run(batches):
            import pyarrow as pa

            for batch, found in chunks(batches):
                n, weights = log_weights(found, shipped.value, buckets)
                keys = sort_keys(batch.column(0).to_pylist(), weights, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weights), pa.array(keys), batch.column(2), batch.column(3)], ["doc_id", "n_grams", "log_weight", "sort_key", "quality", "part"])

        return rows.mapInArrow(run, "doc_id long, n_grams long, log_weight double, sort_key long, quality int, part int")

    def _last_id(self) -> int | None:
        """Of documents with the last key, those with at least this id are kept."""
        tied = self.scores.where(F.col("sort_key") == self.threshold).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
        return kth_largest(tied, "doc_id", self.ties)[0]

    def decided(self) -> DataFrame:
        """doc_id, n_grams, log_weight, kept of every document."""
        if self.threshold is None:
            kept = F.lit(False)
        else:
            at_least = F.coalesce("doc_id", F.lit(-(1 << 63))) >= self._last_id()
            kept = (F.col("sort_key") > self.threshold) | (F.col("sort_key") == self.threshold) & at_least
        return self.scores.select("doc_id", "n_grams", "log_weight", kept.alias("kept"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that the sample holds; weights are computed anew where the rows lie, so no text is moved."""
        if self.threshold is None:
            return docs.limit(0)
        shipped, buckets, seed, threshold, last = docs.sparkSession.sparkContext.broadcast(self.ratio), self.buckets, self.seed, self.threshold, self._last_id()
        names, text_col = docs.columns, self.text_col

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch, found in chunks(batches, 1 + names.index(text_col)):
                _, weights = log_weights(found, shipped.value, buckets)
                ids = batch.column(0).to_pylist()
                keys = sort_keys(ids, weights, seed)
                tied = np.array([-(1 << 63) if i is None else i for i in ids]) >= last
                yield pa.RecordBatch.from_arrays(batch.columns[1:], names).filter(pa.array((keys > threshold) | (keys == threshold) & tied))

        rows = docs.select(F.col(self.id_col).cast("long").alias("_id"), *(docs[c] for c in names))
        return rows.mapInArrow(run, docs.schema)


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return Resampler(docs, labels, **options).keep(docs)


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Resampler(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).decided()


QUERIES = {"op9_importance": op9_importance}
SQL: dict[str, str] = {}
