"""Embedding whitening by a distributed singular value decomposition.

Entries become whole numbers, x = floor(64 * c) + 1000000, so sums and deviations from the mean are exact. A vector less the mean is
(n * x - S) / n, one division of an exact number. MLlib's computeSVD decomposes the rows so centred: with singular values s, the
covariance with divisor n has eigenvalues s^2 / n, and its eigenvectors are the right singular vectors. All components are asked for,
which makes MLlib decompose the Gram matrix whole, to double precision, rather than by iterations up to a tolerance. The total variance comes
from the exact deviations and not from the singular values, so that what is explained is also right where components are left out.

Only counts, sums for each dimension and one square matrix of dimensions go through the driver.

Defined results. A vector that is null or empty, or holds null or an entry that isn't finite, is dropped; so is one whose length is not the most frequent (of
those as frequent the largest). Repeated rows count and are returned as often as they occur; a null id is kept. Components without
variance (under RANK of the largest) are not returned, so a table of one vector, or of equal ones, gives no rows, as an empty table does. Components
of equal variance are some basis of their space. A deviation of over 38 digits, or an entry of over 2^30, is an error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
RANK = 1e-12


def whole_numbers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, x (the vector as whole numbers) of the vectors that take part."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.size(vector) > 0
    sound &= F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    entry = lambda c: F.when(F.abs(c) <= F.lit(float(1 << 30)), F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry of over 2^30")).cast("long"))
    rows = table.select(F.col(id_col).alias("id"), vector.alias("_vector")).where(F.coalesce(sound, F.lit(False)))
    rows = cut(rows.select("id", F.transform("_vector", entry).alias("x")))
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual.d if usual else 0))


def matrix(column):
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their sum in each dimension."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + matrix(batch.column(0)).sum(axis=0, dtype=np.int64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64()), pa.array(np.full(len(total), n), pa.int64())], ["dimension", "total", "n"])

    found = vectors.select("x").mapInArrow(run, "dimension long, total long, n long").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("dimension").collect()
    return (found[0].n if found else 0), [int(r.total) for r in found]


def centred(x, n: int, total: list[int]):
    """n * x - S, exactly: of 64-bit numbers where they suffice, else of Python's."""
    import numpy as np

    wide = max(n * (max(abs(int(x.max())), abs(int(x.min()))) + 1), *map(abs, total)) >= 1 << 62
    return x.astype(object) * n - np.array(total, object) if wide else x * n - np.array(total, np.int64)


def projected(vectors: DataFrame, n: int, total: list[int], weights: list[list[float]] | None = None) -> DataFrame:
    """id, deviation, row: the vector less the mean, or its products with the columns of weights."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        by = None if weights is None else np.array(weights)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                exact = centred(matrix(part.column(1)), n, total)
                most = max(abs(int(exact.max())), abs(int(exact.min())))
                squares = exact.astype(object) ** 2 if most**2 * exact.shape[1] >= 1 << 63 else exact**2
                deviation = pa.array(map(int, squares.sum(axis=1)), pa.decimal128(38, 0))
                row = (exact / n).astype(np.float64)
                row = row if by is None else row @ by
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, pa.array(list(row), pa.list_(pa.float64()))], ["id", "deviation", "row"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "x").mapInArrow(run, f"id {kind}, deviation decimal(38,0), row array<double>")


def row_matrix(rows: DataFrame):
    """The column row as MLlib's distributed matrix."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row"))


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """id, deviation, row (the whitened coordinates) of every vector that takes part, and the model: n, mean, eigenvalues, variance (in total), vectors (a list a component), identity_error."""
    import numpy as np

    vectors = whole_numbers(table, id_col, vector_col)
    n, total = sums(vectors)
    model = {"n": n, "mean": [s / n for s in total], "eigenvalues": [], "variance": 0.0, "vectors": [], "identity_error": 0.0}
    if not n:
        return projected(vectors, 1, total), model
    rows = projected(vectors, n, total)
    deviations = rows.agg(F.sum("deviation")).first()[0]
    if not deviations:  # all vectors are equal
        return rows.where("false"), model
    svd = row_matrix(rows).computeSVD(len(total), computeU=False)
    singular = svd.s.toArray()
    values = singular**2 / n
    kept = min(components, int((values > RANK * values[0]).sum()))
    basis = svd.V.toArray()[:, :kept]
    whitened = cut(projected(vectors, n, total, (basis / np.sqrt(values[:kept])).tolist()))
    covariance = row_matrix(whitened).computeCovariance().toArray() * ((n - 1) / n)  # MLlib's divisor is n - 1
    model |= {
        "eigenvalues": values[:kept].tolist(), "variance": float(Fraction(int(deviations), n**3)), "vectors": basis.T.tolist(),
        "identity_error": float(np.abs(covariance - np.eye(kept)).max()),
    }
    return whitened, model


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(read(spark, sf_dir, "embeddings"))
    explained = F.array(*(F.lit(e / model["variance"]) for e in model["eigenvalues"])).cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("row").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model["identity_error"]).alias("identity_error"),
    )


QUERIES = {"op11_whitening": op11_whitening}
SQL: dict[str, str] = {}
