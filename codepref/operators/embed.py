"""Embedding pairs (E1-E6): chunking, padding with masks, pair texts, pair
scores, a distributed pair-scorer fit and vector equality.

Everything but the fit is row-local array work (no shuffle); chunk vectors
are reassembled by a group-by on the row key whose groups are one row's
chunks (bounded by the text length, not by the data size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codepref.operators.sampling import materialize


def n_chunks(n: Column, size: int = 512, compat: bool = False) -> Column:
    """E1 chunk count: ceil(n / size); ``compat``: floor(n / size) + 1 (an exact
    multiple leaves an empty last chunk, as in the reference)."""
    return F.floor(n / size) + 1 if compat else F.floor((n + size - 1) / size)


def chunk_tokens(df: DataFrame, key: str, toks: Column, size: int = 512, compat: bool = False) -> DataFrame:
    """One row per (key, chunk) with the chunk's tokens."""
    d = df.select(key, toks.alias("_t"))
    k = n_chunks(F.size("_t"), size, compat)
    chunks = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1),
                                       lambda i: F.slice(F.col("_t"), i * size + 1, size)))
    return (d.select(key, F.posexplode(chunks).alias("chunk", "tokens"))
            .withColumn("chunk", F.col("chunk").cast("bigint")))


def reassemble(chunks: DataFrame, key: str, chunk: str = "chunk", vec: str = "vec") -> DataFrame:
    """Concatenate per-chunk vectors in chunk order (one row's chunks per group)."""
    return chunks.groupBy(key).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(chunk).alias("c"), F.col(vec).alias("v")))),
                              lambda s: s["v"])).alias(vec))


def pad_with_mask(v: Column, width: int) -> tuple[Column, Column]:
    """Zero-pad to ``width`` and a 0/1 mask; a longer vector is an error."""
    checked = F.when(F.size(v) > width, F.raise_error(F.lit(f"vector longer than {width}"))).otherwise(v)
    padded = F.slice(F.concat(checked, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width))), 1, width)
    mask = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.when(i <= F.size(v), 1).otherwise(0))
    return padded, mask


def pair_texts(doc: Column, reference: Column, prediction: Column, sep: str = "") -> tuple[Column, Column]:
    """(doc + reference, doc + prediction), with nothing between by default."""
    between = [F.lit(sep)] if sep else []
    return F.concat(doc, *between, reference), F.concat(doc, *between, prediction)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def mean_score(v: Column) -> Column:
    """Default scorer s(x): mean of the components (left fold, portable)."""
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(v)


def pair_score(sa: Column, sb: Column) -> Column:
    """tanh(s(a) - s(b))."""
    return F.tanh(sa - sb)


def vectors_equal(a: Column, b: Column) -> Column:
    """Same length and equal components."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)


def fit_pair_scorer(pairs: DataFrame, a: str = "a", b: str = "b", label: str = "y",
                    max_iter: int = 50, reg: float = 0.0):
    """E5 (re-aimed): Bradley-Terry pair scorer = logistic regression without
    intercept on feature differences a - b, trained distributed by
    ``pyspark.ml``. Returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    diff = F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") - y.cast("double"))
    data = pairs.select(array_to_vector(diff).alias("features"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(maxIter=max_iter, regParam=reg, fitIntercept=False)
    return lr.fit(data)


def descend_pair_scorer(pairs: DataFrame, a: str = "a", b: str = "b", label: str = "y",
                        steps: int = 3, rate: float = 1.0) -> DataFrame:
    """E5 by a fixed number of full-batch gradient steps from zero: one row
    (idx, weight) per component of a - b, averaged over the pairs.

    The differences are written once. Each step is one aggregate over them: the margin
    is computed in the row from the weights, a literal of one number per component, and
    the gradients are added up as vectors with map-side combine. Only the sum comes to
    the driver. Vectors of unequal length are an error; no pairs give no rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    diff = F.when(F.size(a) == F.size(b), F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") - y.cast("double")))
    d = materialize(pairs.select(F.coalesce(diff, F.raise_error(F.lit("vectors of unequal length"))).alias("d"),
                                 F.col(label).cast("double").alias("y")))
    spark = pairs.sparkSession
    width = d.select(F.size("d")).first()
    weights = [0.0] * (width[0] if width else 0)
    for _ in range(steps if width else 0):
        margin = F.aggregate(F.zip_with(F.col("d"), F.lit(weights), lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)
        error = F.col("y") - 1.0 / (1.0 + F.exp(-margin))
        rows = d.select("d", error.alias("e"))
        part = rows.select(array_to_vector(F.transform("d", lambda x: x * F.col("e"))).alias("g"))
        mean = part.select(Summarizer.mean(F.col("g"))).first()[0]
        weights = [w + rate * float(g) for w, g in zip(weights, mean)]
    return spark.createDataFrame(list(enumerate(weights)), "idx int, weight double")
