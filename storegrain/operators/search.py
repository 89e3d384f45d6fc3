"""Store documents, embeddings and vector search."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from storegrain.functions.columns import blank_to_null, first_present, lookup
from storegrain.operators.ranking import top_k
from storegrain.schemas import STATUS_NAMES
from storegrain.session import stage

# The functions that run in tasks travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = ("store_name", "bizesNm")
CATEGORY = ("category_large", "business_category", "indsLclsCdNm")
SUB_CATEGORY = ("category_mid", "business_sub_category", "indsMclsCdNm")
DETAIL = ("category_small", "indsSclsCdNm", "business_detail")
DISTRICT = ("adong_name", "district", "adongNm")
ADDRESS = ("road_address", "rdnmAdr", "lnoAdr")
SGG = ("sgg_name", "sggNm", "sgg_nm")
STATUS = ("biz_status_cd", "b_stt_cd", "b_stt")

# Document layout.
SEPARATOR = " | "
NAMELESS = "상호 미상"
LABELS = {
    "category": "업종: ", "sub_category": "세부: ", "detail": "상세: ",
    "place": "위치: ", "address": "주소: ", "status": "상태: ",
}

# Query vectors and documents compared at a time.
QUERY_BLOCK = 2_000
DOC_CHUNK = 20_000
# Similarities held at a time, 32 MB of doubles.
MATRIX_CELLS = 4_000_000
# The index: rows it is fitted on (about), cells at most; queries (at most) and neighbours its number of probes is measured on, and the
# share of them that must be found.
FIT_ROWS, MAX_CELLS = 50_000, 1_024
TUNING_QUERIES, TUNING_K, RECALL = 200, 5, 0.95


def _text(df: DataFrame, candidates) -> Column:
    name = first_present(df.columns, candidates)
    return blank_to_null(name) if name else F.lit(None).cast("string")


def store_documents(df: DataFrame, key: str = "biz_id") -> DataFrame:
    """One ``(id, text, metadata)`` per store; empty parts are left out.

    The id comes from the store key, so it does not move when rows are added.
    """
    category, sub, detail = _text(df, CATEGORY), _text(df, SUB_CATEGORY), _text(df, DETAIL)
    district, address, sgg = _text(df, DISTRICT), _text(df, ADDRESS), _text(df, SGG)
    code = first_present(df.columns, STATUS)
    status = lookup(STATUS_NAMES, code) if code else F.lit(None).cast("string")
    place = F.when(sgg.isNotNull(), F.concat(sgg, F.lit(" "), district)).otherwise(district)

    def labelled(name: str, value: Column) -> Column:
        return F.concat(F.lit(LABELS[name]), value)

    text = F.concat_ws(
        SEPARATOR, F.coalesce(_text(df, NAME), F.lit(NAMELESS)), labelled("category", category),
        labelled("sub_category", sub), labelled("detail", detail), labelled("place", place),
        labelled("address", address), labelled("status", status))
    entries = {"category": category, "sub_category": sub, "district": district, "sgg": sgg, "status": status}
    metadata = F.map_filter(
        F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return df.select(
        F.concat(F.lit("store_"), F.col(key).cast("string")).alias("id"), text.alias("text"), metadata.alias("metadata"))


# -- embedding --------------------------------------------------------------

def fit_text_embedder(documents: DataFrame, dimensions: int = 256, text: str = "text") -> PipelineModel:
    """Hashed, weighted and normalised word counts; needs no model file."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\s|:,.()]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(documents)


def embed_with_model(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``embedding array<float>``; everything runs in the JVM."""
    out = model.transform(df).withColumn("embedding", vector_to_array("_unit", "float32"))
    return out.select(*df.columns, "embedding")


def embed_with(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text",
               batch_size: int = 100) -> DataFrame:
    """Embeds with a caller's function, batch by batch.

    A batch whose call fails, or in which any text gets no vector, is left out as a whole; ``embed_or_explain`` keeps its rows.
    """
    return embed_or_explain(df, embedder, text, batch_size, retry=False).filter("embedding is not null").drop("error", "attempts")


def embed_or_explain(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text",
                     batch_size: int = 100, retry: bool = True) -> DataFrame:
    """Adds ``embedding``, ``error`` and ``attempts``: every row stays, one without a vector says why.

    Texts are embedded batch by batch. If the call for a batch fails, or any of its texts gets no vector, its texts are tried again one by one,
    so that only those which fail alone stay without a vector. Columns with the new names are replaced.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("embedding", "error", "attempts")])
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()),
                           T.StructField("attempts", T.IntegerType())])

    def tried(texts: list) -> tuple[list, str | None]:
        try:
            vectors = embedder(texts)
        except Exception as error:
            return [None] * len(texts), f"{type(error).__name__}: {error}"
        if len(vectors) != len(texts) or any(v is None or not len(v) for v in vectors):
            return [None] * len(texts), "no vector"
        return [np.asarray(v, dtype=np.float32) for v in vectors], None

    # Arrow batches are cut without a copy: only the texts of one call become Python strings, other columns are handed through.
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for start in range(0, frame.num_rows, batch_size):
                batch = frame.slice(start, batch_size)
                texts = batch.column(text).to_pylist()
                vectors, error = tried(texts)
                errors, attempts = [error] * len(texts), 1
                if error is not None and retry:
                    single = [tried([t]) for t in texts]
                    vectors, errors, attempts = [v[0] for v, _ in single], [e for _, e in single], 2
                added = pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string()), pa.array([attempts] * len(texts), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "embedding", "error", "attempts"])

    return df.mapInArrow(run, schema)


def embed_counts(embedded: DataFrame) -> DataFrame:
    """``n_embedded, n_failed, n_retried`` of the rows of ``embed_or_explain``."""
    return embedded.agg(F.count("embedding").alias("n_embedded"), F.count("error").alias("n_failed"),
                        F.count(F.when(F.col("attempts") > 1, 1)).alias("n_retried"))


# -- exact search -----------------------------------------------------------

def _unit_rows(vectors, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as a matrix and the mask of the usable inputs.

    Missing and empty vectors and those with NaN, infinite or null elements are unusable; one of another width is an error.
    """
    width = width or next((len(v) for v in vectors if v is not None and len(v)), 0)
    usable = np.array([v is not None and len(v) > 0 for v in vectors], dtype=bool)
    if any(len(v) != width for v, ok in zip(vectors, usable) if ok):
        raise ValueError("vectors of different widths")
    if not usable.any():
        return np.empty((0, width)), usable
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v, ok in zip(vectors, usable) if ok])
    length = np.linalg.norm(matrix, axis=1)
    whole = np.isfinite(length) & (length > 0)
    usable[np.flatnonzero(usable)[~whole]] = False
    return matrix[whole] / length[whole, None], usable


def _matches(names, queries: np.ndarray, keys, rows: np.ndarray, k: int, query_id: str, doc_id: str) -> pd.DataFrame:
    """The best k documents of one batch for every query of one block."""
    order = np.argsort(keys, kind="stable")
    names, keys, rows = np.asarray(names), np.asarray(keys)[order], rows[order]
    step = max(k, MATRIX_CELLS // max(1, len(queries)))
    best = None
    for start in range(0, len(rows), step):
        similarity = queries @ rows[start:start + step].T
        # Rounded before ranking, so that ties fall to the smaller key on any partitioning.
        top = np.argsort(-np.round(similarity, 9), axis=1, kind="stable")[:, :k]
        part = pd.DataFrame({
            query_id: np.repeat(names, top.shape[1]),
            doc_id: keys[start:start + step][top.ravel()],
            "similarity": np.take_along_axis(similarity, top, axis=1).ravel(),
        })
        best = part if best is None else _best_of(pd.concat([best, part]), k, query_id, doc_id)
    return best


def _best_of(frame: pd.DataFrame, k: int, query_id: str, doc_id: str) -> pd.DataFrame:
    frame = frame.assign(_s=-frame["similarity"].round(9)).sort_values([query_id, "_s", doc_id])
    return frame.groupby(query_id, sort=False).head(k).drop(columns="_s")


def nearest(docs: DataFrame, queries: DataFrame, k: int = 5, *, doc_id: str = "id", query_id: str = "query_id",
            vector: str = "embedding", block: int = QUERY_BLOCK, chunk: int = DOC_CHUNK) -> DataFrame:
    """Exact top-k documents per query by cosine: ``(query_id, id, similarity, rank)``.

    Up to ``block`` queries are broadcast: every task compares its documents with
    them as matrix products and hands on only its best k per query. More queries
    are laid out with the documents as a grid of blocks and chunks of
    bounded size, one matrix product per field. Neither way makes a row per pair.
    Ids must be unique on both sides.
    """
    schema = T.StructType([
        queries.schema[query_id], docs.schema[doc_id], T.StructField("similarity", T.DoubleType())])
    docs, queries = docs.select(doc_id, vector), queries.select(query_id, vector)
    n_queries = queries.count()
    if n_queries <= block:
        found = _broadcast_top_k(docs, queries, k, doc_id, query_id, vector, schema)
    else:
        found = _grid_top_k(docs, queries, n_queries, k, doc_id, query_id, vector, schema, block, chunk)
    return top_k(found, [query_id], [F.round("similarity", 9).desc(), F.col(doc_id)], k)


def _broadcast_top_k(docs, queries, k, doc_id, query_id, vector, schema) -> DataFrame:
    rows = queries.collect()  # at most one block
    matrix, usable = _unit_rows([r[1] for r in rows])
    names = [r[0] for r, ok in zip(rows, usable) if ok]
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        best = None
        for frame in frames:
            if not names or frame.empty:
                continue
            unit, ok = _unit_rows(list(frame[vector]), matrix.shape[1])
            if len(unit):
                part = _matches(names, matrix, frame[doc_id].to_numpy()[ok], unit, k, query_id, doc_id)
                best = part if best is None else _best_of(pd.concat([best, part]), k, query_id, doc_id)
        if best is not None:
            yield best

    return docs.mapInPandas(run, schema)


def _matcher(schema: T.StructType, k: int, query_id: str, doc_id: str, vector: str):
    """The best k of one chunk of documents for each query of one block."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        matrix, asked = _unit_rows(list(right[vector])) if len(right) else (np.empty((0, 0)), None)
        unit, ok = _unit_rows(list(left[vector]), matrix.shape[1]) if len(left) and len(matrix) else (matrix[:0], None)
        if not len(matrix) or not len(unit):
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
        return _matches(right[query_id].to_numpy()[asked], matrix, left[doc_id].to_numpy()[ok], unit, k, query_id, doc_id)

    return run


def _grid_top_k(docs, queries, n_queries, k, doc_id, query_id, vector, schema, block, chunk) -> DataFrame:
    blocks = -(-n_queries // block) * 2
    chunks = max(1, -(-docs.count() // chunk) * 2)

    def spread(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Both sides may come from one table; columns that a cogroup finds on both sides would be lost on one, so each side has its own.
    left = docs.select(F.col(doc_id).alias(doc_id), F.col(vector).alias(vector)).withColumn("_chunk", spread(doc_id, chunks)).withColumn("_block", every(blocks))
    right = queries.select(F.col(query_id).alias(query_id), F.col(vector).alias(vector)).withColumn("_block", spread(query_id, blocks)).withColumn("_chunk", every(chunks))

    grid = ["_chunk", "_block"]
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(_matcher(schema, k, query_id, doc_id, vector), schema)


# -- approximate search -----------------------------------------------------

def _unit_vectors(df: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """Unit vectors as ``_unit``; rows without a direction are left out, one of another width than ``width`` is an error."""
    raw = df.withColumn("_raw", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    squares = F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fits = F.lit(True) if width is None else F.when(F.size(vector) == width, True).otherwise(
        F.raise_error(F.lit("vectors of different widths")).cast("boolean"))
    # NaN counts as larger than infinity
    usable = F.when((squares > 0) & (squares < float("inf")), fits).otherwise(False)
    return Normalizer(inputCol="_raw", outputCol="_unit").transform(raw.filter(usable)).drop("_raw")


@dataclass(frozen=True)
class Index:
    """Cells of unit vectors and the number of cells to look at for each query."""

    model: KMeansModel
    probes: int

    @property
    def centres(self) -> np.ndarray:
        return _unit_rows(self.model.clusterCenters())[0]


def fit_index(docs: DataFrame, vector: str = "embedding", doc_id: str = "id", cells: int | None = None,
              fit_rows: int = FIT_ROWS, recall_target: float = RECALL, seed: int = 42) -> Index | None:
    """Centres of cells for unit vectors (the square root of the row count, at most ``MAX_CELLS``).

    They are fitted on about ``fit_rows`` rows, chosen by the hash of their id; every row is put into a cell later. The number of probes
    is measured on the same sample: as many nearest cells as hold ``recall_target`` of the true neighbours of some sampled vectors
    (in the whole table neighbours are nearer, so that no more are missed there). None if no row has a direction.
    """
    total = docs.count()
    share = min(1.0, fit_rows / max(1, total))
    chosen = docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else docs
    sample = stage(_unit_vectors(chosen, vector).select(F.col(doc_id).alias("id"), F.col(vector).alias("vector"), "_unit"), "index-sample")
    if sample.isEmpty():
        return None
    cells = cells or min(MAX_CELLS, max(2, round(total ** 0.5)))
    model = KMeans(k=cells, featuresCol="_unit", predictionCol="_cell", distanceMeasure="cosine", maxIter=10, seed=seed).fit(sample)
    return Index(model, _measured_probes(model, sample, recall_target))


def _measured_probes(model: KMeansModel, sample: DataFrame, target: float) -> int:
    asked = sample.orderBy(F.xxhash64(F.lit("tuning"), "id"), "id").limit(TUNING_QUERIES).select(F.col("id").alias("query_id"), "vector")
    asked = stage(asked, "tuning-queries")
    near = nearest(sample.select("id", "vector"), asked, TUNING_K + 1, vector="vector").filter("id != query_id")
    cells = {r[0]: r[1] for r in asked.collect()}  # at most TUNING_QUERIES rows, and TUNING_K + 1 for each below
    pairs = near.join(model.transform(sample).select("id", "_cell"), "id").select("query_id", "_cell").collect()
    if not pairs:
        return len(model.clusterCenters())
    centres = _unit_rows(model.clusterCenters())[0]
    place = {q: np.argsort(np.argsort(-(centres @ np.asarray(v, dtype=np.float64)), kind="stable")) for q, v in cells.items()}
    needed = sorted(int(place[r["query_id"]][r["_cell"]]) + 1 for r in pairs)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]


# -- stored index -----------------------------------------------------------

class StoredIndex:
    """A cell index that lasts: centres and probes, and the documents in one folder for each cell.

    ``add`` puts new documents into cells without fitting again; rows of a document come once in each added batch, so ids must be new. Each batch
    is its own folder, named by the caller: writing a batch again (a retry) replaces it. A search reads only the folders of the cells that its
    queries look at.
    """

    def __init__(self, spark: SparkSession, path: str, doc_id: str = "id", vector: str = "embedding"):
        self.spark, self.path, self.doc_id, self.vector = spark, path.rstrip("/"), doc_id, vector

    def reset(self, docs: DataFrame, **options) -> "StoredIndex":
        """Fit cells to ``docs`` and write them as the only batch; what was stored before goes."""
        model = fit_index(docs, self.vector, self.doc_id, **options)
        if model is None:
            raise ValueError("no document has a direction")
        width = len(model.centres[0])
        rows = [(i, c.tolist(), model.probes, width) for i, c in enumerate(model.centres)]
        fitted = self.spark.createDataFrame(rows, "_cell int, centre array<double>, probes int, width int")
        fitted.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self._placed(docs, model.centres).withColumn("batch", F.lit("reset")).write.mode("overwrite").partitionBy("batch", "_cell").parquet(f"{self.path}/documents")
        return self

    def add(self, docs: DataFrame, batch: str) -> "StoredIndex":
        """Put further documents into the cells; only the folders of this batch are written."""
        if batch == "reset":
            raise ValueError("that name is taken by the first batch")
        rows = self._placed(docs, self._centres()[0])
        rows.write.mode("overwrite").partitionBy("_cell").parquet(f"{self.path}/documents/batch={batch}")
        return self

    def documents(self) -> DataFrame:
        """All documents that are in the index, with ``batch`` and ``_cell``."""
        return self.spark.read.option("basePath", f"{self.path}/documents").parquet(f"{self.path}/documents")

    def count(self) -> DataFrame:
        """``n_docs``: documents with a usable vector."""
        return self.documents().agg(F.count("*").alias("n_docs"))

    def search(self, queries: DataFrame, k: int = 5, *, query_id: str = "query_id", probes: int | None = None) -> DataFrame:
        """Top-k by cosine in the ``probes`` cells nearest to each query; only their folders are read. A query that finds fewer than ``k`` is searched exactly."""
        centres, measured = self._centres()
        asked = stage(_probes(queries, centres, query_id, self.vector, probes or measured), "probes")
        wanted = sorted(r[0] for r in asked.select("_cell").distinct().collect())  # one number for each cell at most
        docs = self.documents().filter(F.col("_cell").isin(wanted)).select(self.doc_id, self.vector, "_cell")
        return _searched(docs, asked, self.documents(), queries, k, self.doc_id, query_id, self.vector, QUERY_BLOCK, DOC_CHUNK)

    def _centres(self) -> tuple[np.ndarray, int]:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("_cell").collect()  # at most MAX_CELLS rows
        return np.array([r.centre for r in rows]), rows[0].probes

    def _placed(self, docs: DataFrame, centres: np.ndarray) -> DataFrame:
        """``docs`` with the cell of their nearest centre; rows without a direction are left out, vectors of another width are an error."""
        vector = self.vector
        schema = T.StructType([*docs.schema.fields, T.StructField("_cell", T.IntegerType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                unit, ok = _unit_rows(list(frame[vector]), centres.shape[1])
                if len(unit):
                    yield frame[ok].assign(_cell=np.argmax(unit @ centres.T, axis=1).astype(np.int32))

        return docs.mapInPandas(run, schema)


def _probes(queries: DataFrame, centres: np.ndarray, query_id: str, vector: str, probes: int) -> DataFrame:
    """``query_id, vector, _cell``: each query once for each of the cells with the nearest centres."""
    schema = T.StructType([queries.schema[query_id], queries.schema[vector], T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            unit, ok = _unit_rows(list(frame[vector]), centres.shape[1])
            nearest_cells = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]
            if len(unit):
                yield frame[ok].assign(_cells=list(nearest_cells.astype(np.int32)))

    return queries.select(query_id, vector).mapInPandas(run, schema).select(query_id, vector, F.explode("_cells").alias("_cell"))


def nearest_approx(index: Index | None, docs: DataFrame, queries: DataFrame, k: int = 5, *, probes: int | None = None,
                   doc_id: str = "id", query_id: str = "query_id", vector: str = "embedding",
                   block: int = QUERY_BLOCK, chunk: int = DOC_CHUNK) -> DataFrame:
    """Top-k by cosine among the documents in the ``probes`` cells nearest to a query (as many as the index has measured,
    if not given): ``(query_id, id, similarity, rank)``.

    Cells are cut into chunks of documents and blocks of queries by measured counts, so a crowded cell is many
    matrix products of bounded size and no row is made for a pair. A query that finds fewer than ``k`` documents in its cells is
    answered by exact search. Ids must be unique on both sides.
    """
    if index is None:
        return nearest(docs, queries, k, doc_id=doc_id, query_id=query_id, vector=vector)
    docs, queries = docs.select(doc_id, vector), queries.select(query_id, vector)
    centres = index.centres
    placed = stage(index.model.transform(_unit_vectors(docs, vector, centres.shape[1])).select(doc_id, vector, "_cell"), "cells")
    asked = stage(_probes(queries, centres, query_id, vector, probes or index.probes), "probes")
    return _searched(placed, asked, docs, queries, k, doc_id, query_id, vector, block, chunk)


def _searched(placed: DataFrame, asked: DataFrame, docs: DataFrame, queries: DataFrame, k: int, doc_id: str, query_id: str, vector: str,
              block: int, chunk: int) -> DataFrame:
    """Top-k of the ``asked`` queries among the documents ``placed`` in their cells; exact search among ``docs`` for those that find too few."""
    schema = T.StructType([queries.schema[query_id], docs.schema[doc_id], T.StructField("similarity", T.DoubleType())])
    docs, queries = docs.select(doc_id, vector), queries.select(query_id, vector)

    # one row for each cell, at most as many as there are centres
    chunks = placed.groupBy("_cell").agg(F.ceil(F.count("*") / chunk).alias("_chunks"))
    blocks = asked.groupBy("_cell").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    sizes = F.broadcast(stage(chunks.join(blocks, "_cell"), "cell-sizes"))

    def spread(name: str, n: str) -> Column:
        return F.pmod(F.xxhash64(name), F.col(n))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    left = placed.join(sizes, "_cell").withColumn("_chunk", spread(doc_id, "_chunks")).withColumn("_block", every("_blocks"))
    right = asked.join(sizes, "_cell").withColumn("_block", spread(query_id, "_blocks")).withColumn("_chunk", every("_chunks"))
    grid = ["_cell", "_chunk", "_block"]
    matched = left.select(doc_id, vector, *grid).groupBy(*grid).cogroup(right.select(query_id, vector, *grid).groupBy(*grid))
    found = stage(matched.applyInPandas(_matcher(schema, k, query_id, doc_id, vector), schema), "found")

    full = found.groupBy(query_id).agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(query_id)
    rest = stage(queries.join(full, query_id, "left_anti"), "short-queries")
    if not rest.isEmpty():
        exact = nearest(docs, rest, k, doc_id=doc_id, query_id=query_id, vector=vector).drop("rank")
        found = found.join(full, query_id, "left_semi").unionByName(exact)
    return top_k(found, [query_id], [F.round("similarity", 9).desc(), F.col(doc_id)], k)


def recall(approximate: DataFrame, exact: DataFrame, doc_id: str = "id", query_id: str = "query_id") -> DataFrame:
    """One row: how many of the exact results the approximate search has."""
    hit = approximate.select(query_id, doc_id, F.lit(1).alias("_hit"))
    return exact.select(query_id, doc_id).join(hit, [query_id, doc_id], "left").agg(
        F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"), (F.count("_hit") / F.count("*")).alias("recall"))


def search_context(found: DataFrame, documents: DataFrame, *, doc_id: str = "id", query_id: str = "query_id") -> DataFrame:
    """One numbered text per query from at most k results."""
    # k rows for each query: the hits are broadcast where they are few, so that the texts need no shuffle
    few = found.count() <= QUERY_BLOCK
    rows = documents.select(doc_id, "text").join(F.broadcast(found) if few else found, doc_id)
    line = F.format_string("Case %d (similarity %.2f)\n%s", F.col("rank"), F.col("similarity"), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(query_id).agg(F.array_join(lines, "\n\n").alias("context"))
