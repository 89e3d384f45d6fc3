"""Token counts: a separator scan over flat token files without an index.

``write_tokens`` turns documents into flat files of fixed-width token numbers, cut into blocks of equal size whatever the documents
are; an end-of-document number follows each document. ``count_tokens`` knows the blocks and the number only: it finds
the ends in each block in one vector comparison, and stitches documents that run over blocks with a prefix scan over
block summaries. A file is what one task has written; its blocks are rows of a Parquet table in the shared folder, because
Spark's writers have no raw binary sink, and the ids of the documents that end in a block stand beside it in the order of the ends.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storegrain.llm.common import slices
from storegrain.session import ship, stage

BLOCK_TOKENS = 1 << 16
#: Number of ``byte_bpe_50k`` that no text gives.
END = 50256


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def write_tokens(docs: DataFrame, path: str, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 end: int = END, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``file, block, tokens (binary, two bytes each), ended (ids)``; the last block of a file may be shorter.

    A null or empty text is an end without tokens. Ids may be null or repeat. The width of two bytes holds numbers below 65,536.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("file"))
    id_type = source.schema["id"].dataType

    def run(batches):
        known, have, ids, block, size, file = encoder(ranks_file, pattern), [], [], 0, 0, 0
        kind = None

        def out(tokens, ended):
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block]), pa.array([tokens.tobytes()], pa.binary()), pa.array([ended], pa.list_(kind))],
                ["file", "block", "tokens", "ended"])

        for part in slices(batches, 1):
            kind, file = part.column(0).type, part.column(2)[0].as_py()
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                new = np.array([*known.encode_ordinary(text or ""), end], "<u2")
                have.append(new)
                size += len(new)
                ids.append((size - 1, doc))  # where the document ends, counted from the start of this block
                while size >= block_tokens:
                    flat = np.concatenate(have)
                    yield out(flat[:block_tokens], [d for at, d in ids if at < block_tokens])
                    have, size, block = [flat[block_tokens:]], size - block_tokens, block + 1
                    ids = [(at - block_tokens, d) for at, d in ids if at >= block_tokens]
        if size:
            yield out(np.concatenate(have), [d for _, d in ids])

    blocks = source.mapInArrow(run, f"file long, block long, tokens binary, ended array<{id_type.simpleString()}>")
    blocks.write.option("compression", "zstd").parquet(path)


def count_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", end: int = END) -> DataFrame:
    """``id_col, file, place, n_tokens``: tokens of each document without its end, and its place in its file from 0 on.

    Tokens behind the last end of a file belong to no document and are not returned. An empty folder of blocks gives no rows.
    """
    blocks = spark.read.parquet(path)
    ship(spark)
    id_type = blocks.schema["ended"].dataType

    def scan(batches):
        for part in batches:
            counts, tails, sizes = [], [], []
            for tokens in part.column(2):
                flat = np.frombuffer(tokens.as_buffer(), "<u2")
                ends = np.flatnonzero(flat == end)
                counts.append(np.diff(ends, prepend=-1) - 1)
                tails.append(len(flat) - 1 - int(ends[-1]) if len(ends) else len(flat))
                sizes.append(len(ends))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(counts, pa.list_(pa.int64())), pa.array(tails, pa.int64()),
                 pa.array(sizes, pa.int64())], ["file", "block", "ended", "counts", "tail", "n_ends"])

    found = blocks.select("file", "block", "tokens", "ended").mapInArrow(
        scan, f"file long, block long, ended {id_type.simpleString()}, counts array<bigint>, tail long, n_ends long")
    found = stage(found, "block-counts")
    # prefix scan over summaries: one small row for each block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", "n_ends", F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("sum"),
                           F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("places"))
    # a document goes on from the last block that has an end: the tails from that block on
    base = F.coalesce(F.max(F.when(F.col("n_ends") > 0, F.col("sum"))).over(before), F.lit(0))
    carry = summary.select("file", "block", "places", (F.col("sum") - base).alias("carry"))
    both = found.join(carry, ["file", "block"])
    return both.select("file", "carry", "places", F.posexplode(F.arrays_zip("ended", "counts")).alias("i", "one")).select(
        F.col("one.ended").alias(id_col), "file", (F.col("places") + F.col("i")).alias("place"),
        (F.col("one.counts") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))
