"""Token counts of documents in flat token files, by a separator scan.

A token file is nothing but little-endian token ids, one document after another, each closed by the
end-of-document id; there is no index. The scan cuts every file into blocks of ``BLOCK`` tokens and searches each
for separators with one vectorised comparison. A block knows the documents that begin and end in it; what
stands before its first separator and after its last are pieces of documents that cross its borders. A
prefix scan over the blocks' separator counts numbers the documents, and pieces of one number are added up.

:func:`write_token_files` makes such files from documents (one per task, or more where a file is full), under names of
the task attempt's own; its manifest says which files the finished job made and which document stands where.

Defined cases: a null or empty text is a document of no tokens; separators in a row are documents of no tokens; tokens
after a file's last separator form a last document without an end, reported with ``closed`` false; an empty file
has no documents; a file whose size is no multiple of the token width raises an error; an
empty table writes no files; repeated rows are written as often as they come; other columns are ignored.

Scale: blocks are read by byte range, in a number of tasks that is told from the summed file sizes (block descriptors are a few bytes each, so
their own size says nothing), and one huge file is spread over all of them; so is asking for the sizes. Complete documents leave their block
at once; only border pieces (two a block) are shuffled. The prefix scan has two levels, ``GROUP`` blocks
each, so no window holds a whole large file's blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlens.llm.common import checkpointed, file_system, shared_folder, small_batches, write_once

BLOCK = 1 << 20
GROUP = 4096
FILE_TOKENS = 1 << 28
# bytes that a task scans, files whose sizes a task asks for
TASK_BYTES = 1 << 27
TASK_FILES = 1000
# documents reported per frame that a task hands on
ROWS = 1 << 16


@lru_cache(maxsize=2)
def _encoding(pattern: str, ranks_path: str) -> tiktoken.Encoding:
    import base64
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_type(width: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4"}[width])


def write_token_files(docs: DataFrame, ranks_path: str, pattern: str, separator: int, width: int = 2, folder: str | None = None) -> DataFrame:
    """Tokenize docs(doc_id, text) into flat files. Returns the manifest (path, ordinal, doc_id).

    The vocabulary file is opened by the tasks under the same path as here (a package's data file). Its ordinary
    encoding never yields the separator.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, kind = _encoding(pattern, ranks_path).encode_ordinary, token_type(width)
        out, name, n, tokens = None, "", 0, 0
        try:
            for batch in batches:
                paths, places = [], []
                for text in batch["text"]:
                    if out is None:
                        name, n, tokens = f"{folder}/files/{uuid.uuid4().hex}.bin", 0, 0
                        out = write_once(name)
                    ids = encode(text) if text else []
                    out.write(np.array([*ids, separator], dtype=kind).tobytes())
                    paths.append(name)
                    places.append(n)
                    n, tokens = n + 1, tokens + len(ids) + 1
                    if tokens >= FILE_TOKENS:
                        out.close()
                        out = None
                yield pd.DataFrame({"path": paths, "ordinal": places, "doc_id": batch["doc_id"].to_numpy()})
        finally:
            if out is not None:
                out.close()

    rows = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(run, "path string, ordinal long, doc_id string")
    made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _spread(rows: DataFrame, least: int, most: int) -> DataFrame:
    """``rows`` dealt evenly to at least ``least`` tasks, as many as there are cores, and at most ``most``: a fixed number, which is not coalesced."""
    return rows.repartition(max(1, min(most, max(least, rows.sparkSession.sparkContext.defaultParallelism))))


def file_sizes(files: DataFrame, width: int = 2) -> DataFrame:
    """Checkpointed files(path, file) -> (path, file, size) of those that are not empty. Sizes are asked for where the tasks run."""
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, number in batch.itertuples(index=False):
                fs, at = file_system(path)
                info = fs.get_file_info(at)
                if info.type != pafs.FileType.File:
                    raise FileNotFoundError(path)
                if info.size % width:
                    raise ValueError(f"{path}: {info.size} bytes are no whole number of {width}-byte tokens")
                found.append((path, number, info.size))
            yield pd.DataFrame(found, columns=["path", "file", "size"])

    n = files.count()
    return _spread(files.select("path", "file"), -(-n // TASK_FILES), n).mapInPandas(sizes, "path string, file long, size long").where("size > 0")


def block_table(sized: DataFrame, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Checkpointed sized(path, file, size) -> (path, file, block, offset, length): byte ranges, dealt evenly to the tasks that scan them."""
    step = block * width
    total, n = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.expr(f"(size - 1) div {step} + 1")), F.lit(0))).first()
    rows = (sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {step}"))))
                 .select("path", "file", "block", (F.col("block") * step).alias("offset"), F.least(F.lit(step), F.col("size") - F.col("block") * step).cast("long").alias("length")))
    return _spread(rows, -(-total // TASK_BYTES), n)


def scan_block(tokens: np.ndarray, separator: int) -> tuple[np.ndarray, int, int]:
    """(tokens of the documents between two separators here, tokens before the first separator, after the last).

    Without a separator all tokens stand before it and the other count is 0.
    """
    at = np.flatnonzero(tokens == separator)
    if not len(at):
        return np.empty(0, dtype=np.int64), len(tokens), 0
    return np.diff(at) - 1, int(at[0]), len(tokens) - int(at[-1]) - 1


def token_counts(files: DataFrame, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """files(path) -> (path, ordinal, n_tokens, closed), one row per document in the files."""
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = token_type(width)
        for batch in batches:
            for path, file, number, offset, length in batch.itertuples(index=False):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    tokens = np.frombuffer(f.read_at(length, offset), dtype=kind)
                if len(tokens) * width != length:
                    raise ValueError(f"{path} is shorter than it was")
                inner, head, tail = scan_block(tokens, separator)
                seps = 0 if head == len(tokens) else len(inner) + 1
                # place 0: the piece before the first separator; then the inner documents; last the open piece
                yield pd.DataFrame({"file": file, "block": number, "seps": seps, "place": [0, seps] if seps else [0], "n_tokens": [head, tail] if seps else [head],
                                    "ends": [seps > 0, False] if seps else [False], "inner": False})
                for i in range(0, len(inner), ROWS):
                    part = inner[i:i + ROWS]
                    yield pd.DataFrame({"file": file, "block": number, "seps": seps, "place": np.arange(i + 1, i + 1 + len(part)), "n_tokens": part, "ends": True, "inner": True})

    # files go by number, their paths come back at the end
    numbered = checkpointed(files.select("path").distinct().withColumn("file", F.monotonically_increasing_id()))
    # the scan of each block is stored (narrow), so the prefix scan and the numbering read one result
    found = checkpointed(block_table(checkpointed(file_sizes(numbered, width)), width, block).mapInPandas(
        counts, "file long, block long, seps long, place long, n_tokens long, ends boolean, inner boolean"))
    blocks = found.where("place = 0 AND NOT inner").select("file", "block", F.expr(f"block div {GROUP}").alias("grp"), "seps")
    ahead = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("file", "grp").agg(F.sum("seps").alias("s")).select("file", "grp", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.withColumn("own", F.coalesce(F.sum("seps").over(inside), F.lit(0))).join(groups, ["file", "grp"])
                    .select("file", "block", (F.col("base") + F.col("own")).alias("start")))
    placed = found.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("place")).cast("long").alias("ordinal"), "n_tokens", "ends", "inner")
    pieces = placed.where("NOT inner").groupBy("file", "ordinal").agg(F.sum("n_tokens").alias("n_tokens"), F.max("ends").alias("closed"))
    # what follows a file's last separator is a document only if it has tokens
    pieces = pieces.where("closed OR n_tokens > 0")
    every = placed.where("inner").select("file", "ordinal", "n_tokens", F.lit(True).alias("closed")).unionByName(pieces.select("file", "ordinal", "n_tokens", "closed"))
    return every.join(numbered, "file").select("path", "ordinal", "n_tokens", "closed")


def corpus_token_counts(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Write docs as token files, scan the files, and say how many tokens each document has: doc_id, n_tokens."""
    manifest = write_token_files(docs, ranks_path, pattern, separator, width)
    counts = token_counts(manifest.select("path"), separator, width, block)
    return counts.join(manifest, ["path", "ordinal"]).select("doc_id", "n_tokens")
