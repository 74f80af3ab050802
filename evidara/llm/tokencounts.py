"""Token counts of documents in flat, unindexed token files (operator 9).

A token file is a run of little-endian 16-bit ids; each document ends with a separator id. Files are
cut into blocks of bytes, each block is searched for separators at once in numpy, and a
prefix scan over the blocks' summaries stitches documents that cross block bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import default_tokenizer, encoding
from .scratch import new_path, small_batches

SEPARATOR = 50256
BLOCK_TOKENS = 1 << 18
#: Files up to this size are read whole by the scan, larger ones in ranges.
MOST_FILE_BYTES = 1 << 30
#: Bytes of a range of a larger file, an even number.
RANGE_BYTES = 1 << 26


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, separator: int = SEPARATOR, index: bool = False) -> None:
    """Write each partition of docs as one flat file of 16-bit ids, documents in row order.

    The rows are raw bytes; the line end of Spark's text writer supplies the last byte of each
    document's separator, so the file holds ids alone. A null or empty text is a separator alone. index: the same task writes
    the documents' doc_ids, in the same order, to a second file; the files are then in ``kind=0`` and the index in ``kind=1``.
    """
    spark, source, low, high = docs.sparkSession, tokenizer or default_tokenizer(), separator & 255, separator >> 8

    def run(batches):
        enc = encoding(source)
        for pdf in batches:
            ids = [np.array(enc.encode_ordinary(t or ""), dtype="<u2").tobytes() + bytes([low]) for t in pdf["text"]]
            if index:
                names = [(d or "").encode() for d in pdf["doc_id"]]
                yield pd.DataFrame({"ids": ids + names, "kind": [0] * len(ids) + [1] * len(ids)})
            else:
                yield pd.DataFrame({"ids": ids})

    small_batches(spark)
    columns = "ids binary, kind int" if index else "ids binary"
    raw = docs.select("text", *([F.col("doc_id").cast("string")] if index else [])).mapInPandas(run, columns)
    raw = raw.select(F.col("ids").cast("string").alias("value"), *(["kind"] if index else []))
    writer = raw.write.option("encoding", "ISO-8859-1").option("lineSep", chr(high)).option("compression", "none")
    # Both files of a task stay open, since a sort by kind might change the order of rows.
    key = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(key, "0")
    spark.conf.set(key, "2")
    try:
        (writer.partitionBy("kind") if index else writer).text(path)
    finally:
        spark.conf.set(key, was)


def read_index(spark: SparkSession, path: str, separator: int = SEPARATOR) -> DataFrame:
    """file_no, doc_no, doc_id of the index files at path."""
    high = bytes([separator >> 8])

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                ids = bytes(content).split(high)[:-1]
                yield pd.DataFrame({"file": name, "doc_no": np.arange(len(ids)), "doc_id": pd.array([int(x) if x else None for x in ids], dtype="Int64")})

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(run, "file string, doc_no long, doc_id long").select(_file_no(), "doc_no", "doc_id")


def _file_no():
    return F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int").alias("file_no")


def ranges(spark: SparkSession, files: list[tuple[str, int]]) -> tuple[str, dict[str, tuple[str, int]]]:
    """Copy files, given as (path, length), to the shared folder in ranges; its path, and for each range's folder and name the file and the first token.

    The driver passes the bytes from stream to stream and holds none of them.
    """
    jvm, hadoop, folder, origin = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), new_path(spark, "ranges"), {}
    for k, (name, length) in enumerate(files):
        source = jvm.org.apache.hadoop.fs.Path(name)
        content = source.getFileSystem(hadoop).open(source)
        for start in range(0, length, RANGE_BYTES):
            target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}-{start}.bin")
            out = target.getFileSystem(hadoop).create(target)
            jvm.org.apache.commons.io.IOUtils.copyLarge(content, out, 0, min(RANGE_BYTES, length - start))
            out.close()
            origin[f"{folder.rsplit('/', 1)[-1]}/{k}-{start}.bin"] = (name, start // 2)
        content.close()
    return folder, origin


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc_no, first_token, n_tokens (without the separator) of every document in the token files at path.

    doc_no counts from 0 in a file. Tokens after the last separator are a last document without an end;
    files without tokens give no rows. Each task holds one file, or one range of a file above MOST_FILE_BYTES, whose
    path and length are sent to the driver; what passes between blocks is a summary.
    """
    source = spark.read.format("binaryFile")
    found = source.load(path)
    large = [(r["path"], r["length"]) for r in found.filter(F.col("length") > MOST_FILE_BYTES).select("path", "length").collect()]
    files, origin = found.filter(F.col("length").between(2, MOST_FILE_BYTES)).select("path", "content"), {}
    if large:
        folder, origin = ranges(spark, large)
        files = files.unionByName(source.load(folder).select("path", "content"))

    def blocks(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                ids = np.frombuffer(content, dtype="<u2", count=len(content) // 2)
                name, base = origin.get("/".join(name.rsplit("/", 2)[-2:]), (name, 0))
                for start in range(0, len(ids), block_tokens):
                    ends = np.flatnonzero(ids[start : start + block_tokens] == separator).astype("<i4")
                    yield pd.DataFrame({"file": [name], "start": [base + start], "size": [min(block_tokens, len(ids) - start)], "n_ends": [len(ends)], "last_end": [base + start + int(ends[-1]) if len(ends) else None], "ends": [ends.tobytes()]})

    found = files.mapInPandas(blocks, "file string, start long, size long, n_ends long, last_end long, ends binary")
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy("start").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stitched = found.select(
        "*",
        F.coalesce(F.sum("n_ends").over(order), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.max("last_end").over(order), F.lit(-1)) + 1).alias("open_at"),
        (F.count(F.lit(1)).over(last) == 1).alias("is_last"),
    )

    def documents(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ends = np.frombuffer(r.ends, dtype="<i4").astype(np.int64) + r.start
                if r.is_last and (not len(ends) or ends[-1] < r.start + r.size - 1) and r.start + r.size > max(r.open_at, ends[-1] + 1 if len(ends) else 0):
                    ends = np.append(ends, r.start + r.size)
                first = np.append(r.open_at, ends + 1)[: len(ends)]
                yield pd.DataFrame({"file": r.file, "doc_no": r.docs_before + np.arange(len(ends)), "first_token": first, "n_tokens": ends - first})

    cols = ["file", "start", "size", "ends", "docs_before", "open_at", "is_last"]
    return stitched.select(*cols).mapInPandas(documents, "file string, doc_no long, first_token long, n_tokens long")


def count_documents(docs: DataFrame, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file_no, doc_no, first_token of every row of docs, by way of flat files in the shared folder.

    Files carry no ids; an index that the same pass writes says which document is the k-th of a file. A null or empty
    text has 0 tokens, a null doc_id and repeated rows are counted like any other, an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, index=True)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=0")
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], "doc_id long, n_tokens long, file_no int, doc_no long, first_token long")
    seen = scan(spark, f"{path}/kind=0", block_tokens=block_tokens).withColumn("file_no", _file_no())
    joined = read_index(spark, f"{path}/kind=1").join(seen, ["file_no", "doc_no"], "left")
    return joined.select("doc_id", "n_tokens", "file_no", "doc_no", "first_token")


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_separator_scan": op9_separator_scan}
ORACLES: dict[str, str] = {}
