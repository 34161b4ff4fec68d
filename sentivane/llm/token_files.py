"""Token counts from flat token files without an index.

A token file is nothing but little-endian ids, one document after the other, each closed by an end
id.  Files are cut into blocks; in each block one vectorised comparison finds the end ids.  A block
knows how many ends it has and where its last one lies; running sums and maxima over the blocks of a
file give each block the documents and tokens before it and the tokens of the document that it goes
on with.  So a document over several blocks is counted once, and no block is read in order.

Bytes behind the last end id are one more document that is not ended.  Two ends in a row are an empty
document.  An empty file has no documents; a file whose size is no multiple of an id is refused.

Files are written by Spark's text writer with the end id as line separator, so commits and lost
executors are its business; the end id's bytes must be valid UTF-8 for that (0 is).  Beside each file
of tokens the same task writes a file of the same name with the documents' ids, which the counts are
joined with.  A task begins a new pair of files when one holds `FILE_BYTES`, so only a single text
beyond that makes a larger one; Spark's binary reader takes files below 2 GiB.

Null texts count as empty: a document of no tokens.  Repeated rows are written, and counted, as often
as they are there; null ids stay null.  Ids are raised by one, and a vocabulary that doesn't fit the
width with that is refused.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentivane.llm.packing import word_tokens
from sentivane.llm.texts import by_batches, narrow, setting
from sentivane.session import new_path, small_table

END = 0
BLOCK_TOKENS = 1 << 20
FILE_BYTES = 8 << 20
# Distinct words, and parts of words, a worker remembers: fewer than in packing, as the text writer
# and the binary reader need their room in the executor.
CACHE_WORDS, CACHE_PARTS = 500_000, 300_000
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write(df: DataFrame, path: str, tokenizer: str, end: int = END, width: int = 2,
          id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Writes the ids of every text, each raised by one so that `end` 0 is no token of a text.

    Tokens go to `path`/kind=tokens, the ids of the documents, as text, to `path`/kind=ids.
    """
    code = f"<u{width}"
    top = len(word_tokens(tokenizer, True).ends)
    if top >= 1 << 8 * width:
        raise ValueError(f"{top} ids and the end don't fit {width} bytes")
    separator = np.array([end], code).tobytes().decode("utf-8")

    def run(batches):
        t = word_tokens(tokenizer, True, CACHE_WORDS, CACHE_PARTS)
        file, size = 0, 0
        for b in batches:
            ids = [(np.frombuffer(x, t.code).astype(code) + 1).tobytes()
                   for x in t.packed(b.column(1))]
            files = []
            for x in ids:
                if size >= file_bytes:
                    file, size = file + 1, 0
                size += len(x) + width
                files.append(file)
            names = [b"" if i is None else b"%d" % i for i in b.column(0).to_pylist()]
            for kind, values in ((b"tokens", ids), (b"ids", names)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind.decode()] * len(ids)), pa.array(files, pa.int32()),
                     pa.array(values, pa.binary())], ["kind", "file", "value"])

    rows = by_batches(narrow(df, id_col, text_col), run, "kind string, file int, value binary")
    with setting(df.sparkSession, _WRITERS, "64"):  # both kinds are open side by side, unsorted
        rows.select("kind", "file", F.col("value").cast("string")).write.partitionBy(
            "kind", "file").option("lineSep", separator).text(path)


def documents(spark: SparkSession, path: str, end: int = END, width: int = 2) -> DataFrame:
    """(file, doc_no, doc_id) of everything `write` put under `path`."""
    separator = np.array([end], f"<u{width}").tobytes().decode("utf-8")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(
        f"{path}/kind=ids")
    # every id, the last one too, has the separator behind it
    ids = F.split(F.col("content").cast("string"), separator)
    return files.filter("length > 0").select(
        _name("path").alias("file"), F.posexplode(F.slice(ids, F.lit(1), F.size(ids) - 1))
    ).select("file", F.col("pos").cast("bigint").alias("doc_no"),
             F.when(F.col("col") != "", F.col("col")).cast("bigint").alias("doc_id"))


def _name(path: str) -> Column:
    """A file's name with the folder of its number, alike for both kinds."""
    return F.regexp_extract(path, "(file=[^/]*/[^/]*)$", 1)


def blocks(spark: SparkSession, path: str, width: int = 2,
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of all token files under `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    step = block_tokens * width
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step)),
        lambda k: F.struct(k.alias("block"), F.substring(
            F.col("content"), (k * step + 1).cast("int"), F.lit(step)).alias("data")))
    whole = F.when(F.col("length") % width == 0, cut).otherwise(
        F.raise_error(F.concat(F.lit("broken token file "), F.col("path"))))
    return files.filter("length > 0").select(
        F.col("path").alias("file"), F.explode(whole).alias("b")).select("file", "b.*")


def counts(spark: SparkSession, path: str, end: int = END, width: int = 2,
           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, doc_no, start, n_tokens, ended) of every document; the end id isn't counted."""

    def search(batches):
        for b in batches:
            data = [np.frombuffer(x, f"<u{width}") for x in b.column("data").to_pylist()]
            ends = [np.flatnonzero(x == end).astype(np.int32) for x in data]
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("block"), pa.array([len(x) for x in data], pa.int64()),
                 pa.array([e.tobytes() for e in ends], pa.binary()),
                 pa.array([len(e) for e in ends], pa.int64()),
                 pa.array([int(e[-1]) + 1 if len(e) else None for e in ends], pa.int64())],
                ["file", "block", "n", "ends", "n_ends", "last"])

    found = by_batches(blocks(spark, path, width, block_tokens), search,
                       "file string, block bigint, n bigint, ends binary, n_ends bigint, "
                       "last bigint")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    scanned = found.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "docs", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn(
        "open", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(0))).withColumn(
        "final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())

    def stitch(batches):
        for b in batches:
            files, doc, begin, size, ended = [], [], [], [], []
            for r in b.to_pylist():
                stop = r["start"] + np.frombuffer(r["ends"], np.int32).astype(np.int64)
                start = np.concatenate([[r["open"]], stop + 1])
                all_of = r["start"] + r["n"]
                if r["final"] and start[-1] < all_of:
                    stop = np.append(stop, all_of)
                start = start[:len(stop)]
                files += [r["file"]] * len(stop)
                doc.append(r["docs"] + np.arange(len(stop)))
                begin.append(start)
                size.append(stop - start)
                ended.append(stop < all_of)
            join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), join(doc, pa.int64()), join(begin, pa.int64()),
                 join(size, pa.int64()), join(ended, pa.bool_())],
                ["file", "doc_no", "start", "n_tokens", "ended"])

    return by_batches(scanned.select("file", "start", "n", "ends", "docs", "open", "final"), stitch,
                      "file string, doc_no bigint, start bigint, n_tokens bigint, ended boolean")


COUNTS = "doc_id bigint, n_tokens bigint, file string, doc_no bigint, start bigint, ended boolean"


def of_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, file, doc_no, start, ended) of all documents, by way of flat files."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write(docs, path, tokenizer)
    if "kind" not in spark.read.format("binaryFile").load(path).columns:  # no rows, no files
        return small_table(spark, [], COUNTS)
    found = counts(spark, f"{path}/kind=tokens").withColumn("file", _name("file"))
    return documents(spark, path).join(found, ["file", "doc_no"]).select(
        "doc_id", "n_tokens", "file", "doc_no", "start", "ended")
