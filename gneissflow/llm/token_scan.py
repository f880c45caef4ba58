"""Token counts of documents in flat, unindexed token streams.

A stream is the token ids of many documents, each closed by an end-of-document id, cut into blocks
of ``BLOCK`` tokens wherever a block happens to end.  Each block is searched for the separator as
one vector comparison; a running sum over the blocks of a stream then gives every separator its
place, and the document that reaches over block borders its whole length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenization pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
WIDTH = np.uint16
ORDER_BITS = 24  # blocks of a task, at most


def load_encoding(data: bytes):
    """The tokenizer of a vocabulary file's bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_known: dict[int, object] = {}


def placed(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Documents as read from files, with the file's name as ``stream`` and the row's number in it as ``place``.

    Fewer partitions than ``parts`` (the cores) are dealt out in ranges of files and rows.
    """
    docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("stream"), F.col("_metadata.row_index").alias("place"))
    parts = parts or docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() >= parts:
        return docs
    return docs.repartitionByRange(parts, "stream", "place").sortWithinPartitions("stream", "place")


def token_streams(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """stream, block, tokens (little-endian 16-bit ids), doc_ids.

    Where ``docs`` has the columns stream and place (see ``placed``), a task holds a run of a stream's
    rows in their order, and however the rows are dealt out the documents found are the same: blocks
    may end anywhere, ``block`` only gives their order.  Other tables are one stream for each task.

    Each document's ids are followed by ``EOD``; a null or empty text is a separator alone.  doc_ids
    names the documents whose separator lies in the block, in order, so that counts found by the
    scan can be told by document.  The vocabulary file is read once, by the driver.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(shared.value)
        enc = _known.get(mark) or _known.setdefault(mark, load_encoding(shared.value))
        own = f"part-{TaskContext.get().partitionId():06d}"
        stream, number = None, 0
        held, ids, size = [], [], 0  # pieces, (end of document, id, place), tokens held

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            """The whole blocks that are held (with ``last`` the rest too); each token is copied once."""
            nonlocal held, ids, size, number
            flat, at, name = np.concatenate(held), 0, 0
            while size - at >= block or (last and at < size):
                end, first = min(at + block, size), name
                order = (ids[first][2] << ORDER_BITS) + number  # ids[first] is the document in which the block begins
                while name < len(ids) and ids[name][0] < end:
                    name += 1
                names = pa.array([[i for _, i, _ in ids[first:name]]], pa.list_(pa.int64()))
                cols = [pa.array([stream]), pa.array([order], pa.int64()), pa.array([flat[at:end].tobytes()], pa.binary()), names]
                yield pa.RecordBatch.from_arrays(cols, names=["stream", "block", "tokens", "doc_ids"])
                at, number = end, number + 1
            held, ids, size = [flat[at:].copy()], [(x - at, i, p) for x, i, p in ids[name:]], size - at

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(2)[i].as_py() or own
                if name != stream:
                    if size:
                        yield from cut(True)
                    stream = name
                text = batch.column(1)[i].as_py()
                if text:
                    t = np.asarray(enc.encode_ordinary(text), WIDTH)
                    held.append(t)
                    size += len(t)
                held.append(np.array([EOD], WIDTH))
                ids.append((size, batch.column(0)[i].as_py(), batch.column(3)[i].as_py() or 0))
                size += 1
                if size >= block:
                    yield from cut(False)
        if size:
            yield from cut(True)

    own = {"stream", "place"} <= set(docs.columns)
    name, place = (F.col("stream"), F.col("place")) if own else (F.lit(None).cast("string"), F.lit(None).cast("long"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), name.alias("stream"), place.cast("long").alias("place"))
    return src.mapInArrow(run, "stream string, block long, tokens binary, doc_ids array<long>")


def token_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The same blocks from flat token files.

    Spark reads a file of this kind as one row, so each must be under 2 GiB and fit a task; a longer
    stream is to be written as several files.  A last odd byte is no token and is left out.  An empty
    file has no blocks.
    """
    width = WIDTH().itemsize
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer()
                whole = data.size - data.size % width
                for number, at in enumerate(range(0, whole, width * block)):
                    part = data.slice(at, min(width * block, whole - at)).to_pybytes()
                    cols = [batch.column(0).slice(i, 1), pa.array([number], pa.int64()), pa.array([part], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([None], pa.list_(pa.int64()))], names=["stream", "block", "tokens", "doc_ids"])

    return files.mapInArrow(run, "stream string, block long, tokens binary, doc_ids array<long>")


def _search(eod: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, seps = [], []
            for x in batch.column(2):
                raw = x.as_buffer() if x.is_valid else b""
                t = np.frombuffer(raw, WIDTH, len(raw) // WIDTH().itemsize)
                n.append(len(t))
                seps.append(np.flatnonzero(t == eod))
            cols = [batch.column(0), batch.column(1), batch.column(3), pa.array(n, pa.int64()), pa.array(seps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["stream", "block", "doc_ids", "n", "seps"])

    return run


def separator_scan(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """stream, ordinal, doc_id, start, n_tokens, closed: every document of every stream.

    start: the document's first token in its stream.  n_tokens counts no separator; two separators
    in a row hold a document of no tokens.  Tokens behind the last separator are a document with
    closed = false.  An empty stream has no documents.  doc_id is null where the blocks name none.
    A null block holds no tokens; a block's last odd byte is none.
    """
    columns = "stream string, block long, doc_ids array<long>, n long, seps array<long>"
    found = blocks.select("stream", "block", "tokens", "doc_ids").mapInArrow(_search(eod), columns)
    ahead = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    found = found.withColumns({"base": so_far("n"), "before": so_far(F.size("seps"))})
    found = found.withColumn("ends", F.transform("seps", lambda s: s + F.col("base")))
    found = found.withColumn("prev", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(ahead), F.lit(-1)))
    found = found.withColumn("final", F.lead("block").over(Window.partitionBy("stream").orderBy("block")).isNull())
    end = F.col("base") + F.col("n")
    last = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("prev"))
    ends = F.when(F.col("final") & (end > last + 1), F.concat("ends", F.array(end))).otherwise(F.col("ends"))
    found = found.select("stream", "before", "prev", "doc_ids", F.size("seps").alias("m"), ends.alias("ends"))
    found = found.withColumn("starts", F.transform(F.concat(F.array("prev"), "ends"), lambda e: e + 1))
    each = found.select("stream", "before", "doc_ids", "m", "starts", F.posexplode("ends").alias("i", "end"))
    start = F.element_at("starts", F.col("i") + 1)
    return each.select(
        "stream", (F.col("before") + F.col("i")).cast("long").alias("ordinal"), F.try_element_at("doc_ids", F.col("i") + 1).alias("doc_id"),
        start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("i") < F.col("m")).alias("closed"),
    )
