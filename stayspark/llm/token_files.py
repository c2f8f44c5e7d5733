"""Token files: the ids of all documents in ascending id order, addressable by position.

A file is a Parquet table of segments.  A segment holds consecutive whole documents: their ids and
lengths, and all their token ids as one directly addressable code (``stayspark.llm.dac``), from which
any document, or any single token, is read without decoding the rest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayspark.llm import dac
from stayspark.llm.tokens import encoder, text_slices, tidy
from stayspark.session import shared_folder

# A segment ends with the first document that takes it to this many tokens.
SEGMENT_TOKENS = 1 << 18
SEGMENT = (
    "part int, segment int, start_in_part long, n_tokens long, "
    "doc_ids array<long>, lengths array<long>, code binary"
)
DOCUMENT = "doc_id long, part int, start_in_part long, n_tokens long"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _segments(path: str, chunked: bool, end: int, limit: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, chunked)
        part = TaskContext.get().partitionId()
        schema = pa.schema(
            [
                ("part", pa.int32()), ("segment", pa.int32()), ("start_in_part", pa.int64()),
                ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                ("lengths", pa.list_(pa.int64())), ("code", pa.binary()),
            ]
        )
        segment = start = held = 0
        doc_ids, lengths, ids = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal segment, start, held, doc_ids, lengths, ids
            flat = np.concatenate(ids)
            columns = [[part], [segment], [start], [len(flat)], [doc_ids], [lengths]]
            columns.append([dac.encode(flat)])
            row = pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )
            segment, start, held = segment + 1, start + len(flat), 0
            doc_ids, lengths, ids = [], [], []
            return row

        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id")
            for first, last in text_slices(texts):
                found, offsets = encode.with_end(texts.slice(first, last - first), end)
                rows = keys.slice(first, last - first).to_pylist()
                at = 0
                while at < len(rows):
                    # As many documents as fit, one at least.
                    room = offsets[at] + max(limit - held, 0)
                    stop = max(at + 1, int(np.searchsorted(offsets, room, side="right")) - 1)
                    doc_ids += rows[at:stop]
                    lengths += np.diff(offsets[at : stop + 1]).tolist()
                    ids.append(found[offsets[at] : offsets[stop]])
                    held += int(offsets[stop] - offsets[at])
                    at = stop
                    if held >= limit or at < len(rows):
                        yield close()
        if ids:
            yield close()

    return write


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int, chunked: bool = True
) -> None:
    """Encode every ``text`` of ``docs`` and write the segments to ``folder``.

    Documents stand in ascending ``doc_id`` order (null first, then repeated ids by the hash of their text); each
    is followed by the id ``end``.  A null text counts as empty.  Other columns are ignored.  Spark
    deals the documents out by ranges of ids, so each task writes its own stretch of the order, and
    its committer makes a repeated task harmless.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    write = _segments(tokenizer, chunked, end, SEGMENT_TOKENS)
    dealt.mapInArrow(tidy(write), SEGMENT).write.parquet(folder)


def _read(digest: bool) -> Callable:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64())),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, doc_ids, lengths, code = (
                    batch.column(name)[row].as_py()
                    for name in ("part", "start_in_part", "doc_ids", "lengths", "code")
                )
                reader, ends = dac.Dac(code), np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                runs = (reader.run(a, b) for a, b in zip(starts, ends, strict=True))
                last = [zlib.crc32(r.tobytes()) if digest else r.astype(np.int64) for r in runs]
                columns = [doc_ids, [part] * len(doc_ids), starts + start, lengths, last]
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return read


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (tokens of all before it), ``n_tokens``, ``ids``.

    With ``digest`` the last column is ``ids_crc32``, of the ids as little-endian unsigned 32-bit
    integers, in place of the ids.  Empty files give no rows.
    """
    schema = DOCUMENT + (", ids_crc32 long" if digest else ", ids array<long>")
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # One row per writing task: its tokens, and those of all tasks before it.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.selectExpr("part", "sum(held) OVER (ORDER BY part) - held AS before")
    documents = segments.mapInArrow(tidy(_read(digest)), schema)
    last = schema.split(", ")[-1].split(" ")[0]
    return documents.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", last
    )


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """The token at each distinct global ``position``: ``position``, ``token``.

    Only segments that hold a wanted position are opened, and in those only that position is read.
    Null and unknown positions give no row.
    """
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # One row per writing task: its tokens, and those of all tasks before it.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.selectExpr("part", "sum(held) OVER (ORDER BY part) - held AS before")
    # The directory without the codes, in steps of a fixed length, so that the look-up is an equi-join.
    first, size = F.col("first"), F.col("n_tokens")
    steps = F.sequence(
        F.floor(first / SEGMENT_TOKENS), F.floor((first + size - 1) / SEGMENT_TOKENS)
    )
    directory = (
        segments.join(F.broadcast(before), "part")
        .select("part", "segment", size, (F.col("before") + F.col("start_in_part")).alias("first"))
        .withColumn("step", F.explode(steps))
    )
    position = F.col("position").cast("long")
    wanted = positions.select(position, F.floor(position / SEGMENT_TOKENS).alias("step"))
    offset = F.col("position") - first
    places = (
        wanted.distinct()
        .join(directory, "step")
        .where((offset >= 0) & (offset < size))
        .groupBy("part", "segment", "first", F.floor(offset / 16384).alias("stretch"))
        .agg(F.collect_list(offset).alias("offsets"))  # distinct, so at most 16,384
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                code, start, offsets = (
                    batch.column(name)[row].as_py() for name in ("code", "first", "offsets")
                )
                reader = dac.Dac(code)
                found = [[start + at for at in offsets], [reader[at] for at in offsets]]
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in found], ["position", "token"]
                )

    held = places.join(segments.select("part", "segment", "code"), ["part", "segment"])
    return held.select("first", "offsets", "code").mapInArrow(
        look_up, "position long, token long"
    )
