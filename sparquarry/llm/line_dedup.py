"""Line dedup by range-partitioned line hashes and per-document keep bitmaps.

Every line that is long enough becomes a row of its 128-bit hash, document and
position.  Rows are range-partitioned by hash and document and sorted by hash,
document and position, so even a line that a third of all documents hold spreads
over many tasks; each task streams its runs and sends on one summary per line it
saw (documents, surviving document).  Lines in enough documents are then joined
back, and what leaves the operator is a compressed bitmap of kept lines for each
document, not text.  apply_bitmaps() puts bitmaps and texts together.

Defined results: a null text is one empty line; a null id orders before every
other id; rows that share an id but not a text count as one document for the
number of documents and keep bitmaps of their own; rows that repeat both are
treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, shuffle_partitions

LEAST_CHARS, LEAST_DOCS = 40, 5
LINE = "rkey long, doc long, h1 long, h2 long, pos int"
#: Stands for a null id.
NONE = -(2**63)


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _lines(least: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rkey", pa.int64()), ("doc", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("pos", pa.int32())])
        for batch in batches:
            keys, docs, hashes, places = [], [], [], []
            for rkey, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for pos, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    if len(line) >= least and len(key := line_key(line)) >= least and code_points(key) >= least:
                        keys.append(rkey)
                        docs.append(doc)
                        places.append(pos)
                        hashes.append(xxhash.xxh3_128_digest(key))
            words = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            columns = [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return lines


def _summaries(last: bool):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("docs", pa.int64()), ("keeper", pa.int64())])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)  # h1, h2, doc
            before = np.vstack([rows[:1] if seen is None else seen, rows[:-1]])
            new_doc = (rows != before).any(1)
            new_doc[0] |= seen is None
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            keeper = (np.maximum if last else np.minimum).reduceat(rows[:, 2], starts)
            seen = rows[-1:].copy()
            yield pa.RecordBatch.from_arrays([pa.array(rows[starts, 0]), pa.array(rows[starts, 1]), pa.array(docs), pa.array(keeper)], schema=schema)

    return summaries


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places in batch.column("places"):
            places = places.values.to_numpy()
            bits = np.zeros(int(places.max()) + 1, bool)
            bits[places] = True
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rkey"), pa.array(out, pa.binary())], names=["doc", "rkey", "dropped"])


def _with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))
    return docs.select(row_key(F.col("doc_id"), text).alias("rkey"), doc.alias("doc"), text.alias("text"))


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keep: str = "last") -> DataFrame:
    """doc, rkey, dropped: for each document that loses lines, the zlib-compressed bitmap of lost lines.

    A line of at least least_chars code points found in at least least_docs documents
    stays only in the document with the largest (keep="last") or smallest id.
    The keep bitmap is the complement: a document without a row keeps every line.
    """
    last = {"last": True, "first": False}[keep]
    lines = materialise(_with_key(docs).mapInArrow(_lines(least_chars), LINE), "lines")
    dealt = lines.repartitionByRange(shuffle_partitions(docs.sparkSession), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    parts = dealt.select("h1", "h2", "doc").mapInArrow(_summaries(last), "h1 long, h2 long, docs long, keeper long")
    pick = F.max if last else F.min
    common = parts.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), pick("keeper").alias("keeper")).where(F.col("docs") >= least_docs).drop("docs")
    # a table of its own, so that both sides of the join are shuffled for it and a hot line's rows can be split
    common = materialise(common, "common")
    lost = lines.join(common, ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    gathered = lost.groupBy("doc", "rkey").agg(F.collect_set("pos").alias("places"))
    return gathered.mapInArrow(_bitmap, "doc long, rkey long, dropped binary")


def keep_bitmap(dropped: bytes | None, n_lines: int) -> np.ndarray:
    """Booleans, one per line, from a bitmap of line_dedup()."""
    keep = np.ones(n_lines, bool)
    if dropped is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), np.uint8), bitorder="little")[:n_lines].astype(bool)
        keep[: len(bits)] &= ~bits
    return keep


def _join(docs: DataFrame, bitmaps: DataFrame, columns: list) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(row_key(F.col("doc_id"), text).alias("rkey"), *columns, text.alias("__lines"))
    return keyed.join(bitmaps.select("rkey", "dropped"), "rkey", "left").drop("rkey")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of documents with the lost lines gone from text (null where it was null); n_chars follows the text."""
    names = ["doc_id", "lang", "source"]
    has_none = F.col("text").isNull().alias("__none")
    joined = _join(docs, bitmaps, [F.col(n) for n in names] + [has_none])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, dropped, none in zip(batch.column("__lines"), batch.column("dropped"), batch.column("__none").to_pylist()):
                text = text.as_py()
                if (dropped := dropped.as_py()) is not None:
                    lines = text.split("\n")
                    text = "\n".join(x for x, kept in zip(lines, keep_bitmap(dropped, len(lines))) if kept)
                texts.append(None if none else text)
                counts.append(None if none else len(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    kinds = dict(docs.select("doc_id", "lang", "source").dtypes)
    return joined.mapInArrow(cut, f"doc_id {kinds['doc_id']}, text string, lang {kinds['lang']}, source {kinds['source']}, n_chars long")


def digest_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, shas = [], [], []
            for text, dropped in zip(batch.column("__lines"), batch.column("dropped")):
                data = text.as_buffer().to_pybytes()
                n, gone = data.count(b"\n") + 1, 0
                if (dropped := dropped.as_py()) is not None:
                    keep = keep_bitmap(dropped, n)
                    gone = n - int(keep.sum())
                    data = b"\n".join(x for x, kept in zip(data.split(b"\n"), keep) if kept)
                n_lines.append(n)
                n_dropped.append(gone)
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _join(docs, bitmaps, [F.col("doc_id")]).mapInArrow(summarise, f"doc_id {dict(docs.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_sha256 string")
