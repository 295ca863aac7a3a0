"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, to be memory-mapped.

Documents are range-partitioned by id; each partition is a shard of three files:
  shard-N.ids   token ids, little-endian, 16 bits wide if the vocabulary allows it, else 32
  shard-N.off   one more unsigned 64-bit offset than documents, counted in ids from the shard's start
  shard-N.doc   the documents' ids as signed 64-bit integers (null ids, which come first, as 0; the manifest counts them)
A manifest row per shard has its counts and its base, the number of ids in all shards before it: prefix sums over
one number per shard. Files get their names when they are complete, and a task that runs again writes the same
bytes, so lost executors do no harm.

Defined results: a null text is empty and encodes to the end id alone; null doc_ids come first; of rows that share
a doc_id the order is by the text's hash. Empty input gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, text_or_empty
from .tokens import IdMemo, by_bytes, kept_memo, read_tokenizer, spaced_pieces

MANIFEST = "shard int, n_docs long, n_null long, n_ids long, base long, base_docs long, width int, path string"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, shards: int | None = None, part_bytes: int = 1 << 20) -> DataFrame:
    """Encode `docs` (doc_id, text), append end_id to each, write shards in ascending doc_id order into `folder`,
    which all executors share, and return the manifest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = read_tokenizer(tokenizer_path)
    vocabulary = json.loads(text)
    largest = max([end_id, *vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary.get("added_tokens") or ())])
    width = 2 if largest < 1 << 16 else 4
    tokenizer = spark.sparkContext.broadcast({"tokenizer": text})
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, root = _file_system(folder)
        kind = np.dtype("<u2" if width == 2 else "<u4")
        memo = kept_memo(tokenizer.value, IdMemo, kind)
        end = np.array([end_id], kind).tobytes()
        mark = f"{TaskContext.get().taskAttemptId()}.part"
        names = [f"{root}/shard-{shard:06d}.{x}" for x in ("ids", "off", "doc")]
        n_ids = n_docs = n_null = 0
        outs = None
        for batch in batches:
            if outs is None:
                fs.create_dir(root, recursive=True)
                outs = [fs.open_output_stream(f"{n}.{mark}") for n in names]
                outs[1].write(np.zeros(1, "<u8").tobytes())
            texts = batch.column("text").to_pylist()
            sizes = np.zeros(len(texts), "<u8")
            last = 0
            for part in by_bytes(texts, part_bytes):
                pieces = [(i, spaced_pieces(t)) for i, t in part]
                memo.learn(set().union(*(p for _, p in pieces)))
                for i, p in pieces:
                    while last < i:
                        outs[0].write(end)
                        last += 1
                    encoded = b"".join(map(memo.__getitem__, p))
                    outs[0].write(encoded)
                    sizes[i] += len(encoded) // width
            while last < len(texts):
                outs[0].write(end)
                last += 1
            offsets = n_ids + np.cumsum(sizes + 1, dtype="<u8")
            outs[1].write(offsets.astype("<u8").tobytes())
            ids = batch.column("doc_id")
            n_null += ids.null_count
            outs[2].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            if len(texts):
                n_ids, n_docs = int(offsets[-1]), n_docs + len(texts)
        if outs is None:
            return
        for out, name in zip(outs, names, strict=True):
            out.close()
            fs.move(f"{name}.{mark}", name)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": n_docs, "n_null": n_null, "n_ids": n_ids}], schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]))

    # The tie-breakers spread rows that share a doc_id over shards; the last only separates equal rows.
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    done = sorted(rows.mapInArrow(encode, "shard int, n_docs long, n_null long, n_ids long").collect())  # a row per shard
    manifest, base, base_docs = [], 0, 0
    for shard, n_docs, n_null, n_ids in done:
        manifest.append((shard, n_docs, n_null, n_ids, base, base_docs, width, f"{folder.rstrip('/')}/shard-{shard:06d}"))
        base, base_docs = base + n_ids, base_docs + n_docs
    table = spark.createDataFrame(manifest, MANIFEST).coalesce(1)
    table.write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def _opened(path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """What reads items a to b of a flat file: mapped where the file system is local, else by range."""
    fs, name = _file_system(path)
    width = np.dtype(kind).itemsize
    if isinstance(fs, pafs.LocalFileSystem):
        held = np.memmap(name, dtype=kind, mode="r") if fs.get_file_info(name).size else np.zeros(0, kind)
        return lambda a, b: held[a:b]
    f = fs.open_input_file(name)
    return lambda a, b: np.frombuffer(f.read_at((b - a) * width, a * width), kind)


def read_token_files(manifest: DataFrame, rows_per_batch: int = 2000, ids_per_batch: int = 1 << 20, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, with_ids also ids (unsigned, as long). A batch is of at
    most so many documents and ids, or of a single longer document."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                ids, off, doc = _opened(m["path"] + ".ids", f"<u{m['width']}"), _opened(m["path"] + ".off", "<u8"), _opened(m["path"] + ".doc", "<i8")
                at = to = 0
                while to < m["n_docs"]:
                    at, to = to, min(to + rows_per_batch, m["n_docs"])
                    edges = off(at, to + 1).astype(np.int64)
                    fits = int(np.searchsorted(edges, edges[0] + ids_per_batch, "right")) - 1
                    to = min(to, at + max(1, fits))
                    edges = edges[: to - at + 1]
                    block = ids(int(edges[0]), int(edges[-1])).astype("<u4")
                    cuts = edges - edges[0]
                    crc = [zlib.crc32(block[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    columns = {
                        "doc_id": pa.array(np.array(doc(at, to)), pa.int64(), mask=np.arange(at, to) < m["n_null"]),
                        "start": pa.array(m["base"] + edges[:-1]),
                        "n_tokens": pa.array(np.diff(edges)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(block.astype(np.int64)))
                    yield pa.RecordBatch.from_pydict(columns)

    assert sys.byteorder == "little"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return manifest.repartition(n).mapInArrow(read, schema)


def encode_and_read_back(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write token files for `docs` into a new shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, tokenizer_path, shared_dir(spark, "token-files")))
