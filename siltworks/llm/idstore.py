"""Operator 3, token-id output: documents as id arrays in a compressed binary format with random access.

Method: one zstandard dictionary is trained on serialized id arrays; each document is compressed alone
with it, so that a short document is small and can be read without its neighbours. Documents are packed,
in ascending id order, into blocks. A block is a self-contained file image::

    magic "SWIDS1\\0\\0" | sha256 of the dictionary (32 bytes) | count u64 | ids before, within the part u64
    | count index entries (doc_id i64, null flag u64, offset u64, length u64, n_ids u64) | frames

All integers are little-endian; ids are unsigned 32-bit. Blocks and the dictionary are stored through
Spark's own writer in the shared folder (one row a block: part, block, data), so any store will do and no
executor opens a path by itself. The reader checks the dictionary's hash in each block.

Edge cases: null text has only the end id; null doc_id sorts first; repeated ids keep all their rows, in
the order of their texts' hashes (equal texts are alike); an empty table writes no block; a text of any length is one frame.

Scale: one range exchange of the texts by id and text hash. The dictionary is trained on at most ``TRAIN_DOCS``
whole documents of at most ``TRAIN_CHARS`` characters each, among those with the smallest hashes of the id (a model
parameter: it changes sizes, never results); all documents are encoded and written, slices bounded by bytes. Totals for ``start`` are one row for each part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.llm.chunks import ChunkEncoder, Encode, JoinedEncoder
from siltworks.session import ship
from siltworks.llm.common import BATCH_SETTING, new_path, released, slices

MAGIC = b"SWIDS1\0\0"
END = 0
BLOCK_BYTES = 4 << 20
DICT_BYTES = 64 << 10
TRAIN_DOCS = 512
TRAIN_CHARS = 16_384
LEVEL = 1
#: Rows and text bytes of a slice; the larger, the fewer words are encoded again.
SLICE_ROWS, SLICE = 65_536, 32 << 20
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "<u8"), ("offset", "<u8"), ("length", "<u8"), ("n", "<u8")])
HEAD = "<8s32sQQ"


def tokenizer_encoder(path: str | None = None, special_as_text: bool = False) -> tuple[Encode, Callable]:
    """Texts to ids, and a column of texts to ids, by the tokenizers library with ``add_special_tokens=False``.

    The string of a special token in a text gives its id, as the library does by default; with
    ``special_as_text`` it is text like any other.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = special_as_text

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(each) if each else np.zeros(0, np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    feed = encode(["\n"])[0]
    if len(feed) != 1:
        return encode, ChunkEncoder(encode)
    return encode, JoinedEncoder(encode, int(feed[0]), [t.content for t in tok.get_added_tokens_decoder().values()])


def train_dictionary(docs: DataFrame, path: str | None = None) -> bytes:
    """A shared dictionary from the id arrays of a bounded sample; empty where there is too little to learn."""
    import zstandard

    least = [r[0] for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()]
    chosen = docs.filter(F.col("doc_id").isin(*[x for x in least if x is not None]) & F.length("text").between(1, TRAIN_CHARS))
    rows = chosen.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()  # TRAIN_DOCS rows
    ids, size = tokenizer_encoder(path)[0]([r.text for r in rows])
    ends = np.cumsum(size).tolist()
    samples = [ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes blocks to ``path``/blocks and the dictionary to ``path``/dictionary, in ascending id order."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dictionary = train_dictionary(rows, tokenizer)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)  # at most DICT_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        column = tokenizer_encoder(tokenizer)[1]
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None)
        sha = hashlib.sha256(held.value).digest()
        part, number, before, total = 0, 0, 0, 0
        entries: list[tuple] = []
        frames: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, before, entries, frames, size
            data = struct.pack(HEAD, MAGIC, sha, len(entries), before) + np.array(entries, ENTRY).tobytes() + b"".join(frames)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([total - before], pa.int64()), pa.array([data], pa.binary())],
                ["part", "block", "n_ids", "data"],
            )
            number, before, entries, frames, size = number + 1, total, [], [], 0
            return out

        for whole in batches:
            for b in slices(whole, SLICE_ROWS, SLICE):
                part = b.column("part")[0].as_py()
                ids, cuts = column(b.column("text"))
                for doc, lo, hi in zip(b.column("doc_id").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    frame = made.compress(ids[lo:hi].astype("<u4").tobytes() + END.to_bytes(4, "little"))
                    entries.append((doc or 0, doc is None, size, len(frame), hi - lo + 1))
                    frames.append(frame)
                    size += len(frame)
                    total += hi - lo + 1
                    if size >= BLOCK_BYTES:
                        yield block()
        if entries:
            yield block()

    key = ["doc_id", "th", "text"]
    parts = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)  # as large as those of the input
    # the hash parts the rows of one id; the sort inside a part compares ids and hashes first
    ordered = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "th").sortWithinPartitions(*key)
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    spark.conf.set(BATCH_SETTING, "64m")  # two slices: the larger, the fewer words are encoded again
    ordered.mapInArrow(released(pack), "part int, block long, n_ids long, data binary").write.options(**{"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}).parquet(f"{path}/blocks")


def open_block(data: bytes, dictionary: bytes):
    """The index of a block, and a function that reads its k-th document without touching the others."""
    import zstandard

    magic, sha, count, before = struct.unpack_from(HEAD, data)
    if magic != MAGIC or sha != hashlib.sha256(dictionary).digest():
        raise ValueError("not a block of this dictionary")
    index = np.frombuffer(data, ENTRY, count, struct.calcsize(HEAD))
    base = struct.calcsize(HEAD) + count * ENTRY.itemsize
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def read(k: int) -> bytes:
        lo = base + int(index["offset"][k])
        return reader.decompress(data[lo : lo + int(index["length"][k])], max_output_size=4 * int(index["n"][k]))

    return index, before, read


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids (array), or with ``digest`` their unsigned crc32, from the files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])  # at most DICT_BYTES
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    placed = blocks.join(F.broadcast(totals), F.col("part") == F.col("p")).select("data", "part_start")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, start in zip(b.column("data"), b.column("part_start").to_pylist()):
                index, before, read = open_block(data.as_py(), dictionary)
                n = index["n"].astype(np.int64)
                raw = (read(k) for k in range(len(index)))
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in raw], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index["doc_id"], mask=index["null"].astype(bool)), pa.array(start + before + np.cumsum(n) - n), pa.array(n), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids array<long>"
    return placed.mapInArrow(released(unpack), f"doc_id long, start long, n_tokens long, {last}")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and reads the digests back from the files."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    write_ids(docs, path, tokenizer, id_col, text_col)
    return read_ids(spark, path, digest=True)
