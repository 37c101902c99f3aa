"""Training-order materialisation: a keyed permutation of all token sequences.

Documents are tokenised with a public tokenizer and cut into sequences of
``length`` tokens, the last one padded. Sequences are numbered 0..n-1 in table
order; a keyed Feistel network with cycle-walking, a bijection of that range, gives
each its global slot. Slots are cut into shards of ``per_shard`` slots; a run of shards
is one partition, and each is written in slot order as one file of fixed-stride records, so
record s lies in file s // per_shard at byte (s % per_shard) * stride, and a
reader can resume at any slot (``read_slots``).

Two passes tokenise: the first only counts sequences per partition, because slots
need the total; the second knows each partition's first number. Its partitions
must be those of the first: each is checked against its recorded row count,
sequence count and checksum of ids, and the job fails rather than give two
sequences one slot.

Recovery: a shard is written to a name of its own attempt and then renamed, so a
repeated task replaces the file with the same bytes. Memory: a task holds one
batch of texts, and one shard's records stream in sorted order.

Defined results: null or empty texts have no sequence; repeated rows have their
own sequences; an id that is null or no integer stands in the index only, and the record
says that it has none;
documents in any number share nothing, a long one simply has many sequences; other
columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import base64
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 512
PER_SHARD = 1 << 15
#: Tasks that write, at most; each writes a run of shards.
MAX_TASKS = 20_000
KEY = 0x5EED_0F_0DE5
PAD = 0
HEAD = "<qiii"  # doc_id, number within the document, tokens, whether there is an integer id


class Tokenizer:
    """A byte-level BPE from a file of ranks; no text is ever taken as a special token."""

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str = TOKENIZER):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.size = len(ranks)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def packed(self, text: str) -> bytes:
        """The ids as ``dtype``; an array takes a list of numbers quicker than numpy does."""
        ids = array("H" if self.dtype.itemsize == 2 else "I", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of ``numbers`` under a keyed bijection of range(n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = common.mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(key | 1) + np.uint64(n))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (common.mix64(right ^ k) & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(numbers.astype(np.uint64))
        while (outside := np.flatnonzero(out >= np.uint64(n))).size:
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def _counted(rows: DataFrame, path: str, length: int) -> list:
    def count(batches):
        from pyspark import TaskContext

        tokenizer, docs, sequences, check = Tokenizer(path), 0, 0, 0
        for batch in common.slices(batches):
            docs += batch.num_rows
            check = zlib.crc32(repr(batch["doc_id"].to_pylist()).encode(), check)
            for text in batch["text"].to_pylist():
                sequences += -(-tokenizer.count(text or "") // length)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in (docs, sequences, check))],
            names=["part", "docs", "sequences", "sum"],
        )

    return rows.mapInArrow(common.lean(count), "part int, docs long, sequences long, sum long").collect()


def materialise(
    docs: DataFrame,
    out_dir: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
) -> DataFrame:
    """Write the shards to ``out_dir`` (default: a new shared folder) and return their
    index: slot, shard, byte_offset, doc_id, sequence, n_tokens, crc32, path."""
    spark = docs.sparkSession
    out_dir = out_dir or common.shared_path(spark, "training-order")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # a row per partition of the input, not per document
    counts = sorted(_counted(rows, tokenizer, length))
    first, total = {}, 0
    for part, n_docs, n, check in counts:
        first[part] = (total, n_docs, n, check)
        total += n
    starts = spark.sparkContext.broadcast(first)
    shards = -(-total // per_shard)
    width = Tokenizer(tokenizer).dtype.itemsize
    stride = struct.calcsize(HEAD) + length * width

    def place(batches):
        from pyspark import TaskContext

        want = starts.value.get(TaskContext.get().partitionId(), (0, 0, 0, 0))
        tokens, at, docs_seen, check = Tokenizer(tokenizer), want[0], 0, 0
        for batch in common.slices(batches):
            rows_of, numbers, pieces = [], [], []
            docs_seen += batch.num_rows
            check = zlib.crc32(repr(batch["doc_id"].to_pylist()).encode(), check)
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = tokens.packed(text or "")
                for k, a in enumerate(range(0, len(ids), length * width)):
                    rows_of.append(row)
                    numbers.append(k)
                    pieces.append(ids[a : a + length * width])
            n = len(pieces)
            if n:
                slot = feistel(np.arange(at, at + n), total, key)
                at += n
                sizes = [len(x) // width for x in pieces]
                yield batch["doc_id"].take(pa.array(rows_of)), [slot, slot // per_shard, numbers, sizes, pieces]
        if (docs_seen, at - want[0], check) != want[1:]:
            raise RuntimeError("the input's partitions changed between the passes; run it again")

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out_dir)
        store.create_dir(base, recursive=True)
        shard, sink, temp = None, None, None

        def close():
            sink.close()
            store.move(temp, f"{base}/shard-{shard:08d}.bin")

        for batch in common.slices(batches):
            sums = []
            for s, doc, k, n, data in zip(
                *(batch[c].to_pylist() for c in ("shard", "doc_id", "sequence", "n_tokens", "tokens")), strict=True
            ):
                if s != shard:
                    if sink is not None:
                        close()
                    shard, temp = s, f"{base}/.writing-{s:08d}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temp)
                head = (doc, k, n, 1) if type(doc) is int else (-1, k, n, 0)
                record = struct.pack(HEAD, *head) + data.ljust(length * width, b"\0")
                sink.write(record)
                sums.append(zlib.crc32(record))
            slot = batch["slot"].to_numpy()
            yield batch["doc_id"], [slot, *(batch[c] for c in ("shard", "sequence", "n_tokens")), slot % per_shard * stride, sums]
        if sink is not None:
            close()

    if not total:
        return spark.createDataFrame(
            [], f"slot long, shard int, byte_offset long, doc_id {kind}, sequence int, n_tokens int, crc32 long, path string"
        )
    placed = common.map_ids(
        rows, place, f"doc_id {kind}, slot long, shard int, sequence int, n_tokens int, tokens binary"
    )
    tasks = min(shards, MAX_TASKS)
    written = common.map_ids(
        placed.repartitionById(tasks, F.expr(f"cast(shard * {tasks}L div {shards} as int)")).sortWithinPartitions("slot"),
        write,
        f"doc_id {kind}, slot long, shard int, sequence int, n_tokens int, byte_offset long, crc32 long",
    )
    return written.select(
        "slot", "shard", "byte_offset", "doc_id", "sequence", "n_tokens", "crc32",
        F.format_string(out_dir + "/shard-%08d.bin", F.col("shard")).alias("path"),
    )


def read_slots(out_dir: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2):
    """Records of slots start..stop-1 in order: (slot, doc_id, sequence, tokens)."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out_dir)
    stride = struct.calcsize(HEAD) + length * width
    slot = start
    while slot < stop:
        shard, offset = divmod(slot, per_shard)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(offset * stride)
            while slot < stop and slot // per_shard == shard:
                record = f.read(stride)
                doc, k, n, known = struct.unpack_from(HEAD, record)
                yield slot, doc if known else None, k, np.frombuffer(record, f"<u{width}", n, struct.calcsize(HEAD))
                slot += 1


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(common.documents(spark, sf_dir)).drop("path")
