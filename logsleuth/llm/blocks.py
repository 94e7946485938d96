"""Blocks of documents that ask a distributed key table.

Some operators need, for every word window of a text, what the whole corpus
knows about it.  One row a window would be many times the text.  Here the rows
of a scan are packed into blocks of about ``BLOCK_BYTES`` of text; a block
sends the sorted distinct 64-bit keys of its windows, cut by value into
buckets, as packed bytes; the tasks that own a bucket merge the keys of all
blocks and reply to each in the order of its keys.  A key that is frequent in
the corpus is one entry a block, so no key is hot; texts move once, to meet
the replies.

Blocks are numbered by task and place in the scan.  The numbers are the same
in every pass over one stored table; a block also carries a digest of its
rows, so a pass that packs other rows than the one before fails instead of
mixing replies up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20     # bytes of text that a bucket's keys come from
MIN_BUCKETS = 8
ASKED = "bucket int, block long, digest long, keys binary, notes array<binary>"


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; sorted keys as differences."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    head = bytes([values.dtype.itemsize])
    return head + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    size = data[0]
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(f"<u{size}").astype(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def narrow(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the smallest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16
                         else np.uint32 if top < 1 << 32 else np.uint64)


class Block:
    """Ids and texts of consecutive rows; ``ids`` is an Arrow array of the id
    column's type, ``text`` a large_binary array without nulls."""

    def __init__(self, ids: pa.Array, text: pa.Array):
        self.ids, self.text, self.number = ids, text, -1

    def digest(self) -> int:
        import xxhash
        h = xxhash.xxh64()
        for part in (self.ids, self.text):
            for buffer in pa.concat_arrays([part]).buffers():
                h.update(b"-" if buffer is None else buffer)
        return h.intdigest() >> 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    """(number, block) for the batches (id, text) of one task."""
    import pyarrow.compute as pc
    number = TaskContext.get().partitionId() << 32
    ids, texts, size = [], [], 0

    def done():
        # copies, so that a block does not depend on how batches were cut
        return Block(pa.concat_arrays([pa.array(sum(ids, []), kind)]), pa.array(sum(texts, []), pa.large_binary()))
    for batch in batches:
        kind = batch.column(0).type
        keys = batch.column(0).to_pylist()
        rows = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"").to_pylist()
        lo = 0
        for i, t in enumerate(rows):
            size += len(t) + 16
            if size >= BLOCK_BYTES:
                ids.append(keys[lo:i + 1])
                texts.append(rows[lo:i + 1])
                yield number, done()
                number += 1
                ids, texts, size, lo = [], [], 0, i + 1
        ids.append(keys[lo:])
        texts.append(rows[lo:])
    if any(ids):
        yield number, done()


def _store(block: Block) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table([block.ids, block.text], names=["id", "text"])
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _load(data: bytes) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(data)
    with pa.ipc.open_stream(raw) as stream:
        table = stream.read_all()
    return Block(table.column(0).combine_chunks(), table.column(1).combine_chunks())


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def buckets_for(total: int) -> int:
    """Number of key buckets: in proportion to the bytes of text."""
    return max(MIN_BUCKETS, -(-total // BUCKET_BYTES))


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from one bucket to the next (buckets + 1 places).
    A bucket is a range of key values."""
    step = (1 << 64) // buckets + 1
    edges = np.array([i * step for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def ask(rows: DataFrame, buckets: int, keys_of: Callable[[Block], list[np.ndarray]]) -> DataFrame:
    """(bucket, block, digest, keys, notes): for each block of ``rows`` (id,
    text) and bucket the packed sorted keys and what goes with each key.
    ``keys_of`` gives the sorted distinct keys of a block and arrays of
    unsigned integers, one for each note."""
    def run(batches):
        for number, block in _blocks(batches):
            keys, *notes = keys_of(block)
            block.number = number
            yield from send(block, keys, notes, buckets)
    return rows.mapInArrow(run, ASKED)


def send(block: Block, keys: np.ndarray, notes: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows with which a block asks for its sorted distinct keys."""
    at, number, digest = bounds(keys, buckets), block.number, block.digest()
    full = np.flatnonzero(np.diff(at))
    if len(full):
        yield pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()), pa.array([number] * len(full), pa.int64()),
            pa.array([digest] * len(full), pa.int64()),
            pa.array([pack_sorted(keys[at[b]:at[b + 1]]) for b in full], pa.binary()),
            pa.array([[pack(narrow(n[at[b]:at[b + 1]])) for n in notes] for b in full], pa.list_(pa.binary()))],
            names=["bucket", "block", "digest", "keys", "notes"])


def answer(asked: DataFrame, merge: Callable[..., tuple[np.ndarray | None, list[np.ndarray], list[float]]]) -> DataFrame:
    """(block, digest, bucket, keys, replies, stats): what ``merge`` says about the keys.

    ``merge(index, size, *notes)`` gets for all keys of a bucket the number of
    the distinct key (``index``, below ``size``) and the notes, each as one
    array over all blocks.  It gives a mask of the keys to reply to (None: all,
    and the keys, which the block knows, are not sent back), arrays of replies
    for all keys, and figures of the bucket, which go with one of its rows."""
    def run(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        notes = [np.concatenate(x) for x in zip(*(
            [unpack(n, np.uint64) for n in row.as_py()] for row in table.column("notes")))]
        every = np.concatenate(keys)
        distinct, index = np.unique(every, return_inverse=True)
        del keys
        mask, out, stats = merge(index, len(distinct), *notes)
        sent, replies = [], []
        for a, b in zip(at, at[1:]):
            part = slice(a, b) if mask is None else a + np.flatnonzero(mask[a:b])
            sent.append(None if mask is None else pack_sorted(every[part]))
            replies.append([pack(narrow(r[part])) for r in out])
        figures = [[float(x) for x in stats]] + [None] * (table.num_rows - 1)
        return pa.table([table.column("block"), table.column("digest"), table.column("bucket"),
                         pa.array(sent, pa.binary()), pa.array(replies, pa.list_(pa.binary())),
                         pa.array(figures, pa.list_(pa.float64()))],
                        names=["block", "digest", "bucket", "keys", "replies", "stats"])
    return asked.groupBy("bucket").applyInArrow(
        run, "block long, digest long, bucket int, keys binary, replies array<binary>, stats array<double>")


def meet(rows: DataFrame, replies: DataFrame, kinds: int,
         work: Callable[[Block, np.ndarray, list[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each block of ``rows`` with its replies through ``work(block, keys,
    replies)``: the keys that were sent back and ``kinds`` arrays of replies,
    in the order of the keys."""
    def packed(batches):
        for number, block in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block.digest()], pa.int64()),
                                              pa.array([_store(block)], pa.binary())], names=["block", "digest", "data"])

    def run(text: pa.Table, reply: pa.Table) -> pa.Table:
        if text.num_rows != 1 or len(set(reply.column("digest").to_pylist()) | {text.column("digest")[0].as_py()}) != 1:
            raise RuntimeError("the rows were packed differently in two passes: store the input first")
        block = _load(text.column("data")[0].as_py())
        block.number = text.column("block")[0].as_py()
        order = np.argsort(reply.column("bucket").to_numpy())
        keys, parts = [np.empty(0, np.uint64)], [[np.empty(0, np.uint64)] for _ in range(kinds)]
        for i in order.tolist():
            if (data := reply.column("keys")[i].as_py()) is not None:
                keys.append(unpack_sorted(data))
            for part, data in zip(parts, reply.column("replies")[i].as_py()):
                part.append(unpack(data, np.uint64))
        out = list(work(block, np.concatenate(keys), [np.concatenate(p) for p in parts]))
        return pa.Table.from_batches(out) if out else empty.empty_table()
    empty = to_arrow_schema(_parse_datatype_string(schema))
    texts = rows.mapInArrow(packed, "block long, digest long, data binary")
    given = replies.select("block", "digest", "bucket", "keys", "replies")
    return texts.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(run, schema)
