"""Token ids in training order: a keyed permutation gives every sequence its slot, and fixed-stride shards hold the slots."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .bpe import default_tokenizer, encode_column
from .common import Scratch, blocks

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tasks that write shards, at most; with more shards, each writes a run of them.
MOST_TASKS = 20_000
#: Bytes of text that are encoded together: words that several of its texts have are looked up once.
BLOCK = 24 << 20


def _round(half: np.ndarray, key: int, number: int) -> np.ndarray:
    x = half.astype(np.uint64) ^ np.uint64((key + (number + 1) * int(_MIX)) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the next even number of bits, walked on
    along its cycle as long as it leaves the range (less than four steps on the average)."""
    bits = max(1, -(-max(1, int(n - 1).bit_length()) // 2))
    mask = np.uint64((1 << bits) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(bits), x & mask
        for r in range(rounds):
            left, right = right, left ^ (_round(right, key, r) & mask)
        return (left << np.uint64(bits)) | right

    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            out[todo] = once(out[todo])
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _zip(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _encoded(path: str, end_id: int, stride: int, unit: str):
    """Texts to blocks: the task's number, the sequences before the block in the task and in it, keys, counts of tokens, and all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text", BLOCK):
            ids, ends = encode_column(batch.column("text"), path)
            if max(int(ids.max(initial=0)), end_id) > np.iinfo(unit).max:
                raise ValueError("an id needs wide records")
            n = np.diff(ends) + 1
            whole = np.full(len(ids) + len(n), end_id, unit)
            own = np.ones(len(whole), bool)
            own[ends[1:] + np.arange(len(n))] = False
            whole[own] = ids
            held = int((-(-n // stride)).sum())
            keys = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), batch.column("key"))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at]), pa.array([held]), keys, pa.array([_zip(n.astype("<i8"))]), pa.array([_zip(whole)])], ["part", "at", "n", "keys", "sizes", "ids"])
            at += held

    return run


def _dealt(stride: int, per_shard: int, total: int, key: int, unit: str):
    """Blocks to a row for each shard that they have sequences of: the slots, rising, with keys, pieces, counts of tokens and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, sizes, ids in zip(batch.column("first").to_pylist(), batch.column("keys"), batch.column("sizes"), batch.column("ids"), strict=True):
                n, whole = _unzip(sizes.as_py(), "<i8"), _unzip(ids.as_py(), unit)
                count = -(-n // stride)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                used = np.minimum(n[row] - piece * stride, stride)
                slot = permute(np.arange(first, first + len(row)), total, key)
                order = np.argsort(slot, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(used * whole.itemsize)]).astype(np.int32)  # where one sequence ends the next begins
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(whole)]).take(pa.array(order))
                row, piece, used, slot = row[order], piece[order], used[order], slot[order]
                shard = slot // per_shard
                ends = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(slot)]])
                at = np.frombuffer(data.buffers()[1], np.int32)[ends] // whole.itemsize
                flat = np.frombuffer(data.buffers()[2], unit)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[ends[:-1]]), listed(pa.array(slot)), listed(keys.values.take(pa.array(row))), listed(pa.array(piece.astype(np.int32))), listed(pa.array(used.astype(np.int32))), pa.array([_zip(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["shard", "slots", "keys", "pieces", "used", "ids"],
                )

    return run


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def materialise(df: DataFrame, key_col: str, text_col: str, path: str, out: str, key: int, stride: int = 256, per_shard: int = 16_384, end_id: int = 49_407, wide: bool = False) -> DataFrame:
    """Writes every sequence of the texts at its slot of the training order, and returns one row for each as read back.

    A text's ids and end_id are cut into sequences of `stride` tokens, the last padded with 0. A sequence's number is its
    place in the input (the same for a table read twice); its slot is the keyed permutation of that. Shard s holds the slots
    from s * per_shard as records of equal length: the count of tokens as 4 bytes, then the ids as 2 (wide: 4), little-endian.
    So slot i is read by one seek, and a reader goes on from any slot. A shard is written under another name and renamed when
    whole, next to a JSON file with its rows and checksum: a task that is run again replaces its shard, and a job that is run
    again into the same folder leaves shards alone that are there with the checksum they should have.

    Texts are encoded once, into a table of packed blocks of ids; counts, slots and shards are taken from it. The driver gets the
    count of sequences only. A block sends one packed row to each shard; a task of the last step owns a range of slots, which is
    one shard or a run of them, and holds one at a time (per_shard * stride ids).

    Rows: key, piece, slot, shard, record, n_tokens, ids_crc32 (of the ids as unsigned 4 bytes, without padding). Null and empty
    texts give the end id alone; null and repeated keys are kept; an empty table gives no rows and no shards.
    """
    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    unit = "<u4" if wide else "<u2"
    kind = rows.schema["key"].dataType.simpleString()
    made = Scratch(df.sparkSession).save(rows.mapInArrow(_encoded(path, end_id, stride, unit), f"part int, at long, n long, keys array<{kind}>, sizes binary, ids binary"), "blocks")
    counts = made.groupBy("part").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    n_shards = max(1, -(-total // per_shard))
    run = -(-n_shards // MOST_TASKS)
    first = made.join(F.broadcast(before), "part").select((F.col("at") + F.col("before")).alias("first"), "keys", "sizes", "ids")
    dealt = first.mapInArrow(_dealt(stride, per_shard, total, key, unit), f"shard long, slots array<long>, keys array<{kind}>, pieces array<int>, used array<int>, ids binary")
    ranged = dealt.repartitionById(-(-n_shards // run), F.expr(f"int(shard div {run}L)")).sortWithinPartitions("shard")
    return ranged.mapInArrow(_written(out, stride, per_shard, total, unit), f"key {kind}, piece int, slot long, shard long, record long, n_tokens long, ids_crc32 long")


def _written(out: str, stride: int, per_shard: int, total: int, unit: str):
    """Rows sorted by shard to shards, each written, read back and told sequence by sequence."""
    size = 4 + stride * np.dtype(unit).itemsize

    def close(files, folder: str, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        shard = rows.column("shard")[0].as_py()
        slot, key, piece, n = (rows.column(c).combine_chunks().flatten() for c in ("slots", "keys", "pieces", "used"))
        order = np.argsort(slot.to_numpy(), kind="stable")
        slots, n = slot.to_numpy()[order], n.to_numpy()
        first = shard * per_shard
        if not np.array_equal(slots, np.arange(first, min(first + per_shard, total))):
            raise RuntimeError(f"shard {shard} lacks a slot")
        made = np.zeros((len(slots), stride), unit)
        made[np.arange(stride) < n[:, None]] = np.concatenate([_unzip(x.as_py(), unit) for x in rows.column("ids")])
        data = np.zeros((len(slots), size), np.uint8)
        data[:, :4] = n[order].astype("<u4").view(np.uint8).reshape(-1, 4)
        data[:, 4:] = made[order].view(np.uint8)
        data = data.tobytes()
        name, note = f"{folder}/{shard:08d}.bin", {"shard": shard, "first_slot": int(slots[0]), "rows": len(slots), "record_bytes": size, "stride": stride, "unit": unit, "crc32": zlib.crc32(data)}
        if not _there(files, name, note):
            files.create_dir(folder, recursive=True)
            for path_, what in ((name, data), (f"{name}.json", json.dumps(note).encode())):
                with files.open_output_stream(tmp := f"{path_}.{_attempt()}.tmp") as f:
                    f.write(what)
                files.move(tmp, path_)
        with files.open_input_stream(name) as f:
            back = np.frombuffer(f.read(), np.uint8).reshape(len(slots), size)
        used = np.ascontiguousarray(back[:, :4]).view("<u4").ravel()
        ids = np.ascontiguousarray(back[:, 4:]).view(unit).astype("<u4")
        crc = np.fromiter((zlib.crc32(x[:k]) for x, k in zip(ids, used.tolist(), strict=True)), np.int64, len(used))
        return pa.RecordBatch.from_arrays([key.take(pa.array(order)), piece.take(pa.array(order)), pa.array(slots), pa.array(np.full(len(slots), shard)), pa.array(slots - slots[0]), pa.array(used.astype(np.int64)), pa.array(crc)], ["key", "piece", "slot", "shard", "record", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(out)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                shards = batch.column("shard").to_numpy()
                if held and held[0].column("shard")[0].as_py() != shards[0]:
                    yield close(files, folder, held)
                    held.clear()
                same = int(np.searchsorted(shards, shards[0], "right"))
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield close(files, folder, held)

    return run


def _attempt() -> str:
    from pyspark import TaskContext

    return str(TaskContext.get().taskAttemptId())


def _there(files, name: str, note: dict) -> bool:
    from pyarrow import fs

    if any(x.type == fs.FileType.NotFound for x in files.get_file_info([name, f"{name}.json"])):
        return False
    with files.open_input_stream(f"{name}.json") as f:
        if json.loads(f.read()) != note:
            return False
    with files.open_input_stream(name) as f:
        return zlib.crc32(f.read()) == note["crc32"]


def read_slots(path: str, first: int, n: int) -> list[np.ndarray]:
    """The token ids of n slots from `first` on, by seeks into the shards of a materialised folder."""
    files, folder = filesystem(path)
    with files.open_input_stream(f"{folder}/{0:08d}.bin.json") as f:
        head = json.loads(f.read())
    out: list[np.ndarray] = []
    for slot in range(first, first + n):
        with files.open_input_file(f"{folder}/{slot // head['rows']:08d}.bin") as f:
            f.seek(slot % head["rows"] * head["record_bytes"])
            data = f.read(head["record_bytes"])
        used = int.from_bytes(data[:4], "little")
        out.append(np.frombuffer(data[4:], head["unit"])[:used])
    return out


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences of 256 tokens in a keyed training order, as written to and read back from shards."""
    out = materialise(table(spark, sf_dir, "documents"), "doc_id", "text", default_tokenizer(), Scratch(spark).root + "/order", key=20_260_101)
    return out.withColumnRenamed("key", "doc_id")
