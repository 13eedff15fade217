"""Byte-pair encoding by a public tokenizer file, over distinct words.

The vocabulary file belongs to the tokenizers library; its path is a parameter. A text is cut at white space into
chunks, a chunk into the tokenizer's pre-tokens (here: words). No rule of the tokenizer looks across white
space, so the ids of a text are the ids of its words in order, and a word needs encoding only once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import blocks

#: Chunks of these characters only are split by the plain pattern below: printable ASCII and Latin letters up to
#: U+024F but U+0130 (its lower case has two characters), for which NFC changes nothing. All others take the library's own steps.
_PLAIN = re.compile("[\\x21-\\x7eÀ-įı-ɏ]+")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Chunks whose ids one Python worker keeps: the first it meets, among them the frequent ones.
CACHE = 100_000
#: The fewest and the most buckets of words.
MOST_BUCKETS = 256, 1 << 15


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if it is a visible Latin-1 letter, else the next free code from 256."""
    seen = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    free = (chr(256 + i) for i in range(256))
    return {b: seen.get(b) or next(free) for b in range(256)}


class WordEncoder:
    """Splits chunks into words and encodes words. One instance for each Python worker and file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.pieces = pa.array([self.tok.id_to_token(i) or "" for i in range(size)])
        self.digits = pa.array([str(i) for i in range(size)])
        self.cache: dict[str, tuple[int, ...]] = {}

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk without white space, in the vocabulary's byte letters; a special token is a word as it stands."""
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            found = _WORDS.findall(chunk.lower())
            return found if chunk.isascii() else [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in found]
        parts = self.at_special.split(chunk) if self.at_special else [chunk]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                out += [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out

    def ids(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.tok.model.tokenize(word)]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        got = self.cache.get(chunk)
        if got is None:
            got = tuple(i for w in self.words(chunk) for i in self.ids(w))
            if len(self.cache) < CACHE:
                self.cache[chunk] = got
        return got


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _taken(values: Callable[[str], list | tuple], chunks: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """values() of every chunk in a row, each distinct chunk worked on once: all values, and how many each chunk has."""
    coded = chunks.dictionary_encode()
    lists = [values(c) for c in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((v for x in lists for v in x), kind.to_pandas_dtype(), int(sizes.sum()))
    made = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat, kind))
    index = coded.indices.to_numpy()
    return made.take(pa.array(index)).flatten().to_numpy(), sizes[index] if len(index) else np.zeros(0, np.int64)


def _per_text(lists: pa.ListArray, per_chunk: np.ndarray) -> np.ndarray:
    """Bounds of each text in the values, from how many each of its chunks has."""
    ends = np.concatenate([[0], np.cumsum(per_chunk)])
    chunks = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    return ends[chunks]


def encode_column(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after the other, and each text's bounds in them (one more than texts)."""
    lists = pc.ascii_split_whitespace(text.cast(pa.string()).fill_null(""))
    ids, sizes = _taken(encoder(path).chunk_ids, lists.flatten(), pa.uint32())
    return ids, _per_text(lists, sizes)


def _joined(table_: pa.Array, ids: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    words = table_.take(pa.array(ids))
    line = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), words)
    return pc.binary_join(line, " ")[0].as_buffer().to_pybytes()


# The distinct-word table --------------------------------------------------------------------------------------


_ROW = "kind int, at long, doc binary, words binary"


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    values = np.ascontiguousarray(values)
    least = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if t is np.int64 or not len(values) or (values.min() >= 0 and values.max() <= np.iinfo(t).max))
    planes = np.ascontiguousarray(values.astype(least).view(np.uint8).reshape(len(values), -1).T)  # high bytes together pack best
    return np.dtype(least).char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _split(path: str, buckets: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to blocks: one row with the positions of words (kind 0), and the block's distinct words dealt to buckets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard
        from pyspark import TaskContext

        enc, task = encoder(path), TaskContext.get().partitionId() << 32
        for number, batch in enumerate(blocks(batches, "text", block_bytes)):
            lists = pc.ascii_split_whitespace(batch.column("text").cast(pa.string()).fill_null(""))
            book: dict[str, int] = {}
            codes, sizes = _taken(lambda c: [book.setdefault(w, len(book)) for w in enc.words(c)], lists.flatten(), pa.uint32())
            bounds = _per_text(lists, sizes)
            key, at = batch.column("key"), task + number
            words = list(book)
            used = np.bincount(codes, minlength=len(words))
            order = np.argsort(-used, kind="stable")  # frequent words get small numbers, which pack well
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            absent = key.is_null().to_numpy(zero_copy_only=False)
            doc = [_pack(key.fill_null(0).to_numpy()), _pack(absent), _pack(np.diff(bounds)), _pack(place[codes])]
            head = np.array([len(x) for x in doc], np.int64).tobytes()
            yield pa.RecordBatch.from_pydict({"kind": pa.array([0], pa.int32()), "at": pa.array([at]), "doc": pa.array([head + b"".join(doc)]), "words": pa.array([None], pa.binary())})
            dealt: list[list[int]] = [[] for _ in range(buckets)]
            for i in order.tolist():
                dealt[zlib.crc32(words[i].encode()) % buckets].append(i)
            zip_ = zstandard.ZstdCompressor(level=1)
            rows = [(b, zip_.compress("\n".join(words[i] for i in own).encode()), _pack(place[own])) for b, own in enumerate(dealt) if own]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([b + 1 for b, _, _ in rows], pa.int32()), "at": pa.array([at] * len(rows)), "doc": pa.array([d for _, _, d in rows], pa.binary()), "words": pa.array([w for _, w, _ in rows], pa.binary())})

    return run


def _encode_words(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word lists to lists of ids; a task owns whole buckets of words and encodes each word once. Blocks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, known = encoder(path), {}
        for batch in batches:
            out = []
            for kind, words in zip(batch.column("kind").to_pylist(), batch.column("words"), strict=True):
                if kind == 0:
                    out.append(None)
                    continue
                lists = []
                for w in zstandard.ZstdDecompressor().decompress(words.as_py()).decode().split("\n"):
                    if (got := known.get(w)) is None:
                        if len(known) >= 4 * CACHE:  # a bucket with more distinct words encodes some again
                            known.clear()
                        got = known[w] = np.array(enc.ids(w), np.uint32).tobytes()
                    lists.append(got)
                sizes = _pack(np.fromiter((len(x) // 4 for x in lists), np.int64, len(lists)))
                out.append(len(sizes).to_bytes(8, "little") + sizes + _pack(np.frombuffer(b"".join(lists), np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("at"), batch.column("doc"), pa.array(out, pa.binary())], ["kind", "at", "doc", "words"])

    return run


def _ids_by_position(path: str, each: Callable, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """A block's rows to the ids of its texts: the words' ids taken at the words' positions."""

    def run(rows: pa.Table) -> pa.Table:
        lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = None
        for kind, doc, words in zip(rows.column("kind").to_pylist(), rows.column("doc"), rows.column("words"), strict=True):
            if kind == 0:
                whole = doc.as_py()
            else:
                data = words.as_py()
                n = int.from_bytes(data[:8], "little")
                lists.append((_unpack(doc.as_py()), _unpack(data[8 : 8 + n]), _unpack(data[8 + n :])))
        if whole is None:
            raise RuntimeError("a block has words but no texts")
        cut = np.cumsum(np.frombuffer(whole[:32], np.int64)) + 32
        key, absent, counts, codes = (_unpack(whole[a:b]) for a, b in zip([32, *cut[:-1]], cut, strict=True))
        place = np.concatenate([x[0] for x in lists]) if lists else np.zeros(0, np.int64)
        sizes = np.concatenate([x[1] for x in lists]).astype(np.int64) if lists else np.zeros(0, np.int64)
        flat = np.concatenate([x[2] for x in lists]).astype(np.uint32) if lists else np.zeros(0, np.uint32)
        if len(codes) and (len(place) != int(codes.max()) + 1):
            raise RuntimeError("a block lacks some of its words")
        table_ = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(flat))
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        codes = back[codes.astype(np.int64)]
        ids = table_.take(pa.array(codes)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
        return pa.Table.from_pydict(each(pa.array(key.astype(np.int64), mask=absent.astype(bool)), ids, ends), schema=schema)

    return run


def _buckets(rows: DataFrame, block_bytes: int) -> int:
    """Buckets of words for so many bytes of input, as the optimiser knows them: they grow as the root of the blocks, since each block
    sends a row to each bucket, and distinct words grow more slowly than words."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unknown = size >= 1 << 60
    return MOST_BUCKETS[0] if unknown else min(MOST_BUCKETS[1], max(MOST_BUCKETS[0], 8 * int((size / block_bytes) ** 0.5)))


def encode_distinct(df: DataFrame, key_col: str, text_col: str, path: str, each: Callable, schema: pa.Schema, ddl: str, buckets: int | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """Encodes texts through a table of distinct words, and gives each block's keys, ids and bounds to `each`.

    1. Every task splits its texts into blocks of bounded bytes: the positions of words as numbers, and the block's
       distinct words dealt by a hash to buckets.
    2. A bucket of words meets in one task, which encodes every word once, whichever blocks ask for it.
    3. The ids go back to the block and take the places of the words (a join by block and position).

    A frequent word is one entry for each block, never one for each occurrence. Keys are longs, null and repeated
    ones included: each row is encoded for itself. Texts may be null (empty), empty or longer than a block (then a
    block of its own). An empty table gives no rows. Other columns are ignored.
    """
    rows = df.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_split(path, buckets or _buckets(rows, block_bytes), block_bytes), _ROW)
    dealt = made.repartition(F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.xxhash64("at")))
    encoded = dealt.mapInArrow(_encode_words(path), _ROW)
    return encoded.groupBy("at").applyInArrow(_ids_by_position(path, each, schema), ddl)


def digests(path: str) -> Callable:
    """For encode_distinct: the count and checksums of ids, and of the text that the ids decode to."""

    def each(key: pa.Array, ids: np.ndarray, ends: np.ndarray) -> dict:
        enc = encoder(path)
        own = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return {
            "key": key,
            "n_tokens": np.diff(ends),
            "ids_sha256": [hashlib.sha256(_joined(enc.digits, x)).hexdigest() for x in own],
            "decoded_sha256": [hashlib.sha256(_joined(enc.pieces, x)).hexdigest() for x in own],
        }

    return each


def decode_ids(df: DataFrame, ids_col: str, path: str, out_col: str) -> DataFrame:
    """Adds the text that each row's ids decode to: every id is looked up in the id-to-piece table (as large as the
    vocabulary, whatever the rows), and the pieces are joined by a space, as the library does for a file without a decoder.
    Null ids give null; an id outside the vocabulary fails the job."""

    @F.pandas_udf("string")
    def decoded(ids):
        pieces = encoder(path).pieces
        return ids.map(lambda x: None if x is None else _joined(pieces, np.asarray(x, np.int64)).decode())

    return df.withColumn(out_col, decoded(F.col(ids_col)))


def op4_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through the table of distinct words, and the text they decode to, as checksums."""
    path = default_tokenizer()
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    out = encode_distinct(table(spark, sf_dir, "documents"), "doc_id", "text", path, digests(path), schema, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", "doc_id")
