"""Byte-level BPE encoding and decoding with one encoding of every distinct word.

Method: global distinct-word shuffle. The pre-tokens of the corpus are gathered per block
of documents as distinct words; the words, not the text, are dealt by hash over the
cluster; each task encodes every distinct word it holds once; the ids join back to the
blocks, where the pre-tokens of each document are put together by position. A block is
some MB of text, so a word that every document uses travels once per block, however often
it occurs, and no task holds more than one block or one share of the words. Decoding joins
ids with the token-byte table, whose size the vocabulary bounds.

Blocks are numbered by task and order. If a block is computed again from rows in another
order, as can happen after a lost executor, words missing from its dictionary are encoded
in place, so the ids never depend on how rows were dealt.

Texts that are null count as empty. Empty tables give no rows; repeated rows and repeated
keys each give their own row. Columns of the input that are not in `keep` are not returned,
so clashing names do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, shuffle_partitions, tidy

by_value(__name__)

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a rank file: token bytes to id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 3)


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    starts = [4 + 4 * n, *ends[:-1]] if n else []
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def pack_ids(ids: list[list[int]]) -> bytes:
    counts = np.fromiter(map(len, ids), np.uint32, len(ids))
    flat = np.fromiter((x for w in ids for x in w), np.uint32, int(counts.sum()))
    return zstandard.compress(np.uint32(len(ids)).tobytes() + counts.tobytes() + flat.tobytes(), 1)


def unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint32)
    n = int(raw[0])
    return raw[1 : 1 + n], raw[1 + n :]


def _blocks(batches, block_bytes):
    """(block number, table of whole rows): rows in order, about block_bytes of text each."""
    part, k, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        sizes = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])) if len(text) else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            n = int(np.searchsorted(sizes, before + block_bytes - size, "right")) - at
            if n <= 0 and held:  # the next row has no place: wherever batches end, blocks end at the same rows
                yield part | k, pa.Table.from_batches(held)
                k, held, size = k + 1, [], 0
                continue
            n = max(1, n)
            held.append(batch.slice(at, n))
            size += int(sizes[at + n - 1]) - before
            at += n
    if held:
        yield part | k, pa.Table.from_batches(held)


def _pieces(pattern):
    import regex

    return regex.compile(pattern).findall


def word_rows(block_bytes: int, buckets: int, pattern: str):
    def run(batches):
        find = _pieces(pattern)
        for block, t in _blocks(batches, block_bytes):
            words: set[str] = set()
            for x in t.column("text").to_pylist():
                if x:
                    words.update(find(x))
            dealt: dict[int, list[bytes]] = {}
            for w in words:
                w = w.encode()
                dealt.setdefault(zlib.crc32(w) % buckets, []).append(w)
            rows = [(k, pack_words(v)) for k, v in dealt.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "words"])

    return run


def text_rows(block_bytes: int):
    def run(batches):
        for block, t in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_table(t.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return run


def _core(rank_file, pattern):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(rank_file), special_tokens={})._core_bpe


def encode_words(rank_file: str, pattern: str):
    """Every distinct word of this task's share is encoded once; `known` is no larger than that share."""

    def run(batches):
        piece, known = _core(rank_file, pattern).encode_single_piece, {}
        for batch in batches:
            out = []
            for blob in batch.column("words"):
                ids = []
                for w in unpack_words(blob.as_py()):
                    if (x := known.get(w)) is None:
                        x = known[w] = piece(w)
                    ids.append(x)
                out.append(pack_ids(ids))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("words"), pa.array(out, pa.binary())], ["block", "words", "ids"])

    return run


def reassemble(rank_file: str, pattern: str, keep: list[str]):
    def run(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        find, core = _pieces(pattern), None
        index: dict[str, int] = {}
        counts, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for words, ids in zip(dictionary.column("words"), dictionary.column("ids"), strict=True):
            n = len(index)
            index.update((w.decode(), n + i) for i, w in enumerate(unpack_words(words.as_py())))
            c, f = unpack_ids(ids.as_py())
            counts.append(c)
            flat.append(f)
        count, ids = np.concatenate(counts).astype(np.int64), np.concatenate(flat).astype(np.int32)
        first = np.cumsum(count) - count
        kept, values, sizes = [], [], []
        for blob in texts.column("rows"):
            t = pa.ipc.open_stream(blob.as_py()).read_all()
            kept.append(t.select(keep))
            for x in t.column("text").to_pylist():
                words = find(x) if x else []
                if missing := [w for w in dict.fromkeys(words) if w not in index]:
                    core = core or _core(rank_file, pattern)
                    more = [core.encode_single_piece(w.encode()) for w in missing]
                    known = len(index)
                    index.update((w, known + i) for i, w in enumerate(missing))
                    count = np.append(count, [len(m) for m in more])
                    ids = np.append(ids, np.array([i for m in more for i in m], np.int32))
                    first = np.cumsum(count) - count
                at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                n = count[at]
                total = int(n.sum())
                values.append(ids[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(total)])
                sizes.append(total)
        rows = pa.concat_tables(kept)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.concatenate(values))
        return rows.append_column("n_tokens", pa.array(sizes, pa.int64())).append_column("ids", lists.cast(pa.list_(pa.int32())))

    return run


def _dealt(docs: DataFrame, rank_file: str, text: str, keep: list[str], pattern: str, block_bytes: int, buckets: int | None):
    """Texts and encoded words, both grouped by block, and the schema of what reassemble() makes of them."""
    n = buckets or shuffle_partitions(docs.sparkSession)
    rows = docs.select(*[F.col(c) for c in keep if c != "text"], F.col(text).alias("text"))
    words = rows.select("text").mapInArrow(tidy(word_rows(block_bytes, n, pattern)), "block long, bucket int, words binary")
    ids = words.repartition(n, "bucket").mapInArrow(tidy(encode_words(rank_file, pattern)), "block long, words binary, ids binary")
    texts = rows.mapInArrow(tidy(text_rows(block_bytes)), "block long, rows binary")
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts.groupBy("block").cogroup(ids.groupBy("block")), schema


def encode(docs: DataFrame, rank_file: str, text: str = "text", keep: list[str] | None = None, pattern: str = PATTERN, block_bytes: int = 8 << 20, buckets: int | None = None) -> DataFrame:
    """The columns `keep` (doc_id) of every row, with n_tokens long and ids array<int>.

    rank_file is a path that every executor has. The ids are those of the tiktoken library's
    encode_ordinary. block_bytes bounds the text that is put together at once; a longer text
    is a block of its own.
    """
    keep = ["doc_id"] if keep is None else keep
    groups, schema = _dealt(docs, rank_file, text, keep, pattern, block_bytes, buckets)
    return groups.applyInArrow(reassemble(rank_file, pattern, keep), schema)


def round_trip(docs: DataFrame, rank_file: str, text: str = "text", keep: list[str] | None = None, pattern: str = PATTERN, block_bytes: int = 8 << 20, buckets: int | None = None, digest: bool = False, keep_ids: bool = False) -> DataFrame:
    """decode(encode(docs)), where a block's ids are decoded by the worker that has just put them together."""
    keep = ["doc_id"] if keep is None else keep
    groups, schema = _dealt(docs, rank_file, text, keep, pattern, block_bytes, buckets)
    out = decoded_schema(schema, digest, keep_ids)
    there, back = reassemble(rank_file, pattern, keep), decoder(rank_file, out.names, digest, keep_ids)
    return groups.applyInArrow(lambda texts, words: pa.Table.from_batches(back(there(texts, words).to_batches())), out)


def token_table(rank_file: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table as (bytes, offsets by id); an id without a token is empty and marked by -1."""
    ranks = load_ranks(rank_file)
    by_id = {i: b for b, i in ranks.items()}
    top = max(by_id, default=-1) + 1
    sizes = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
    return np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def decode_ids(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> bytes:
    if len(ids) and (ids.min() < 0 or ids.max() >= len(offsets) - 1):
        raise ValueError("an id is not in the token-byte table")
    n = offsets[ids + 1] - offsets[ids]
    return data[np.repeat(offsets[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def decoded_schema(schema: T.StructType, digest: bool, keep_ids: bool) -> T.StructType:
    drop = {"decoded", "ids_sha256", "decoded_sha256", *(["ids"] if digest and not keep_ids else [])}
    added = [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")[keep_ids:]] if digest else [T.StructField("decoded", T.BinaryType())]
    return T.StructType([*[f for f in schema.fields if f.name not in drop], *added])


def decoder(rank_file: str, names: list[str], digest: bool, keep_ids: bool):
    """Batches with ids -> batches with the columns `names`; the token-byte table is made once a task."""
    table: list = []

    def run(batches):
        if not table:
            data, offsets = token_table(rank_file)
            table.extend((data, offsets, [str(i) for i in range(len(offsets) - 1)]))
        data, offsets, decimal = table
        for batch in batches:
            out, shas = [], []
            for x in batch.column("ids"):
                ids = np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)
                raw = decode_ids(ids, data, offsets)
                if digest and not keep_ids:
                    shas.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                out.append(hashlib.sha256(raw).hexdigest() if digest else raw)
            new = {"decoded_sha256": pa.array(out, pa.string())} if digest else {"decoded": pa.array(out, pa.binary())}
            if digest and not keep_ids:
                new["ids_sha256"] = pa.array(shas, pa.string())
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return run


def decode(encoded: DataFrame, rank_file: str, digest: bool = False, keep_ids: bool = False) -> DataFrame:
    """Every row with `decoded` binary joined from the token-byte table; ids that are null decode to nothing.

    With digest, ids and bytes are replaced by ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256; with keep_ids as well, ids stay and decoded_sha256 is beside
    them. An id outside the table is an error.
    """
    out = decoded_schema(encoded.schema, digest, keep_ids)
    return encoded.mapInArrow(tidy(decoder(rank_file, out.names, digest, keep_ids)), out)
