"""Token ids as bit-plane shuffled, compressed blocks with a chunk index.

*File format.* A folder of Parquet files, written and committed by Spark, one row per chunk. A chunk holds
whole documents in ascending id order and cuts their ids into blocks of a fixed size. A block is transposed
into planes: plane k has byte k (or bit k) of every id, so the slowly changing high parts compress well.
Each plane is compressed with zstandard by itself. The other columns are the chunk index: shard, chunk,
ids before it in its shard, ids in it, planes of a block, and document ids with their sizes. Readers of the index
never touch the planes.

Shards are ranges of document ids, cut at approximate quantiles, and each shard is one partition, so ids
ascend from shard to shard and chunk to chunk. Null texts count as empty. Rows without a document id come
first; rows that share an id follow each other in the order of their texts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import bounded_batches, give_back, shared_dir
from .words import SPACE, Stretches, gathered, listed, stretches, unpacked

END_ID = 2
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 19
LEVEL = 3
LINE = 2000  # words that the tokenizer gets as one text
LINES = 8  # texts that it gets at once
LONG = 40  # characters of a word that is remembered
REMEMBERED = 1 << 19  # words per generation; two generations are kept, at most 200 MB a worker
MARKED = r"(?s)^(?P<stem>.*[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])(?P<marks>[.,;:!?]+)$"
GATHER_BYTES = 8 << 20  # text whose words are looked up together
CUTS_ACCURACY = 10_000

CHUNKS = (
    "shard int, chunk int, first_id long, n_ids long, plane_bits int, plane_count int, block_ids int, "
    "doc_ids array<long>, doc_sizes array<long>, planes array<binary>"
)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work, one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        lengths[i] = len(token)  # the byte-level alphabet has one letter per byte
    return tokenizer, lengths


class Remembered:
    """Packed ids of words after a blank; a full generation becomes the old one, and what is asked again comes back."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def recall(self, words: list[str]) -> list[bytes | None]:
        out = list(map(self.now.get, words))
        if self.old:
            for k, ids in enumerate(out):
                if ids is None and (back := self.old.get(words[k])) is not None:
                    out[k] = self.now[words[k]] = back
        return out

    def add(self, words: list[str], ids: list[bytes]) -> None:
        if len(self.now) + len(words) > self.most:
            self.now, self.old = {}, self.now
        self.now.update(zip(words, ids))


@lru_cache(maxsize=2)
def _memory(path: str) -> Remembered:
    """One per Python worker, kept from slice to slice and from task to task."""
    return Remembered(REMEMBERED)


def _coded(texts: list[str], path: str) -> list[np.ndarray]:
    out, tokenizer = [], _tokenizer(path)[0]
    for start in range(0, len(texts), LINES):  # the library's own results are large
        some = tokenizer.encode_batch_fast(texts[start : start + LINES], add_special_tokens=False)
        out += [np.array(c.ids, "<u4") for c in some]
    return out


def stretch_ids(cut: Stretches, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all stretches, as `gathered` takes them; only words that are not remembered reach the library.

    Marks that end a word are encoded apart from it, as the library's own pattern always cuts between a
    letter and a mark.
    """
    parts = pc.extract_regex(cut.after, MARKED)
    marked = pc.is_valid(parts)
    stems = pc.if_else(marked, pc.struct_field(parts, "stem"), cut.after).dictionary_encode()
    marks = pc.struct_field(parts.filter(marked), "marks").dictionary_encode()
    ids = word_ids(stems.dictionary, path)
    ends = [c.tobytes() for c in _coded(listed(marks.dictionary), path)]
    out = list(map(ids.__getitem__, stems.indices.to_pylist()))
    for k, mark in zip(np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist(), marks.indices.to_pylist()):
        out[k] += ends[mark]
    return unpacked(out + [c.tobytes() for c in _coded(cut.others, path)])


def word_ids(after: pa.Array, path: str) -> list[bytes]:
    """Packed ids of different words after a blank.

    Many words go to the library in one line, each after the blank that it has in the text; the lengths of
    the tokens tell where each ends. Words that end in a blank would run into the next one of a line, so they
    go by themselves.
    """
    known, lengths = _memory(path), _tokenizer(path)[1]
    words = listed(after)
    out = known.recall(words)
    missing = np.fromiter((k for k, ids in enumerate(out) if ids is None), np.int64)
    new = after.take(pa.array(missing))
    runs_on = pc.match_substring_regex(new, f"{SPACE}$|^$").to_numpy(zero_copy_only=False)
    joint, alone = missing[~runs_on].tolist(), missing[runs_on].tolist()
    line = [words[k] for k in joint]
    coded = _coded([" " + " ".join(line[i : i + LINE]) for i in range(0, len(line), LINE)], path)
    flat = np.concatenate([np.zeros(0, "<u4"), *coded])
    size = pc.binary_length(new).to_numpy(zero_copy_only=False)[~runs_on].astype(np.int64) + 1
    # words and tokens both cover the lines without a gap
    ends = (np.searchsorted(np.cumsum(lengths[flat]), np.cumsum(size), side="right") * 4).tolist()
    raw = flat.tobytes()
    line_ids = [raw[a:b] for a, b in zip([0, *ends], ends)]
    for k, ids in zip(joint, line_ids):
        out[k] = ids
    for k, ids in zip(alone, _coded([" " + words[k] for k in alone], path)):
        out[k] = ids.tobytes()
    short = [(w, ids) for w, ids in zip(line, line_ids) if len(w) <= LONG]
    known.add([w for w, _ in short], [ids for _, ids in short])
    return out


def document_ids(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and where each text's begin; ``end_id`` closes each text."""
    cut = stretches(texts)
    ids, edges = gathered(cut, *stretch_ids(cut, path))
    if end_id is None:
        return ids, edges
    return np.insert(ids, edges[1:], end_id), edges + np.arange(len(edges))


def to_planes(ids: np.ndarray, bits: int, count: int) -> list[bytes]:
    """Transpose a block of ids into ``count`` planes of ``bits`` (1 or 8) bits each."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 1:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(rows[:, k]).tobytes() for k in range(count)]
    return [rows[:, k].tobytes() for k in range(count)]


def from_planes(planes: list[bytes], bits: int, n: int) -> np.ndarray:
    columns = [np.frombuffer(p, np.uint8) for p in planes]
    if bits == 1:
        columns = [np.unpackbits(c, count=n) for c in columns]
        out = np.zeros((n, 32), np.uint8)
        out[:, : len(columns)] = np.stack(columns, axis=1)
        return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()
    out = np.zeros((n, 4), np.uint8)
    out[:, : len(columns)] = np.stack(columns, axis=1)
    return out.view("<u4").ravel()


class Chunks:
    """Gathers documents of one shard into chunks of about ``CHUNK_IDS`` ids."""

    def __init__(self, shard: int, bits: int, count: int):
        self.shard, self.bits, self.count = shard, bits, count
        self.chunk = self.first = self.n = 0
        self.docs: list = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, docs: list, sizes: np.ndarray, ids: np.ndarray) -> Iterator[dict]:
        """Take documents; gives the chunks that are full."""
        room = np.cumsum(sizes) + self.n
        cuts = np.flatnonzero(np.diff(room // CHUNK_IDS, prepend=self.n // CHUNK_IDS) > 0) + 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        for cut in [*cuts.tolist(), len(docs)]:
            self.docs += docs[at:cut]
            self.sizes += sizes[at:cut].tolist()
            self.parts.append(ids[ends[at] : ends[cut]])
            self.n += int(ends[cut] - ends[at])
            at = cut
            if self.n >= CHUNK_IDS:
                yield self.close()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.docs:
            yield _row(self.close())

    def close(self) -> dict:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, "<u4")
        planes = [
            self.press.compress(p)
            for k in range(0, len(ids), BLOCK_IDS)
            for p in to_planes(ids[k : k + BLOCK_IDS], self.bits, self.count)
        ]
        row = dict(
            shard=self.shard, chunk=self.chunk, first_id=self.first, n_ids=len(ids), plane_bits=self.bits,
            plane_count=self.count, block_ids=BLOCK_IDS, doc_ids=self.docs, doc_sizes=self.sizes, planes=planes,
        )
        self.chunk += 1
        self.first += len(ids)
        self.n, self.docs, self.sizes, self.parts = 0, [], [], []
        return row


def chunk_ids(row: dict) -> np.ndarray:
    """All ids of a chunk read back from its planes."""
    press, count = zstandard.ZstdDecompressor(), row["plane_count"]
    parts, left = [], row["n_ids"]
    for k in range(0, len(row["planes"]), count):
        n = min(left, row["block_ids"])
        parts.append(from_planes([press.decompress(p) for p in row["planes"][k : k + count]], row["plane_bits"], n))
        left -= n
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(shard, document ids, texts) in order, each of one shard and of about ``GATHER_BYTES``: equal words meet there."""
    held: list[pa.RecordBatch] = []
    size = 0

    def rest():
        table = pa.Table.from_batches(held).combine_chunks()
        docs, texts = (pa.concat_arrays(table.column(c).chunks) for c in ("doc_id", "text"))
        return held[0].column("shard")[0].as_py(), docs, texts

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and (size >= GATHER_BYTES or held[0].column("shard")[0].as_py() != shards[a]):
                yield rest()
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
    if held:
        yield rest()


def write(
    docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID, bits: int = 8
) -> None:
    """Encode texts with a tokenizer file and write their ids to the folder ``path``; see the module text.

    ``bits``: 8 for byte planes, 1 for bit planes. ``vocabulary`` is a file that every executor has.
    """
    if bits not in (1, 8):
        raise ValueError("planes have 1 or 8 bits")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [n / shards for n in range(1, shards)]
    cuts = rows.agg(F.percentile_approx("doc_id", points, CUTS_ACCURACY)).first()[0] if points else []
    cuts = sorted(set(cuts or []))
    shard = F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    shard = F.when(F.col("doc_id").isNull(), 0).otherwise(shard).cast("int")
    dealt = rows.withColumn("shard", shard).repartitionById(len(cuts) + 1, F.col("shard"))
    largest = max(len(_tokenizer(vocabulary)[1]) - 1, end_id or 0).bit_length()
    count = -(-largest // bits)

    def run(batches):
        now: Chunks | None = None
        for shard, doc_ids, text in _gathered(batches):
            if now is not None and now.shard != shard:
                yield from now.rest()
                now = None
            now = now or Chunks(shard, bits, count)
            ids, edges = document_ids(text, vocabulary, end_id)
            for row in now.add(doc_ids.to_pylist(), np.diff(edges), ids):
                yield _row(row)
        if now is not None:
            yield from now.rest()
        give_back()

    ordered = dealt.sortWithinPartitions("shard", "doc_id", "text")
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(path)


_KINDS = [
    ("shard", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("plane_bits", pa.int32()),
    ("plane_count", pa.int32()), ("block_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_sizes", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
]


def _row(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(_KINDS))


def index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index of a folder, without its planes."""
    return spark.read.schema(CHUNKS).parquet(path).drop("planes")


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard; one number per shard reaches the driver."""
    sizes = index(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    return dict(zip([r["shard"] for r in sizes], accumulate([r["n"] for r in sizes], initial=0)))


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids if asked for.

    ``ids`` are little-endian 32-bit numbers. Chunks hold whole documents, so every chunk is read by itself.
    """
    bounded_batches(spark)
    starts = shard_starts(spark, path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = chunk_ids(row).astype("<u4", copy=False)
                edges = np.concatenate([[0], np.cumsum(np.array(row["doc_sizes"], np.int64))])
                raw = memoryview(data.tobytes())
                cuts = (edges * 4).tolist()
                parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(edges[:-1] + row["first_id"] + starts[row["shard"]]),
                    pa.array(row["doc_sizes"], pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(p) for p in parts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return spark.read.schema(CHUNKS).parquet(path).mapInArrow(run, schema)


def new_folder(spark: SparkSession, name: str = "tokens") -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
