"""Token ids in binary shards: one zstandard dictionary for all, each document a frame of its own, with an offset index.

``write_token_files`` encodes whole texts with a ``tokenizers`` file, appends an end id and writes shards in ascending order
of document id.  A shard is::

    magic, item size (2 or 4 bytes an id, little-endian), SHA-256 of the dictionary (zeros: none)
    a zstandard frame a document
    index: document ids, null flags, id counts, frame offsets (int64 / uint8 arrays, one zstandard frame)
    offset of the index, number of documents, magic

so that one short document is read with two ranged reads (:func:`read_document`).  Each task writes its shard under a name of its
own attempt; the manifest, which Spark writes and commits, lists the names that count, so a task that runs twice, or dies
half way, leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.llm.common import shared_dir, slices

MAGIC = b"FMTOKZ01"
HEAD, FOOT = "<8sB32s", "<QQ8s"

#: The dictionary is trained on at most so many documents (those whose ids hash lowest), of these sizes in characters:
#: a shared dictionary helps short documents.  It changes the files' size only, never what is read back.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1000, (64, 8192), 64 << 10, 3

#: Words as written, and their parts in lower case, that a task remembers with their ids (about 200 bytes each, twice as many at most).
MEMO_WORDS, MEMO_PIECES, MEMO_BYTES = 120_000, 100_000, 48


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


#: The set-up under which a text's ids are its words' ids in turn (words as split at ASCII white space): no rule of it
#: looks across white space.  Fixed values, as in the tokenizer file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class Memo(dict):
    """Values that ``make`` gives, made when first asked for.  At most twice ``most`` are kept: those asked for since there were ``most``
    new ones last, and those from before.  Long keys aren't kept.
    """

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        if (made := self.before.get(key)) is None:
            made = self.make(key)
        if len(key) <= MEMO_BYTES:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = made
        return made


class Encoder:
    """Texts (UTF-8 bytes) to id arrays (bytes), as ``encode(text, add_special_tokens=False)`` gives them.

    Where the tokenizer works word by word, words and their ids are remembered; of a new word of plain letters and signs each part is
    looked up in lower case, and only a new part goes to the library's BPE model; anything else goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            setup = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.by_word = (setup["normalizer"], setup["pre_tokenizer"]) == _BY_WORD and all(re.fullmatch(r"\S*<\|\S+", x["content"]) and not x["lstrip"] and not x["rstrip"] for x in setup["added_tokens"])
        self.memo, self.pieces = Memo(self._word, MEMO_WORDS), Memo(self._model, MEMO_PIECES)
        self.packed = [self._pack([k]) for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.pattern = regex.compile(_PATTERN)
        self.plain = re.compile("[\x21-\x7e¡-ɏ]+")  # NFC and lower case act on each of these alone
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE shows as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = dict(zip(shown, shown, strict=True)) | {b: 256 + k for k, b in enumerate(hidden)}

    def forget(self) -> None:
        """Give back the memory of remembered words: the worker goes on to other work."""
        for memo in (self.memo, self.pieces):
            memo.clear()
            memo.before = {}

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalpha()):  # byte-level BPE shows these letters as themselves
            piece = piece.encode().decode("latin-1").translate(self.byte_chars)
        found = self.tokenizer.model.tokenize(piece)
        return self.packed[found[0].id] if len(found) == 1 else b"".join([self.packed[t.id] for t in found])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not self.plain.fullmatch(text):
            return self._whole(text)
        text = text.lower()
        return self.pieces[text] if text.isalpha() else b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._whole(text.decode())
        return b"".join(map(self.memo.__getitem__, text.split()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; workers keep theirs from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _text_bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def train_dictionary(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """A zstandard dictionary for this corpus' id arrays; empty if there are too few short documents to train one."""
    rows, scale = docs.count(), 1 << 30
    rank = F.pmod(F.xxhash64(F.col(id_col)), F.lit(scale))
    near = docs.where(F.length(text_col).between(*SAMPLE_CHARS)).select(rank.alias("rank"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Few rows pass, whatever the size of the corpus; of these the lowest ranks are taken.
    few = near.where(F.col("rank") < min(scale, int(scale * 8 * SAMPLE_DOCS / max(rows, 1)))).orderBy("rank", "id", "text").limit(SAMPLE_DOCS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([enc.encode(t) for t in batch.column(0).to_pylist()], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in few.select(_text_bytes("text")).mapInArrow(encode, "ids binary").collect()]
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    if size < 1024 or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too short for a dictionary
        return b""


@dataclass
class Index:
    doc_ids: np.ndarray
    null: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray
    item: np.dtype
    dict_hash: bytes


def _read_index(f: pa.NativeFile) -> Index:
    foot = struct.calcsize(FOOT)
    magic, item, dict_hash = struct.unpack(HEAD, f.read_at(struct.calcsize(HEAD), 0))
    at, n, end = struct.unpack(FOOT, f.read_at(foot, f.size() - foot))
    if magic != MAGIC or end != MAGIC:
        raise ValueError("not a token shard, or cut short")
    raw = zstandard.ZstdDecompressor().decompress(f.read_at(f.size() - foot - at, at), max_output_size=n * 17 + 8 * (n + 1))
    ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
    counts, offsets = np.frombuffer(raw, "<i8", n, 9 * n), np.frombuffer(raw, "<i8", n + 1, 17 * n)
    return Index(ids, null, counts, offsets, np.dtype(f"<u{item}"), dict_hash)


def _decompressor(fs: pyarrow.fs.FileSystem, folder: str, dict_hash: bytes) -> zstandard.ZstdDecompressor:
    if dict_hash == bytes(32):
        return zstandard.ZstdDecompressor()
    with fs.open_input_stream(f"{folder}/dictionary-{dict_hash.hex()}.zdict") as f:
        data = f.read()
    if hashlib.sha256(data).digest() != dict_hash:
        raise ValueError("the dictionary is not the one that the shard was written with")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))


def read_document(folder: str, name: str, row: int) -> np.ndarray:
    """The ids of the shard's document at ``row``: reads the index and that frame only."""
    fs, path = _fs(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        index = _read_index(f)
        frame = f.read_at(int(index.offsets[row + 1] - index.offsets[row]), int(index.offsets[row]))
    ids = _decompressor(fs, path, index.dict_hash).decompress(frame, max_output_size=int(index.counts[row]) * index.item.itemsize)
    return np.frombuffer(ids, index.item).astype("<u4")


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """The first key (no_id, id, tie) of each of ``parts`` ranges of nearly equal counts but the first; a row a range is collected."""
    order = [F.col("no_id").desc(), F.col("id"), F.col("tie")]
    ranges = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("part"))
    first = ranges.agg(F.min(F.struct((~F.col("no_id")).alias("has_id"), "id", "tie")).alias("first")).select("first.*").collect()
    return sorted((r.has_id, r.id or 0, r.tie) for r in first)[1:]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards, the dictionary and the manifest of ``docs`` to ``folder``.

    Null texts are empty; null ids come first; rows of one id are ordered by a hash of their text; repeated rows are each
    written.  Other columns are not read.  The ids' column must be a whole number.  A very long text is one frame, held in memory
    with its ids.  Texts are encoded and compressed where they are read, so only frames are shuffled.
    """
    fs, path = _fs(folder)
    fs.create_dir(path)
    data = train_dictionary(docs, tokenizer, id_col=id_col, text_col=text_col)
    dict_hash = hashlib.sha256(data).digest() if data else bytes(32)
    if data:
        with fs.open_output_stream(f"{path}/dictionary-{dict_hash.hex()}.zdict") as f:
            f.write(data)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), _text_bytes(text_col).alias("text")).withColumn("no_id", F.col("id").isNull())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(keyed.select("no_id", "id", "tie"), parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, item = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        press = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}))
        for batch in slices(batches):
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shards = [bisect_right(bounds, (i is not None, i or 0, t)) for i, t in zip(ids, ties, strict=True)]
            counts, frames = [], []
            for text in batch.column(2):
                raw = enc.encode(text.as_py()) + end
                counts.append(len(raw) // item), frames.append(press.compress(raw))
            columns = [pa.array(shards, pa.int32()), batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "id", "tie", "n", "frame"])
        enc.forget()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        shard, item = TaskContext.get().partitionId(), encoder(tokenizer).dtype.itemsize
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tokz"
        ids, null, counts, offsets, f = [], [], [], [struct.calcsize(HEAD)], None
        for batch in batches:
            if f is None and batch.num_rows:
                f = fs.open_output_stream(f"{path}/{name}")
                f.write(struct.pack(HEAD, MAGIC, item, dict_hash))
            own, frames = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ids += [i or 0 for i in own]
            null += [i is None for i in own]
            counts += batch.column(1).to_pylist()
            for frame in frames:
                offsets.append(offsets[-1] + len(frame))
            if f is not None:
                f.write(b"".join(frames))
        if f is None:
            return
        index = np.array(ids, "<i8").tobytes() + np.array(null, "u1").tobytes() + np.array(counts, "<i8").tobytes() + np.array(offsets, "<i8").tobytes()
        f.write(zstandard.ZstdCompressor().compress(index) + struct.pack(FOOT, offsets[-1], len(ids), MAGIC))
        f.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "docs": [len(ids)], "ids": [sum(counts)]}, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    framed = keyed.select("id", "tie", "text").mapInArrow(encode, "shard int, id long, tie long, n long, frame binary")
    ordered = framed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    ordered.select("id", "n", "frame").mapInArrow(write, "shard int, name string, docs long, ids long").write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, *, id_col: str = "doc_id") -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every document in the shards: start counts the ids of all documents before
    it, ids_crc32 is the CRC-32 of its ids as little-endian unsigned 32-bit integers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    manifest = manifest.select("name", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    index = _read_index(f)
                    open_ = _decompressor(fs, path, index.dict_hash)
                    starts = start + np.concatenate([[0], np.cumsum(index.counts)])
                    crcs = np.empty(len(index.counts), "i8")
                    for k, n in enumerate(index.counts):
                        frame = f.read_at(int(index.offsets[k + 1] - index.offsets[k]), int(index.offsets[k]))
                        ids = np.frombuffer(open_.decompress(frame, max_output_size=int(n) * index.item.itemsize), index.item)
                        crcs[k] = zlib.crc32(ids.astype("<u4").tobytes())
                columns = [pa.array(index.doc_ids, mask=index.null.astype(bool)), pa.array(starts[:-1]), pa.array(index.counts), pa.array(crcs)]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, kind: str = "tokens") -> str:
    """A folder of its own for one run's files, in the shared folder, as a qualified path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
