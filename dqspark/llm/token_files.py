"""Token ids as flat binary files with 64-bit document offsets.

A folder of shards and a manifest.  A shard is three files: ``<name>.ids``,
little-endian unsigned integers one after the other (16 bits where the
vocabulary fits, else 32); ``<name>.offsets``, n + 1 little-endian unsigned
64-bit places within it, so document i of the shard is
``ids[offsets[i]:offsets[i + 1]]``; ``<name>.docs``, an Arrow file with the
documents' ids.  The manifest (Parquet) names the shards in order with the
number of documents and ids before each: prefix sums over the shards, so no
task writes more than its own shard and a place in the whole is a base plus
an offset.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.common import REMEMBERED, tidy, written
from dqspark.llm.tokens import TextTokenizer, _byte_characters

#: Most chunks, and most words, each of at most ``CHUNK_CHARS`` characters, whose ids one Python worker remembers
#: (about 200 bytes each).
CHUNK_CACHE, CHUNK_CHARS = 1_000_000, 40

# A run of ASCII white space with what follows it.  A byte-level pre-token
# holds white space only at its start, or nothing else, so the place between
# other characters and white space always parts two pre-tokens.
_CHUNK = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_OTHER_SPACE = re.compile(r"[^\S \n\r\t]")
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])")


_LETTER, _DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\t\n\r -~\xa0-\xff]*")
#: The byte-level word pattern on those characters.
_WORDS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")


class _Remembered(dict):
    """Text -> ids by ``encode``; short texts are remembered, up to a limit."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, text):
        ids = self.encode(text)
        if len(text) <= CHUNK_CHARS:
            if len(self) >= CHUNK_CACHE:
                self.clear()
            self[text] = ids
        return ids


class FileEncoder:
    """Ids of whole texts as the bytes of ``dtype``, equal to those of the
    library for the whole text.  For a byte-level tokenizer without
    normaliser a text of common characters is encoded word by word, another
    one chunk by chunk, each once per distinct word or chunk."""

    def __init__(self, path: str):
        self._whole = TextTokenizer(path)
        size, chunked, self._marks = 1 << 32, False, []
        if path.endswith(".json"):
            from tokenizers import Tokenizer
            lib = Tokenizer.from_file(path)
            size, chunked = lib.get_vocab_size(with_added_tokens=True), _byte_level(path)
            self._model = lib.model
            self._marks = [t.content for t in lib.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._chunks = _Remembered(self._chunk) if chunked else None
        self._words = _Remembered(self._word)
        self._letters = _byte_characters()

    def _plain(self, text: str) -> bytes:
        return np.frombuffer(self._whole.ids(text), "<u4").astype(self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token, its UTF-8 bytes as byte-level characters, by the library's model."""
        found = self._model.tokenize(word.encode().decode("latin-1").translate(self._letters))
        return np.array([t.id for t in found], self.dtype).tobytes()

    def _common(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not any(m in text for m in self._marks)

    def _chunk(self, chunk: str) -> bytes:
        if self._common(chunk):
            return b"".join(map(self._words.__getitem__, _WORDS.findall(chunk)))
        return self._plain(chunk)

    def ids(self, text: str) -> bytes:
        if self._chunks is None:
            return self._plain(text)
        if self._common(text):
            return self._chunk(text)
        chunks = _SAFE_CUT.split(text) if _OTHER_SPACE.search(text) else _CHUNK.findall(text)
        return b"".join(map(self._chunks.__getitem__, filter(None, chunks)))


def _byte_level(path: str) -> bool:
    """Whether the file's only pre-tokenizer is the byte-level one with its
    word pattern, without normaliser, and no added token takes in white space."""
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return bool(pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and not spec.get("normalizer")
                and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                            for t in spec.get("added_tokens", [])))


@functools.lru_cache(2)
def encoder(path: str) -> FileEncoder:
    """One encoder, and its chunk cache, per Python worker."""
    return FileEncoder(path)


REMEMBERED["token files"] = encoder.cache_clear


def _store(path: str):
    """The file system of a folder (local, HDFS, S3, ...) and the path within it."""
    from pyarrow import fs
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _shard_writer(path: str, tokenizer_path: str, end_id: int):
    """Writes the rows of a partition (id, text; in order) as one shard under
    a name of this attempt's own, and returns its row of the manifest.  An
    attempt that dies leaves files that no manifest names."""

    def run(batches):
        files, enc = None, None
        n_docs = at = 0
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                enc = encoder(tokenizer_path)
                end = np.array([end_id], enc.dtype).tobytes()
                store, folder = _store(path)
                store.create_dir(f"{folder}/shards", recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                files = [store.open_output_stream(f"{folder}/shards/{name}.{kind}") for kind in ("ids", "offsets", "docs")]
                names = pa.schema([(b.schema.field(0).name, b.schema.field(0).type)])
                docs = pa.ipc.new_file(files[2], names)
                files[1].write(np.zeros(1, "<u8").tobytes())
            offsets = np.empty(b.num_rows, "<u8")
            for i, text in enumerate(b.column(1)):
                data = enc.ids(text.as_py())
                files[0].write(data)
                files[0].write(end)
                at += len(data) // enc.dtype.itemsize + 1
                offsets[i] = at
            files[1].write(offsets.tobytes())
            docs.write_batch(pa.RecordBatch.from_arrays([b.column(0)], schema=names))
            n_docs += b.num_rows
        if files is not None:
            docs.close()
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "id_bytes": pa.array([enc.dtype.itemsize], pa.int32()),
                "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([at], pa.int64())})

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write all documents of ``docs``, in ascending ``id_col`` order, each as
    its ids followed by ``end_id``, to the folder ``path``; returns the
    manifest.  ``path`` must be in a store that all executors reach.

    One shuffle deals the documents by ranges of their id, and each range is
    encoded and written by one task.  Rows with equal ids are ordered by a
    hash of their text, and the ranges may part them, so an id that holds a
    third of all rows is still written by many tasks.  Only one row per
    shard is left for the prefix sums.

    Null ids come first; a null or empty text is the end id alone; repeated
    rows are written each; an empty table gives a manifest without rows;
    other columns, whatever their names, are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"),
                       F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), "hash", "place"]
    shards = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
                     .mapInArrow(tidy(_shard_writer(path, tokenizer_path, end_id), "token files"),
                                 "shard int, name string, id_bytes int, n_docs bigint, n_ids bigint"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = shards.withColumns({
        "first_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
        "first_id": F.coalesce(F.sum("n_ids").over(before), F.lit(0))})
    manifest.write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


MANIFEST = "shard int, name string, id_bytes int, n_docs bigint, n_ids bigint, first_doc bigint, first_id bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


class Shard:
    """The files of one shard: memory-mapped where the store is a mounted
    folder, else read by ranges."""

    def __init__(self, path: str, name: str, id_bytes: int, n_docs: int, n_ids: int):
        from pyarrow import fs
        self._store, folder = _store(path)
        self._at = f"{folder}/shards/{name}"
        self._map = isinstance(self._store, fs.LocalFileSystem)
        self.ids = self._values("ids", f"<u{id_bytes}", n_ids)
        self.offsets = self._values("offsets", "<u8", n_docs + 1)

    def _values(self, kind, dtype, n):
        """``slice -> array`` over a file of n numbers."""
        if self._map:
            mapped = np.memmap(f"{self._at}.{kind}", dtype, "r", shape=(n,))
            return lambda a, b: mapped[a:b]
        f, size = self._store.open_input_file(f"{self._at}.{kind}"), np.dtype(dtype).itemsize
        return lambda a, b: np.frombuffer(f.read_at((b - a) * size, a * size), dtype)

    def doc_ids(self):
        """Batches of the documents' ids."""
        source = pa.memory_map(f"{self._at}.docs") if self._map else self._store.open_input_file(f"{self._at}.docs")
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i).column(0)


def _shard_reader(path: str, with_ids: bool):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(path, row["name"], row["id_bytes"], row["n_docs"], row["n_ids"])
                doc = 0
                for ids in shard.doc_ids():
                    bounds = shard.offsets(doc, doc + len(ids) + 1).astype(np.int64)
                    crc, bodies = [], []
                    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        body = shard.ids(a, z).astype("<u4").tobytes()
                        crc.append(zlib.crc32(body))
                        if with_ids:
                            bodies.append(body)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(ids)) + row["first_doc"] + doc), ids, pa.array(bounds[:-1] + row["first_id"]),
                         pa.array(np.diff(bounds)), pa.array(crc, pa.int64())] + ([pa.array(bodies, pa.binary())] if with_ids else []),
                        ["ordinal", "id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                    doc += len(ids)
    return run


def read_token_files(spark: SparkSession, path: str, id_type: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the folder, read from its files: ``ordinal``
    (place in the whole), ``id_col``, ``start`` (ids of all documents
    before), ``n_tokens`` (with the end id), ``ids_crc32`` (of the ids as
    unsigned 32-bit integers) and, with ``with_ids``, ``ids`` themselves as
    such.  Each shard is read by a task of its own."""
    manifest = read_manifest(spark, path)
    schema = f"ordinal bigint, id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return (manifest.repartition(max(1, manifest.count())).mapInArrow(_shard_reader(path, with_ids), schema)
            .withColumnRenamed("id", id_col))


class TokenFiles:
    """Random access for a reader outside of Spark (a training process): any
    document, or any run of ids of the whole, by the memory-mapped files."""

    def __init__(self, path: str):
        import pyarrow.parquet as pq
        store, folder = _store(path)
        rows = pq.read_table(f"{folder}/manifest", filesystem=store).sort_by("shard").to_pylist()
        self._shards = [(r, Shard(path, r["name"], r["id_bytes"], r["n_docs"], r["n_ids"])) for r in rows]
        self._docs = np.array([r["first_doc"] for r in rows], np.int64)
        self._ids = np.array([r["first_id"] for r in rows], np.int64)
        self.n_docs = rows[-1]["first_doc"] + rows[-1]["n_docs"] if rows else 0
        self.n_ids = rows[-1]["first_id"] + rows[-1]["n_ids"] if rows else 0

    def document(self, ordinal: int) -> np.ndarray:
        if not 0 <= ordinal < self.n_docs:
            raise IndexError(ordinal)
        row, shard = self._shards[int(np.searchsorted(self._docs, ordinal, "right")) - 1]
        a, z = shard.offsets(ordinal - row["first_doc"], ordinal - row["first_doc"] + 2).tolist()
        return shard.ids(a, z)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``[first, last)`` of the whole, across documents and shards."""
        parts = []
        for i in range(max(0, int(np.searchsorted(self._ids, first, "right")) - 1), len(self._shards)):
            row, shard = self._shards[i]
            a, z = max(first - row["first_id"], 0), min(last - row["first_id"], row["n_ids"])
            if a >= z:
                break
            parts.append(shard.ids(a, z))
        return np.concatenate(parts) if parts else np.zeros(0, "<u2")
