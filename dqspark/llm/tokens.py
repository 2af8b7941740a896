"""Token counts with a digest cache, and the tokenizer helper shared with packing.

Counts are those of the tokenizer library for the whole text, without begin,
end or added special tokens; special strings inside a text are handled as the
library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.llm.common import REMEMBERED, tidy, written

#: Most chunks, and most words, whose ids one Python worker remembers (about 200 bytes each).
WORD_CACHE = 1 << 18

_SPACE = " \t\n\r"
_ID = np.dtype("<u4")


class _Words(dict):
    """White-space-free chunk, or part of one, -> its token ids (little-endian uint32 bytes)."""

    def __init__(self, encode, limit):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk):
        ids = self.encode(chunk)
        if len(chunk) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


class TextTokenizer:
    """Token ids of whole texts by the library that the file belongs to
    (``.json``: tokenizers, ``.model``: sentencepiece).

    For a tokenizer whose rules drop white space between words
    (``drops_space``), a text's ids are those of its white-space-separated
    chunks in order, so the library is asked once per distinct chunk."""

    def __init__(self, path: str, cache: int = WORD_CACHE):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._plain = lambda text: np.array(sp.encode(text), _ID).tobytes()
            self.drops_space = False
            return
        from tokenizers import Tokenizer
        self._lib = Tokenizer.from_file(path)
        self._lib.no_truncation()
        self._lib.no_padding()
        self._plain = lambda text: np.array(self._lib.encode(text, add_special_tokens=False).ids, _ID).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_space = drops_space(spec)
        if self.drops_space:
            self._marked = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)").search
            self._parts = _Words(self._model_ids, cache)
            self._words = _Words(self._chunk, cache)

    # one run of letters is one pre-token and a run of other marks another;
    # both reach the library's BPE model lower-cased, their UTF-8 bytes as
    # byte-level characters (Latin-1 letters are in composed form already)
    _SHAPE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:%*&$#|<>()\-]*)")

    def _model_ids(self, word):
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_byte_characters())
        return np.array([t.id for t in self._lib.model.tokenize(word)], _ID).tobytes()

    def _chunk(self, chunk):
        m = self._SHAPE.fullmatch(chunk)
        if m and not self._marked(chunk):
            return self._parts[m[1].lower()] + (self._parts[m[2]] if m[2] else b"")
        return self._plain(chunk)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit token ids."""
        if not self.drops_space:
            return self._plain(text)
        if len(text) < 1 << 22:
            return b"".join(map(self._words.__getitem__, _split(text)))
        out, at = [], 0  # a very long text in slices that end at white space
        while at < len(text):
            end = min(len(text), at + (1 << 21))
            while end < len(text) and text[end] not in _SPACE:
                end += 1
            out.append(b"".join(map(self._words.__getitem__, _split(text[at:end]))))
            at = end
        return b"".join(out)


@functools.cache
def _byte_characters() -> dict[int, str]:
    """Byte-level characters: printable bytes stand for themselves, the others
    in order for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


def _split(text: str) -> list[str]:
    """Chunks between ASCII blanks, tabs and line ends (other white space
    stays inside a chunk and is left to the library)."""
    return [c for c in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c]


def drops_space(spec: dict) -> bool:
    """Whether a tokenizers file turns white space into bare word bounds: its
    normalizer folds white space, and its pre-tokenizer removes what its word
    pattern does not match, which includes white space; no added token takes
    in neighbouring white space."""
    def parts(x, inner):
        return [] if not x else x.get(inner, [x])
    folds = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " "
                for n in parts(spec.get("normalizer"), "normalizers"))
    first = (parts(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    removes = (first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
               and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", ""))
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", []))
    suffix = spec.get("model", {}).get("type") == "BPE" and spec["model"].get("end_of_word_suffix") is not None
    return bool(folds and removes and plain and suffix)


@functools.lru_cache(4)
def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer, and its word cache, per Python worker."""
    return TextTokenizer(path)


REMEMBERED["tokens"] = tokenizer.cache_clear


def tokenizer_digest(path: str) -> str:
    """Names the tokenizer version: digest of its file and library version."""
    import tokenizers
    with open(path, "rb") as f:
        body = f.read()
    lib = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(lib).__version__ if lib == "sentencepiece" else tokenizers.__version__
    return hashlib.sha256(body + f"|{lib} {version}".encode()).hexdigest()


CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def read_cache(spark, path: str) -> DataFrame:
    """The stored counts; an absent folder is an empty cache."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def content_digest(text, fold_space: bool):
    """SHA-256 of the normalised content.  Normalising must not change the
    count, so white space is folded only for tokenizers that drop it."""
    body = F.coalesce(text, F.lit(""))
    if fold_space:
        body = F.trim(F.regexp_replace(body, "[ \\t\\n\\r]+", " "))
    return F.unhex(F.sha2(body, 256))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every row of ``docs``.

    Every row's content digest is joined to the counts stored in
    ``cache_path`` for this tokenizer version.  Of each digest that is not
    stored, one row is encoded, and the new counts are appended to the cache;
    then all rows take their count from it.  Copies of one text, however
    many, are one digest: they are pre-aggregated before the shuffle and
    never meet in one task.

    Null text counts as empty (0 bytes, 0 tokens); null or repeated ids and
    repeated rows each get their own row; an empty table gives an empty
    result; other columns, whatever their names, are not read.  A run that
    dies while appending leaves no partial rows (the append commits as a
    whole); digests that two runs append at once have equal counts, and one
    is used."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    fold = tokenizer(tokenizer_path).drops_space
    stored = (lambda: read_cache(spark, cache_path).filter(F.col("tokenizer") == version))
    keyed = written(docs.select(F.col(id_col).alias("_id"), content_digest(F.col(text_col), fold).alias("digest"),
                                F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")), "token-digests")
    misses = (keyed.groupBy("digest").agg(F.min("_id").alias("_id"))
              .join(stored().select("digest"), "digest", "left_anti").withColumnRenamed("digest", "_digest"))
    texts = docs.select(F.col(id_col).alias("_tid"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                        content_digest(F.col(text_col), fold).alias("digest"))
    todo = (texts.join(misses, texts["_tid"].eqNullSafe(misses["_id"]) & (texts["digest"] == misses["_digest"]), "left_semi")
            .select("digest", "_text"))

    def encode(batches):
        tok = tokenizer(tokenizer_path)
        seen = set()  # a fully repeated row is encoded once per task
        for b in batches:
            d, n = [], []
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(digest)
                    d.append(digest)
                    n.append(len(tok.ids(text)) // 4)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    (todo.mapInArrow(tidy(encode, "tokens"), "digest binary, n_tokens bigint")
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))
    counts = stored().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest", "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")
