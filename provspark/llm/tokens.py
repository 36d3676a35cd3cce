"""Operator 2: token counts through a digest cache.

Texts are normalised (null becomes empty), digested with SHA-256, and joined
with the digest of the tokenizer file to a table of stored counts. Digests
without a stored count are reduced to one document each, only those texts are
encoded, and their counts are appended to the cache table.

Within a worker, counts of chunks are kept too: where no piece of the
vocabulary has a word mark after another character, no merge can reach over
the blank before a word, so the tokens of a text are those of its
blank-separated chunks. This is read off the vocabulary when the model is
loaded; other models, and .json tokenizers, encode each text whole.

Edge cases: a null text is empty (0 bytes, 0 tokens); repeated texts and
repeated rows are encoded once and each gets its count; an empty table gives
an empty result; white space and special strings inside a text are ordinary
text; texts are never cut. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import in_parts, materialize, shared_dir

CACHE_SCHEMA = "digest binary, model binary, n_tokens long"
#: Chunks whose counts a worker keeps; the memory of the memo is bounded by this.
MEMO_CHUNKS = 400_000
MARK = "▁"
_loaded: dict[bytes, object] = {}


class ChunkCounts(dict):
    """Counts of blank-separated chunks, each as it stands after one blank."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        # an empty chunk is a final blank: one piece, which encode("") would not give
        n = len(self.model.encode(chunk, num_threads=1)) if chunk else 1
        if len(chunk) < 64:
            self[chunk] = n
        return n


class PieceCounter:
    """Token counts of a sentencepiece model, without begin or end."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        inner = any(MARK in p.lstrip(MARK) for p in pieces)
        # the split also needs that blanks are kept and that one is put in front
        plain = [len(self.model.encode(s)) for s in ("a", "a ", "a  ", " a")] == [1, 2, 2, 2]
        self.by_chunk = not inner and plain and self.model.encode("a", out_type=str) == [MARK + "a"]
        self.counts = ChunkCounts(self.model)

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> int:
        # a word mark in the text itself is the same character as a blank
        if not text:
            return 0
        if MARK in text:
            return len(self.model.encode(text, num_threads=1))
        of = self.counts.__getitem__
        chunks = text.split(" ")
        if "" in chunks:  # runs of blanks belong to the chunk that follows
            chunks = [c[1:] for c in re.findall(" +[^ ]*", " " + text)]
        return sum(map(of, chunks))


class JsonCounter:
    """Token counts of a tokenizers file, special strings taken as its default, none added."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(data.decode())
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(digest: bytes, pieces: bool, data: bytes):
    """The model of a worker, by the digest of its file; one is held."""
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = PieceCounter(data) if pieces else JsonCounter(data)
    return _loaded[digest]


def _encode(digest: bytes, pieces: bool, data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(digest, pieces, data.value)
        for b in batches:
            counts = model.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; the folder may not exist yet."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    cache: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_tokens, over_limit).

    model_path is a file on the driver, sent to executors as a broadcast. cache is a folder in shared storage that later calls
    use again; by default a new one in the session's shared folder.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    digest = hashlib.sha256(model).digest()
    cache = cache or f"{shared_dir(spark)}/token-cache/{uuid.uuid4().hex}"
    sent = spark.sparkContext.broadcast(model)

    text = F.coalesce(F.col(text_col), F.lit(""))
    full = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    # only digests and ids move here; the representative of a text is its smallest id
    keyed = materialize(full.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "tokens")
    stored = read_cache(spark, cache).where(F.col("model") == F.lit(digest)).select("digest", "n_tokens").dropDuplicates(["digest"])
    one = keyed.groupBy("digest").agg(F.min("doc_id").alias("__id"))
    misses = one.join(stored, "digest", "left_anti").withColumnRenamed("digest", "__digest")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    texts = full.join(misses.hint("shuffle_hash"), same, "left_semi").select("digest", "text")
    new = texts.mapInArrow(in_parts(_encode(digest, model_path.endswith(".model"), sent)), "digest binary, n_tokens long")
    new.select("digest", F.lit(digest).alias("model"), "n_tokens").write.mode("append").parquet(cache)
    # repeated rows with one id and text may be stored twice: one count is kept
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("model") == F.lit(digest)).select("digest", "n_tokens").dropDuplicates(["digest"])
    stored = materialize(stored, "tokens")  # as a table, so that a join with one hot digest can be split
    return keyed.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
