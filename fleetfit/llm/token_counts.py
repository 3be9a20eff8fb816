"""Token counts through a digest cache.

The cache is a stored table (content digest, tokenizer version, n_tokens). Documents are joined with it by digest; only
distinct contents that it lacks are encoded, and their counts are appended. A content is the text with white space runs
as one space and none at the ends where the tokenizer drops white space, and the unchanged text otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetfit import session
from fleetfit.llm.common import stored, text_of
from fleetfit.llm.wordpieces import definition_at, drops_white_space, encoder

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


class Counter:
    """How many tokens texts have; ``version`` names the tokenizer in the cache."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".json"):
            self.definition = definition_at(path)
            self.by_word = drops_white_space(self.definition)
            data = self.definition.encode()
        else:
            with open(path, "rb") as file:
                self.definition = data = file.read()
            self.by_word = False
        self.version = hashlib.sha256(data).hexdigest()

    def content(self, text: Column) -> Column:
        # \s here is ASCII white space only, at which the tokenizer may be cut.
        return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "") if self.by_word else text


def counting(counter: Counter):
    """A function for the tasks: texts to numbers of tokens."""
    if counter.by_word:
        encode = encoder(counter.definition).encode
        return lambda texts: [sum(encode(w)[0] for w in t.encode().split()) for t in texts]
    if counter.path.endswith(".json"):
        tokenizer = encoder(counter.definition).tokenizer
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=counter.definition)
    return lambda texts: [len(i) for i in model.encode(texts, num_threads=1)]


def new_cache(spark) -> str:
    """An empty cache in the shared folder."""
    path = session.scratch_path(spark, "llm-token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return path


def token_counts(
    docs: DataFrame, path: str, cache: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``; ``cache`` is extended.

    ``path`` is a tokenizers file (.json) or a sentencepiece model (.model). A null text counts as empty; repeated rows
    stay repeated; extra columns are ignored. Appending the same content twice (a rerun after a failure) is harmless:
    equal rows of the cache count once.
    """
    spark = docs.sparkSession
    counter = Counter(path)
    content = counter.content(text_of(text_col))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), digest.alias("digest")
        ),
        "digests",
    )
    version = F.col("version") == counter.version
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(version).select("digest", "n_tokens")
    # One document stands for each content that the cache lacks.
    misses = rows.groupBy("digest").agg(F.min("id").alias("lead")).join(cached, "digest", "left_anti")
    texts = docs.select(F.col(id_col).alias("id"), content.alias("content"), digest.alias("_digest"))
    lead = texts.join(misses, (texts["id"].eqNullSafe(misses["lead"])) & (texts["_digest"] == misses["digest"]), "left_semi")
    known = spark.sparkContext.broadcast(counter)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counting(known.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n = count(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    new = lead.select("_digest", "content").mapInArrow(counted, "digest binary, n_tokens long").dropDuplicates(["digest"])
    new.select("digest", F.lit(counter.version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return rows.join(stored(counts, "token-counts"), "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
