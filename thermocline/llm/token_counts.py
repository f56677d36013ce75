"""Token counts of whole texts under a public tokenizer: lengths only, encoded in batches balanced by bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 512
BATCH_BYTES = 1 << 20
REMEMBERED = 300_000  # pieces a worker remembers before it starts afresh

# One plain space between two characters that are not white space.  The tokenizer's own splitting always ends a piece
# there and gives the space to the next one, so texts cut at such places have the tokens of the whole text.
SAFE = re.compile(r"(?<=\S) (?=\S)")

_loaded: dict[str, tuple] = {}


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; each piece but the first begins with its space."""
    first, *rest = SAFE.split(text)
    return [first, *(" " + p for p in rest)]


def _tokenizer(name: str):
    """The named tokenizer and the lengths this worker remembers, loaded once per worker process."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # Its normaliser reads across spaces, so texts go whole.
            _loaded[name] = (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            split = (str(model.pre_tokenizer).startswith("ByteLevel") and "add_prefix_space=False" in str(model.pre_tokenizer)
                     and model.normalizer is None)
            _loaded[name] = (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)],
                             {} if split else None)
    return _loaded[name]


def _by_bytes(texts) -> Iterator[list[str]]:
    """Batches of about BATCH_BYTES; a longer text is a batch of its own."""
    batch, size = [], 0
    for text in texts:
        if batch and size + 4 * len(text) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += 4 * len(text)
    if batch:
        yield batch


def text_lengths(texts: list[str], name: str) -> list[int]:
    """Number of tokens of each text."""
    encode, known = _tokenizer(name)
    if known is None:
        return [n for batch in _by_bytes(texts) for n in encode(batch)]
    counts = []
    for text in texts:
        cut = pieces(text)
        new = [p for p in dict.fromkeys(cut) if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(dict.fromkeys(cut))
        for batch in _by_bytes(new):
            known.update(zip(batch, encode(batch)))
        counts.append(sum(map(known.__getitem__, cut)))
    return counts


def token_counts(docs: DataFrame, name: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``; null texts count as empty ones.

    No begin, end or added special tokens, no truncation; special strings inside a text are read as the library reads
    them by default.  One scan, no shuffle.  Only ids and texts reach Python, in Arrow batches.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(text_lengths(batch.column(2).to_pylist(), name), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    counted = read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the byte-level vocabulary of 50k entries."""
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
