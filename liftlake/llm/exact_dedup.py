"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

The first pass takes each text's length and the hash of its first bytes,
in expressions that touch nothing behind them. Only (length, prefix) groups
with two or more rows survive; the second pass lower-cases and hashes the whole
texts of the survivors alone. Texts never enter a shuffle: the second pass
recognises survivors with a bitmap of at most ``MAX_SIEVE_BITS`` bits. A false
hit merely costs one hash, so the answer does not depend on the bitmap's size.

Defined cases: a null text counts as empty, and empty texts equal each other;
null ids come after every id, so a null id stays only where the whole group has
none; repeated rows (one id and text) count as copies, exactly one row of a
group stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import small_batches, stored, to_signed

PREFIX_BYTES = 256
MAX_SIEVE_BITS = 1 << 28      # 32 MB
SIEVE_BITS_PER_KEY = 16
_BUCKET_BITS = 32768          # bits of one bitmap_construct_agg value

_FULL = "doc_id long, text_key long, length long, digest binary, survivor boolean"
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text, length (UTF-8 bytes) and prefix (hash of length and first bytes)."""
    text = F.coalesce("text", F.lit(""))
    # the first bytes lie within as many first characters
    head = F.substring(F.translate(F.substring(text, 1, PREFIX_BYTES), _UPPER, _LOWER).cast("binary"), 1, PREFIX_BYTES)
    length = F.octet_length(text).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), length.alias("length"),
                       F.xxhash64(length, head).alias("prefix"))


def _sieve(keys: DataFrame) -> np.ndarray:
    """Bitmap of the surviving prefix hashes; its size follows their number up to a bound."""
    count = max(keys.count(), 1)
    bits = min(MAX_SIEVE_BITS, max(1 << 16, 1 << (SIEVE_BITS_PER_KEY * count - 1).bit_length()))
    place = F.pmod(F.col("prefix"), F.lit(bits))
    parts = (keys.groupBy(F.floor(place / _BUCKET_BITS).cast("int").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.pmod(place, F.lit(_BUCKET_BITS))).alias("bitmap")))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():     # at most bits / 32768 rows of 4 KB
        start = row.bucket * (_BUCKET_BITS // 8)
        out[start:start + len(row.bitmap)] = np.frombuffer(row.bitmap, np.uint8)
    return out


def exact_dedup(docs: DataFrame, digest_all: bool = False, key_all: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``.

    Returns doc_id, text_key (64-bit key of the exact text), digest (SHA-256 of
    the text with A-Z lower-cased), keep_id, group_size and kept. Of equal
    texts the row with the largest doc_id stays. The digest is null for texts that
    refinement proved unique, unless ``digest_all``; so is the key without
    ``key_all``, and then these texts are not read whole."""
    spark = docs.sparkSession
    small_batches(spark)
    source = _narrow(docs)
    groups = source.groupBy("length", "prefix").count()
    sieve = spark.sparkContext.broadcast(_sieve(stored(groups.filter("count > 1").select("prefix"), "survivors")))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sieve.value
        for batch in batches:
            place = batch.column("prefix").to_numpy() % (len(bitmap) * 8)   # as pmod
            hit = (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            full, keyed = hit | digest_all, hit | digest_all | key_all
            read = np.flatnonzero(keyed)
            keys, digests = np.zeros(len(hit), np.int64), [None] * len(hit)
            texts = batch.column("text").cast(pa.binary()).take(pa.array(read, pa.int64()))
            for i, raw in zip(read.tolist(), texts.to_pylist()):
                keys[i] = to_signed([xxhash.xxh64_intdigest(raw, 42)])[0]
                if full[i]:
                    digests[i] = hashlib.sha256(raw.lower()).digest()     # bytes.lower() changes A-Z only
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_key": pa.array(keys, mask=~keyed), "length": batch.column("length"),
                "digest": pa.array(digests, pa.binary()), "survivor": pa.array(hit)})

    rows = stored(source.mapInArrow(second_pass, _FULL).withColumn("row", F.monotonically_increasing_id()), "hashed")
    survivors = rows.filter("survivor")
    classes = (survivors.groupBy("length", "digest")
               .agg(F.max(F.struct(F.col("doc_id"), F.col("row"))).alias("keep"), F.count("*").alias("group_size"))
               .filter("group_size > 1"))
    # Stored, so that the join exchanges both sides itself and a hot group's rows can be split.
    c = stored(classes.select(F.col("length").alias("_length"), F.col("digest").alias("_digest"), "keep", "group_size"), "classes")
    joined = rows.join(c, (rows["digest"] == c["_digest"]) & (rows["length"] == c["_length"]) & rows["survivor"], "left")
    return joined.select(
        "doc_id", "text_key", "digest",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"))
