"""Packing tokenised documents into fixed-length sequences.

Documents are tokenised in Arrow batches, ended by a separator id and cut into
pieces of at most ``length`` ids. Pieces are dealt by hash into randomised
groups of about ``GROUP_TOKENS`` ids, and every group packs its pieces on its
own: first-fit decreasing over a tournament tree of bin capacities. Groups are
bounded, so their number and not their size grows with the corpus.

Defined cases: a null text counts as empty and gives the separator alone; a text
that holds an added token of the vocabulary gets that token's id, as the file says;
null ids and repeated rows are packed like any other, each dealt on its own; an empty table gives an empty
result; a text of any length is cut whole; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.binpack import first_fit_decreasing
from liftlake.llm.common import small_batches, stored

GROUP_TOKENS = 8_000_000
BIN_SPAN = 1 << 32          # sequence ids: group * BIN_SPAN + bin

# The split pattern of byte-level BPE files whose pre-tokenizer is
# "ByteLevel" with its own regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pick long")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """(encode, check): a fast encoder over the vocabulary of the file, and the file's own in ``tokenizers``.

    For byte-level BPE files the ids are a vocabulary's merge ranks, which
    ``tiktoken`` applies about five times faster; ``check`` is then used on a
    text of every batch. Other files are encoded by ``tokenizers`` itself."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def check(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec["model"].get("type", "BPE") != "BPE":
        return check, None
    import tiktoken

    special = {t["content"] for t in spec.get("added_tokens", [])}
    marks = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)", re.IGNORECASE)
    letters = _byte_alphabet()
    ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        """The file's own handling wherever a text may hold one of its added tokens."""
        return check(text) if marks.search(text) else fast.encode_ordinary(text)

    return encode, check


def _pieces(path: str, separator: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, check = tokenizer(path)
        for batch in batches:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "pick", *(["ids"] if with_ids else []))
            out = {n: [] for n in names}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            shortest = min(range(len(texts)), key=lambda i: (len(texts[i]) == 0, len(texts[i])), default=None)
            for i, (doc_id, text, pick) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, batch.column("pick").to_pylist())):
                ids = encode(text)
                if i == shortest and check and check(text) != ids:
                    raise ValueError("the fast encoder and the tokenizer file disagree")
                ids = np.array([*ids, separator], "<u4")
                for start in range(0, len(ids), length):
                    part = ids[start:start + length]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    out["doc_tokens"].append(len(ids))
                    out["pick"].append((pick + start * 0x9E3779B97F4A7C15) % (1 << 63))
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
            types = {n: pa.int64() for n in names} | {"ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, types[n]) for n, v in out.items()})
    return run


def _pack(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "pick", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        sizes = group["length"].to_numpy()
        bins = first_fit_decreasing(sizes, length)
        by_bin = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[by_bin])
        first = np.r_[True, bins[by_bin][1:] != bins[by_bin][:-1]]
        begin = ends - sizes[by_bin]
        offset = np.empty(len(group), np.int64)
        offset[by_bin] = begin - np.maximum.accumulate(np.where(first, begin, 0))
        group["sequence_id"] = group["group"].to_numpy() * BIN_SPAN + bins
        group["offset"] = offset
        return group.drop(columns=["group", "pick"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, separator: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs(doc_id, text, ...)``.

    doc_id, start (ids of its document before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens (with the
    separator), sequence_id, offset (in the sequence, gapless from 0) and, if
    asked, the ids. Sequences are padded to ``length``."""
    small_batches(docs.sparkSession)
    extra = ", ids array<int>" if with_ids else ""
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 63) - 1)).alias("pick"))
    pieces = stored(source.mapInArrow(_pieces(tokenizer_path, separator, length, with_ids), _PIECES + extra), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // GROUP_TOKENS))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("pick"), F.lit(groups)))
    schema = _PIECES.replace(", pick long", "") + extra + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(_pack(length), schema)
