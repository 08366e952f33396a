"""Secret scan: candidate strings judged by a random forest that removes false positives.

Candidates are provider keys, values assigned to a credential name, private key
headers and other long unbroken strings. Every candidate gets the same features:
its length and character classes, how usual its character transitions are in the
corpus, how much of it dictionary words cover, its path, and the words around
it. A random forest trained on labelled findings then says which candidates are
secrets.

Values and names are taken whole, whatever their length; a name may be quoted and
hold digits and hyphens, and a run of characters is searched from its start once.

Transition counts and the dictionary are gathered from every document; the
forest is trained on at most ``SAMPLE_ROWS`` labelled findings, chosen by keyed
hash. Labels come from reviewed findings where there are some; ``format_labels``
gives them by format alone where there are none.

Defined cases: a null text has no candidates; a null path is an empty one; null
ids and repeated rows are scanned like any other; a text of any length is
scanned whole; labels of one kind give no forest and every candidate keeps a
null score and verdict; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import small_batches, stored, text_bytes

SAMPLE_ROWS = 20_000
DICTIONARY_WORDS = 20_000     # the most frequent ones; bounds what every task loads
WORD_SPAN = (3, 12)           # letters of a dictionary word
TREES, DEPTH = 40, 6
PATH_BUCKETS = 16

CANDIDATE = re.compile(
    rb"(?P<provider>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36}\b|\bxox[abprs]-[0-9A-Za-z-]{10,72}|\bAIza[0-9A-Za-z_-]{35})"
    rb"|(?P<pem>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)"
    rb"|(?<![0-9A-Za-z+/_=-])(?P<name>[0-9A-Za-z+/_=-]*?(?:password|passwd|secret|token|(?:api|access|private)[_-]?key)(?:[_-]?key)?[0-9]*)"
    rb"[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<assigned>[^\s\"',;]{6,})"
    rb"|(?P<long>(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_=-]{16,}+)", re.IGNORECASE)
_KINDS = ("provider", "pem", "assigned", "long")
_WORD = re.compile(rb"[^\W\d_]+")
_RANDOM = re.compile(rb"[0-9a-f]{12,}|[0-9A-Z]{16,}|[0-9A-Za-z+/_=-]{20,}")
_NEAR = 60                    # bytes read for the words around a candidate
CREDENTIAL_WORDS = frozenset(b"password passwd secret token key apikey credential auth login bearer private".split())
HARMLESS_WORDS = frozenset(b"example sample dummy test placeholder fake changeme commit checksum sha md5 hash digest".split())

FEATURES = ("length", "digit_share", "upper_share", "lower_share", "symbol_share", "class_changes", "entropy", "transitions",
            "coverage", "path_depth", "path_bucket", "path_test", "assigned_before", "quoted", "credential_near", "harmless_near")

# Classes of the transition table: a-z, any digit, any other byte of a candidate.
_CLASS = np.full(256, 27, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = np.arange(26)
_CLASS[ord("A"):ord("Z") + 1] = np.arange(26)
_CLASS[ord("0"):ord("9") + 1] = 26
_SPACE = 28
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_SIDE = 29


def transition_counts(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring character classes inside the words of all documents (29 x 29)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIDE * _SIDE, np.int64)
        for batch in batches:
            for text in text_bytes(batch):
                c = _CLASS[np.frombuffer(text or b"", np.uint8)].astype(np.int16)
                total += np.bincount(c[:-1] * _SIDE + c[1:], minlength=_SIDE * _SIDE) if len(c) > 1 else 0
        yield pa.RecordBatch.from_pydict({"pair": np.arange(_SIDE * _SIDE), "n": total})

    out = np.zeros(_SIDE * _SIDE)
    for row in docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[row.pair] = row.n
    return out.reshape(_SIDE, _SIDE)


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent words of all documents: letters only, lower case."""
    low, high = WORD_SPAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for text in text_bytes(batch):
                seen.update((text or b"").lower().split())
            words = [(w, n) for w, n in seen.items() if low <= len(w) <= high and w.isalpha()]
            yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w, _ in words], pa.string()),
                                              "n": pa.array([n for _, n in words], pa.int64())})

    counts = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()]


def _coverage(value: bytes, words: frozenset[bytes]) -> float:
    """Share of the characters that dictionary words cover, longest word first."""
    low, high = WORD_SPAN
    at, covered = 0, 0
    while at < len(value):
        for n in range(min(high, len(value) - at), low - 1, -1):
            if value[at:at + n] in words:
                covered, at = covered + n, at + n
                break
        else:
            at += 1
    return covered / len(value)


def _transitions(value: bytes, bits: np.ndarray) -> float:
    """Mean surprise, in bits, of the steps from character to character."""
    c = _CLASS[np.frombuffer(value, np.uint8)]
    return float(bits[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


def _features(value: bytes, before: bytes, after: bytes, path: str, bits: np.ndarray, words: frozenset[bytes]) -> list[float]:
    n = len(value)
    a = np.frombuffer(value, np.uint8)
    digit = (a >= 48) & (a <= 57)
    upper = (a >= 65) & (a <= 90)
    lower = (a >= 97) & (a <= 122)
    kind = digit + 2 * upper + 3 * lower
    counts = np.bincount(a)
    p = counts[counts > 0] / n
    near = [w.lower() for w in _WORD.findall(before)[-3:] + _WORD.findall(after)[:2]]
    parts = [x for x in re.split(r"[/\\]", path.lower()) if x]
    return [float(n), digit.mean(), upper.mean(), lower.mean(), (kind == 0).mean(), float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
            float(-(p * np.log2(p)).sum()), _transitions(value, bits), _coverage(value.lower(), words),
            float(len(parts)), float(xxhash.xxh32_intdigest(parts[0].encode() if parts else b"") % PATH_BUCKETS),
            float(any(re.search("test|example|doc|sample", x) for x in parts)),
            float(bool(re.search(rb"[=:]\s*[\"']?$", before))), float(before[-1:] in (b'"', b"'")),
            float(any(w in CREDENTIAL_WORDS for w in near)), float(any(w in HARMLESS_WORDS for w in near))]


_SCHEMA = ("doc_id long, start long, length long, kind string, value_sha256 string, preview string, looks_random boolean, "
           "features array<double>")


def findings(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """Candidates of ``docs(doc_id, text, ...)``: one row each, with its place in bytes, its kind and its features.

    The value itself is not returned: a digest, and a preview of its ends."""
    small_batches(docs.sparkSession)
    counts = transition_counts(docs) + 1.0
    bits = -np.log2(counts / counts.sum(axis=1, keepdims=True))
    words = frozenset(w.encode() for w in dictionary(docs))
    shared = docs.sparkSession.sparkContext.broadcast((bits, words))       # 29 x 29 numbers, DICTIONARY_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_, words_ = shared.value
        for batch in batches:
            out = {n: [] for n in ("doc_id", "start", "length", "kind", "value_sha256", "preview", "looks_random", "features")}
            for doc_id, text, where in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), batch.column("path").to_pylist()):
                for m in CANDIDATE.finditer(text or b""):
                    kind = next(k for k in _KINDS if m[k] is not None)
                    start, end = m.span(kind)
                    value = text[start:end]
                    shown = value.decode("utf-8", "replace")
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(end - start)
                    out["kind"].append(kind)
                    out["value_sha256"].append(hashlib.sha256(value).hexdigest())
                    out["preview"].append(shown[:2] + "..." + shown[-2:])
                    out["looks_random"].append(bool(_RANDOM.fullmatch(value)) and bool(re.search(rb"\d", value)))
                    out["features"].append(_features(value, text[max(0, start - _NEAR):start], text[end:end + _NEAR], where or "", bits_, words_))
            types = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "looks_random": pa.bool_(), "features": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, types.get(n, pa.string())) for n, v in out.items()})

    where = F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))
    return docs.select("doc_id", "text", where.alias("path")).mapInArrow(run, _SCHEMA)


def format_labels(found: DataFrame) -> DataFrame:
    """``found`` with label: 1.0 for provider keys, key headers and assigned values of a random format, else 0.0."""
    strong = F.col("kind").isin("provider", "pem") | ((F.col("kind") == "assigned") & F.col("looks_random"))
    return found.withColumn("label", strong.cast("double"))


def _vector(found: DataFrame) -> DataFrame:
    columns = found.select("*", *[F.col("features")[i].alias(f"_{n}") for i, n in enumerate(FEATURES)])
    return VectorAssembler(inputCols=[f"_{n}" for n in FEATURES], outputCol="_vector").transform(columns).drop(*[f"_{n}" for n in FEATURES])


def train(labelled: DataFrame, seed: int = 1):
    """The forest, fitted on at most SAMPLE_ROWS rows of ``labelled(features, label, value_sha256)``; None for one label."""
    sample = stored(labelled.filter("label IS NOT NULL").select("features", "label", "value_sha256")
                    .orderBy(F.xxhash64(F.lit(seed), "value_sha256"), "value_sha256", "features").limit(SAMPLE_ROWS), "labelled-findings")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed,
                                    predictionCol="_prediction", probabilityCol="_probability", rawPredictionCol="_raw")
    return forest.fit(_vector(sample))


def scan(found: DataFrame, forest) -> DataFrame:
    """``found`` with score (the forest's probability) and is_secret, without the features."""
    if forest is None:
        return found.withColumns({"score": F.lit(None).cast("double"), "is_secret": F.lit(None).cast("boolean")}).drop("features", "looks_random")
    scored = forest.transform(_vector(found))
    score = vector_to_array("_probability")[1]
    return scored.withColumns({"score": score, "is_secret": score >= 0.5}).drop(
        "_vector", "_raw", "_probability", "_prediction", "features", "looks_random", "label")
