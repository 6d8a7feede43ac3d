"""Search: text of blobs, chunks, embeddings, and the best matches."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casframe.functions import lexical, pdf
from casframe.functions.hashing import fnv1a
from casframe.functions.text import SNIPPET, STOPWORDS, tokens

CHUNK, OVERLAP, LOOK_BACK = 1200, 200, 200
DIM = 512
LEXICAL = "builtin-lexical-v1"
REMOTE = "ollama:"
REMOTE_URL, REMOTE_SECONDS = "http://localhost:11434", 30
_SPACES = frozenset(pdf.SPACE)


def extracted(blobs: DataFrame) -> DataFrame:
    """(blob_id, text) of (blob_id, data); text is null where there is none to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(pdf.extract, b.column(1).to_pylist()), pa.string())], names=["blob_id", "text"])

    return blobs.select("blob_id", "data").mapInArrow(run, "blob_id string, text string")


def bounds(text: str) -> list[tuple[int, int]]:
    """Start and end of the pieces: about CHUNK characters, ended after white space where there is some
    near, the next one starting OVERLAP before, after white space again."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + CHUNK, n)
        if end < n:
            floor = max(start, end - LOOK_BACK)
            end = next((i for i in range(end, floor, -1) if text[i - 1] in _SPACES), end)
        out.append((start, end))
        if end >= n:
            break
        back = end - OVERLAP
        start = end if back <= start else next((i + 1 for i in range(back, min(back + LOOK_BACK, end)) if text[i] in _SPACES), back)
    return out


def pieces(text: str | None) -> list[str]:
    """The pieces, trimmed; blank ones are left out and take no number."""
    return [p for a, b in bounds(text or "") if (p := text[a:b].strip(pdf.SPACE))]


def chunks(texts: DataFrame) -> DataFrame:
    """(blob_id, seq, text, snippet) of (blob_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = pieces(text)
                if got:
                    previews = [p.replace("\n", " ").replace("\r", " ")[:SNIPPET] for p in got]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(got), pa.string()), pa.array(range(len(got)), pa.int32()), pa.array(got), pa.array(previews)], names=["blob_id", "seq", "text", "snippet"])

    return texts.select("blob_id", "text").mapInArrow(run, "blob_id string, seq int, text string, snippet string")


def bucket(token: Column | str) -> Column:
    return F.pmod(fnv1a(token), F.lit(DIM)).cast("int")


def sign(token: Column) -> Column:
    return F.when(fnv1a(F.concat(F.lit("sign:"), token)) % 2 == 0, 1.0).otherwise(-1.0)


def term_frequencies(chunks_: DataFrame, keys: tuple[str, ...] = ("blob_id", "seq")) -> DataFrame:
    """(keys, token, tf), without stopwords."""
    rows = chunks_.select(*keys, F.explode(tokens("text")).alias("token")).where(~F.col("token").isin(*STOPWORDS))
    return rows.groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def sparse_vectors(tf: DataFrame, keys: tuple[str, ...] = ("blob_id", "seq")) -> DataFrame:
    """(keys, bucket, weight): hashed, weighted 1 + ln tf with a sign, and scaled to length 1.

    Hashes are taken once for each distinct token.
    """
    words = tf.select("token").distinct().select("token", bucket("token").alias("bucket"), sign(F.col("token")).alias("sign"))
    terms = tf.join(words, "token").withColumn("w", ((F.log("tf") + 1).cast("float") * F.col("sign")).cast("double"))
    sums = terms.groupBy(*keys, "bucket").agg(F.sum("w").alias("w"))
    norms = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, list(keys)).where("norm > 0").select(*keys, "bucket", (F.col("w") / F.col("norm")).alias("weight"))


def text_terms(texts: DataFrame, key: str) -> DataFrame:
    """term_frequencies() of whole texts (key, text) whose keys are all different: nothing is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _few(b):
                found = [lexical.term_counts(t) for t in part.column(1).to_pylist()]
                yield _beside(part, np.repeat(np.arange(len(found)), [len(x) for x in found]), token=pa.array([t for x in found for t in x], pa.string()), tf=pa.array([n for x in found for n in x.values()], pa.int64()))

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, token string, tf long")


def text_vectors(texts: DataFrame, key: str) -> DataFrame:
    """sparse_vectors() of whole texts (key, text) whose keys are all different: nothing is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _few(b):
                row, bucket_, weight = lexical.weights(part.column(1).to_pylist())
                yield _beside(part, row, bucket=pa.array(bucket_, pa.int32()), weight=pa.array(weight, pa.float64()))

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, bucket int, weight double")


def query_weights(text: str) -> dict[int, float]:
    _, buckets, found = lexical.weights([text])
    return dict(zip(buckets.tolist(), found.tolist(), strict=True))


def text_scores(texts: DataFrame, key: str, query: dict[int, float]) -> DataFrame:
    """(key, score) of whole texts whose keys are all different: the product with the query's weights, of texts that share a bucket with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array([query.get(i, np.nan) for i in range(DIM)])
        for b in batches:
            for part in _few(b):
                row, bucket_, weight = lexical.weights(part.column(1).to_pylist())
                shared = ~np.isnan(of[bucket_])
                sums = np.bincount(row[shared], weight[shared] * of[bucket_[shared]], part.num_rows)
                rows = np.unique(row[shared])
                yield _beside(part, rows, score=pa.array(sums[rows].astype(np.float32)))

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, score float")


def _few(b: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, where each row becomes many."""
    return (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def _beside(b: pa.RecordBatch, rows: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """The keys of some rows of a batch beside other columns."""
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *columns.values()], names=[b.schema.names[0], *columns])


class Embedder(Protocol):
    """What turns texts into vectors of length 1, under a name that an index records."""

    def name(self) -> str: ...

    def dim(self) -> int: ...

    def embed(self, texts: list[str]) -> list[np.ndarray]: ...


class LexicalEmbedder:
    """Hashed bag of words: matches shared words, not meaning."""

    def name(self) -> str:
        return LEXICAL

    def dim(self) -> int:
        return DIM

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        return [v for i in range(0, len(texts), 256) for v in lexical.embed_each(texts[i : i + 256])]


class RemoteEmbedder:
    """Vectors from a local embedding server; the first answer fixes the dimension."""

    def __init__(self, model: str, url: str = REMOTE_URL) -> None:
        self.model, self.url, self._dim = model, url, 0

    def name(self) -> str:
        return REMOTE + self.model

    def dim(self) -> int:
        return self._dim

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            body = json.dumps({"model": self.model, "prompt": text}).encode()
            request = urllib.request.Request(f"{self.url}/api/embeddings", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=REMOTE_SECONDS) as answer:
                    found = json.load(answer).get("embedding")
            except urllib.error.HTTPError as e:
                raise RuntimeError(f"embedding server returned status {e.code}") from None
            except (OSError, ValueError) as e:
                raise RuntimeError(f"embedding server failed at {self.url}: {e}") from None
            if not found or (self._dim and len(found) != self._dim):
                raise RuntimeError("embedding server returned a vector of another dimension")
            self._dim = len(found)
            v = np.array(found, np.float32)
            norm = np.sqrt((v.astype(float) ** 2).sum())
            out.append(v / np.float32(norm) if norm else v)
        return out


def embedder(name: str) -> Embedder:
    if name == LEXICAL:
        return LexicalEmbedder()
    if name.startswith(REMOTE) and len(name) > len(REMOTE):
        return RemoteEmbedder(name[len(REMOTE) :])
    raise ValueError(f"unknown embedder: {name}")


def vectors(chunks_: DataFrame, model: Embedder | None = None) -> DataFrame:
    """(blob_id, seq, snippet, vec) with dense float vectors."""
    model = model or LexicalEmbedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _few(b):
                made = model.embed(part.column(2).to_pylist())
                ends = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*made, np.zeros(0, np.float32)]), pa.float32()))], names=["blob_id", "seq", "snippet", "vec"])

    return chunks_.select("blob_id", "seq", "text", "snippet").mapInArrow(run, "blob_id string, seq int, snippet string, vec array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Over the shared prefix, in doubles, as a float; 0 where either vector is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms > 0, dot(x, y) / norms).otherwise(0.0).cast("float")


def best_chunks(scored: DataFrame) -> DataFrame:
    """The best chunk of each blob (blob_id, seq, snippet, score), the first of equal ones."""
    return scored.groupBy("blob_id").agg(F.max_by(F.struct("snippet", "seq"), F.struct("score", (-F.col("seq")).alias("s"))).alias("best"), F.max("score").alias("score")).select("blob_id", "best.snippet", "best.seq", "score")


def top_k(best: DataFrame, k: int) -> DataFrame:
    """The k best, equal scores by blob id."""
    return best.orderBy(F.desc("score"), "blob_id").limit(max(k, 0))


def search(index: DataFrame, query: np.ndarray, k: int) -> DataFrame:
    """The k best blobs of a vector index for one query vector, which is a literal in the plan."""
    literal = F.array(*(F.lit(float(x)).cast("float") for x in query))
    return top_k(best_chunks(index.withColumn("score", cosine(F.col("vec"), literal))), k)


def sparse_search(index: DataFrame, text: str, k: int) -> DataFrame:
    """The same over sparse vectors (blob_id, seq, bucket, weight): an equi-join with the query's few buckets."""
    spark = index.sparkSession
    one = spark.createDataFrame([(0, text)], "q int, text string")
    query = sparse_vectors(term_frequencies(one, ("q",)), ("q",)).select("bucket", F.col("weight").alias("qw"))
    scored = index.join(F.broadcast(query), "bucket").groupBy("blob_id", "seq").agg(F.sum(F.col("weight") * F.col("qw")).cast("float").alias("score"))
    return top_k(best_chunks(scored.withColumn("snippet", F.lit(None).cast("string"))), k)


def located(matches: DataFrame, locations: DataFrame, messages: DataFrame) -> DataFrame:
    """Matches with commit, path and message; those that no commit reaches fall away, after the limit."""
    return matches.join(locations, "blob_id").join(messages.select(F.col("id").alias("commit_id"), "message"), "commit_id")
