"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: a global distinct-word shuffle.  Texts are split into pre-tokens in the
JVM.  Documents are taken in chunks of bounded size where they are read: each
distinct pre-token of a chunk becomes one row (chunk, number, word), and each
document keeps its pre-tokens by position as these numbers.  The rows are
shuffled by word; there each distinct word of the corpus is encoded once, and its
ids go back to the chunks that hold it.  A chunk's documents meet the ids of its
words and are reassembled by position.

A word has at most one row per chunk, however often it occurs, and that row does
not carry its positions, so no word is hot and nothing is broadcast.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import written

TOKENIZERS_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The public pre-token pattern of this vocabulary. The class
#: flag gives \s, \p{L} and \p{N} their Unicode meaning in the JVM.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after which a chunk of documents is closed.
CHUNK_CHARS = 1 << 22


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bpe(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _bpe_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _bpe_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and a linked list: n log n for very long pre-tokens."""
    import heapq

    n = len(parts)
    left = list(range(-1, n - 1))
    right = [*range(1, n), -1]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    alive: list[bytes | None] = list(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if alive[i] != a or j < 0 or alive[j] != b:
            continue
        alive[i], alive[j] = a + b, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x in (left[i], i):
            if x >= 0 and right[x] >= 0 and (r := ranks.get(alive[x] + alive[right[x]])) is not None:
                heapq.heappush(heap, (r, x, alive[x], alive[right[x]]))
    return [ranks[p] for p in alive if p is not None]


def _chunks(chunk_chars: int):
    """mapInArrow step: (doc_key, words) to (chunk, no, word) of each chunk and (chunk, doc_key, codes) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            t = pa.Table.from_batches(held).combine_chunks()
            keys, lists = t["doc_key"].combine_chunks(), t["words"].combine_chunks()
            held, size, number = [], 0, number + 1
            coded = lists.flatten().dictionary_encode()
            words, docs = coded.dictionary, len(keys)
            n = len(words)
            same = lambda m: pa.array(np.full(m, number - 1))
            for at in range(0, n, 50_000):
                part = words.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([same(len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), part, pa.nulls(len(part), keys.type), pa.nulls(len(part), pa.list_(pa.int32()))], names=["chunk", "no", "word", "doc_key", "codes"])
            offsets = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), coded.indices)
            for at in range(0, docs, 5_000):
                part = keys.slice(at, 5_000)
                yield pa.RecordBatch.from_arrays([same(len(part)), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.string()), part, codes.slice(at, 5_000)], names=["chunk", "no", "word", "doc_key", "codes"])

        for batch in batches:
            at = 0
            sizes = np.cumsum(batch.column(2).to_numpy())
            done = 0
            while at < batch.num_rows:
                # as many rows as the chunk still takes, at least one
                upto = max(at + 1, int(np.searchsorted(sizes, done + chunk_chars - size, "right")))
                held.append(batch.slice(at, upto - at).select([0, 1]))
                size += int(sizes[upto - 1]) - done
                at, done = upto, int(sizes[upto - 1])
                if size >= chunk_chars or at < batch.num_rows:
                    yield from close()
        if held:
            yield from close()

    return run


def _encode_words(path: str):
    """mapInArrow step over (chunk, no, word) sorted by word: (chunk, no, wids), each distinct word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        last, last_ids = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if ranks is None:
                ranks = read_ranks(path)
            words = batch.column(2)
            new = np.r_[True, pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)]
            distinct = words.take(pa.array(np.flatnonzero(new))).to_pylist()
            ids = [bpe(w.encode("utf-8", "surrogatepass"), ranks) if w != last else last_ids for w in distinct]
            last, last_ids = distinct[-1], ids[-1]
            wids = pa.array(ids, pa.list_(pa.int32())).take(pa.array(np.cumsum(new) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wids], names=["chunk", "no", "wids"])

    return run


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, no, wids, doc_key, codes), of a chunk first its words by number, then its documents, to (doc_key, ids)."""
    words: list[pa.Array] = []
    chunk = None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = batch.column(0).to_numpy()
        is_word = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        # runs of rows of one chunk and kind
        starts = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (is_word[1:] != is_word[:-1])])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(a, b - a)
            if is_word[a]:
                if chunks[a] != chunk:
                    chunk, words = chunks[a], []
                words.append(part.column(2))
                continue
            if len(words) > 1:
                words = [pa.concat_arrays(words)]
            codes = part.column(4)
            ids = words[0].take(codes.flatten())
            ends = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]
            rows = np.r_[0, np.cumsum(codes.value_lengths().to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([part.column(3), pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), ids.flatten())], names=["doc_key", "ids"])


def pretokens(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, no, word) of each distinct pre-token of a chunk, and (chunk, doc_key, codes) of each document that is not empty."""
    words = F.regexp_extract_all(F.col("doc_text"), F.lit(PATTERN), F.lit(0))
    kind = dict(docs.dtypes)["doc_key"]
    rows = docs.where(F.length("doc_text") > 0).select("doc_key", words.alias("words"), F.octet_length("doc_text").cast("long").alias("size"))
    return rows.mapInArrow(_chunks(chunk_chars), f"chunk long, no int, word string, doc_key {kind}, codes array<int>")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS_DIR, vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(key, ids): the ids of each text without special tokens; [] for an empty or null text.

    One row per row of ``docs``, also for repeated and null keys.  Special tokens'
    strings in a text are ordinary text.  Other columns are not read.  The
    vocabulary file must lie at the same path on every executor.
    """
    path = f"{tokenizers.rstrip('/')}/{vocabulary}"
    docs = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("doc_text"))
    kind = dict(docs.dtypes)["doc_key"]
    pre = written(pretokens(docs, chunk_chars), "pretokens")
    rows = pre.where("no is not null").select("chunk", "no", "word").repartition("word").sortWithinPartitions("word")
    coded = rows.mapInArrow(_encode_words(path), "chunk long, no int, wids array<int>")
    none = F.lit(None)
    both = coded.select("chunk", "no", "wids", none.cast(kind).alias("doc_key"), none.cast("array<int>").alias("codes")).unionByName(pre.where("no is null").select("chunk", "no", none.cast("array<int>").alias("wids"), "doc_key", "codes"))
    got = both.repartition("chunk").sortWithinPartitions("chunk", F.col("no").asc_nulls_last()).mapInArrow(_reassemble, f"doc_key {kind}, ids array<int>")
    blank = docs.where("doc_text is null or length(doc_text) = 0").select(F.col("doc_key").alias(key), F.array().cast("array<int>").alias("ids"))
    return got.select(F.col("doc_key").alias(key), "ids").unionByName(blank)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizers: str = TOKENIZERS_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): joins each position's id with the token-byte table and reassembles the text.

    The table has as many rows as the vocabulary has tokens (some 50,000), which
    bounds its broadcast.  An empty list decodes to ''.
    """
    spark = encoded.sparkSession
    ranks = read_ranks(f"{tokenizers.rstrip('/')}/{vocabulary}")
    table = spark.createDataFrame(pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))
    spread = encoded.select(F.col(key).alias("k"), F.posexplode_outer(ids).alias("pos", "id"))
    joined = spread.join(F.broadcast(table), "id", "left")
    # hex keeps the aggregation on strings; bytes of a character may be split over tokens
    parts = joined.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("h"))))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8")
    return parts.select(F.col("k").alias(key), F.coalesce(text, F.lit("")).alias("text"))
