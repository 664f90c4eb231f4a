"""Encoding of a corpus with a public byte-level BPE vocabulary.

Words are cut by the JVM's regular expressions.  Python gets whole Arrow
batches, keeps each distinct word once, and encodes those by a contiguous rank
array; the ids of the batch are then gathered by numpy.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for the JVM, with Unicode white space and without backtracking where none is needed.
JVM_PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Bytes up to which a word is merged by scanning its array; longer ones by a heap.
SHORT_WORD = 256
#: Distinct words a worker remembers between batches.
REMEMBERED = 400_000
_LAST = 1 << 60


def default_vocabulary() -> str:
    """Path of ``byte_bpe_50k.tiktoken`` in the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with one base-64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a contiguous rank array.

    ``cut`` holds the boundaries of the parts, ``rank`` that of each part joined
    with the next. The least rank is looked for again and again, the boundary
    between its two parts goes, and the ranks on either side are found anew.
    Equal ranks are joined from the left.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n > SHORT_WORD:
        return _encode_long(word, ranks)
    get = ranks.get
    cut = list(range(n + 1))
    rank = [get(word[i : i + 2], _LAST) for i in range(n - 1)]
    while rank:
        least = min(rank)
        if least == _LAST:
            break
        at = rank.index(least)
        del cut[at + 1], rank[at]
        if at:
            rank[at - 1] = get(word[cut[at - 1] : cut[at + 1]], _LAST)
        if at < len(rank):
            rank[at] = get(word[cut[at] : cut[at + 2]], _LAST)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word, with linked parts and a heap."""
    n = len(word)
    end, after, before, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    get = ranks.get
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] - i != length:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]] - i))
        h = before[i]
        if h >= 0 and (r := get(word[h : end[i]])) is not None:
            heapq.heappush(heap, (r, h, end[i] - h))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class _Vocabulary:
    """Ranks with the words met so far, in one worker."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.known: dict[str, list[int]] = {}

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, ranks, out = self.known, self.ranks, []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = known[word] = encode_word(word.encode(), ranks)
            out.append(ids)
        counts = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for ids in out for i in ids), np.int32, int(counts.sum()))
        return flat, counts


_LOADED: dict[str, _Vocabulary] = {}


def _vocabulary(name: str, load: Callable[[], dict[bytes, int]]) -> _Vocabulary:
    """One per worker process; workers are kept between tasks."""
    if name not in _LOADED:
        _LOADED[name] = _Vocabulary(load())
    return _LOADED[name]


def _gather(words: pa.ListArray, vocabulary: _Vocabulary, count_only: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Offsets of the rows, and the ids of all rows, for a list column of words without nulls."""
    flat = words.flatten()
    offsets = np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))))
    coded = flat.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    ids, counts = vocabulary.ids(coded.dictionary.to_pylist())
    each = counts[index] if len(index) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(each)))
    rows = ends[offsets]
    if count_only:
        return rows, None
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    begin = firsts[index] if len(index) else np.zeros(0, np.int64)
    where = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], each)
    return rows, ids[where]


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, count_only: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Every row's token ids by a byte-level BPE vocabulary, without special tokens.

    Columns: ``key``, the columns ``carry``, and ``ids`` (array of int), or with
    ``count_only`` ``tokens`` (long).  A null and an empty text have an empty
    list; a blank text the ids of its blanks; text that spells a special token is
    ordinary text.  Rows that repeat a key come out each.

    ``vocabulary`` is a file of ranks on the driver (0.8 MB, of fixed size); it
    is sent to the workers as a broadcast.
    """
    spark: SparkSession = df.sparkSession
    path = vocabulary or default_vocabulary()
    sent = spark.sparkContext.broadcast(Path(path).read_bytes())
    carry = carry or []

    def load() -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in sent.value.splitlines() if line)}

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(path, load)
        for batch in stream:
            *kept, words = batch.columns
            rows, ids = _gather(words, known, count_only)
            if count_only:
                last = pa.array(np.diff(rows), pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, last], names=[*batch.schema.names[:-1], "tokens" if count_only else "ids"])

    rows = df.select(key, *carry, _words(F.col(text)).alias("_words"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(batches, kept + (", tokens long" if count_only else ", ids array<int>"))


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(JVM_PATTERN), F.lit(0)), F.array().cast("array<string>"))
