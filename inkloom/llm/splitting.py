"""Cutting oversized texts at natural boundaries.

Agglomerative merging: the text is cut into atomic segments, adjacent pairs
wait in a heap, and the pair across the weakest boundary is merged first while
the merged piece and its overlap fit the limit.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import word_count

#: Word spans, counted as by the JVM: \w there holds marks and joiners too.
_WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}][\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}'’-]*+")
#: Boundaries by strength: a cut is wanted most at the strongest.
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(6)
_CUTS = regex.compile(
    r"(?P<paragraph>\n[^\S\n]*\n\s*)|(?P<line>\n)|(?P<sentence>[.!?…。！？]+[\"'”’」』)\]]*\s+|[。！？]+[」』”’]*)|(?P<clause>[,;:—，；：、]\s*)"
)
_HEADING = regex.compile(r"\s*(?:(?:chapter|part|book)\s+\S{1,20}|prologue|epilogue|[A-Z][A-Z '’-]{0,40}|\d{1,3})\s*(?:\n|$)", regex.I)

PIECES = "key long, piece_no int, n_pieces int, total_words int, start_char int, end_char int, overlap_chars int, words int, text string"


def _atoms(text: str, starts: list[int], limit: int) -> list[tuple[int, int]]:
    """Atomic segments as (end, strength of the boundary at the end); none holds more words than ``limit``."""
    out, at = [], 0
    for cut in _CUTS.finditer(text):
        end = cut.end()
        if end <= at or end >= len(text):
            continue
        kind = cut.lastgroup
        if kind == "paragraph":
            strength = HEADING if _HEADING.match(text, end) else PARAGRAPH
        else:
            strength = {"line": LINE, "sentence": SENTENCE, "clause": CLAUSE}[kind]
        if bisect_left(starts, end) == bisect_left(starts, at):
            if out and strength > out[-1][1]:
                out[-1] = (end, strength)  # no word in between: the stronger boundary holds
                at = end
            continue
        out.append((end, strength))
        at = end
    out.append((len(text), HEADING))
    whole, at = [], 0
    for end, strength in out:
        first, last = bisect_left(starts, at), bisect_left(starts, end)
        for k in range(first + limit, last, limit):
            whole.append((starts[k], WORD))
        whole.append((end, strength))
        at = end
    return whole


def cut_text(text: str, target: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start of the overlap, start, end) in characters.

    ``[start, end)`` of all pieces together are the text; the overlap before
    ``start`` repeats the end of the piece before.  No piece, overlap included,
    has more words than ``limit``.
    """
    words = list(_WORD.finditer(text))
    starts = [w.start() for w in words]
    limit = max(1, limit)
    if len(starts) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    room = limit - overlap
    atoms = _atoms(text, starts, max(1, min(room, target)))
    bounds = [0, *(e for e, _ in atoms)]
    size = [bisect_left(starts, b) - bisect_left(starts, a) for a, b in zip(bounds, bounds[1:])]
    strength = [s for _, s in atoms]
    n = len(atoms)
    after, before, alive, version = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n

    def merge(cap: int, small: int) -> None:
        """Merges weakest boundaries first up to ``cap`` words; with ``small``, only where one side is below it."""
        heap = [(strength[i], size[i] + size[after[i]], i, version[i]) for i in range(n) if alive[i] and after[i] < n]
        heapq.heapify(heap)
        while heap:
            _, both, i, seen = heapq.heappop(heap)
            if not alive[i] or seen != version[i] or after[i] >= n:
                continue
            j = after[i]
            if both != size[i] + size[j] or both > cap or (small and min(size[i], size[j]) >= small):
                continue
            size[i], strength[i], after[i], alive[j] = both, strength[j], after[j], False
            version[i] += 1
            bounds[i + 1] = bounds[j + 1]
            if after[i] < n:
                before[after[i]] = i
                heapq.heappush(heap, (strength[i], size[i] + size[after[i]], i, version[i]))
            if before[i] >= 0 and alive[before[i]]:
                k = before[i]
                version[k] += 1
                heapq.heappush(heap, (strength[k], size[k] + size[i], k, version[k]))

    wanted = max(1, min(room, target - overlap if target > 2 * overlap else target))
    merge(wanted, 0)
    merge(room, max(1, (wanted + 1) // 2))
    ends = [bounds[i + 1] for i in range(n) if alive[i]]
    out, start = [], 0
    marks = [e for e, _ in atoms]
    for end in ends:
        back = start
        if start and overlap:
            first = bisect_left(starts, start)
            least = starts[max(0, first - overlap)]
            natural = bisect_left(marks, least)
            back = least
            if natural < len(marks) and marks[natural] < start and bisect_left(starts, marks[natural]) <= first - (overlap + 1) // 2:
                back = marks[natural]
        out.append((back, start, end))
        start = end
    return out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, total, target, limit, overlap in batch.itertuples(index=False, name=None):
            cuts = cut_text(text, int(target), int(limit), int(overlap))
            for no, (back, start, end) in enumerate(cuts, 1):
                piece = text[back:end]
                rows.append((key, no, len(cuts), total, start, end, start - back, len(_WORD.findall(piece)), piece))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def split_oversized(df: DataFrame, key: str, text: str, limits: DataFrame, by: str, target: str, limit: str, overlap: str) -> DataFrame:
    """Every text as pieces within the word limit of its group.

    ``limits`` has one row per group ``by`` with the columns ``target``,
    ``limit`` and ``overlap``.  Columns of the result: ``key``, ``piece_no`` from
    1, ``n_pieces``, ``total_words``, ``start_char`` and ``end_char`` (the
    piece's own part, in characters from 0), ``overlap_chars`` (repeated before
    it), ``words`` and ``text``.

    Texts within the limit, or of a group without one, stay whole; they never
    leave the JVM.  A null text gives one piece with null text and 0 words, an
    empty one an empty piece.  A limit below 1 counts as 1; an overlap above half
    the limit counts as half of it.  A word is never cut.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(by).alias("by"))
    rows = rows.withColumn("total_words", F.coalesce(word_count(F.col("text")), F.lit(0)))
    sizes = limits.select(F.col(by).alias("by"), F.col(target).cast("int").alias("target"), F.col(limit).cast("int").alias("limit"), F.col(overlap).cast("int").alias("overlap"))
    rows = rows.join(sizes, "by", "left")
    over = F.col("limit").isNotNull() & (F.col("total_words") > F.greatest("limit", F.lit(1)))
    length = F.coalesce(F.length("text"), F.lit(0))
    whole = rows.filter(~over).select(
        "key", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), "total_words", F.lit(0).alias("start_char"), length.alias("end_char"), F.lit(0).alias("overlap_chars"), F.col("total_words").alias("words"), "text"
    )
    cut = rows.filter(over).select("key", "text", "total_words", F.coalesce("target", "limit").alias("target"), "limit", F.coalesce("overlap", F.lit(0)).alias("overlap")).mapInPandas(_pieces, PIECES)
    return whole.unionByName(cut).withColumnRenamed("key", key)


def oversized(df: DataFrame, key: str, text: str, limits: DataFrame, by: str, target: str, limit: str, overlap: str) -> DataFrame:
    """Keys of the texts that ``split_oversized`` had to cut, once each."""
    pieces = split_oversized(df, key, text, limits, by, target, limit, overlap)
    return pieces.filter((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select(key)
