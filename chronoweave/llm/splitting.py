"""Oversized texts cut into overlapping pieces at their strongest natural boundaries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
BLOCK = 64
#: Boundaries and their strengths; a cut lies at the end of the match. A run of marks is read once, from its start.
BOUNDARIES = ((re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"), 6), (re.compile(r"\r\n?|\n"), 5), (re.compile(r"(?<![.!?])[.!?]++[\"')\]]*+(?=\s)|[。！？]+[”’」』）]*"), 4), (re.compile(r"[,;:](?=\s)|[，；：、]"), 2), (re.compile(r"[ \t　]+"), 1))


class RangeMaximum:
    """Range-maximum over keys: a sparse table over block maxima, and scans inside the two end blocks.

    With blocks of 64 the table takes (n / 64) log(n / 64) entries, so that a text of many million characters fits.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        n = -(-len(keys) // BLOCK)
        padded = np.full(n * BLOCK, -1, np.int64)
        padded[: len(keys)] = keys
        level = padded.reshape(n, BLOCK).max(1) if n else padded
        self.levels = [level]
        span = 1
        while 2 * span <= n:
            level = np.maximum(level[:-span], level[span:])
            self.levels.append(level)
            span *= 2

    def best(self, lo: int, hi: int) -> int:
        """The largest key in [lo, hi)."""
        lo, hi = int(lo), int(hi)
        a, b = -(-lo // BLOCK), hi // BLOCK
        if a >= b:
            return int(self.keys[lo:hi].max())
        found = [int(self.keys[x:y].max()) for x, y in ((lo, a * BLOCK), (b * BLOCK, hi)) if x < y]
        k = (b - a).bit_length() - 1
        found += [int(self.levels[k][a]), int(self.levels[k][b - (1 << k)])]
        return max(found)


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character (index len(text) is the end): 0 where there is no boundary."""
    out = np.zeros(len(text) + 1, np.int8)
    for pattern, strength in reversed(BOUNDARIES):
        ends = [m.end() for m in pattern.finditer(text)]
        out[ends] = np.maximum(out[ends], strength)
    return out


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at the end) of the pieces of ``text``.

    A piece ends in the second half of what is permissible after its start, at the strongest boundary there, of equal
    ones the last; where there is no boundary it has the full length. The next piece starts ``overlap`` characters
    before that. A text of at most ``limit`` characters is one piece; an empty text is one empty piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    strengths = boundary_strengths(text)
    index = RangeMaximum(strengths.astype(np.int64) * (n + 1) + np.arange(n + 1))
    pieces, start = [], 0
    while n - start > limit:
        best = index.best(start + limit // 2, start + limit + 1)
        strength, end = divmod(best, n + 1)
        if strength == 0:
            end = start + limit
        pieces.append((start, end, int(strength)))
        start = end - overlap
    return [*pieces, (start, n, 0)]


def text_of(raw: str | None, path: tuple[str, ...]) -> str | None:
    """The string at ``path`` of a JSON object; null for invalid JSON and for anything that is no string there.

    A lone surrogate, which no UTF-8 text can hold, becomes U+FFFD, so that the length stays the same.
    """
    try:
        value = json.loads(raw)
        for name in path:
            value = value[name]
    except (ValueError, TypeError, KeyError, IndexError, RecursionError):
        return None
    if not isinstance(value, str):
        return None
    try:
        value.encode()
    except UnicodeEncodeError:
        value = re.sub("[\ud800-\udfff]", "�", value)
    return value


SCHEMA = "item_table string, item_id string, n_chars long, piece_no int, start long, end long, cut_strength int, text string"


def pieces(items: DataFrame, path: tuple[str, ...], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points in ``items`` (item_table, item_id, raw JSON).

    Texts within the limit, null or invalid JSON and texts that are no strings give no rows. A JSON string can't be
    shorter than the text it holds, so short ones are left out before Python sees them.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for table, item, raw in zip(batch["item_table"], batch["item_id"], batch["raw"], strict=True):
                text = text_of(raw, path)
                if text is None or len(text) <= limit:
                    continue
                out += [(table, item, len(text), i, a, b, s, text[a:b]) for i, (a, b, s) in enumerate(cut_points(text, limit, overlap))]
            yield pd.DataFrame(out, columns=["item_table", "item_id", "n_chars", "piece_no", "start", "end", "cut_strength", "text"])

    return items.filter(F.length("raw") > limit).select("item_table", "item_id", "raw").mapInPandas(cut, SCHEMA)


def oversized_pieces(event_log: DataFrame, envelopes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the long texts of the event log (each event once, of its first delivery) and of the raw envelopes
    (a file once, its smallest text if it is there with several). Rows without an id have no pieces."""
    long = event_log.filter((F.length("content") > limit) & F.col("event_id").isNotNull())
    once = long.groupBy("event_id").agg(F.min(F.struct("recorded_at", "wal_offset", "content")).alias("e"))
    events = once.select(F.lit("event_log").alias("item_table"), F.col("event_id").alias("item_id"), F.col("e.content").alias("raw"))
    named = envelopes.filter((F.length("raw") > limit) & F.col("file_name").isNotNull()).groupBy("file_name").agg(F.min("raw").alias("raw"))
    files = named.select(F.lit("incident_envelopes").alias("item_table"), F.col("file_name").alias("item_id"), "raw")
    return pieces(events, ("text",), limit, overlap).unionByName(pieces(files, ("content", "text"), limit, overlap))
