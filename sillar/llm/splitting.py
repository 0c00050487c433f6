"""Splitting oversized texts at natural boundaries.

A text longer than the limit is cut into pieces under the limit that end where a
section, a paragraph, a sentence or at least a word ends, each piece after the
first repeating up to ``overlap`` characters of the one before.

The offsets of all words are found at once from the code points; running sums of
line breaks tell which gaps between words end a line; the sorted arrays of word,
sentence, paragraph and heading ends are then searched by bisection for the last
boundary under the limit, and for the first word start inside the overlap. Only a
run without white space longer than the limit is cut hard.

One narrow pass over the oversized rows; the rest is filtered out in the JVM and
never reaches Python. Each row is worked on alone, so a page with a tenth or a third
of the rows is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150

#: Unicode white space, as str.isspace has it.
_SPACE = np.array(sorted(c for c in range(0x3001) if chr(c).isspace()), dtype=np.uint32)
_LINE_ENDS = np.array([0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。！？؟।"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "»”’\"')]}"], dtype=np.uint32)

WORD, SENTENCE, PARAGRAPH, HEADING = 0, 1, 2, 3
NAMES = ("word", "sentence", "paragraph", "heading")
#: Least part of the limit that a piece must fill to end at this kind of boundary.
FILL = {HEADING: 0.25, PARAGRAPH: 0.5, SENTENCE: 0.5, WORD: 0.0}


class Boundaries:
    """Sorted offsets of words and of the ends of words, sentences, paragraphs and sections."""

    def __init__(self, text: str):
        self.points = points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        space = np.zeros(len(points) + 2, dtype=bool)
        space[0] = space[-1] = True
        space[1:-1] = np.isin(points, _SPACE)
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        n = len(self.ends)
        breaks = np.concatenate([[0], np.cumsum(np.isin(points, _LINE_ENDS))])
        after = np.append(self.starts[1:], len(points))
        new_line = breaks[after] > breaks[self.ends]
        last = points[self.ends - 1]
        inner = np.where(np.isin(last, _CLOSERS) & (self.ends - self.starts > 1), points[np.maximum(self.ends - 2, 0)], last)
        following = np.append(points[self.starts[1:]], 0) if n else np.zeros(0, dtype=np.uint32)
        lower = np.array([chr(c).islower() for c in following.tolist()], dtype=bool) if n else np.zeros(0, dtype=bool)
        stop = np.isin(inner, _STOPS) & ~lower & (self.ends - self.starts > 2)
        rank = np.where(new_line, PARAGRAPH, np.where(stop, SENTENCE, WORD))
        # headings: lines whose first and last word are runs of two to six "="
        self.heads: list[tuple[int, str]] = []
        line_first = np.flatnonzero(np.concatenate([[True], new_line[:-1]])) if n else []
        line_last = np.flatnonzero(np.concatenate([new_line[:-1], [True]])) if n else []
        marks = points[self.starts] == ord("=") if n else []
        for i, j in zip(line_first, line_last):
            if marks[i]:
                line = text[self.starts[i] : self.ends[j]]
                name = line.strip("=").strip()
                width = len(line) - len(line.lstrip("="))
                if name and 2 <= width <= 6 and line.endswith("=" * width):
                    self.heads.append((int(self.starts[i]), name))
                    rank[i : j + 1] = WORD  # never leave a heading behind at a piece's end
                    if i:
                        rank[i - 1] = HEADING
        self.by_rank = {k: self.ends[rank >= k] for k in (WORD, SENTENCE, PARAGRAPH, HEADING)}
        self.sentence_starts = self.starts[1:][rank[:-1] >= SENTENCE] if n else self.starts


def cuts(bounds: Boundaries, size: int, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """``(start, own, end, how)`` of each piece: it runs from ``start`` to ``end``, of which
    what lies before ``own`` repeats the piece before. ``how`` names the boundary it ends
    at, ``end`` for the last and ``hard`` for a forced cut."""
    words, starts = bounds.by_rank[WORD], bounds.starts
    stop = int(words[-1]) if len(words) else 0
    own = int(starts[0]) if len(starts) else 0
    start, out = own, []
    while own < stop:
        nearest = int(words[np.searchsorted(words, own, side="right")])
        if nearest - start > limit >= nearest - own:
            # less overlap, so that the next word fits whole
            at = np.searchsorted(starts, nearest - limit)
            start = min(int(starts[at]), own) if at < len(starts) else own
        if stop - start <= limit:
            out.append((start, own, stop, "end"))
            break
        end, how = 0, "hard"
        for kind in (HEADING, PARAGRAPH, SENTENCE, WORD):
            places = bounds.by_rank[kind]
            at = np.searchsorted(places, start + limit, side="right") - 1
            if at >= 0 and places[at] > own and places[at] - start >= FILL[kind] * limit:
                end, how = int(places[at]), NAMES[kind]
                break
        if not end:
            if start + limit <= own:
                start = own  # a wide gap has used up the overlap
            end = start + limit
        out.append((start, own, end, how))
        at = np.searchsorted(starts, end)
        following = int(starts[at]) if at < len(starts) else stop
        own = end if how == "hard" and (at == 0 or words[at - 1] > end) else following
        start = own
        if overlap > 0:
            back = max(end - overlap, out[-1][0] + 1)
            for places in (bounds.sentence_starts, starts):
                at = np.searchsorted(places, back)
                if at < len(places) and places[at] < end:
                    start = int(places[at])
                    break
            else:
                start = min(back, end) if how == "hard" else own
    return out


def tidy_section(section: Column, default: str = "Introducción") -> Column:
    """A section's name in one spelling: no heading marks, no "(cont.)", no padding, first
    letter upper case if the name is in one case; blank or null is the introduction."""
    name = F.regexp_replace(F.coalesce(section, F.lit("")), r"(?U)^[\s=#]+|[\s=#:]+$", "")
    name = F.regexp_replace(name, r"(?iU)\s*\((?:cont|continuación|continuacion|sigue)\.?\)$", "")
    name = F.regexp_replace(name, r"(?U)\s+", " ")
    one_case = (name == F.lower(name)) | (name == F.upper(name))
    name = F.when(one_case, F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2))))).otherwise(name)
    return F.when(name == "", default).otherwise(name)


def _split(limit: int, overlap: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            sections = b.column("section").to_pylist() if texts else [None] * b.num_rows
            for row, (text, section) in enumerate(zip(b.column("text").to_pylist(), sections)):
                if text is None or len(text) <= limit or len(text.strip()) <= limit:
                    continue
                bounds = Boundaries(text)
                made = cuts(bounds, len(text), limit, overlap)
                if not texts:
                    rows.append((row, 0, 0, 0, 0, "hard" if any(h == "hard" for *_, h in made) else "boundary", None, None))
                    continue
                at, heads = -1, bounds.heads
                for i, (start, own, end, how) in enumerate(made):
                    while at + 1 < len(heads) and heads[at + 1][0] <= own:
                        at += 1
                    rows.append((row, i, start, own, end, how, section if at < 0 else heads[at][1], text[start:end]))
            if rows:
                index, *columns = zip(*rows)
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("chunk_id").take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["chunk_id", "piece", "start", "own_start", "end", "cut", "section", "text"],
                )

    return run


PIECES = "piece int, start int, own_start int, end int, cut string, section string, text string"


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(chunk_id, piece, start, own_start, end, cut, section, text)``: the pieces of every
    text that has more than ``limit`` characters without the white space at its ends.

    ``text`` is the original's from ``start`` to ``end`` (offsets in code points); of it,
    what lies before ``own_start`` repeats the piece before. Between the end of a piece and
    the own start of the next there is white space only, so the pieces give back the text.
    ``section`` is that of the last heading inside the text at or before the own start,
    else the row's own, tidied. Exact copies of a row are one row. Null, blank and short
    texts give no pieces; an empty table gives none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    big = chunks.filter(F.length("text") > limit).select("chunk_id", tidy_section(F.col("section")).alias("section"), "text").distinct()
    return big.mapInArrow(_split(limit, overlap, True), f"chunk_id {_type(chunks)}, {PIECES}")


def oversized_kinds(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(chunk_id, kind)``: ``forced`` if the split of the text needs a cut inside a run
    without white space, else ``boundary``; texts as in ``split_oversized``. Should rows of
    one chunk have several texts, one forced cut is enough."""
    big = chunks.filter(F.length("text") > limit).select("chunk_id", "text")
    pieces = big.mapInArrow(_split(limit, overlap, False), f"chunk_id {_type(chunks)}, {PIECES}")
    forced = F.max((F.col("cut") == "hard").cast("int"))
    return pieces.groupBy("chunk_id").agg(F.when(forced == 1, "forced").otherwise("boundary").alias("kind"))


def _type(chunks: DataFrame) -> str:
    return chunks.schema["chunk_id"].dataType.simpleString()
