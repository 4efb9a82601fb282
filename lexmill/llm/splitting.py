"""Problem 4: items over a size limit cut into pieces at natural boundaries.

Method: recursive bisection. A part that is too large is cut at the strongest boundary near its midpoint, and each
half is done likewise until all parts fit the limit less the overlap; then each piece but the first gets the end of
the text before it as its overlap.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col

BLANKS = " \t\r\n"
#: Boundaries from the strongest: paragraph, line, sentence, clause, word.
_BOUNDARIES = [(5, re.compile(r"\n[ \t\r]*\n\s*")), (4, re.compile(r"\n\s*")), (3, re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+|[。！？]")), (2, re.compile(r"[,;:]\s+|\s[–—-]\s+")), (1, re.compile(r"\s+"))]


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions after which ``text`` may be cut, rising, and the strength of each."""
    strength: dict[int, int] = {}
    for s, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            strength.setdefault(m.end(), s)
    strength.pop(len(text), None)
    places = sorted(strength)
    return places, [strength[p] for p in places]


def _is_flag_letter(ch: str) -> bool:
    return "\U0001f1e6" <= ch <= "\U0001f1ff"


def _joined(text: str, at: int) -> bool:
    """Whether the characters around ``at`` make one visible character."""
    before, after = text[at - 1], text[at]
    if before.isascii() and after.isascii():
        return before == "\r" and after == "\n"
    if unicodedata.category(after) in ("Mn", "Me", "Mc") or after in "\u200c\u200d" or before == "\u200d":
        return True  # marks, variation selectors and joiners
    if "\U0001f3fb" <= after <= "\U0001f3ff" or "\U000e0020" <= after <= "\U000e007f":
        return True  # tones of skin, and the letters of a flag's name
    if "\u1160" <= after <= "\u11ff" and "\u1100" <= before <= "\u11ff" or ("\u1160" <= after <= "\u11ff" and "\uac00" <= before <= "\ud7a3"):
        return True  # Hangul letters that are not the first of a syllable
    if _is_flag_letter(after) and _is_flag_letter(before):
        start = at
        while start and _is_flag_letter(text[start - 1]):
            start -= 1
        return (at - start) % 2 == 1  # within a pair that is a flag
    return False


def _nearest(places: list[int], a: int, b: int, mid: int) -> int | None:
    """The one of ``places`` between ``a`` and ``b`` that is nearest to ``mid``."""
    i = bisect_left(places, mid)
    return min((p for p in places[max(0, i - 1) : i + 1] if a < p < b), key=lambda p: abs(p - mid), default=None)


def cut_points(text: str, size: int, reach: float = 0.25) -> list[int]:
    """Rising cut positions that leave parts of at most ``size`` characters."""
    places, strength = boundaries(text)
    out, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            continue
        mid, far = (a + b) // 2, max(1, int((b - a) * reach))
        lo, hi = bisect_left(places, max(a + 1, mid - far)), bisect_left(places, min(b, mid + far + 1))
        if lo < hi:
            at = places[max(range(lo, hi), key=lambda i: (strength[i], -abs(places[i] - mid)))]
        elif (near := _nearest(places, a, b, mid)) is not None:  # none near the midpoint, but one further out
            at = near
        else:  # no boundary in the whole part: within a word, but not within a character
            at = mid
            while at > a + 1 and _joined(text, at):
                at -= 1
            if at == a + 1:
                at = mid
        out.append(at)
        todo += [(a, at), (at, b)]
    return sorted(out)


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(overlap start, start, end)`` of each piece: ``text[start:end]`` are its own characters, those before are repeated.

    The own parts make up ``text`` without gaps; a piece with its overlap has at most ``max_chars`` characters. The
    overlap has exactly ``overlap`` characters, or as many as there are before the piece.
    """
    if max_chars < 1 or overlap < 0 or overlap >= max_chars:
        raise ValueError("0 <= overlap < max_chars is needed")
    if len(text) <= max_chars:
        return [(0, 0, len(text))]
    ends = [0, *cut_points(text, max_chars - overlap), len(text)]
    return [(max(0, a - overlap) if a else 0, a, b) for a, b in zip(ends, ends[1:])]


def split_oversized(df: DataFrame, id_col: str, field_cols: list[str], limits: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Pieces ``doc_id, field_name, piece_no, n_pieces, start_char, end_char, overlap_chars, piece`` of each field over its limit.

    ``limits`` gives ``(max_chars, overlap_chars)`` by field; fields without limits aren't cut. Sizes are code points
    after removal of blank, tab, CR and LF at both ends, and positions count from the start of what is left. Null
    and fitting texts give no piece. Rows delivered twice count once; where an id comes with different texts, each
    text is cut for itself. A piece is the overlap followed by the characters from ``start_char`` to ``end_char``.
    Other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    schema = "doc_id string, field_name string, piece_no int, n_pieces int, start_char int, end_char int, overlap_chars int, piece string"
    found = None
    for field in field_cols:
        if field not in limits:
            continue
        text = F.expr(f"trim(BOTH ' \\t\\r\\n' FROM `{field}`)")
        big = df.select(col(id_col).cast("string").alias("doc_id"), F.lit(field).alias("field_name"), text.alias("text")).where(F.length("text") > limits[field][0])
        found = big if found is None else found.unionByName(big)
    if found is None:
        return spark.createDataFrame([], schema)

    limits = dict(limits)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc, field, text in zip(batch["doc_id"], batch["field_name"], batch["text"]):
                cuts = split_text(text, *limits[field])
                rows += [(doc, field, k, len(cuts), a, b, a - o, text[o:b]) for k, (o, a, b) in enumerate(cuts, 1)]
            yield pd.DataFrame(rows, columns=names)

    # only rows over their limit are moved, spread evenly over the tasks
    return found.dropDuplicates().mapInPandas(pieces, schema)


def limits_of(split_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """The limits table as a dict; a row a field, so it is small by its nature."""
    return {r["field_name"]: (r["max_chars"], r["overlap_chars"]) for r in split_limits.where("field_name IS NOT NULL AND max_chars IS NOT NULL").select("field_name", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).collect()}


def split_passages(passages: DataFrame, split_limits: DataFrame) -> DataFrame:
    limits = limits_of(split_limits)
    return split_oversized(passages, "doc_id", [f for f in ("segment", "body") if f in limits], limits)
