"""Splitting oversized texts at natural boundaries (problem 9)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.tokens import VOCABULARY, encoding

#: Limits of documents without a source, or of one the plan doesn't name.
DEFAULT_MAX, DEFAULT_OVERLAP = 512, 64
#: A piece that isn't the last one has at least this share of the tokens it may have, so that a
#: strong boundary near its start doesn't make it tiny, unless a word would have to be cut.
MIN_FILL = 0.5
#: The index over boundary strengths is built for so many tokens at a time.
INDEX_TOKENS = 1 << 20

# Strengths of boundaries.
HEADING, PARAGRAPH, LINE, SENTENCE, CLAUSE, COMMA, BLANK, INSIDE, BROKEN = 8, 7, 6, 5, 4, 3, 2, 1, 0
_HEADING = re.compile(rb"#{1,6} |\xe3\x80\x90|Claim \d|\d+(?:\.\d+)*\.? \S|[IVX]+\. ")
_WIDE_SPACE = re.compile(rb"(?:\xe3\x80\x80|\xc2\xa0|\xe2\x80[\x80-\x8a])+")
#: Ends of units in scripts written without blanks, with closing quotes and brackets behind them.
_WIDE_STOP = re.compile("(?:((?:。|！|？)+)|((?:；)+)|(?:，|、)+)(?:」|』|）|】|”|’)*".encode())
#: Strength of a blank by the byte before it.
_AFTER = np.full(256, BLANK, np.int8)
_AFTER[list(b".!?")] = SENTENCE
_AFTER[list(b";:")] = CLAUSE
_AFTER[list(b",")] = COMMA


def strengths(raw: bytes) -> np.ndarray:
    """Strength of a cut before each byte of UTF-8 text, and at its end.

    All positions of a stretch of white space have the strength of the boundary it marks; positions
    inside a character are BROKEN, others INSIDE.
    """
    data = np.frombuffer(raw, np.uint8)
    out = np.full(len(data) + 1, INSIDE, np.int8)
    out[:-1][(data & 0xC0) == 0x80] = BROKEN
    if b"\xe3\x80\x80" in raw or b"\xc2\xa0" in raw or b"\xe2\x80" in raw:
        for m in _WIDE_SPACE.finditer(raw):
            part = out[m.start() : m.end() + 1]
            part[part != BROKEN] = BLANK
    if b"\xe3\x80" in raw or b"\xef\xbc" in raw:
        for m in _WIDE_STOP.finditer(raw):
            out[m.end()] = SENTENCE if m[1] else CLAUSE if m[2] else COMMA
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([False], blank, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return out
    value = _AFTER[data[begin - 1]]
    value[begin == 0] = BLANK
    value = np.maximum(value, out[begin])
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    lines = lines[end] - lines[begin]
    value[lines == 1] = LINE
    value[lines > 1] = PARAGRAPH
    for i in np.flatnonzero(lines).tolist():
        if _HEADING.match(raw, int(end[i])):
            value[i] = HEADING
    length = end - begin + 1
    if (length == 2).all():
        out[begin] = out[end] = value
    else:
        first = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        out[first + np.arange(length.sum())] = np.repeat(value, length)
    return out


class StrongestCut:
    """Sparse table for the position of the maximum in a window; of equal ones the rightmost."""

    def __init__(self, values: np.ndarray, widest: int):
        self.values = values
        self.levels = [np.arange(len(values))]
        span = 1
        while span * 2 <= min(widest, len(values)):
            low = self.levels[-1]
            left, right = low[: len(low) - span], low[span:]
            self.levels.append(np.where(values[left] > values[right], left, right))
            span *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position of the maximum of values[lo..hi], both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        return a if self.values[a] > self.values[b] else b


class Splitter:
    """Cuts texts into pieces within a number of tokens."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.enc = encoding(vocabulary)
        self.size = np.array([len(self.enc.decode_single_token_bytes(i)) for i in range(self.enc.n_vocab)])

    def _count(self, raw: bytes, ends: np.ndarray, safe: np.ndarray, s: int, e: int) -> int:
        """Tokens of the piece of tokens s..e when it is encoded by itself.

        Between two white-space boundaries the tokens stay the same, so only a word cut at either end
        is encoded again.
        """
        n = e - s
        if s and not safe[s]:
            near = np.flatnonzero(safe[s + 1 : e])
            if not len(near):
                return len(self.enc.encode_ordinary(raw[ends[s] : ends[e]].decode()))
            p = s + 1 + int(near[0])
            n += len(self.enc.encode_ordinary(raw[ends[s] : ends[p]].decode())) - (p - s)
        if e < len(ends) - 1 and not safe[e]:
            near = np.flatnonzero(safe[s + 1 : e])
            if not len(near):
                return len(self.enc.encode_ordinary(raw[ends[s] : ends[e]].decode()))
            p = s + 1 + int(near[-1])
            n += len(self.enc.encode_ordinary(raw[ends[p] : ends[e]].decode())) - (e - p)
        return n

    def _by_characters(self, raw: bytes, a: int, behind: int, limit: int, overlap: int) -> tuple[int, int, int]:
        """A piece from byte ``a`` where tokens and characters hardly ever end together: its end, its tokens
        and the start of the next piece, all at characters. It ends behind byte ``behind``."""
        tail = raw[a : max(a, behind) + 4 * limit + 4].decode(errors="ignore")
        size = [len(c.encode()) for c in tail]

        def count(i: int, j: int) -> int:
            return len(self.enc.encode_ordinary(tail[i:j]))

        i, passed, least = 0, a, 0
        while least < len(size) and passed <= behind:
            passed += size[least]
            least += 1
        k = max(least, min(len(tail), limit))
        while k > max(1, least) and count(0, k) > limit:
            k -= 1
        while i < least - 1 and count(i, k) > limit:  # too much overlap to advance: start later
            i += 1
        j = k - 1 if overlap else k
        while j > i + 1 and count(j, k) < overlap:
            j -= 1
        start = a + sum(size[:i])
        return start, a + sum(size[:k]), a + sum(size[: max(j, i + 1)])

    def split(self, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
        """Pieces (start byte, end byte, tokens, text) of a text with more than ``limit`` tokens, else none."""
        raw = text.encode("utf-8", "replace")
        if len(raw) <= limit:  # a token has at least one byte
            return []
        if len(tokens := self.enc.encode_ordinary(text)) <= limit:
            return []
        out: list[tuple[int, int, int, str]] = []
        offset = behind = 0
        while True:
            rest = self._cut(raw[offset:], tokens, limit, overlap, behind - offset, offset, out)
            if rest is None:
                return out
            start, z, following = self._by_characters(raw, rest, behind := out[-1][1] if out else 0, limit, overlap)
            piece = raw[start:z].decode()
            out.append((start, z, len(self.enc.encode_ordinary(piece)), piece))
            if z == len(raw):
                return out
            offset, behind = following, z
            tokens = self.enc.encode_ordinary(raw[offset:].decode())

    def _cut(self, raw, tokens, limit, overlap, behind, offset, out) -> int | None:
        """Append pieces cut between tokens; the start of a piece for which that is impossible, or None.

        The first piece must end behind byte ``behind``.
        """
        n = len(tokens)
        ends = np.concatenate(([0], np.cumsum(self.size[tokens])))
        cut = strengths(raw)[ends]
        data = np.frombuffer(raw, np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        safe = np.zeros(n + 1, bool)
        inner = ends[1:-1]
        safe[1:-1] = blank[inner] & ~blank[inner - 1]
        least = max(1, min(limit, max(int(limit * MIN_FILL), overlap + 8)))
        before = max(0, int(np.searchsorted(ends, behind, "right")) - 1)
        s, base, index = 0, 0, None
        while True:
            hi = min(n, s + limit)
            while True:
                if hi == n:
                    e = n
                else:
                    if index is None or hi - base >= len(index.values):
                        base = s
                        index = StrongestCut(cut[base : base + INDEX_TOKENS + limit + 1], limit + 1)
                    lo = min(max(s + least, before + 1), hi)
                    e = base + index.query(lo - base, hi - base)
                    first = max(s, before) + 1
                    if cut[e] <= INSIDE and first < lo:  # a short piece before a cut word
                        early = base + index.query(first - base, lo - 1 - base)
                        e = early if cut[early] > INSIDE else e
                    while e > max(s, before) and cut[e] == BROKEN:  # the nearest character's end before it
                        e -= 1
                if e <= max(s, before):
                    return offset + int(ends[s])
                count = self._count(raw, ends, safe, s, e)
                if count <= limit:
                    break
                hi = min(e, hi) - (count - limit)
                if hi <= max(s, before):
                    return offset + int(ends[s])
            a, z = int(ends[s]), int(ends[e])
            out.append((offset + a, offset + z, count, raw[a:z].decode()))
            if e == n:
                return None
            wanted = following = e - min(overlap, e - s - 1)
            while following > s + 1 and cut[following] == BROKEN:
                following -= 1
            if cut[following] == BROKEN:  # no character begins between: the next one behind
                following = wanted
                while cut[following] == BROKEN:
                    following += 1
            s, before = following, e


def split_oversized(
    documents: DataFrame, plan: DataFrame, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Pieces of every document with more tokens than its source allows.

    Result: ``doc_id``, ``piece`` (from 0), ``start_byte``, ``end_byte`` (in UTF-8), ``n_tokens``, ``text``. Each piece has
    at most ``max_tokens`` tokens when encoded by itself and, but for the first, begins ``overlap_tokens``
    tokens of the document before the end of the one before (a few more where that would fall inside
    a character). It ends at the strongest boundary of the permitted window, of equal ones at the
    rightmost: heading, paragraph, line, sentence, clause, comma, blank, and inside a word only where
    there is none. Null and empty texts and texts within the limit give no rows; a null or unplanned
    source takes 512 and 64; an overlap of the limit or more counts as the greatest that lets pieces
    advance; one character with more tokens than the limit is a piece; repeated rows are split each. The pieces cover the text without gaps. Other columns are
    ignored.

    One scan without a shuffle; the plan is a small table that is joined by source. Texts are handled
    one at a time, and the index holds a bounded number of tokens.
    """
    limits = plan.select(
        F.col("source").alias("__source"),
        F.coalesce(F.col("max_tokens"), F.lit(DEFAULT_MAX)).alias("limit"),
        F.coalesce(F.col("overlap_tokens"), F.lit(DEFAULT_OVERLAP)).alias("overlap"),
    ).filter("__source is not null").dropDuplicates(["__source"])
    base = (
        documents.select("doc_id", "source", "text")
        .filter("text is not null and text <> ''")
        .join(limits, F.col("source") == F.col("__source"), "left")
        .select(
            "doc_id", "text",
            F.greatest(F.coalesce("limit", F.lit(DEFAULT_MAX)), F.lit(1)).alias("limit"),
            F.greatest(F.coalesce("overlap", F.lit(DEFAULT_OVERLAP)), F.lit(0)).alias("overlap"),
        )
        .filter(F.octet_length("text") > F.col("limit"))
    )

    def cut(batches):
        splitter = Splitter(vocabulary)
        columns = ["doc_id", "piece", "start_byte", "end_byte", "n_tokens", "text"]
        for batch in batches:
            rows = []
            for doc, text, limit, overlap in zip(batch["doc_id"], batch["text"], batch["limit"], batch["overlap"]):
                for i, piece in enumerate(splitter.split(text, limit, min(overlap, limit - 1))):
                    rows.append((doc, i, *piece))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return base.mapInPandas(
        cut, "doc_id long, piece int, start_byte long, end_byte long, n_tokens int, text string"
    )
