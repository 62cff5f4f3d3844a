"""Texts cut off by field limits or in transfer (problem 1).

Two kinds of evidence. A copy of the same text that goes on tells where an alignment ends early.
Where no copy goes on, the text's last unit (sentence or note) is scored by how often such units end
there: by its closing word, and by its frame, the unit with all but common words masked. Both are
counted over all texts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.look_alikes import plain_form
from docketry.session import materialize

#: What feeds put behind a cut: ellipses of two dots or more, notices, broken characters, tags and entities, hyphens.
CUT_MARKS = (
    r"(?:\s*(?:\.{2,}|…+|\[(?:\.{2,}|…+)\]|\((?:이하\s*생략|생략|중략|계속|truncated|continued|more)\)"
    r"|�+|<[^<>\n]{0,12}|&#?\w{0,8};?|(?<=[A-Za-z])-))+\s*$"
)
#: Closing remarks behind a whole text.
REMARKS = (
    r"(?:\s*(?:대표도\s*[-:–]?\s*도\s*\d+|\((?:선택도|대표도|도면)[^()]*\)|\[[^\[\]\d.…]{1,12}\]"
    r"|(?:키워드|주제어|색인어)\s*:[^.\n]*|(?i:(?:key ?words?|index terms)\s*:[^.\n]*|\((?:fig(?:ure)?\.?|drawing)[^()]*\)|\[end\])))+\s*$"
)
#: What may stand behind the last word of a cut text as if it were whole.
STOP = re.compile(r"[.!?。]['\"”’)\]]*$")
#: Where a unit ends in a text with single blanks and line breaks: full stops (those of numbers only before no
#: number), lines, semicolons, slashes between blanks.
UNIT_END = re.compile(r" (?:(?<=[^\d\s][.!?。] )|(?<=\d[.!?。] )(?=\D)|/[ \n])|\n(?:/[ \n])?|;[ \n]")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_FULL_STOP = re.compile(r"[^\d\s][.!?。](?:\s|$)")
_HANGUL = re.compile("[가-힣]")
#: A word is common in its group (script, prose or notes) if at least this share of the units hold it. There are at most
#: (mean words of a unit) / FRAME_SHARE such words, so they are sent to all tasks.
FRAME_SHARE = 0.035
#: The frame looks at this many words before the end.
FRAME_WORDS = 14
#: Prefixes of words are looked up by at most this many characters; longer ones are compared whole behind that.
PREFIX = 40
#: Bits of the sketch of the keys that texts are searched by: its size is fixed, it only spares rows that meet nothing.
SKETCH_BITS = 1 << 26
#: Seen less often than this, a frame or word says nothing.
ENOUGH = 5
MIN_FRAME, MIN_WORD = 0.35, 0.03
#: A word that hardly ever closes outweighs a frame that does if it is seen this often.
CERTAIN = 100

SHINGLE = 5
BANDS, ROWS = 5, 3
#: Numbers of words at which heads of texts are compared; dense enough that the largest one within a
#: text leaves out less than a fifth of it, so the heads of a cut text and its copy are 0.8 similar.
LADDER = [5, 6, 7, 8, 9, 11, 13, 16, 19, 23]
while LADDER[-1] < 10**7:
    LADDER.append(int(LADDER[-1] * 1.23))
MIN_SIMILARITY = 0.8
_MIX = np.random.default_rng(20240229).integers(1, 2**63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


#: Groups of units: script, and whether the text has full stops at all.
GROUPS = ("ko.prose", "ko.note", "other.prose", "other.note")
_B = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(int(_B), j, 1 << 64) for j in range(FRAME_WORDS)], np.uint64)


def packed_units(body: str) -> str:
    """The units of a text in one string, numbers masked.

    Each begins with the number of its group; units are parted by line breaks, words by a blank.
    """
    note = 0 if _FULL_STOP.search(body) else 1
    pieces = _NUMBER.sub("#", "\n".join([p.strip(" ").rstrip(".!?。") for p in UNIT_END.split(body)])).split("\n")
    units = [p.strip(" ") for p in pieces]
    return "\n".join([f"{note if _HANGUL.search(u) else note + 2}{u}" for u in units if u])


class _Flat:
    """The words of all units of a batch in one array."""

    def __init__(self, packed: list[str], is_open: np.ndarray):
        texts = [p.split("\n") if p else [] for p in packed]
        units = [u for t in texts for u in t]
        self.group = np.array([int(u[0]) for u in units], np.int64)
        sizes = np.array([u.count(" ") + 1 for u in units], np.int64)
        flat = " ".join(u[1:] for u in units).split(" ") if units else []
        self.code, self.words = pd.factorize(np.array(flat, dtype=object))
        self.unit = np.repeat(np.arange(len(units)), sizes)
        self.last = np.cumsum(sizes) - 1
        begin = self.last - sizes + 1
        #: Place of each word in its unit, from 0.
        self.place = np.arange(len(flat)) - begin[self.unit] if units else np.empty(0, np.int64)
        self.inner = np.ones(len(flat), bool)
        self.inner[self.last] = False
        #: Units whose end counts: not the last one of an open text, as it may be cut. Else the same fragment,
        #: cut off again and again, would pass for a closing word.
        self.ends = np.ones(len(units), bool)
        at = np.cumsum([len(t) for t in texts]) - 1
        self.ends[at[[bool(o) and bool(t) for o, t in zip(is_open, texts)]]] = False


def _word_counts(f: _Flat) -> dict[str, np.ndarray]:
    """Per group (a number): units (with an empty word), units with a word, how often it closes a unit or stands inside."""
    n = len(f.words)
    own = f.group[f.unit] * n + f.code
    held = pd.unique(f.unit * (len(GROUPS) * n) + own) % (len(GROUPS) * n)
    count = lambda x: np.bincount(x, minlength=len(GROUPS) * n)
    units, mid, close = count(held), count(own[f.inner]), count(own[f.last[f.ends]])
    at = np.flatnonzero(units)
    none, every = np.zeros(len(GROUPS), np.int64), np.arange(len(GROUPS))
    totals = np.bincount(f.group, minlength=len(GROUPS))
    return {
        "grp": np.append(at // n, every), "word": np.append(f.words[at % n], [""] * len(GROUPS)),
        "n_units": np.append(units[at], totals), "n_close": np.append(close[at], none), "n_mid": np.append(mid[at], none),
    }


COUNTS = ("grp", "word", "n_units", "n_close", "n_mid")


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def _frame_keys(f: _Flat, common: frozenset, group: np.ndarray) -> np.ndarray:
    """Key of the frame that ends at each word: at most the last FRAME_WORDS words of the unit, all but common ones masked."""
    star = _hash("*")
    table = np.full((len(GROUPS), max(1, len(f.words))), star, np.uint64)
    for i, w in enumerate(f.words):
        for g, name in enumerate(GROUPS):
            if w == "#" or (name, w) in common:
                table[g, i] = _hash(w)
    code = table[group[f.unit], f.code] if len(f.code) else np.empty(0, np.uint64)
    key = np.zeros(len(code), np.uint64)
    for j in range(min(FRAME_WORDS, len(code))):
        key[j:] += np.where(f.place[j:] >= j, code[: len(code) - j], np.uint64(0)) * _POWERS[j]
    whole = f.place < FRAME_WORDS
    key ^= (group[f.unit].astype(np.uint64) * np.uint64(2) + whole.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(31)
    return (key * _B).view(np.int64)


def _frame_counts(frame):
    """How often each frame is a whole unit and how often a unit goes on after it."""

    def count(batches):
        for batch in batches:
            f = _Flat(batch["units"].tolist(), batch["open"].to_numpy())
            found, at = np.unique(_frame_keys(f, frame.value, f.group), return_inverse=True)
            n = len(found)
            close = np.bincount(at[f.last[f.ends]], minlength=n)
            mid = np.bincount(at[f.inner], minlength=n)
            yield pd.DataFrame({"frame": found, "n_close": close, "n_mid": mid})[close + mid > 0]

    return count


def _last_units(frame):
    """Last unit of each open text: script, closing word, its frame, and its frame among prose."""

    def last(batches):
        for batch in batches:
            packed = [p.rpartition("\n")[2] or "3*" for p in batch["units"]]
            f = _Flat(packed, np.zeros(len(packed), bool))
            keys = [_frame_keys(f, frame.value, g)[f.last] for g in (f.group, f.group // 2 * 2)]
            script = np.array(["ko", "other"], object)[f.group // 2]
            yield pd.DataFrame(
                {"tid": batch["tid"].to_numpy(), "script": script, "word": f.words[f.code[f.last]], "frame": keys[0], "prose_frame": keys[1]}
            )

    return last


def _tokens(body: str) -> list[str]:
    return [w for w in body.replace("\n", " \n ").split(" ") if w] or [""]


class _Hashes(dict):
    """Hash of each word, worked out once."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _head_keys(split: list[list[str]], top_only: bool):
    """Band keys of the heads of texts, given as words: arrays of text numbers and of their BANDS keys, step by step.

    ``top_only``: only of the longest head of each text.
    """
    # The last word may be cut in two, so it is in no head.
    kept = [i for i, w in enumerate(split) if len(w) > SHINGLE]
    if not kept:
        return
    numbers = np.array(kept)
    sizes = np.array([len(split[i]) for i in kept], np.int64)
    known = _Hashes()
    h = np.array([known[w] for i in kept for w in split[i][:-1]], np.uint64)
    s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        s = s * np.uint64(0x100000001B3) + h[j : len(h) - SHINGLE + 1 + j]
    begin = np.concatenate(([0], np.cumsum(sizes - 1)[:-1]))
    low = np.full((len(kept), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    rest, at = np.arange(len(kept)), 0
    for step, following in zip(LADDER, LADDER[1:]):
        rest = rest[sizes[rest] - 1 >= step]
        if not len(rest):
            return
        width = step - SHINGLE + 1 - at
        places = (begin[rest] + at)[:, None] + np.arange(width)
        for lo in range(0, len(rest), max(1, 200_000 // width)):
            part = slice(lo, lo + max(1, 200_000 // width))
            mixed = s[places[part]][:, :, None] * _MIX[0] + _MIX[1]
            mixed ^= mixed >> np.uint64(31)
            low[rest[part]] = np.minimum(low[rest[part]], mixed.min(axis=1))
        at += width
        out = rest[sizes[rest] - 1 < following] if top_only else rest
        grouped = low[out].reshape(len(out), BANDS, ROWS)
        key = np.uint64(step) * np.uint64(1_000_003) + np.arange(BANDS, dtype=np.uint64)[None, :]
        for j in range(ROWS):
            key = (key ^ grouped[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        yield numbers[out], key.view(np.int64)


def _described(batches):
    """Texts with their packed units, the band keys of their longest head, and their last four words.

    The first text of a batch carries the word counts of the batch.
    """
    for batch in batches:
        bodies = batch["body"].tolist()
        keys: list = [()] * len(bodies)
        split = [_tokens(b) for b in bodies]
        for at, found in _head_keys(split, True):
            for i, k in zip(at.tolist(), found):
                keys[i] = k
        tails = [f" {' '.join(w[-4:-1])} {STOP.sub('', w[-1]) or w[-1]}" for w in split]
        units = [packed_units(b) for b in bodies]
        out = batch.assign(units=units, keys=keys, tail=tails)
        if any(units):
            counts = _word_counts(_Flat(units, batch["open"].to_numpy()))
            yield out.assign(**{c: [v, *[None] * (len(batch) - 1)] for c, v in counts.items()})
        elif bodies:
            yield out.assign(**dict.fromkeys(COUNTS))


def _heads(sketch):
    """Band keys of all heads of each text that the sketch knows: (key, id, characters)."""

    def heads(batches):
        bits = np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            ids, chars = batch["id"].to_numpy(), batch["body"].str.len().to_numpy().astype(np.int32)
            for at, found in _head_keys([_tokens(b) for b in batch["body"]], False):
                bit = found & (SKETCH_BITS - 1)
                row, band = np.nonzero(bits[bit >> 3] >> (bit & 7) & 1)
                yield pd.DataFrame({"key": found[row, band], "id": ids[at[row]], "n": chars[at[row]]})

    return heads


def key_sketch(keys: DataFrame, key: str = "key") -> bytes:
    """A bitmap of SKETCH_BITS bits with a bit for each key: of the same size for any number of keys."""
    bit = F.col(key).bitwiseAND(F.lit(SKETCH_BITS - 1))
    rows = (
        keys.groupBy(F.bitmap_bucket_number(bit + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits"))
        .collect()
    )
    out = bytearray(SKETCH_BITS // 8)
    for r in rows:
        out[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = r.bits
    return bytes(out)


def align_end(cut: str, full: str) -> int:
    """Where the text ``cut`` ends in ``full``: 1 inside a unit, 0 at the end of one, -1 not aligned.

    The words before the last must be 0.8 similar by five-word shingles to as many of ``full``; the
    three words before the last must stand in ``full`` near the same place, followed by a word that
    begins with the last one. A full stop behind the last word may have been put there, so the word is
    compared without it, and the text is whole only where ``full`` ends a unit too.
    """
    c, f = _tokens(cut), _tokens(full)
    m = len(c) - 1
    if m < SHINGLE or len(full) <= len(cut):
        return -1

    def shingles(words):
        return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}

    a = shingles(c[:m])
    b = shingles(f[: m + max(2, m // 10)])
    if len(a & b) < MIN_SIMILARITY * len(a):
        return -1
    word = STOP.sub("", c[m]) or c[m]
    places = [j for j in range(3, len(f)) if f[j - 3 : j] == c[m - 3 : m] and f[j].startswith(word)]
    if not places:
        return -1
    j = min(places, key=lambda x: abs(x - m))
    rest = f[j][len(word) :]
    if rest and rest != ";" and not STOP.fullmatch(rest):
        return 1
    if rest or c[m][-1] == ";":
        return 0
    if j + 1 == len(f):
        return -1
    return 0 if f[j + 1] in ("\n", "/") else 1


@F.pandas_udf(T.IntegerType())
def _align(cut: pd.Series, full: pd.Series) -> pd.Series:
    return pd.Series([align_end(a, b) for a, b in zip(cut, full)], dtype="int32")


def _then(value: Column, step) -> Column:
    """``step`` of a value that is computed once, however often the step names it."""
    return F.transform(F.array(value), step)[0]


def body_of(col: Column) -> Column:
    """The text in one form of characters, blanks squeezed inside lines, closing remarks dropped.

    Each replacement is tried only where a cheaper test says that its pattern can occur.
    """
    control = r"\t\r\f\x0B\x1C-\x1F\x85"

    def steps(text: Column) -> Column:
        blanks = F.contains(text, F.lit("  ")) | ~text.rlike(rf"\A[^{control}]*+\z")
        text = _then(text, lambda t: F.when(blanks, F.regexp_replace(t, f"[ {control}]+", " ")).otherwise(t))
        return _then(F.trim(_then(text, lines)), without_remarks)

    def lines(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r" ?\n[\n ]*", "\n")).otherwise(text)

    def without_remarks(text: Column) -> Column:
        # No remark ends with a full stop; one that names its words may end anyhow, the others end as tested.
        end = F.right(text, F.lit(1))
        may = (end != ".") & (end.rlike(r"[)\]\d]") | text.rlike("(?i)키워드|주제어|색인어|key ?words?|index terms"))
        return F.rtrim(F.when(may, F.regexp_replace(text, REMARKS, "")).otherwise(text), F.lit(" \n"))

    return _then(plain_form(col), steps)


def without_marks(text: Column) -> Column:
    """The text without marks of a cut; a single full stop is none."""
    # The last mark ends the text, and no mark is so long that its end holds none of these characters.
    marked = F.right(text, F.lit(16)).rlike(r"[.…\])�<&-]") & ~F.right(text, F.lit(2)).rlike(r"[^.\s]\.$")
    return F.when(marked, F.regexp_replace(text, CUT_MARKS, "")).otherwise(text)


def stopped(text: Column) -> Column:
    """Does the text end with a full stop that is no point of a number, quotes and brackets aside?"""
    return F.right(F.rtrim(text, F.lit("'\"”’)]")), F.lit(2)).rlike(r"[^\d\s][.!?。]")


def truncated(
    df: DataFrame, text: str = "astrtCont", id_col: str = "rec_id", source: str = "source"
) -> DataFrame:
    """One row per record: ``rec_id``, ``source``, ``is_cut``, ``evidence``.

    ``evidence`` is ``none`` (null or blank text, or one that ends with a full stop and that no copy
    shows to be cut), ``aligned`` (a copy goes on or shows a complete unit), ``mark`` (something that marks a cut stands behind an
    incomplete text) or ``closing`` (closing word and frame). Copies of one text are judged once;
    repeated rows are kept; an empty table gives no rows. Other columns are ignored.

    Near-copies come from min-hash bands of five-word shingles over heads of the texts: a text is
    searched by its longest head among the heads of all texts. One with a full stop is cut if a copy
    goes on inside the unit and none ends it there. All
    texts of a band bucket are compared with the text, so the pairs grow with what texts have in
    common. Heads are looked up in a sketch of fixed size first, which only spares those that no text
    is searched by. A text of fewer than six words has no five-word shingle before its last word, so
    it has no near-copies and is scored by its closing words. Words and frames are counted where the
    texts are and combined before each shuffle.
    """
    spark = df.sparkSession
    base = materialize(
        df.select(
            F.col(id_col).alias("rec_id"),
            F.col(source).alias("source"),
            body_of(F.coalesce(F.col(text), F.lit(""))).alias("whole"),
        )
        .withColumn("body", without_marks(F.col("whole")))
        .withColumn("marked", F.col("body") != F.col("whole"))
        # Blank texts are judged without a text; each keeps to itself, so that they don't meet in one task.
        .withColumn("blank", F.concat(F.lit("blank "), F.monotonically_increasing_id()))
        .withColumn("tid", F.when(F.col("body") == "", F.col("blank")).otherwise(F.md5(F.concat("body", F.col("marked").cast("string")))))
        .drop("blank")
        .drop("whole"),
        "bodies",
    )
    texts = materialize(
        base.filter("body <> ''")
        .groupBy("tid")
        .agg(F.any_value("body").alias("body"), F.any_value("marked").alias("marked"))
        # A full stop behind a number may be the point of a longer number, so such a text is looked at.
        .withColumn("open", ~stopped(F.col("body")))
        .mapInPandas(
            _described,
            "tid string, body string, marked boolean, open boolean, units string, keys array<long>, tail string, "
            "grp array<long>, word array<string>, n_units array<long>, n_close array<long>, n_mid array<long>",
        ),
        "texts",
    )
    counted = texts.filter("grp is not null").select(F.inline(F.arrays_zip(*COUNTS)))
    counted = counted.withColumn("grp", F.array(*map(F.lit, GROUPS))[F.col("grp").cast("int")])
    grouped = materialize(
        counted.groupBy("grp", "word").agg(*[F.sum(c).alias(c) for c in ("n_units", "n_close", "n_mid")]), "words"
    )
    totals = grouped.filter("word = ''").select("grp", F.col("n_units").alias("total"))
    common = grouped.filter("word <> ''").join(totals, "grp").filter(F.col("n_units") >= FRAME_SHARE * F.col("total"))
    frame = spark.sparkContext.broadcast(frozenset((r.grp, r.word) for r in common.select("grp", "word").collect()))
    words = (
        grouped.filter("word <> ''")
        .groupBy(F.substring_index("grp", ".", 1).alias("script"), "word")
        .agg(F.sum("n_close").alias("n_close"), F.sum("n_mid").alias("n_mid"))
    )

    frames = (
        texts.select("units", "open")
        .mapInPandas(_frame_counts(frame), "frame long, n_close long, n_mid long")
        .groupBy("frame")
        .agg(F.sum("n_close").alias("f_close"), F.sum("n_mid").alias("f_mid"))
    )
    open_texts = texts.filter("open")
    last = open_texts.select("tid", "units").mapInPandas(
        _last_units(frame), "tid string, script string, word string, frame long, prose_frame long"
    )
    by_word = words.select("script", "word", F.col("n_close").alias("w_close"), F.col("n_mid").alias("w_mid"))
    # Is an unknown closing word the beginning of known ones?
    longer = (
        words.filter((F.length("word") > 1) & (F.col("n_close") + F.col("n_mid") >= ENOUGH))
        .select(
            "script",
            F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(PREFIX))), lambda i: F.substr("word", F.lit(1), i))).alias("word"),
            (F.col("n_close") + F.col("n_mid")).alias("n"),
            F.col("n_close").alias("c"),
        )
        .groupBy("script", "word")
        .agg(F.sum("n").alias("n_longer"), F.sum("c").alias("longer_close"))
    )
    # The few closing words longer than that meet the words that share their first characters.
    long_words = words.filter((F.length("word") > PREFIX) & (F.col("n_close") + F.col("n_mid") >= ENOUGH))
    long_ends = last.filter(F.length("word") > PREFIX).select("script", "word").distinct()
    longer = longer.unionByName(
        long_ends.withColumn("start", F.left("word", F.lit(PREFIX)))
        .join(long_words.select("script", F.left("word", F.lit(PREFIX)).alias("start"), F.col("word").alias("other"), "n_close", "n_mid"), ["script", "start"])
        .filter(F.startswith("other", "word") & (F.col("other") != F.col("word")))
        .groupBy("script", "word")
        .agg(F.sum(F.col("n_close") + F.col("n_mid")).alias("n_longer"), F.sum("n_close").alias("longer_close"))
    )
    as_prose = frames.select(F.col("frame").alias("prose_frame"), F.col("f_close").alias("p_close"), F.col("f_mid").alias("p_mid"))
    scored = (
        last.join(by_word, ["script", "word"], "left")
        .join(longer, ["script", "word"], "left")
        .join(frames, "frame", "left")
        .join(as_prose, "prose_frame", "left")
    )

    # Bands carry a hash of the text's key. If two texts share one, a candidate is wrong or missing;
    # every candidate is verified by its alignment.
    hashed = F.xxhash64("tid").alias("id")
    # All texts of a bucket are candidates; one that isn't longer can't go on.
    probes = texts.select(hashed, F.length("body").alias("n"), F.explode("keys").alias("key"))
    sketch = spark.sparkContext.broadcast(key_sketch(probes))
    heads = texts.select(hashed, "body").mapInPandas(_heads(sketch), "key long, id long, n int").select("key", F.col("id").alias("copy"), F.col("n").alias("n_copy"))
    pairs = probes.join(heads, "key").filter("id <> copy and n_copy > n").select("id", "copy").distinct()
    aligned = (
        pairs.join(texts.select("tid", hashed, F.col("body").alias("cut"), "tail"), "id")
        .join(texts.select(F.xxhash64("tid").alias("copy"), F.col("body").alias("full")), "copy")
        # What the alignment demands first: the last words stand in the copy.
        .filter(F.contains(F.concat(F.lit(" "), F.replace("full", F.lit("\n"), F.lit(" \n "))), F.col("tail")))
        .select("tid", _align("cut", "full").alias("ends"))
        .filter("ends >= 0")
        .groupBy("tid")
        .agg(F.max("ends").alias("ends"), F.min("ends").alias("least_end"))
    )
    w_close, w_mid = F.coalesce(F.col("w_close"), F.lit(0)), F.coalesce(F.col("w_mid"), F.lit(0))
    f_close, f_mid = F.coalesce(F.col("f_close"), F.lit(0)), F.coalesce(F.col("f_mid"), F.lit(0))
    p_close, p_mid = F.coalesce(F.col("p_close"), F.lit(0)), F.coalesce(F.col("p_mid"), F.lit(0))
    known_word = w_close + w_mid >= ENOUGH
    word_share = w_close / F.greatest(w_close + w_mid, F.lit(1))
    frame_share = F.when(f_close + f_mid >= ENOUGH, f_close / (f_close + f_mid)).when(
        p_close + p_mid >= ENOUGH, p_close / (p_close + p_mid)
    )
    weak_frame = F.coalesce(frame_share < 0.9, F.lit(True))
    closing = (
        F.when(known_word & (word_share < MIN_WORD) & (weak_frame | (w_close + w_mid >= CERTAIN)), True)
        .when(frame_share < MIN_FRAME, True)
        .when(~known_word & (F.coalesce("longer_close", F.lit(0)) > 1), True)
        .when(frame_share.isNotNull(), False)
        .when(known_word, word_share < 0.5)
        .otherwise(F.coalesce("n_longer", F.lit(0)) > 0)
    )
    verdicts = (
        texts.select("tid", "marked", "open")
        .join(scored, "tid", "left")
        .join(aligned, "tid", "left")
        .filter(F.col("open") | (F.col("least_end") == 1))
        .select(
            "tid",
            F.when(F.col("ends").isNotNull(), F.col("ends") == 1).when(F.col("marked"), True).otherwise(closing).alias("is_cut"),
            F.when(F.col("ends").isNotNull(), "aligned").when(F.col("marked"), "mark").otherwise("closing").alias("evidence"),
        )
    )
    return (
        base.select("rec_id", "source", "tid")
        .join(verdicts, "tid", "left")
        .select("rec_id", "source", F.coalesce("is_cut", F.lit(False)).alias("is_cut"), F.coalesce("evidence", F.lit("none")).alias("evidence"))
    )


def cut_shares(verdicts: DataFrame) -> DataFrame:
    """Per source (null is one of its own): records, cut records and their share."""
    return verdicts.groupBy("source").agg(
        F.count("*").alias("n_records"),
        F.count_if("is_cut").alias("n_cut"),
        F.avg(F.col("is_cut").cast("double")).alias("cut_share"),
    )
