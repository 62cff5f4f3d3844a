"""Problem 1: alignment, marks and closing words, on texts cut here at known places."""

import random

from docketry.llm.truncation import LADDER, STOP, align_end, cut_shares, truncated

NOUNS = ["필터", "밸브", "센서", "펌프", "노즐", "렌즈", "기판", "코일", "탱크", "커넥터"]
FRAMES = [
    "{a}의 표면에는 {b}를 따라 돌기가 형성되고, 돌기의 높이는 {n} mm를 넘지 않는다.",
    "작업자는 {a}를 분리하지 않고도 {b}를 점검할 수 있다.",
    "이에 따라 충전 속도가 종래보다 {n} %만큼 달라지고 {a}의 수명은 함께 개선된다.",
    "사용자가 {a}를 누르면 {b}가 열리고 {n}초 뒤에 스스로 닫힌다.",
    "The {a} shares the load with the {b} and keeps a gap of {n} mm.",
    "When the signal exceeds {n} V, the {a} stops and the {b} returns to its initial position.",
]


def abstract(rng, k=5):
    return " ".join(f.format(a=rng.choice(NOUNS), b=rng.choice(NOUNS), n=rng.randrange(2, 900)) for f in rng.choices(FRAMES[:4], k=k))


def build():
    rng = random.Random(11)
    rows, cut = [], set()

    def add(text, is_cut=False):
        rows.append((len(rows), rng.choice(["s1", "s2", None]), text))
        if is_cut:
            cut.add(len(rows) - 1)

    whole = [abstract(rng) for _ in range(400)]
    for i, t in enumerate(whole):
        add(t)
        if i % 5 == 0:
            add(t)  # delivered again
        if i % 4 == 0:  # cut inside its last sentence; a copy exists
            at = t.rindex(". ") + 2 + rng.randint(4, len(t) - t.rindex(". ") - 6)
            add(t[:at].rstrip() + rng.choice(["", "...", " [...]", "(이하 생략)", "�"]), True)
    for _ in range(80):  # cut, without a copy
        t = abstract(rng)
        at = t.rindex(". ") + 2 + rng.randint(4, len(t) - t.rindex(". ") - 8)
        add(t[:at].rstrip() + rng.choice(["", "", "...", " [...]"]), True)
    for _ in range(60):  # whole, in other styles
        t = abstract(rng)
        add(rng.choice([t[:-1], t + " [끝]", t + " 대표도 - 도 2", t + " 키워드: 유로, 단열"]))
    for text in (None, "", " ", "\n"):
        add(text)
    add("가" * 200_000 + ".")
    return rows, cut


def test_cut_texts(spark):
    rows, cut = build()
    df = spark.createDataFrame([(*r, 1, "c", "c") for r in rows], "rec_id long, source string, astrtCont string, key int, tid string, word string")
    verdicts = truncated(df).collect()
    assert len(verdicts) == len(rows)
    found = {r.rec_id for r in verdicts if r.is_cut}
    assert len(found & cut) / len(cut) >= 0.95, sorted(cut - found)[:5]
    assert len(found & cut) / len(found) >= 0.95, [rows[i] for i in sorted(found - cut)[:5]]
    assert all(r.evidence == "none" for r in verdicts if rows[r.rec_id][2] in (None, "", " ", "\n"))
    assert {r.evidence for r in verdicts} == {"none", "aligned", "mark", "closing"}
    shares = {r.source: r for r in cut_shares(truncated(df)).collect()}
    assert sum(r.n_records for r in shares.values()) == len(rows) and None in shares
    assert sum(r.n_cut for r in shares.values()) == len(found)


def test_empty_and_lone(spark):
    schema = "rec_id long, source string, astrtCont string"
    assert truncated(spark.createDataFrame([], schema)).count() == 0
    assert not truncated(spark.createDataFrame([(1, "s", "끝난다.")], schema)).first().is_cut


def test_alignment():
    full = "one two three four five six seven eight. nine ten eleven twelve"
    assert align_end("one two three four five six sev", full) == 1
    assert align_end("one two three four five six seven", full) == 1
    assert align_end("one two three four five six seven eight.", full) == 0
    assert align_end("one two three four five six seven eight", full) == 0
    assert align_end("one two three four five six other", full) == -1
    assert align_end(full, full) == -1
    assert align_end("a b c", full) == -1


def test_heads_are_similar_enough():
    """The head a cut text is searched by has at least 0.8 of its words, beyond the shortest ones."""
    assert all(b <= a / 0.8 + 1 for a, b in zip(LADDER, LADDER[1:]))


def test_stops_behind_a_cut(spark):
    """Two dots are a mark of a cut; a single full stop doesn't hide one from a copy that goes on."""
    rng = random.Random(5)
    full = [abstract(rng) for _ in range(60)]
    cuts = [t[: t.rindex(" ", 0, len(t) - 8) + 2] for t in full[:20]]
    rows = [*full, *[c + ".." for c in cuts[:8]], *[c + "." for c in cuts[8:16]], *[c + ".)" for c in cuts[16:]]]
    rows += [t[: t.rindex(". ") + 1] for t in full[20:40]]  # whole sentences of longer copies
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "rec_id long, source string, astrtCont string")
    got = {r.rec_id: (r.is_cut, r.evidence) for r in truncated(df).collect()}
    assert {i for i, v in got.items() if v[0]} == set(range(60, 80)), got
    assert {got[i] for i in range(60, 80)} == {(True, "aligned")} and got[80] == (False, "none")
    lone = abstract(rng)[:-6] + ".."
    assert truncated(spark.createDataFrame([(1, "s", lone)], df.schema)).first().evidence == "mark"


def test_alignment_behind_a_stop():
    full = "one two three four five six seven eight 12.5 mm. nine ten"
    assert align_end("one two three four five six sev.", full) == 1
    assert align_end("one two three four five six seven.", full) == 1
    assert align_end("one two three four five six seven eight 12.", full) == 1
    assert align_end("one two three four five six seven eight 12.5 mm.", full) == 0


def test_every_copy_of_a_crowded_bucket(spark):
    """The copy that goes on is found among many other texts with the same opening."""
    opening = "The controller reads the current level "
    words = ["".join(random.Random(i).choices("bcdfghklmnprst", k=9)) for i in range(40)]
    rows = [opening + w + " of the tank " + "and again " * i + "stops." for i, w in enumerate(words)]
    rows += [opening + w[:6] for w in words] + [opening + w[:6] + "." for w in words[:5]]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "rec_id long, source string, astrtCont string")
    got = {r.rec_id: (r.is_cut, r.evidence) for r in truncated(df).collect()}
    assert {got[i] for i in range(40, 85)} == {(True, "aligned")}
    assert not any(got[i][0] for i in range(40))


def exhaustive(texts):
    """Verdicts of every alignment of two texts: 1 if some copy goes on, 0 if all end there."""
    bodies = [t for t in texts if t]
    ends = {}
    for a in bodies:
        found = [e for b in bodies if len(b) > len(a) and (e := align_end(a, b)) >= 0]
        if found:
            ends[a] = max(found) if not STOP.search(a) else min(found)
    return ends


def test_alignments_against_all_pairs(spark):
    """Of the links that comparing all texts with all others gives, at least 0.95 are found."""
    rng = random.Random(21)
    texts = []
    for _ in range(150):
        t = abstract(rng, rng.randint(2, 6))
        texts.append(t)
        words = t.split(" ")
        for _ in range(rng.randint(0, 3)):
            w = words[: rng.randint(6, len(words) - 1)]
            if rng.random() < 0.4:  # another wording at a place before the cut
                w[rng.randrange(len(w))] = rng.choice(NOUNS)
            if rng.random() < 0.5 and len(w[-1]) > 2:
                w[-1] = w[-1][:-1]
            texts.append(" ".join(w) + rng.choice(["", "", "."]))
    texts = list(dict.fromkeys(t for t in texts if not t.endswith("..")))
    want = exhaustive(texts)
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "rec_id long, source string, astrtCont string")
    got = {texts[r.rec_id] for r in truncated(df).collect() if r.evidence == "aligned"}
    links = {t for t, e in want.items() if e == 1 or not STOP.search(t)}
    assert len(links) > 100 and len(links & got) >= 0.95 * len(links) and got <= set(want)


def test_no_text_is_too_long_for_a_mark_or_remark(spark):
    """A remark of thousands of characters is dropped, a mark of hundreds is seen, and words of any length do no harm."""
    rng = random.Random(6)
    whole = [abstract(rng) for _ in range(30)]
    remark = " 키워드: " + ", ".join(f"유로{i}" for i in range(900))
    long_word = "x" * 300
    rows = [*whole, whole[0][:-1] + remark, whole[1][: len(whole[1]) // 2] + "…" * 400]
    rows += [f"본 발명은 {rng.choice(NOUNS)}를 {long_word}abc 장치에 관한 것이다." for _ in range(8)] + [f"본 발명은 다른 {rng.choice(NOUNS)} {long_word}a"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "rec_id long, source string, astrtCont string")
    got = {r.rec_id: (r.is_cut, r.evidence) for r in truncated(df).collect()}
    assert got[30][0] is False and got[31][0] is True
