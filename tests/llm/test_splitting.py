"""Problem 9: pieces stay within the limit, overlap, and cover the text."""

import random

import numpy as np
import pytest

from docketry.llm.splitting import SENTENCE, Splitter, StrongestCut, split_oversized, strengths


@pytest.fixture(scope="module")
def splitter():
    return Splitter()


def test_strongest_cut_is_rightmost_maximum():
    rng = random.Random(1)
    values = np.array([rng.randrange(5) for _ in range(200)])
    index = StrongestCut(values, 64)
    for _ in range(2000):
        lo = rng.randrange(200)
        hi = min(199, lo + rng.randrange(64))
        best = max(range(lo, hi + 1), key=lambda i: (values[i], i))
        assert index.query(lo, hi) == best


def sample_texts():
    rng = random.Random(2)
    words = ["배터리", "냉각판을", "the", "controller", "x", "1.25", "μm", "구동한다.", "ends.", "그리고,", "(340)", "😀", "漢字"]
    out = ["".join(rng.choice("가나다라마바사😀漢字") for _ in range(3000)), "a" * 5000, " " * 4000, "\n" * 500, "x　" * 900]
    for _ in range(25):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n", "", "  "]) for _ in range(rng.randrange(900))))
    return out


@pytest.mark.parametrize("limit,overlap", [(64, 8), (128, 0), (37, 30), (8, 7), (2, 1), (1, 0)])
def test_pieces(splitter, limit, overlap):
    enc = splitter.enc
    for text in sample_texts():
        pieces = splitter.split(text, limit, overlap)
        raw = text.encode()
        whole = len(enc.encode_ordinary(text))
        assert bool(pieces) == (whole > limit)
        for i, (a, z, n, t) in enumerate(pieces):
            assert raw[a:z].decode() == t and n == len(enc.encode_ordinary(t))
            assert n <= limit or len(t) == 1  # one character can have more tokens than a tiny limit
            if i:
                before = pieces[i - 1]
                assert before[0] < a <= before[1] < z
                if overlap and limit >= 37:
                    assert 0 < len(enc.encode_ordinary(raw[a : before[1]].decode())) <= overlap + 8
        if pieces:
            assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)


def test_natural_boundaries(splitter):
    text = "첫 문장은 길게 이어진다. " * 60 + "\n\n## 결론\n" + "Second part goes on here. " * 60
    pieces = splitter.split(text, 200, 20)
    assert all(p[3].rstrip().endswith((".", "결론")) for p in pieces)
    s = strengths("끝. 다음".encode())
    assert s[len("끝.".encode())] == SENTENCE


def test_operator(spark):
    docs = spark.createDataFrame(
        [(1, "a", "word " * 300, 9), (2, None, "word " * 300, 9), (3, "zz", "word " * 600, 9), (4, "a", None, 9), (5, "a", "", 9), (1, "a", "word " * 300, 9)],
        "doc_id long, source string, text string, piece int",
    )
    plan = spark.createDataFrame([("a", 0.5, 1, 100, 10), ("b", 0.5, 1, None, 500)], "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int")
    rows = split_oversized(docs, plan).collect()
    assert {r.doc_id for r in rows} == {1, 3}
    assert max(r.n_tokens for r in rows if r.doc_id == 1) <= 100 and max(r.n_tokens for r in rows if r.doc_id == 3) <= 512
    assert sum(r.doc_id == 1 and r.piece == 0 for r in rows) == 2
    assert split_oversized(docs.limit(0), plan).count() == 0
    assert {r.doc_id for r in split_oversized(docs, plan.limit(0)).collect()} == {3}


def test_early_boundary_before_a_cut_word(splitter):
    rng = random.Random(3)
    text = "The first line stands by itself.\n" + "".join(rng.choice("abcdefghij") for _ in range(3000))
    pieces = splitter.split(text, 100, 10)
    assert pieces[0][3].strip() == "The first line stands by itself."
    assert all(a[0] < b[0] <= a[1] < b[1] for a, b in zip(pieces, pieces[1:])) and pieces[-1][1] == len(text)


def test_ends_without_blanks(splitter):
    s = strengths("甲。乙，丙；丁！」戊、己。 庚".encode())
    assert [int(s[3 * i]) for i in (2, 4, 6, 9, 11, 13)] == [5, 3, 4, 5, 3, 5] and s[3 * 8] == 1
    text = "".join("電池を冷却する装置" + "水" * (i % 7) + "を備える。" for i in range(200))
    assert all(p[3].endswith("。") for p in splitter.split(text, 120, 10))
