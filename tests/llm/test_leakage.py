"""Problem 7: every shared run is found; the retrieval equals exhaustive scoring."""

import random

import numpy as np

from docketry.llm import leakage
from docketry.llm.leakage import ItemIndex, _codes, gram_hashes, leaks


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))


def brute(docs, items, n=60):
    import re

    clean = lambda t: re.sub(r"[\W_]+", "", t.lower())
    runs = {}
    for i, t in items:
        t = clean(t or "")
        for k in range(len(t) - n + 1):
            runs.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for d, t in docs:
        t = clean(t or "")
        for k in range(len(t) - n + 1):
            out |= {(d, i) for i in runs.get(t[k : k + n], ())}
    return out


def fixture():
    rng = random.Random(3)
    items = [(i, " ".join(word(rng) for _ in range(rng.randint(20, 60)))) for i in range(40)] + [(90, "short"), (91, None), (92, "")]
    docs = []
    for d in range(300):
        text = " ".join(word(rng) for _ in range(rng.randint(0, 400)))
        for _ in range(rng.randint(0, 2)):
            t = items[rng.randrange(40)][1]
            a = rng.randrange(len(t))
            piece = t[a : a + rng.randint(40, 110)]
            if rng.random() < 0.5:
                piece = piece.upper().replace(" ", rng.choice(["", "\n", " - "]))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + piece + text[at:]
        docs.append((d, text))
    return docs + [(400, None), (401, ""), (402, "x " * 50_000), (0, docs[0][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = fixture()
    dd = spark.createDataFrame([(*r, 1, "c") for r in docs], "doc_id long, text string, item_id long, terms string")
    ii = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    assert len(expected) > 100
    assert {tuple(r) for r in leaks(dd, ii).collect()} == expected
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 2000)  # several blocks of items
    got = leaks(dd, ii).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert leaks(dd.limit(0), ii).count() == 0 and leaks(dd, ii.limit(0)).count() == 0


def test_wand_equals_exhaustive_scores(monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 2)
    rng = random.Random(5)
    common = [word(rng) for _ in range(12)]
    texts = ["".join(rng.choice(common) for _ in range(rng.randint(15, 40))) for _ in range(60)]
    index = ItemIndex(list(range(60)), texts)
    for _ in range(300):
        query = "".join(rng.choice(common) for _ in range(rng.randint(3, 30)))
        _, terms = index.known(gram_hashes(_codes(query)))
        terms = np.unique(terms)
        score = np.zeros(60)
        for t in terms:
            for p in range(index.start[t], index.start[t + 1]):
                score[index.item[p]] += index.score[p]
        for threshold in (0.3, 1.0):
            assert sorted(index.retrieve(terms, threshold)) == np.flatnonzero(score >= threshold * (1 - 1e-9)).tolist()


def test_least_window():
    """The bound equals a count of the distinct grams of every window, with grams that repeat."""
    rng = random.Random(2)
    for size in (60, 61, 90, 200):
        for letters in ("ab", "abcdefgh"):
            text = "".join(rng.choice(letters) for _ in range(size))
            grams = [int(g) for g in gram_hashes(_codes(text))]
            scores = {g: rng.random() for g in grams}
            window = 60 - leakage.GRAM + 1
            want = min(sum(scores[g] for g in set(grams[i : i + window])) for i in range(len(grams) - window + 1))
            got = leakage._least_window(text, np.array([scores[g] for g in sorted(scores)]), window)
            assert want * (1 - 1e-8) <= got <= want


def test_memory_of_a_full_block():
    """An index of BLOCK_CHARS characters, with every item verified, takes less than 300 MB."""
    import subprocess
    import sys

    code = """
import random, resource
from docketry.llm.leakage import BLOCK_CHARS, ItemIndex
rng = random.Random(1)
texts = ["".join(rng.choices("abcdefghijklmnop0123456789", k=500)) for _ in range(BLOCK_CHARS // 500)]
ids = list(range(len(texts)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = ItemIndex(ids, texts)
assert all(index.shares_run(k, texts[k][100:200]) and not index.shares_run(k, texts[k - 1]) for k in range(len(texts)))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert int(out.stdout) < 300, out.stdout
    print(out.stdout)
