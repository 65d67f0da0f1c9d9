"""Repeated windows of words against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidebar.llm import superkmers

SCHEMA = "doc_id long, text string, lang string, ord long, packed string, starts long"


def brute(rows, window=13):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    key = lambda i: -(1 << 63) if i is None else i
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    texts = [None, "", " \n\t ", "one", " ".join(passage), "  ".join(passage) + "\n", "the " * 60, "the " * 30, "a b " * 40, " ".join(passage[:12]), " ".join(passage[:13])]
    for _ in range(30):
        a, b = rng.randint(0, 20), rng.randint(20, 40)
        texts.append(" ".join([word() for _ in range(rng.randint(0, 30))] + passage[a:b] + [word() for _ in range(rng.randint(0, 30))] + ["the"] * rng.randint(0, 25)))
    texts += [" ".join(word() for _ in range(3000)) + " " + " ".join(passage)]
    texts += [texts[-1] + " tail", texts[15], "x" * 50_000 + " " + "y" * 40_000 + " " + texts[4], "Z" * 200_000]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return [*out, (5, texts[4] + " again"), (5, texts[4]), (None, texts[15]), (None, texts[15]), (-7, texts[16])]


@pytest.mark.parametrize(("hot", "part"), [(5_000, 1 << 16), (1, 200), (0, 64)])
def test_windows_are_removed_as_by_brute_force(spark, rows, monkeypatch, hot, part):
    monkeypatch.setattr(superkmers, "HOT", hot)
    monkeypatch.setattr(superkmers, "PART", part)
    monkeypatch.setattr(superkmers.hashing, "CHUNK", part)
    df = spark.createDataFrame([(i, t, "en", 1, "p", 2) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in superkmers.remove_windows(df, keep_text=True).collect()), key=repr)
    assert got == brute(rows)


def test_other_lengths_and_empty_tables(spark, rows):
    df = spark.createDataFrame([(i, t, "en", 1, "p", 2) for i, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in superkmers.remove_windows(df, window=6, keep_text=True).collect()), key=repr) == brute(rows, 6)
    assert superkmers.remove_windows(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        superkmers.remove_windows(df, window=4)


def test_windows_of_super_kmers_are_all_windows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("a", "b", "cc", "the")) for _ in range(n)) for n in (0, 12, 13, 14, 200)]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *map(len, texts)])
    row, first, n, _ = superkmers.super_kmers(np.frombuffer(data, dtype=np.uint8), bounds)
    met = sorted((int(r), int(f) + k) for r, f, m in zip(row, first, n, strict=True) for k in range(m))
    assert met == [(r, k) for r, t in enumerate(texts) for k in range(len(t.split()) - 12)]


def test_equal_numbers_are_equal_windows():
    words = np.array([1, 2, 1, 2, 1, 2, 3] * 9)
    number = superkmers.window_numbers(words, 5)
    same = {}
    for k in range(len(words) - 4):
        same.setdefault(tuple(words[k : k + 5]), set()).add(int(number[k]))
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)
    least, n = superkmers.firsts(pa.array([b"a b c d e f", b"b c d e f", b"a b c d e g"]), np.array([5, 9, 2]), 5)
    assert least.tolist() == [2, 5, 5, 2, 2] and n.tolist() == [2, 1, 2]
