"""Alignment against plain Python over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidebar.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, rid long, pair long, n_a string"


def tokens(text):
    """(id, start, end) of both sides, by the libraries themselves, and by the vocabularies' own files."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    if not tokens.__dict__:
        t = Tokenizer.from_file(A)
        t.encode_special_tokens = True
        with open(A, encoding="utf-8") as f:
            names = {i: x for x, i in json.load(f)["model"]["vocab"].items()}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        tokens.a, tokens.names, tokens.of, tokens.b = t, names, of, sentencepiece.SentencePieceProcessor(model_file=B)
    out = []
    if not text:
        return [], []
    for ids, to_bytes in ((tokens.a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(tokens.of[c] for c in tokens.names[i])), (tokens.b.encode(text), lambda i: bytes([int(p[3:5], 16)]) if len(p := tokens.b.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())):
        at, rows = 0, []
        for i in ids:
            n = len(to_bytes(i))
            rows.append((i, at, at + n))
            at += n
        if b"".join(map(to_bytes, ids)) != b" " + text.encode():
            return [], []
        out.append(rows)
    return out


def brute(rows):
    docs = []
    for doc_id, text in rows:
        a, b = tokens(text)
        link, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                link.append((i, b[k][0], max(s, b[k][1]), min(e, b[k][2])))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, p, q = [], 0, 0
        for cut in cuts:
            x, y = [], []
            while p < len(a) and a[p][2] <= cut:
                x.append(str(a[p][0]))
                p += 1
            while q < len(b) and b[q][2] <= cut:
                y.append(str(b[q][0]))
                q += 1
            groups.append(f"{','.join(x)}|{','.join(y)}")
        docs.append((doc_id, a, b, link, groups))
    count = Counter(x for *_, link, _ in docs for x in {t[:2] for t in link})
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    text = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((d, len(a), len(b), len(g), len(k), sum(count[x[:2]] == top[x[0]] for x in k), sum(count[x[:2]] for x in k), text(g)) for d, a, b, k, g in docs), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ßtion日本🙂.,'\n\t 12") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " ", "a", "  two  spaces ", "▁ kept as it is", "<s> <|endoftext|> </s><0x41>", "x\u0000y", "ﬁ ① ½", "Z" * 3000, " " * 500, "tab\t\r\n" * 40]
    texts += [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(25)]
    return [*enumerate(texts), (3, texts[20]), (None, texts[20]), (None, None)]


@pytest.mark.parametrize(("piece", "at_once", "most"), [(1 << 15, 400_000, 10**9), (40, 300, 10**9), (7, 100, 0), (1 << 15, 2_000, 0)])
def test_alignment_is_that_of_brute_force(spark, rows, monkeypatch, piece, at_once, most):
    monkeypatch.setattr(alignment, "AT_ONCE", at_once)
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, A, B, piece=piece).collect()), key=repr)
    assert got == brute(rows)


def test_links_are_the_overlaps(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(t for _, t in rows)], SCHEMA)
    got = sorted(tuple(r) for r in alignment.links(alignment.pieces_of(df, A, B, piece=25), A, B).drop("rid").collect())
    want = []
    for i, (_, text) in enumerate(rows):
        a, b = tokens(text)
        want += [(i, x, y, max(s, u), min(e, v)) for x, s, e in a for y, u, v in b if max(s, u) < min(e, v)]
    assert got == sorted(want)


def test_pieces_have_equal_work():
    rng = random.Random(9)
    for _ in range(50):
        a, b = (np.array(sorted(rng.sample(range(1, 400), rng.randint(1, 200)))) for _ in range(2))
        piece = rng.choice((2, 5, 16, 1000))
        i, j = alignment.splits(a, b, piece)
        assert (i[-1], j[-1]) == (len(a), len(b)) and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i) + np.diff(j) <= piece + 1).all()
        for p, q in zip(i[1:-1], j[1:-1], strict=True):  # all ends before a cut are less than all after it
            assert max([*a[:p], *b[:q]]) < min([*a[p:], *b[q:], 400])


def test_empty_table_and_query(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)
    assert alignment.align(df.where("false"), A, B).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, str(tmp_path)).collect()), key=repr) == brute(rows)


def test_very_long_texts():
    one = alignment.ByteLevel(A)
    for text in ("a" * 300_000, " " * 300_000, "é日" * 50_000):
        assert b"".join(one.bytes[i] for i in one.encode(text).tolist()) == text.encode()
