"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from tidebar.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(convs):
    """convs: id to list of (role, text)."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * (len(re.findall(prefix_trie.WORD, q[-1][1])) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, text))
    return {c: [(x[1], x[3]) for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 45), 60, 61, 99, 100, 119, 9000, 9001]:
        if c == 40:
            continue
        n = rng.choice((1, 1, 2, 3, 4, 7, 8, 9, 17))
        out += [(c, t, rng.choice(("user", "assistant", None)) if t > 2 else "user", rng.choice(("a b", "c  d\te", None, "", "ß x")) if t > 1 else "hello there", 1, "k") for t in range(n)]
    long = [(c, t, "user", f"turn {t} of a long one", 1, "k") for c in (200, 201, 202) for t in range(30 if c < 202 else 41)]
    long[12] = (200, 12, "user", "another", 1, "k")
    out += long + [(300, None, "user", "first", 1, "k"), (300, 1, "user", "x", 1, "k"), (300, 1, "assistant", "x", 1, "k"), (300, 1, "user", "x", 1, "k"), (None, 1, "user", "x", 1, "k")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width", [2, 8])
def test_trie_is_that_of_brute_force(spark, rows, width, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_TOGETHER", 7)
    monkeypatch.setattr(prefix_trie, "BLOCKS_TOGETHER", 3)
    got = [tuple(r) for r in prefix_trie.of_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ordered(rows))


def test_query_rebuilds_conversations(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op11_prefix_trie(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt(ordered(rows)))


def test_ended_conversations_and_empty_tables(spark):
    one = spark.createDataFrame([(7, None, None, None, 1, "k")], SCHEMA)
    assert [tuple(r)[:7] for r in prefix_trie.of_conversations(one).orderBy("depth").collect()] == [(7, 0, None, 1, 1, 1, 0), (7, 1, 7, 1, 0, 1, 0)]
    none = one.where("false")
    assert prefix_trie.of_conversations(none).count() == 0
    bare = prefix_trie.prefix_trie(prefix_trie.numbered(none), one.select("conv_id"))  # a conversation without turns
    assert [tuple(r) for r in bare.collect()] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_very_long_text(spark):
    words = "w " * 200_000
    df = spark.createDataFrame([(c, 0, "user", words, 1, "k") for c in range(3)], SCHEMA)
    assert {r["saved_tokens"] for r in prefix_trie.of_conversations(df).collect()} == {400_000}
