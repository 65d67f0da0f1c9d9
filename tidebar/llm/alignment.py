"""Alignment of two tokenizers' tokens by merge-path partitioning.

The ends of a text's A tokens and of its B tokens are two sorted lists. Merging them gives the overlaps: each end in either
list closes a stretch of bytes that lies in one A and one B token. Diagonal binary searches cut the merge into pieces of
equal work, each a row of its own, so that a very long text is many rows. Pieces give their overlaps by themselves; groups
(stretches between bytes where both end a token) that run over a piece's edge are stitched afterwards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.hashing import ranges
from tidebar.llm.store import BROADCAST_BYTES, delete, scope, written

#: Tokens of A and B that a piece has, and tokens that are worked on at once, at most (and a piece more).
PIECE, AT_ONCE = 1 << 15, 400_000
#: Pairs of ids with their counts that are sent to all tasks, at most; more are joined.
MOST_PAIRS = BROADCAST_BYTES // 17


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class ByteLevel:
    """Ids of a byte-level BPE file, without special tokens, and the bytes of each id.

    Where the file has no normaliser and its ids are in the order of its merges, the vocabulary is merged by tiktoken, which
    gives the same ids in a sixth of the time; any other file, and a text that it refuses, goes to tokenizers.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = _byte_of(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(map(of.__getitem__, token))
        self.path, self.slow, self.fast = path, None, None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if plain and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except BaseException as e:  # its regular expressions give up on some very long texts, by a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class Pieces:
    """Ids of a sentencepiece model and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)


_LOADED: dict[tuple, object] = {}


def _loaded(kind: type, path: str):
    """Once a worker."""
    return _LOADED.get((kind, path)) or _LOADED.setdefault((kind, path), kind(path))


def _lengths(tokenizer) -> np.ndarray:
    return np.array([len(b) for b in tokenizer.bytes], dtype=np.int64)


def splits(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted ends a and b come before each cut of their merge into pieces of that many, by binary search on the diagonals; equal ends are not parted."""
    d = np.arange(0, len(a) + len(b), piece, dtype=np.int64)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        before = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)]  # a[mid] is merged before b[d - mid - 1]
        lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    i, j = lo, d - lo
    j = j + ((i > 0) & (j < len(b)) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, len(b) - 1)]))
    return np.append(i, len(a)), np.append(j, len(b))


_PIECES = "batch long, rid long, doc_id long, piece long, pieces long, a binary, b binary, a_from long, b_from long, a_next int, b_next int"


def _encode(path_a: str, path_b: str, piece: int, at_once: int):
    schema = pa.schema([(c, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in _PIECES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _loaded(ByteLevel, path_a), _loaded(Pieces, path_b)
        len_a, len_b = _lengths(one), _lengths(two)
        number = TaskContext.get().partitionId() << 33
        rows, tokens, rid = [], 0, number
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                want = b" " + text.encode()
                a, b = (one.encode(" " + text), two.encode(text)) if text else (np.zeros(0, dtype=np.int64),) * 2
                kept = len_a[a].sum() == len(want)  # a byte-level vocabulary parts bytes, and changes none
                if not kept or b"".join(map(two.bytes.__getitem__, b.tolist())) != want:
                    a = b = np.zeros(0, dtype=np.int64)
                at_a, at_b = np.concatenate([[0], np.cumsum(len_a[a])]), np.concatenate([[0], np.cumsum(len_b[b])])
                i, j = splits(at_a[1:], at_b[1:], piece) if len(a) else (np.zeros(2, dtype=np.int64),) * 2
                for k in range(len(i) - 1):
                    (p, q), (r, s) = i[k : k + 2].tolist(), j[k : k + 2].tolist()
                    after = (int(a[q]) if q < len(a) else -1, int(b[s]) if s < len(b) else -1)
                    rows.append((number, rid, doc_id, k, len(i) - 1, a[p:q].astype("<u2" if len(len_a) <= 1 << 16 else "<u4").tobytes(), b[r:s].astype("<u2" if len(len_b) <= 1 << 16 else "<u4").tobytes(), int(at_a[p]), int(at_b[r]), *after))
                    tokens += q - p + s - r
                    if tokens > at_once:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, tokens, number = [], 0, number + 1
                rid += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pieces_of(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """The tokens of all texts in pieces, as a written table: rid (of the row), doc_id, piece, pieces (of the row), a and b (ids), where they begin, and the ids after them; batch numbers runs of pieces of bounded size.

    Null and empty texts, and those that a tokenizer does not keep byte by byte, have one piece without tokens.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_encode(path_a, path_b, piece, AT_ONCE), _PIECES)
    return written(rows, "pieces")


class Merged:
    """The merge of some pieces, all at once: token ids and groups, and the overlaps (links) in order."""

    def __init__(self, batch: pa.RecordBatch, len_a: np.ndarray, len_b: np.ndarray) -> None:
        begin = np.minimum(batch.column("a_from").to_numpy(), batch.column("b_from").to_numpy())
        self.n = batch.num_rows
        self.base = np.arange(self.n, dtype=np.int64) << 40  # pieces lie apart
        ends, ids = [], []
        for c, length in (("a", len_a), ("b", len_b)):
            width = 2 if len(length) <= 1 << 16 else 4
            column = batch.column(c)
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + self.n + 1].astype(np.int64) // width
            data = column.buffers()[2]
            x = np.frombuffer(data, dtype=f"<u{width}")[offsets[0] : offsets[-1]].astype(np.int64) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.int64)
            count = np.diff(offsets)
            total = np.concatenate([[0], np.cumsum(length[x])])
            first = np.concatenate([[0], np.cumsum(count)])
            shift = self.base + batch.column(f"{c}_from").to_numpy() - begin - total[first[:-1]]
            ends.append(total[1:] + np.repeat(shift, count))
            ids.append((x, count, first))
        (self.a, self.n_a, self.first_a), (self.b, self.n_b, self.first_b) = ids
        self.ends_a, self.ends_b = ends
        both = np.sort(np.concatenate(ends), kind="stable")  # merges two sorted runs
        new = np.concatenate([both[1:] != both[:-1], [True]]) if len(both) else np.zeros(0, dtype=bool)
        self.ends = both[new]
        self.common = both[:-1][~new[:-1]] if len(both) else both
        self.piece = (self.ends >> 40).astype(np.int64)
        # the token of each side in which the bytes before an end lie: the first that ends there or later, or the one after the piece
        link = []
        for x, own, count, first, after in ((self.a, ends[0], self.n_a, self.first_a, "a_next"), (self.b, ends[1], self.n_b, self.first_b, "b_next")):
            at = np.searchsorted(own, self.ends)
            beyond = at >= first[self.piece + 1]
            link.append(np.where(beyond, batch.column(after).to_numpy()[self.piece], x[np.minimum(at, max(len(x) - 1, 0))] if len(x) else -1).astype(np.int64))
        self.link_a, self.link_b = link
        self.pairs = self.link_a << 32 | self.link_b


def _slices(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Batches of few enough tokens."""
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in "ab")) // 2
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + at_once, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _pairs(path_a: str, path_b: str, at_once: int):
    """Pairs of ids that are linked, with how many rows of one piece hold them; of rows of several pieces each pair by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        len_a, len_b = _lengths(_loaded(ByteLevel, path_a)), _lengths(_loaded(Pieces, path_b))
        for batch in _slices(batches, at_once):
            m = Merged(batch, len_a, len_b)
            at, pair = pd.factorize(m.pairs)
            if not len(pair):
                continue
            each = pd.unique(m.piece * len(pair) + at)  # once a piece
            piece, at = each // len(pair), each % len(pair)
            alone = batch.column("pieces").to_numpy()[piece] == 1
            n = np.bincount(at[alone], minlength=len(pair))
            have = np.flatnonzero(n)
            rid = np.asarray(batch.column("rid"))[piece[~alone]]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.nulls(len(have), pa.int64()), pa.array(rid)]), pa.array(np.concatenate([pair[have], pair[at[~alone]]])), pa.array(np.concatenate([n[have], np.ones(len(rid), dtype=np.int64)]).astype(np.int64))], names=["rid", "pair", "n"],
            )

    return run


def pair_counts(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair (A's id shifted left by 32, or'ed with B's), n (rows that hold it linked) and best (n is the highest of A's id), as a written table."""
    found = pieces.mapInArrow(_pairs(path_a, path_b, AT_ONCE), "rid long, pair long, n long")
    keep: list[DataFrame] = []
    with scope(pieces.sparkSession, keep):
        found = written(found, "pairs-found")
        single = found.where("rid is null").select("pair", "n")
        several = found.where("rid is not null").groupBy("rid", "pair").agg(F.lit(1).cast("long").alias("n")).select("pair", "n")
        counts = written(single.unionByName(several).groupBy("pair").agg(F.sum("n").alias("n")), "pairs-counted")
        first = F.shiftright("pair", 32)
        top = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
        out = written(counts.withColumn("a", first).join(top.hint("merge"), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
        keep.append(out)
    return out


_SCORED = "rid long, doc_id long, piece long, pieces long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string, open_a string, open_b string, closed string, rest_a string, rest_b string"


def _texts(m: Merged, names: tuple[list[str], int, int]) -> Iterator[tuple[str, str, str | None, str, str]]:
    """Of each piece: ids of A and B up to its first common end, the groups closed after it, and ids after its last common end. Without a common end the third is None, and all ids are in the first two."""
    table, n_a, n_b = names
    group_a, group_b = np.searchsorted(m.common, m.ends_a), np.searchsorted(m.common, m.ends_b)
    ends_in = np.searchsorted(m.common, np.append(m.base, m.n << 40))  # common ends before each piece
    last_a = np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else np.zeros(0, dtype=bool)
    last_b = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, dtype=bool)
    codes = np.concatenate([m.a + last_a * n_a, 2 * n_a + m.b + last_b * n_b])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    words = list(map(table.__getitem__, codes[order].tolist()))
    group = np.concatenate([group_a, group_b])[order]
    first = m.first_a + m.first_b
    for k in range(m.n):
        i, j, lo, hi = int(ends_in[k]), int(ends_in[k + 1]), int(first[k]), int(first[k + 1])
        own_a, own_b = slice(m.first_a[k], m.first_a[k + 1]), slice(m.first_b[k], m.first_b[k + 1])
        ids = lambda x: [",".join(map(str, v[own][g[own] == x].tolist())) for v, g, own in ((m.a, group_a, own_a), (m.b, group_b, own_b))]  # noqa: E731, B023
        p, q = lo + int(np.searchsorted(group[lo:hi], i, side="right")), lo + int(np.searchsorted(group[lo:hi], j))
        yield (*ids(i), None, "", "") if i == j else (*ids(i), "".join(words[p:q])[:-1], *ids(j))


def _scored(batch: pa.RecordBatch, one: ByteLevel, two: Pieces, names: tuple, pair: np.ndarray, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """Pieces with their numbers; pair is sorted."""
    m = Merged(batch, _lengths(one), _lengths(two))
    at, own = pd.factorize(m.pairs)
    where = np.searchsorted(pair, own)
    count, top = (n[where][at], best[where][at]) if len(own) else (np.zeros(0, dtype=np.int64),) * 2
    sums = [np.bincount(m.piece, minlength=m.n)]
    for x in (top, count):
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        edge = np.concatenate([[0], np.cumsum(sums[0])])
        sums.append(total[edge[1:]] - total[edge[:-1]])
    groups = np.bincount(m.common >> 40, minlength=m.n)
    rows: list[tuple] = []
    for k, parts in enumerate(_texts(m, names)):
        if batch.column("pieces")[k].as_py() == 1:
            head = f"{parts[0]}|{parts[1]}" if m.n_a[k] else ""
            text = head + (";" + parts[2] if parts[2] else "")
            rows.append((hashlib.sha256(text.encode()).hexdigest() if text else "", *(None,) * 5))
        else:
            rows.append((None, *parts))
    columns = [pa.array(x.astype(np.int64)) for x in (m.n_a, m.n_b, groups, *sums)] + [pa.array(c, type=pa.string()) for c in zip(*rows, strict=True)]
    schema = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in (x.split() for x in _SCORED.split(", "))])
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "piece", "pieces")), *columns], schema=schema)


def _names(one: ByteLevel, two: Pieces) -> tuple[list[str], int, int]:
    """Ids as they are written: A's inside a group and at its end, B's the same."""
    n_a, n_b = len(one.bytes), len(two.bytes)
    return [f"{i}{mark}" for n, mark in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)], n_a, n_b


def _score(path_a: str, path_b: str, at_once: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _loaded(ByteLevel, path_a), _loaded(Pieces, path_b)
        names = _names(one, two)
        for batch in _slices(batches, at_once):
            yield _scored(batch, one, two, names, *sent.value)

    return run


def _asked(path_a: str, path_b: str, at_once: int):
    """batch and pair, of each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        len_a, len_b = _lengths(_loaded(ByteLevel, path_a)), _lengths(_loaded(Pieces, path_b))
        for batch in _slices(batches, at_once):
            m = Merged(batch, len_a, len_b)
            own = batch.column("batch").to_numpy()
            for number in np.unique(own):
                pair = pd.unique(m.pairs[own[m.piece] == number])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), number)), pa.array(pair)], names=["batch", "pair"])

    return run


def _score_joined(path_a: str, path_b: str, at_once: int):
    def run(pieces: pa.Table, pairs: pa.Table) -> pa.Table:
        one, two = _loaded(ByteLevel, path_a), _loaded(Pieces, path_b)
        names = _names(one, two)
        pairs = pairs.sort_by("pair").combine_chunks()
        sent = [pairs.column(c).to_numpy() for c in ("pair", "n", "best")]
        out = [_scored(b, one, two, names, *sent) for b in _slices(iter(pieces.combine_chunks().to_batches()), at_once)]
        return pa.Table.from_batches(out)

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored pieces, sorted by rid and piece: one row per rid, its groups hashed as they stream by."""
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in numbers), ("groups_sha256", pa.string())])
    rid, state = None, None

    def finish() -> dict:
        return {"rid": rid, "doc_id": state["doc_id"], **dict(zip(numbers, state["sums"], strict=True)), "groups_sha256": state["hash"].hexdigest()}

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in ("rid", "doc_id", *numbers)}
            if row["rid"] != rid:
                if state is not None:
                    out.append(finish())
                rid, state = row["rid"], {"doc_id": row["doc_id"], "sums": [0] * len(numbers), "hash": hashlib.sha256(), "open": ([], []), "any": False}
            state["sums"] = [x + row[c] for x, c in zip(state["sums"], numbers, strict=True)]
            text = lambda c: list(filter(None, [batch.column(c)[k].as_py()]))  # noqa: E731, B023
            for side, c in zip(state["open"], ("open_a", "open_b"), strict=True):
                side.extend(text(c))
            if not batch.column("closed")[k].is_valid:
                continue
            for part in (f"{','.join(state['open'][0])}|{','.join(state['open'][1])}", *text("closed")):
                state["hash"].update((";" if state["any"] else "").encode())
                state["hash"].update(part.encode())
                state["any"] = True
            state["open"] = (text("rest_a"), text("rest_b"))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([finish()], schema=schema)


def _sent(spark: SparkSession, pairs: DataFrame):
    """All pairs, sorted, for every task; of bounded number."""
    rows = pairs.toArrow().sort_by("pair").combine_chunks()
    return spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (path_a, a byte-level BPE file) encodes a space and the text, B (path_b, a sentencepiece model) the text. Links are
    the pairs of an A and a B token that share bytes, groups end where both end a token. n_best and count_sum are over links:
    how many have the highest count of their A id's pairs, and the sum of counts; a pair's count is the number of rows
    that hold it linked. Texts that are null, empty or not kept byte by byte have no tokens: zeros and an empty
    groups_sha256. Null ids and repeated rows are rows like others. Empty tables give no rows; further columns are not
    looked at. While there are at most MOST_PAIRS different pairs, all tasks get their counts; else each batch of pieces asks
    for its own pairs by a join.
    """
    spark = docs.sparkSession
    keep: list[DataFrame] = []
    with scope(spark, keep):
        pieces = pieces_of(docs, path_a, path_b, id_col, text_col, piece)
        pairs = pair_counts(pieces, path_a, path_b)
        if pairs.count() <= MOST_PAIRS:
            scored = pieces.mapInArrow(_score(path_a, path_b, AT_ONCE, _sent(spark, pairs)), _SCORED)
        else:
            asked = written(pieces.mapInArrow(_asked(path_a, path_b, AT_ONCE), "batch long, pair long"), "pairs-asked").distinct()
            told = written(asked.join(pairs.hint("merge"), "pair").select("batch", "pair", "n", "best"), "pairs-told")  # of a batch, few
            scored = pieces.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_score_joined(path_a, path_b, AT_ONCE), _SCORED)
        scored = written(scored, "scored")
        delete(spark, [pieces._tidebar_path])
        parts = scored.where("pieces > 1").drop("digest", "pieces").repartition("rid").sortWithinPartitions("rid", "piece")
        parts = written(parts.mapInArrow(_stitch, "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "stitched")
        keep += [scored, parts]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    whole = scored.where("pieces = 1").select(*columns, F.col("digest").alias("groups_sha256"))
    return whole.unionByName(parts.drop("rid"))


def links(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The links of pieces_of: rid, doc_id, a_id, b_id, start and end, the bytes that both tokens have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        len_a, len_b = _lengths(_loaded(ByteLevel, path_a)), _lengths(_loaded(Pieces, path_b))
        for batch in _slices(batches, AT_ONCE):
            m = Merged(batch, len_a, len_b)
            begin = np.minimum(batch.column("a_from").to_numpy(), batch.column("b_from").to_numpy())
            reach = np.maximum(batch.column("a_from").to_numpy(), batch.column("b_from").to_numpy())
            end = m.ends - m.base[m.piece] + begin[m.piece]
            start = np.concatenate([[0], end[:-1]]) if len(end) else end
            new = np.concatenate([[True], m.piece[1:] != m.piece[:-1]]) if len(end) else np.zeros(0, dtype=bool)
            start[new] = reach[m.piece[new]]  # where the last end before the piece was
            take = pa.array(m.piece)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rid", "doc_id")), *(pa.array(x.astype(np.int64)) for x in (m.link_a, m.link_b, start, end))], names=["rid", "doc_id", "a_id", "b_id", "start", "end"])

    return pieces.mapInArrow(run, "rid long, doc_id long, a_id long, b_id long, start long, end long")
