"""Best-fit packing by exact-complement hashing.

Documents are tokenised and cut into pieces of at most one sequence. What is packed is the histogram of piece lengths,
at most capacity rows whatever the corpus: sums of one, two or three available lengths are looked up to fill gaps exactly,
as often as the counts allow, and what is left is packed best fit. The plan assigns ranks among pieces of a length to
places, and pieces take their places by rank, on the executors.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.store import partitions_for, written

CAPACITY = 2048
#: Words whose ids a worker remembers before it drops the older half.
CACHE_WORDS = 400_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks: never letters or digits.
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def _shown() -> dict[int, str]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = _shown()


class WordCache:
    """Ids of texts, by words.

    This vocabulary normalises and splits at white space before merging, so a text's ids are those of its words one
    after the other; words seen before are looked up. A-Z is lower-cased first, as the normaliser does; texts in which
    that could build a special token's name go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        parts = text.encode().lower().replace(b"\n", b" ").split(b" ")
        try:
            return b"".join(map(self.new.__getitem__, parts))
        except KeyError:
            if len(self.new) > CACHE_WORDS:
                self.old, self.new = self.new, {b"": b""}
            self.learn(set(parts).difference(self.new))
            return b"".join(map(self.new.__getitem__, parts))

    def learn(self, missing: set[bytes]) -> None:
        unknown, joint = set(), []
        for w in missing:
            if (ids := self.old.get(w)) is not None:
                self.new[w] = ids
                continue
            stem = w.rstrip(_MARKS)
            if len(stem) < len(w) and stem[-1:].isalpha():  # letters and the marks after them are merged apart
                joint.append((w, stem, w[len(stem) :]))
                unknown.update(x for x in joint[-1][1:] if x not in self.new)
            else:
                unknown.add(w)
        others = []
        for w in unknown:
            text = w.decode()
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):  # nothing to normalise or split
                ids = [t.id for t in self.model.tokenize(w.decode("latin-1").translate(_SHOWN))]
                self.new[w] = np.array(ids, dtype="<u4").tobytes()
            else:
                others.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
        self.new.update((w, np.array(x.ids, dtype="<u4").tobytes()) for w, x in zip(others, found, strict=True))
        self.new.update((w, self.new[a] + self.new[b]) for w, a, b in joint)


_CACHES: dict[str, WordCache] = {}


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        cache = _CACHES.get(path) or _CACHES.setdefault(path, WordCache(path))
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = cache.encode(text.as_py() or "") + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    values = (doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<i4"))
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32 (and with keep_ids, ids). Null text is empty: the end id alone."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_cut(path or tokenizer_path(), capacity, end_id, keep_ids), schema)


def _take(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often all of lengths together are available."""
    return min(int(counts[x]) // lengths.count(x) for x in set(lengths))


def _pair(counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two available lengths of that sum, the larger one as large as can be."""
    a = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
    ok = (counts[a] > 0) & (counts[gap - a] > 0) & ((2 * a != gap) | (counts[a] > 1))
    return (int(a[k]), gap - int(a[k])) if len(a) and ok[k := int(ok.argmax())] else None


def _triple(counts: np.ndarray, gap: int) -> tuple[int, int, int] | None:
    sums = np.convolve(counts > 0, counts > 0)  # which sums some pair has
    for a in np.flatnonzero(counts[: gap - 1])[::-1]:
        if sums[gap - a] > 0:
            counts[a] -= 1
            two = _pair(counts, gap - int(a))
            counts[a] += 1
            if two:
                return int(a), *two
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns with how many sequences follow each: (number, ((length, times), ...)). Every piece is used once.

    Its size is bounded by capacity, not by the numbers of pieces: each step uses up a length or a pattern.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    found: dict[tuple[int, ...], int] = {}

    def use(lengths: tuple[int, ...], n: int) -> None:
        for x in lengths:
            counts[x] -= n
        key = tuple(sorted(lengths, reverse=True))
        found[key] = found.get(key, 0) + n

    if counts[capacity]:
        use((capacity,), int(counts[capacity]))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        while counts[length]:
            counts[length] -= 1
            others: tuple[int, ...] | None = (gap,) if counts[gap] else _pair(counts, gap) or _triple(counts, gap)
            counts[length] += 1
            if others is None:
                break
            use((length, *others), _take(counts, (length, *others)))
    done = [(n, key) for key, n in found.items()]
    # what is left: longest first into the tightest open gap, all sequences of a pattern at once
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        while n := int(counts[length]):
            gap = min((g for g, x in open_.items() if x and g >= length), default=None)
            key, room = open_[gap].pop() if gap is not None else ((), n)
            gap = capacity if gap is None else gap
            times = min(gap // length, n)
            used = min(room, n // times)
            if key and used < room:
                open_[gap].append((key, room - used))
            open_.setdefault(gap - times * length, []).append(((*key, *(length,) * times), used))
            counts[length] -= used * times
    done += [(n, key) for group in open_.values() for key, n in group]
    return [(n, tuple((x, key.count(x)) for x in dict.fromkeys(key))) for n, key in done]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """The plan as rows (length, first rank, sequences, times in each, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for n, key in patterns:
        offset = 0
        for length, times in key:
            rows.append((length, rank.get(length, 0), n, times, sequence, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += length * times
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def _placer(table: np.ndarray):
    key = (table[:, 0] << 48) + table[:, 1]

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy(dtype=np.int64)
        row = table[np.searchsorted(key, (length.to_numpy(dtype=np.int64) << 48) + r, side="right") - 1]
        at = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 4] + at // row[:, 3], "offset": row[:, 5] + at % row[:, 3] * row[:, 0]})

    return F.pandas_udf(place, "sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Packs documents: one row per piece with doc_id, piece, start, length, ids_crc32, sequence_id and offset (and ids with keep_ids).

    Null and empty texts are the end id alone; long texts are cut into full pieces and a rest. Null ids and repeated rows
    are packed as they come. Empty tables give no rows; further columns are not looked at. Ranks among equal lengths are
    numbered per bucket of ids, so a length that a third of all pieces have spreads over the buckets.
    """
    spark = docs.sparkSession
    pieces = written(cut_documents(docs, path, capacity, 0, id_col, text_col, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    buckets = partitions_for(spark, sum(histogram.values()), 50_000)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
    table = places(plan(histogram, capacity))
    out = ranked.withColumn("place", _placer(table)("length", "rank"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *(["ids"] if keep_ids else []))
