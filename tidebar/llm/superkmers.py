"""Repeated word windows by super-k-mer partitioning.

The minimiser of a window is the run of words of least hash in it, taken with the words next to it on the side on which
the window has more. Consecutive windows mostly share theirs, so they travel together as one packed string (a
super-k-mer) to the bucket of the minimiser; equal windows have equal minimisers and meet there. A bucket sorts its
windows, by exact numbers of their words, and knows of each in which document it comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm import hashing
from tidebar.llm.store import delete, scope, small, written

#: Words of a window, and of a minimiser without those at its side.
WINDOW, MINIMISER = 13, 4
#: Distinct super-k-mers of a minimiser above which its windows travel one by one, by their own words; and about how many super-k-mers a bucket has.
HOT, IN_BUCKET = 5_000, 20_000
#: Bytes of text taken at a time; a longer text is cut at blanks.
PART = 1 << 16
_BITS = np.uint64((1 << 21) - 1)
#: Windows of a super-k-mer are fewer than this, in bits.
_FEW = 6
_BLANKS = r"[\x20\x09-\x0D]+"


def words_only(text: Column) -> Column:
    """The words of text joined by one space each; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "))


def _parts(raw: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows in parts of about PART bytes: first row, words of it that come before, bytes, and where rows begin and end in them. Parts of a long text share the words that no window of the earlier part begins with."""
    for i, j in hashing.chunks(at, PART):
        lo, hi = int(at[i]), int(at[j])
        if j > i + 1 or hi - lo <= PART:
            yield i, 0, raw[lo:hi], at[i : j + 1] - at[i]
            continue
        text, done, a, size = raw[lo:hi].tobytes(), 0, 0, PART
        while True:
            b = text.find(b" ", a + size)
            b = again = len(text) if b < 0 else b
            for _ in range(window - 1):
                again = text.rfind(b" ", a, again) if again > a else -1
            if again < 0 and b < len(text):  # fewer words than a window
                size *= 2
                continue
            yield i, done, raw[lo + a : lo + b], np.array([0, b - a])
            if b == len(text):
                break
            done += text.count(b" ", a, again) + 1
            a, size = again + 1, PART


def _word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and how many words each row has; words are separated by one space and rows by nothing."""
    space = data == 32
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds[:-1][np.diff(bounds) > 0]] = True
    begins = edge[: len(data)].copy()
    begins[1:] |= space[:-1]
    ends = np.zeros(len(data), dtype=bool)
    ends[bounds[1:][np.diff(bounds) > 0] - 1] = True
    ends[:-1] |= space[1:]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.diff(np.searchsorted(s, bounds))


def super_kmers(data: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: row, first window (by its first word in the row), number of windows and minimiser of each super-k-mer."""
    s, e, counts = _word_bounds(data, bounds)
    begin = np.concatenate([[0], np.cumsum(counts)])
    has = np.flatnonzero(counts >= window)
    if not len(has):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    q = hashing.prefix_sums(data)
    h = hashing.mix(hashing.window_hash(q, s, e) + (e - s).astype(np.uint64))
    grams = h[: len(h) - MINIMISER + 1].copy()
    for k in range(1, MINIMISER):
        grams = hashing.mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - MINIMISER + 1 + k])
    least = (grams & ~_BITS) | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal ones
    span, width = 1, window - MINIMISER + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    at = (least & _BITS).astype(np.int64)
    # windows that lie in a row, in runs with the same minimiser
    starts = hashing.ranges(begin[has], counts[has] - window + 1)
    row = np.repeat(has, counts[has] - window + 1)
    side = (window - MINIMISER + 1) // 2
    from_ = at[starts]
    left = from_ - starts >= side
    from_ = from_ - side * left
    new = np.concatenate([[True], (from_[1:] != from_[:-1]) | (left[1:] != left[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    key = left[first].astype(np.uint64)
    for k in range(MINIMISER + side):
        key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + h[from_[first] + k])
    return row[first], starts[first] - begin[row[first]], np.diff(np.concatenate([first, [len(starts)]])), key


def _find(window: int, count: bool):
    """Super-k-mers' minimisers: with how often each is met in a batch (count), or with row and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column("text"))
            rows, places, found = [], [], []
            for i, before, data, bounds in _parts(raw, at, window):
                row, first, n, minimiser = super_kmers(data, bounds, window)
                rows.append(row + i)
                places.append((first + before) << _FEW | n)
                found.append(minimiser.view(np.int64))
            row, place, minimiser = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (rows, places, found))
            if count:
                minimiser, n = np.unique(minimiser, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(minimiser), pa.array(n.astype(np.int64))], names=["minimiser", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(minimiser), pa.array(np.asarray(batch.column("rid"))[row]), pa.array(place)], names=["minimiser", "rid", "place"])

    return run


def _gather(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes start to end of raw, each as a value."""
    data = raw[hashing.ranges(start, end - start)]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _pack(window: int):
    """Of texts with their found super-k-mers: each as a packed string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column("text"))
            for i, j in hashing.chunks(at, 16 * PART):
                text, bounds = raw[int(at[i]) : int(at[j])], at[i : j + 1] - at[i]
                s, e, counts = _word_bounds(text, bounds)
                found = batch.column("found").slice(i, j - i)
                row = np.repeat(np.arange(j - i), np.asarray(found.value_lengths()))
                x = found.flatten()
                place = x.field("place").to_numpy()
                first, n = place >> _FEW, place & ((1 << _FEW) - 1)
                word = np.concatenate([[0], np.cumsum(counts)])[row] + first
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rid", "ord")), pa.array(first), x.field("minimiser"), _gather(text, s[word], e[word + n + window - 2])], names=["rid", "ord", "first", "minimiser", "packed"])

    return run


_PACKED = "rid long, ord long, first long, minimiser long, packed binary"


def _single(window: int):
    """Packed strings as those of their single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column("packed"))
            s, e, counts = _word_bounds(raw[at[0] : at[-1]], at - at[0])
            begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
            n = counts - window + 1
            start = hashing.ranges(begin, n)
            row = np.repeat(np.arange(len(n)), n)
            take = pa.array(row)
            firsts = np.asarray(batch.column("first"))[row] + start - begin[row]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rid", "ord")), pa.array(firsts), batch.column("minimiser").take(take), _gather(raw[at[0] : at[-1]], s[start], e[start + window - 1])], names=["rid", "ord", "first", "minimiser", "packed"])

    return run


def _numbers(values: np.ndarray) -> np.ndarray:
    """Equal values by the same number."""
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def window_numbers(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for the window from every place on, the same for equal windows only: pairs of numbers are sorted and numbered anew at doubled lengths."""
    size, out = 1, ids.astype(np.int64)
    while size < window:
        step = min(size, window - size)
        out = _numbers(out[:-step] << 32 | out[step:])
        size += step
    return out


def firsts(packed: pa.Array, ords: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least ord of each window of the packed strings, one after the other, and how many windows each has."""
    raw, at = hashing.utf8(packed)
    raw, at = raw[at[0] : at[-1]], at - at[0]
    s, e, counts = _word_bounds(raw, at)
    ids = _gather(raw, s, e).dictionary_encode().indices.to_numpy()
    n = counts - window + 1
    starts = hashing.ranges(np.concatenate([[0], np.cumsum(counts)])[:-1], n)
    number = _numbers(window_numbers(ids, window)[starts])
    least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, np.repeat(ords, n))
    return least[number], n


def _bucket(window: int):
    """Rows sorted by bucket: super-k-mers of which some occurrence is not the first of a window, with the least ord of each window."""

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        all_ = pa.Table.from_batches(rows).combine_chunks()
        packed = all_.column("packed").combine_chunks()
        least, n = firsts(packed, all_.column("least").to_numpy(), window)
        begin = np.concatenate([[0], np.cumsum(n)])
        late = np.minimum.reduceat(least, begin[:-1]) < all_.column("most").to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(least))
        return pa.RecordBatch.from_arrays([all_.column("minimiser").combine_chunks(), packed, lists], names=["minimiser", "packed", "firsts"]).filter(pa.array(late))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            now = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(now[1:] != now[:-1]) + 1).tolist(), len(now)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if bucket is not None and now[a] != bucket:
                    yield finish(rows)
                    rows = []
                bucket = now[a]
                rows.append(batch.slice(a, b - a))
        if rows:
            yield finish(rows)

    return run


def _remove(window: int):
    schema = pa.schema([("rid", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column("text"))
            rows = []
            for k in range(batch.num_rows):
                text = raw[at[k] : at[k + 1]]
                s, e, _ = _word_bounds(text, np.array([0, len(text)]))
                first, late = (batch.column("late")[k].values.field(c).to_numpy() for c in ("first", "late"))
                starts = np.concatenate([first[late >> b & 1 == 1] + b for b in range(int(late.max()).bit_length())])
                edges = np.zeros(len(s) + 1, dtype=np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept = text[np.repeat(~gone, np.diff(np.append(s, len(text))))].tobytes().removesuffix(b" ")  # words with the space after them
                rows.append({"rid": batch.column("rid")[k].as_py(), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept.decode()})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _digest() -> Column:
    """By which occurrences of a packed string find it again: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2("packed", 256), 1, 32))


def repeated_windows(base: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of base (rid, ord, text: words joined by one space) the windows that also start in a row of lesser ord: rid, and late, structs of a first word and the bits of those windows that begin there or after.

    Only super-k-mers whose minimiser is met more than once travel, as no other window can be met again. Of each distinct
    one the least ord goes to its bucket, so a passage that any number of documents share is one string there. A
    minimiser of more than HOT distinct super-k-mers, as frequent words or lines have, has its windows travel one by one:
    grouped by all their words they need no bucket.
    """
    spark = base.sparkSession
    keep: list[DataFrame] = []
    with scope(spark, keep):
        counted = base.select("text").mapInArrow(_find(window, True), "minimiser long, n long")
        again = written(counted.groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1").select("minimiser"), "again")
        shared = base.select("rid", "text").mapInArrow(_find(window, False), "minimiser long, rid long, place long").join(again.hint("shuffle_hash"), "minimiser")
        per = written(shared.groupBy("rid").agg(F.collect_list(F.struct("minimiser", "place")).alias("found")), "found")  # of one document
        texts = base.select("rid", "ord", "text").join(per.hint("shuffle_hash"), "rid")
        packed = written(texts.mapInArrow(_pack(window), _PACKED), "super-kmers")
        delete(spark, [per._tidebar_path, again._tidebar_path])
        one = written(packed.groupBy("minimiser", "packed").agg(F.min("ord").alias("least"), F.max("ord").alias("most")), "distinct")
        hot = written(one.groupBy("minimiser").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("minimiser"), "hot")
        # the others, by buckets
        rest = one.join(small(hot), "minimiser", "left_anti")
        buckets = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), one.count() // IN_BUCKET)
        rest = rest.withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket")
        late = written(rest.mapInArrow(_bucket(window), "minimiser long, packed binary, firsts array<long>").select("minimiser", _digest().alias("digest"), "firsts"), "late")
        delete(spark, [one._tidebar_path])
        met = packed.select("minimiser", _digest().alias("digest"), "rid", "ord", "first").join(late.hint("merge"), ["minimiser", "digest"])
        bits = F.transform("firsts", lambda least, k: F.when(F.col("ord") > least, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(0))
        starts = met.select("rid", "first", F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x + y).alias("late")).where("late > 0")
        if not hot.isEmpty():
            single = written(packed.join(small(hot), "minimiser", "left_semi").mapInArrow(_single(window), _PACKED), "windows")
            least = single.groupBy("packed").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("most > least").drop("most")
            met = single.join(written(least, "late-windows").hint("merge"), "packed").where("ord > least")
            starts = starts.unionByName(met.select("rid", "first", F.lit(1).cast("long").alias("late")))
        out = written(starts.groupBy("rid").agg(F.collect_list(F.struct("first", "late")).alias("late")), "starts")  # of one document
        keep.append(out)
    return out


def remove_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and with keep_text, kept: the words left, joined by one space).

    Words are runs of characters other than blanks (space, tab to carriage return). Removed is each word of a run of window
    words that also starts in a row of smaller id; rows that share an id do not count for each other, and a null id is the
    least number. Null text has no words; texts of fewer words than a window keep all. Repeated rows are judged alike.
    Empty tables give no rows; further columns are not looked at. Long texts are hashed in parts.
    """
    if not MINIMISER < window < 1 << _FEW:
        raise ValueError(f"a window must have more words than a minimiser ({MINIMISER}) and fewer than {1 << _FEW}")
    keep: list[DataFrame] = []
    with scope(docs.sparkSession, keep):
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_only(F.col(text_col)).alias("text")).withColumn("rid", F.monotonically_increasing_id())
        n_words = F.when(F.col("text") == "", 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long")
        base = written(base.select("doc_id", "rid", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("ord"), n_words.alias("n_words"), F.sha2("text", 256).alias("sha"), "text"), "words")
        starts = repeated_windows(base.where(F.col("n_words") >= window), window)
        keep += [base, starts]
    changed = base.select("rid", "text").join(starts.hint("shuffle_hash"), "rid").mapInArrow(_remove(window), "rid long, n_removed long, kept_sha256 string, kept string")
    if not keep_text:
        changed, base = changed.drop("kept"), base.drop("text")
    out = base.join(changed, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *([F.coalesce("kept", "text").alias("kept")] if keep_text else []))
