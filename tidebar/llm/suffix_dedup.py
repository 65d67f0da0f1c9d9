"""Repeated substrings by distributed prefix doubling.

Positions are ranked by what they begin with, at growing lengths: Spark sorts pairs of a position's rank and the bytes that
follow at the next offset, ranks them anew, and lets positions go whose rank is unique, until the length asked for is
reached. The first ranking is sparse. Every window of that length has an anchor, the k-gram of least hash in it, and equal
windows have equal anchors at equal places; so anchors are ranked first, and of each anchor that is not unique the windows
around it are ranked together, in ever shorter stretches of neighbours: what all windows of a stretch have in common grows
as the stretch gets shorter, until it is one window. A stretch that is a copy as a whole needs no further ranking.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import hashing
from tidebar.llm.store import delete, scope, small, written

#: Bytes of a repeated string, and of an anchor.
LENGTH, ANCHOR = 100, 28
#: Windows of a stretch, by round, after the first round, in which it has all windows of an anchor; each is a multiple of the next.
STRETCHES = (8, 1)
#: Rows made at a time, at least, and bytes hashed at a time (their hashes stay in a core's cache).
AT_ONCE, PART = 50_000, 1 << 16
#: Anchors that are counted together in a task, and about how many hashes a bucket of them has.
TOGETHER, IN_BUCKET = 500_000, 500_000
_BITS = np.uint64((1 << 21) - 1)

#: Place of an anchor: its position, how far before it its first window begins, and how many more windows there are, the latter two in so many bits.
_ANCHORS, _SHORT = "anchor long, rid long, place long", 15


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: each anchor's hash and place, and the first and last window that it is the anchor of; places in data."""
    n = len(data)
    inside = np.diff(bounds) >= length
    if not inside.any():
        return (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
    h = hashing.mix(hashing.all_windows(data, ANCHOR))
    least = (h & ~_BITS) | np.arange(n - ANCHOR + 1, dtype=np.uint64)  # the leftmost of equal ones
    span, width = 1, length - ANCHOR + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    pos = (least & _BITS).astype(np.int64)
    # runs of windows with the same anchor, then cut to windows inside one text
    new = np.flatnonzero(pos[1:] != pos[:-1]) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(pos)]]) - 1
    begin, end = bounds[:-1][inside], bounds[1:][inside] - length
    i, j = (np.searchsorted(first, x, side="right") - 1 for x in (begin, end))
    run, text = hashing.ranges(i, j - i + 1), np.repeat(np.arange(len(begin)), j - i + 1)
    at = pos[first[run]]
    return h[at], at, np.maximum(first[run], begin[text]), np.minimum(last[run], end[text])


def _parts(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in parts of about PART bytes: first row, bytes, and where each row begins and ends in them; a long text in overlapping parts."""
    for i, j in hashing.chunks(at, PART):
        if j > i + 1:
            yield i, raw[int(at[i]) : int(at[j])], at[i : j + 1] - at[i]
            continue
        for lo in range(int(at[i]), max(int(at[j]) - length + 1, int(at[i]) + 1), PART):
            hi = min(lo + PART + length - 1, int(at[j]))
            yield i, raw[lo:hi], np.array([0, hi - lo])


def _count(length: int, bits: int):
    """Hashes of anchors, packed by their first bits: those met once, and those met again, in some megabytes of text."""

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        spans = [(k, a, b) for k, (a, b) in enumerate(itertools.pairwise(cuts.tolist())) if a < b]
        packed = [[h[a:b][(n[a:b] > 1) == again].tobytes() for _, a, b in spans] for again in (False, True)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, *_ in spans], type=pa.int32()), *(pa.array(x, type=pa.binary()) for x in packed)], names=["bucket", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            raw, at = hashing.utf8(batch.column("text"))
            found += [anchors(data, bounds, length)[0] for _, data, bounds in _parts(raw, at, length)]
            if sum(map(len, found)) > TOGETHER:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: the hashes that are met more than once."""
    bucket, once, again = None, [], []

    def finish() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(once + again), return_counts=True)
        twice = np.unique(np.concatenate([h[n > 1], *again]))
        return pa.RecordBatch.from_arrays([pa.array(twice.view(np.int64))], names=["anchor"])

    for batch in batches:
        for now, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "once", "again")), strict=True):
            if now != bucket and once:
                yield finish()
                once, again = [], []
            bucket = now
            once.append(np.frombuffer(a, dtype=np.uint64))
            again.append(np.frombuffer(b, dtype=np.uint64))
    if once:
        yield finish()


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column("text"))
            columns: list[list[np.ndarray]] = [[], [], []]
            done = 0  # where the next part of a long text begins
            for i, data, bounds in _parts(raw, at, length):
                h, pos, first, last = anchors(data, bounds, length)
                row = np.searchsorted(bounds, first, side="right") - 1
                base = bounds[row]
                if len(bounds) == 2:
                    base, done = -done, done + PART
                    if done >= int(at[i + 1] - at[i]) - length + 1:
                        done = 0
                for column, x in zip(columns, (h.view(np.int64), row + i, ((pos - base) << 2 * _SHORT) + ((pos - first) << _SHORT) + last - first), strict=True):
                    column.append(x)
            h, row, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in columns)
            rid = np.asarray(batch.column("rid"))[row]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rid), pa.array(place)], names=["anchor", "rid", "place"])

    return run


def _contexts(length: int):
    """Of each anchor the bytes of all its windows, and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column("text"))
            for k in range(batch.num_rows):
                found = batch.column("found")[k].values.to_numpy()
                pos = found >> 2 * _SHORT
                first = pos - (found >> _SHORT & (1 << _SHORT) - 1)
                last = first + (found & (1 << _SHORT) - 1)
                text = raw[at[k] : at[k + 1]].tobytes()
                context = [text[a : b + length] for a, b in zip(first, last, strict=True)]
                before = (pos - first).astype("<i4").tobytes()  # with the number of bytes, this fixes which windows there are
                digest = [hashlib.blake2b(before[4 * i : 4 * i + 4] + c, digest_size=16).digest() for i, c in enumerate(context)]
                same = pa.array(np.full(len(context), batch.column("ord")[k].as_py()))
                yield pa.RecordBatch.from_arrays([same, *(pa.array(x.astype(np.int32)) for x in (pos, first, last)), pa.array(digest, type=pa.binary()), pa.array(context, type=pa.binary())], names=["ord", "pos", "first", "last", "digest", "context"])

    return run


_CONTEXTS = "ord long, pos int, first int, last int, digest binary, context binary"


def _common(node: int, size: int, length: int) -> tuple[int, int]:
    """What all windows of a stretch share, from and to, with the anchor at 0: those that begin node * size to node * size + size - 1 bytes before it."""
    return -node * size, length - min(node * size + size - 1, length - ANCHOR)


def _pieces(length: int, size: int, parent: int):
    """Rows of contexts with their stretches of the round before (struct of node and rank): each shorter stretch, with the bytes it has in common beyond the longer one's."""

    def rows(batch: pa.RecordBatch, row: list[int], nodes: list[int], ranks: list[int], pieces: list[bytes]) -> pa.RecordBatch:
        take = pa.array(row, type=pa.int64())
        own = [batch.column(c).take(take) for c in ("ord", "pos")]
        return pa.RecordBatch.from_arrays([*own, pa.array(nodes, type=pa.int32()), pa.array(ranks, type=pa.int64()), pa.array(pieces, type=pa.binary())], names=["ord", "pos", "node", "rank", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = [_common(n, size, length) for n in range((length - ANCHOR) // size + 1)]
        wide = [_common(n, parent, length) for n in range((length - ANCHOR) // parent + 1)] if parent else []
        for batch in batches:
            row, nodes, ranks, pieces = [], [], [], []
            pos, first, last = (batch.column(c).to_pylist() for c in ("pos", "first", "last"))
            context = batch.column("context").to_pylist()
            known = batch.column("known").to_pylist() if parent else None
            for k, text in enumerate(context):
                least, most, at = pos[k] - last[k], pos[k] - first[k], pos[k] - first[k]
                if not parent:
                    row.append(k)
                    nodes.append(0)
                    ranks.append(0)
                    pieces.append(text[at : at + ANCHOR])
                    continue
                for x in known[k]:
                    over, rank = x["node"], x["rank"]
                    c, d = wide[over]
                    for n in range(max(over * parent, least) // size, min(over * parent + parent - 1, most) // size + 1):
                        a, b = spans[n]
                        row.append(k)
                        nodes.append(n)
                        ranks.append(rank)
                        pieces.append(text[at + a : at + c] + text[at + d : at + b])
                if len(row) > AT_ONCE:
                    yield rows(batch, row, nodes, ranks, pieces)
                    row, nodes, ranks, pieces = [], [], [], []
            yield rows(batch, row, nodes, ranks, pieces)

    return run


_PIECES = "ord long, pos int, node int, rank long, piece binary"


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans: their starts and ends."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        rows = []
        raw, at = hashing.utf8(batch.column("text"))
        for k in range(batch.num_rows):
            text = raw[at[k] : at[k + 1]].tobytes()
            spans = batch.column("spans")[k].values
            start, end = merged(*(spans.field(c).to_numpy() for c in ("start", "end")))
            kept = b"".join(text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True))
            rows.append({"rid": batch.column("rid")[k].as_py(), "n_removed": len(text) - len(kept), "n_spans": len(start), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _order():
    """The order of occurrences of a string whose place to its anchor is given."""
    return F.struct("ord", "pos")


def _ranked(rows: DataFrame, *key: str) -> DataFrame:
    """Groups of rows with the same key, of which there are several, and the earliest of each. For joins that can be split, as each group is one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(_order()).alias("least")).where("n > 1").drop("n")


def repeated_spans(base: DataFrame, order: DataFrame, n_bytes: int, length: int = LENGTH) -> DataFrame:
    """Spans ord, start, end that cover, per row of base (rid, text), all bytes of strings of that length which also start earlier. order: rid and ord, the rows' order; n_bytes: of all texts, about.

    Ranks are made of bytes: that of the anchor, then pairs of a rank and the next bytes. Only whole stretches of windows
    are told to be copies by a digest (BLAKE2b, 128 bits). Groups of any size are counted with map-side combining and
    joined, and the join can be split.
    """
    spark, keep = base.sparkSession, []
    with scope(spark, keep):
        bits = max(6, (n_bytes // (length // 3 * IN_BUCKET)).bit_length())
        buckets = base.select("text").mapInArrow(_count(length, bits), "bucket int, once binary, again binary").repartition("bucket").sortWithinPartitions("bucket")
        again = written(buckets.mapInArrow(_shared, "anchor long"), "again")
        shared = base.select("rid", "text").mapInArrow(_find(length), _ANCHORS).join(again.hint("shuffle_hash"), "anchor")
        per = written(shared.groupBy("rid").agg(F.collect_list("place").alias("found")).join(order, "rid"), "anchors")  # of one document
        texts = base.join(small(per.select("rid")), "rid", "left_semi")
        contexts = texts.join(per.hint("shuffle_hash"), "rid").select("ord", "text", "found").mapInArrow(_contexts(length), _CONTEXTS)
        contexts = written(contexts, "contexts")
        # all windows of an anchor at once
        state = contexts.select("ord", "pos", "first", "last", "digest").join(written(_ranked(contexts, "digest"), "copies").hint("shuffle_hash"), "digest", "left")
        state = written(state.select("ord", "pos", "first", "last", (F.col("least").isNotNull() & (_order() != F.col("least"))).alias("later")), "wholes")
        spans = state.where("later").select("ord", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
        rest = written(contexts.drop("digest").join(state.where("not later").select("ord", "pos").hint("shuffle_hash"), ["ord", "pos"], "left_semi"), "rest")
        keep += [state, rest]
    rows, met, parent = rest, None, 0
    for size in (length - ANCHOR + 1, *STRETCHES):
        if met is not None:
            known = met.groupBy("ord", "pos").agg(F.collect_list(F.struct("node", "rank")).alias("known"))  # of one anchor
            rows = rest.join(known.hint("shuffle_hash"), ["ord", "pos"])
        keep = []
        with scope(spark, keep):
            pieces = written(rows.mapInArrow(_pieces(length, size, parent), _PIECES), "pieces")
            delete(spark, [] if met is None else [met._tidebar_path, *([rest._tidebar_path] if size == 1 else [])])
            groups = _ranked(pieces, "rank", "node", "piece").withColumn("id", F.monotonically_increasing_id())
            groups = written(groups.drop("least" if size > 1 else "id"), "ranks")
            kept = pieces.join(groups.hint("shuffle_hash"), ["rank", "node", "piece"])
            if size > 1:
                met, parent = written(kept.select("ord", "pos", "node", F.col("id").alias("rank")), "met"), size
                keep.append(met)
            else:
                late = kept.where(_order() != F.col("least")).select("ord", (F.col("pos") - F.col("node")).alias("start"))
                spans = spans.unionByName(late.withColumn("end", F.col("start") + length))
                keep += [pieces, groups]
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with keep_text, kept: the bytes left).

    Removed is each byte covered by a string of length bytes that also starts earlier: in a row of smaller id (null is
    smallest, rows that share an id count in the order in which they are read), or earlier in the same text. Null text is
    empty; shorter texts keep all. Empty tables give no rows; further columns are not looked at. Rows are numbered once, in
    a written table. Of equal texts all but those of the least id lose everything, before any others are looked at. Texts
    of any length are hashed in parts.
    """
    if any(a % b for a, b in zip(STRETCHES, STRETCHES[1:], strict=False)) or STRETCHES[-1] != 1 or not ANCHOR < length < 1 << _SHORT:
        raise ValueError("each of STRETCHES must be a multiple of the next and the last one 1; length must exceed ANCHOR and be under 32768")
    keep: list[DataFrame] = []
    with scope(docs.sparkSession, keep):
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        base = base.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), "text")
        base = written(base, "texts")
        thin = base.drop("text").where(F.col("n_bytes") >= length)
        groups = thin.groupBy("sha", "n_bytes").agg(F.min(F.struct("doc_id")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = written(thin.join(written(groups, "groups").hint("shuffle_hash"), ["sha", "n_bytes"]).where(~F.struct("doc_id").eqNullSafe(F.col("least"))).select("rid"), "copies")
        order = written(thin.select("rid", "doc_id").orderBy(F.asc_nulls_first("doc_id"), "rid").select("rid", F.monotonically_increasing_id().alias("ord")), "order")
        own = base.where(F.col("n_bytes") >= length).join(small(copies), "rid", "left_anti").select("rid", "text")
        n_bytes = thin.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        spans = repeated_spans(own, order, n_bytes, length).groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        spans = written(spans.join(order, "ord").drop("ord"), "spans")
        keep += [base, copies, spans]
    changed = own.join(small(spans.select("rid")), "rid", "left_semi").join(spans.hint("shuffle_hash"), "rid")
    changed = changed.mapInArrow(_remove, "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not keep_text:
        changed = changed.drop("kept")
    out = (base if keep_text else base.drop("text")).join(copies.withColumn("copy", F.lit(True)), "rid", "left").join(changed, "rid", "left")
    removed = lambda c, of_copy, of_other: F.when(F.col("copy"), of_copy).otherwise(F.coalesce(c, of_other))
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_bytes", removed("n_removed", F.col("n_bytes"), zero).alias("n_removed"), removed("n_spans", F.lit(1).cast("long"), zero).alias("n_spans"), removed("kept_sha256", empty, F.col("sha")).alias("kept_sha256"),
        *([removed("kept", F.lit("").cast("binary"), F.col("text").cast("binary")).alias("kept")] if keep_text else []),
    )
