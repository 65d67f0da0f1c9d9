"""N-gram Jaccard join by a size-aware heavy-light scheme.

Documents are sets of word shingles. Small (light) sets enumerate all their subsets of the size that a linked pair must
share, so that meeting in a subset is a link. Large (heavy) sets scan inverted lists: each set posts the tokens of its
prefix (all but the tokens a linked pair may lack), ordered with frequent tokens last, and sets of similar size that
meet in a list are compared. The boundary is the size at which the estimated cost of both is least.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm import hashing
from tidebar.llm.components import components
from tidebar.llm.store import scope, small, written

#: Words of a shingle. A shingle is its 64-bit hash: nothing is compared with fewer bits.
WORDS = 5
#: Similarity 0.8: two sets of a and b tokens link if they share at least 4 * (a + b) / 9.
NEED, OF = 4, 9
#: Lists longer than this hold a frequent token; frequent tokens come last in every set's order.
FREQUENT = 64
#: Up to so many frequent tokens (8 bytes each) are broadcast; more are joined.
FREQUENT_MOST = 500_000
#: The largest boundary considered, and sets compared at a time on either side.
LIGHT_MOST, BLOCK = 12, 256

_SETS = "doc_id long, n long, sig1 long, sig2 long, tokens binary"


def _make_sets(words: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = hashing.utf8(batch.column(1))
            for i, j in hashing.chunks(at):
                h, counts = hashing.shingles(*hashing.words(raw, at[i : j + 1]), words)
                ends = np.cumsum(counts)
                sets = [np.unique(h[e - c : e].view(np.int64)) for e, c in zip(ends, counts, strict=True)]
                some = [x if len(x) else np.zeros(1, dtype=np.int64) for x in sets]
                flat, starts = np.concatenate(some).view(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in some])])[:-1]
                sig1 = np.add.reduceat(hashing.mix(flat), starts).view(np.int64)
                sig2 = np.add.reduceat(hashing.mix(flat ^ np.uint64(0xD6E8FEB86659FD93)), starts).view(np.int64)
                packed = [(x if whole else x[: max(LIGHT_MOST, region_size(len(x)))]).tobytes() for x in sets]
                n = pa.array([len(x) for x in sets], type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, pa.array(sig1), pa.array(sig2), pa.array(packed, type=pa.binary())], names=["doc_id", "n", "sig1", "sig2", "tokens"])

    return run


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int64)


def prefix_size(n):
    """Of n tokens, how many it takes for one to be shared with any linked set."""
    return n - (4 * n + 4) / 5 + 1 if not isinstance(n, (int, np.ndarray)) else n - (4 * n + 4) // 5 + 1


def region_size(n):
    """How many tokens, in order of hash, are looked at before frequent ones are known: the prefix and a margin."""
    return np.minimum(n, (n + 3) // 4 + 4) if isinstance(n, np.ndarray) else min(n, (n + 3) // 4 + 4)


def _post(whole: bool):
    """Postings token, doc_id, n, idx of each set's region, or of all its tokens (of whole sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column("doc_id").to_numpy(), batch.column("n").to_numpy()
            take = n if whole else region_size(n)
            cuts = np.concatenate([[0], np.cumsum(take)])
            for i, j in hashing.chunks(cuts, 1 << 18):
                token = [_tokens(batch.column("tokens")[k].as_py())[: take[k]] for k in range(i, j)]
                idx = hashing.ranges(np.zeros(j - i, dtype=np.int64), take[i:j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token)), pa.array(np.repeat(ids[i:j], take[i:j])), pa.array(np.repeat(n[i:j], take[i:j]).astype(np.int32)), pa.array(idx.astype(np.int32))], names=["token", "doc_id", "n", "idx"]
                )

    return run


def _ordered(frequent):
    """Prefix postings token, doc_id, n of sets in full order, their frequent tokens (a broadcast sorted array) last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for doc_id, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                token = _tokens(raw)
                usual = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] != token
                token = np.concatenate([token[usual], token[~usual]])[: prefix_size(n)]
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), doc_id)), pa.array(np.full(len(token), n, dtype=np.int32))], names=["token", "doc_id", "n"])

    return run


_POSTING = "token long, doc_id long, n int, idx int"


def partners(n: int, most: int) -> list[tuple[int, int, int]]:
    """(lesser size, greater size, tokens to share) of linked pairs of sets of up to most tokens, one of them of n."""
    out = []
    for m in range(1, most + 1):
        a, b = min(n, m), max(n, m)
        need = -(-NEED * (a + b) // OF)
        if need <= a and not (a == b == need):
            out.append((a, b, need))
    return out


def subsets_of(n: int, most: int) -> int:
    import math

    return sum(math.comb(n, need) for _, _, need in partners(n, most))


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The size up to which sets are light: where enumerating subsets below and scanning lists above cost least together.

    sizes: how many sets there are of each size, up to LIGHT_MOST. list_length: entries met for each posting. Sets that
    can be linked with a heavy one post tokens too.
    """

    def cost(x: int) -> float:
        light = sum(k * subsets_of(n, x) for n, k in sizes.items() if n <= x)
        return light + sum(k * prefix_size(n) * (1 + list_length) for n, k in sizes.items() if 5 * n >= 4 * (x + 1))

    return min(range(LIGHT_MOST + 1), key=cost)


def _enumerate(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, small_side = [], [], []
            for doc_id, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                token = hashing.mix(_tokens(raw).view(np.uint64))
                for a, b, need in partners(n, most):
                    pick = np.array(list(itertools.combinations(range(n), need)))
                    keys.append(hashing.mix(token[pick].sum(axis=1, dtype=np.uint64) + np.uint64(64 * a + b)).view(np.int64))
                    ids += [doc_id] * len(pick)
                    small_side += [n == a] * len(pick)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids, type=pa.int64()), pa.array(small_side)], names=["key", "doc_id", "lesser"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each pair of sets (without repeats) shares."""
    n = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = (np.cumsum(shared) - 1)[inverse]
    row, column = row[shared[inverse]], column[shared[inverse]]
    out, total, step = np.zeros((n, n), dtype=np.float32), int(shared.sum()), max(64, 2_000_000 // n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, total, step):
        a, b = np.searchsorted(column, [c, c + step])
        m = np.zeros((n, min(step, total - c)), dtype=np.float32)
        m[row[a:b], column[a:b] - c] = 1
        out += m @ m.T
    return out


def spanning(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the linked documents of a unit: each with the least one that it can be reached from."""
    linked = OF * overlaps(sets) >= NEED * (n[:, None] + n[None, :])
    np.fill_diagonal(linked, True)
    label = np.arange(len(ids))
    while True:
        least = np.where(linked, label[None, :], len(ids)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(ids[i]), int(ids[k])) for i, k in enumerate(label) if i != k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit; compares each unit's sets when its last row has come."""
    unit, ids, n, sets, seen = None, [], [], [], set()
    out: list[tuple[int, int]] = []

    def finish() -> None:
        if len(ids) > 1:
            order = np.argsort(ids)
            out.extend(e for e in spanning(np.array(ids)[order], np.array(n, dtype=np.float64)[order], [_tokens(sets[i]) for i in order]) if e[0] != e[1])

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], type=pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for k in range(batch.num_rows):
            now = tuple(batch.column(c)[k].as_py() for c in range(4))
            if now != unit:
                finish()
                unit, ids, n, sets, seen = now, [], [], [], set()
            doc, raw = batch.column("doc_id")[k].as_py(), batch.column("tokens")[k].as_py()
            if (doc, hash(raw)) not in seen:  # rows that share an id may differ
                seen.add((doc, hash(raw)))
                ids.append(doc)
                n.append(batch.column("n")[k].as_py())
                sets.append(raw)
        if len(out) > 100_000:
            yield rows()
            out.clear()
    finish()
    yield rows()


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each set is linked with its unit's head."""
    for batch in batches:
        own, head = batch.column("tokens").to_pylist(), batch.column("head_tokens").to_pylist()
        linked = [OF * len(np.intersect1d(_tokens(a), _tokens(b), assume_unique=True)) >= NEED * (len(a) + len(b)) // 8 for a, b in zip(own, head, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("doc_id"), pa.array(linked, type=pa.bool_())], names=["head", "doc_id", "linked"])


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, whole: bool = True) -> DataFrame:
    """doc_id, n, two signatures of the whole set, and its tokens packed in order of hash: all, or as many as LIGHT_MOST or its region."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_make_sets(words, whole), _SETS)


def _prefixes(sets: DataFrame, whole) -> tuple[DataFrame, float]:
    """Postings token, doc_id, n of every set's prefix, as far as another set may post the same token; and entries met for each posting."""
    of_p = lambda n: n - F.floor((4 * n + 4) / 5) + 1
    of_region = lambda n: F.least(n, F.floor((n + 3) / 4) + 4)
    p, region = of_p(F.col("n")), of_region(F.col("n"))
    region_postings = sets.mapInArrow(_post(False), _POSTING)
    counts = written(region_postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "df")
    stats = counts.agg(F.sum(F.col("df") * F.col("df")).alias("met"), F.sum("df").alias("shared")).first()
    found = written(region_postings.join(counts.hint("shuffle_hash"), "token").select("token", "doc_id", "n", "idx", (F.col("df") > FREQUENT).alias("frequent")), "postings")
    # prefixes longer by k tokens share k more: a set is left with partners only if so many tokens of its region are met elsewhere
    least = F.floor((4 * F.col("n") + 4) / 5)  # the size of the least partner
    need = F.least(region - p, of_region(least) - of_p(least)) - 1
    alive = written(found.groupBy("doc_id").agg(F.count("*").alias("met"), F.first("n").alias("n")).where(F.col("met") >= need).select("doc_id"), "alive")
    found = written(found.join(small(alive), "doc_id", "left_semi"), "postings")
    # a set's own frequent tokens move back, so its prefix reaches further by as many
    moved = found.where("frequent").groupBy("doc_id").agg(F.array_sort(F.collect_list("idx")).alias("at"), F.first("n").alias("n"))  # of one document
    moved = moved.withColumn("moved", F.aggregate("at", F.lit(0).cast("long"), lambda h, i: F.when(i - h < p, h + 1).otherwise(h)))
    moved = written(moved.select("doc_id", "moved", (p + F.col("moved") > region).alias("beyond")), "moved")
    beyond = moved.where("beyond").select("doc_id")
    own = F.coalesce("moved", F.lit(0))
    near = found.where("not frequent").join(small(moved), "doc_id", "left").where((F.col("idx") < p + own) & ~F.coalesce("beyond", F.lit(False))).select("token", "doc_id", "n")
    # sets with too many frequent tokens for the margin: ordered in full
    frequent = written(counts.where(F.col("df") > FREQUENT).select("token", F.lit(True).alias("frequent")), "frequent")
    full = whole(beyond)
    if 0 < frequent.count() <= FREQUENT_MOST:
        known = np.sort(np.array([r["token"] for r in frequent.select("token").collect()], dtype=np.int64))
        full = full.mapInArrow(_ordered(sets.sparkSession.sparkContext.broadcast(known)), "token long, doc_id long, n int")
    else:
        order = Window.partitionBy("doc_id").orderBy(F.coalesce("frequent", F.lit(False)), "token")
        full = full.mapInArrow(_post(True), _POSTING).join(frequent, "token", "left")
        full = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p).select("token", "doc_id", "n")
    full = written(full, "full-prefixes")
    # tokens that only these post beyond their region can be met once in a region: those entries are still needed
    extra = written(full.select("token").distinct().join(counts, "token", "left_anti"), "extra")
    late = region_postings.join(small(extra), "token", "left_semi").join(small(alive), "doc_id", "left_semi").join(small(moved), "doc_id", "left")
    late = late.where((F.col("idx") < p + own) & ~F.coalesce("beyond", F.lit(False))).select("token", "doc_id", "n")
    met = float(stats["met"] or 0) / max(1, stats["shared"] or 0)
    return near.unionByName(full).unionByName(late), met


def links(sets: DataFrame, whole) -> DataFrame:
    """Edges u, v between sets, none with the same signature: all of them are links, and they join what any links join.

    sets: with tokens of their regions. whole: gives the sets of a written table of doc_id with all their tokens.
    """
    spark, keep = sets.sparkSession, []
    with scope(spark, keep):
        postings, met = _prefixes(sets, whole)
        sizes = {r["n"]: r["k"] for r in sets.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("k")).collect()}  # LIGHT_MOST rows
        most = boundary(sizes, met)
        keys = sets.where(F.col("n") <= most).mapInArrow(_enumerate(most), "key long, doc_id long, lesser boolean")
        least = keys.where("lesser").groupBy("key").agg(F.min("doc_id").alias("v"))
        light = written(keys.join(least, "key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct(), "light")
        unit = written(_units(postings, most), "units")
        keep += [light, unit]
    many = unit.groupBy("head", "band").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    many = written(many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "large-units")
    one = F.lit(0).alias
    few = unit.join(small(many), ["head", "band"], "left_anti").select("head", "band", one("left"), one("right"), "doc_id")
    return light.unionByName(_compared(few, whole)).unionByName(_large_units(unit, many, whole))


def _compared(rows: DataFrame, whole) -> DataFrame:
    """Links within each unit of rows (head, band, left, right, doc_id) of at most two blocks of sets."""
    needed = written(rows.select("doc_id").distinct(), "needed")
    rows = rows.join(whole(needed).select("doc_id", "n", "tokens").hint("merge"), "doc_id").select("head", "band", "left", "right", "doc_id", "n", "tokens")
    rows = rows.repartition("head", "band", "left", "right").sortWithinPartitions("head", "band", "left", "right")
    return rows.mapInArrow(_compare, "u long, v long").distinct()


def _large_units(unit: DataFrame, many: DataFrame, whole) -> DataFrame:
    """Links of units of more than a block of sets. All sets are compared with the unit's head, which joins what is linked with it; the others are compared with all, in blocks."""
    unit = written(unit.join(small(many), ["head", "band"]), "large")
    pairs = written(unit.where("doc_id <> head").select("head", "doc_id").distinct(), "pairs")
    heads, members = (written(pairs.select(F.col(c).alias("doc_id")).distinct(), "ids") for c in ("head", "doc_id"))
    rows = pairs.join(whole(members).select("doc_id", "tokens").hint("merge"), "doc_id")
    rows = rows.join(whole(heads).select(F.col("doc_id").alias("head"), F.col("tokens").alias("head_tokens")).hint("merge"), "head")
    star = written(rows.select("head", "doc_id", "tokens", "head_tokens").mapInArrow(_star, "head long, doc_id long, linked boolean"), "star")
    near = star.where("linked").select(F.col("doc_id").alias("u"), F.col("head").alias("v")).distinct()
    far = star.groupBy("head", "doc_id").agg(F.bool_or("linked").alias("linked")).where("not linked").select("head", "doc_id")
    far = written(unit.join(small(written(far, "far")), ["head", "doc_id"], "left_semi"), "far")
    rest = written(far.groupBy("head", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("far_blocks")), "far-blocks")
    turn = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = far.join(small(rest), ["head", "band"]).withColumn("left", turn("far_blocks")).withColumn("right", every("blocks"))
    b = unit.join(small(rest), ["head", "band"]).withColumn("right", turn("blocks")).withColumn("left", every("far_blocks"))
    columns = ("head", "band", "left", "right", "doc_id")
    return near.unionByName(_compared(a.select(*columns).unionByName(b.select(*columns)), whole))


def _units(postings: DataFrame, most: int) -> DataFrame:
    """head, band, doc_id: the sets to compare, all lists with the same head as one unit."""
    # lists by token and band of sizes: linked sets are of the same band or of neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))
    entries = postings.where(5 * F.col("n") >= 4 * (most + 1)).withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    entries = written(entries.select("token", "band", "own", "doc_id"), "entries")
    heads = entries.groupBy("token", "band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.max("own").alias("most"))
    heads = heads.where("head < last and most = band").select("token", "band", "head")
    heads = written(heads, "heads")  # without the greater band, the list of the band below has it all
    # all lists with the same head are one unit, so sets that share many tokens are compared once
    return entries.join(heads.hint("merge"), ["token", "band"]).select("head", "band", "doc_id").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least id reachable by links, its own included).

    Null and empty texts, and texts of white space, have no shingles and no links; a text of fewer words than a shingle
    is one shingle. Equal sets link as one class. Rows with a null id are linked with nothing and have a null component;
    rows that share an id are one document whose links are those of either. Empty tables give no rows; further columns
    are not looked at. Classes of equal sets are counted with map-side combining before any set is compared, frequent
    tokens are used only by sets that have hardly any others, and units of many sets are split in blocks.
    """
    spark, keep = docs.sparkSession, []
    with scope(spark, keep):
        sets = written(shingle_sets(docs, id_col, text_col, words, whole=False), "sets")
        source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        whole = lambda ids: shingle_sets(source.join(small(ids), "doc_id", "left_semi"), words=words).where("n > 0")  # noqa: E731  hashed again, which is cheaper than to keep them
        thin = written(sets.select("doc_id", "n", "sig1", "sig2"), "signatures")
        classes = written(thin.where("n > 0 and doc_id is not null").groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
        again = thin.where("doc_id is not null and n > 0").join(classes.where("rep < last"), ["n", "sig1", "sig2"]).where("doc_id <> rep").select("doc_id", "rep")
        again = written(again, "members")
        reps = sets.where("n > 0 and doc_id is not null").join(small(again.select("doc_id")), "doc_id", "left_anti")
        edges = written(links(reps, whole).unionByName(again.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), "links")
        found = written(components(edges), "components")
        keep += [thin, found]
    return thin.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, the one with the least id; all columns as they were, and rows with a null id."""
    away = written(near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "away")
    return docs.join(small(away), "doc_id", "left_anti").select(*docs.columns)
