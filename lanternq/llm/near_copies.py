"""Problem 2: records that are edited copies of each other, by a chosen-path join.

A record is the set of its shingles, embedded as SLOTS minimum hashes. A run puts it into a bucket by one sampled slot and
the value there; a bucket of more than SMALL records is split again by further slots that its own path samples, so the
records of a pair stay together as long as they share what is sampled. Small buckets are compared by brute force on
sketches of four bits a slot; runs are repeated until the target recall; pairs that may reach the threshold are verified on
the exact sets. Equal texts form a class that takes part once.

A bucket is split by the task that reads it: all at once if it has at most HELD records, else its records go on to the next
shuffle as they pass by. So no list of buckets is held anywhere, and SMALL is the same at every size. Only paths that hold
a large part of a sample of the records are split before they are shuffled, so that none of them meets in one task; the
tree of buckets is the same wherever it is split.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import spread, stage
from .codes import chunks, codes_of

SLOTS = 128
#: Slots sampled at the root (the runs), slots sampled by a bucket that is split, and the depth at which splitting ends.
RUNS, CHILDREN, DEPTH = 12, 2, 10
#: Records that are compared by brute force.
SMALL = 64
#: Records of a bucket that a task holds to split it by itself.
HELD = 50_000
#: Records of a bucket that is not to be split any more are compared block by block, with so many records in a block.
BLOCK = 2048
#: About so many records are looked at for hot paths, which hold more than one in HOT of them. They choose where a bucket is
#: split, before or after the shuffle, never whether.
HOT_SAMPLE, HOT = 100_000, 200
#: Members of a class of equal texts in one block of the expansion.
CLASS_BLOCK = 1000
BLANKS = (" ", "\n", "\u00a0", "\u3000")
_RNG = np.random.default_rng(20240229)
FACTOR = _RNG.integers(1 << 20, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of several integers, element by element."""
    h = np.uint64(0x51_7C_C1_B7_27_22_0A_95)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def stripped(title: str | None, text: str | None) -> str:
    s = (title or "") + (text or "")
    for b in BLANKS:
        s = s.replace(b, "")
    return s


def min_hashes(texts: list[str], width: int) -> np.ndarray:
    """SLOTS minimum hashes (uint32) of the shingle set of each text; every text has at least one shingle."""
    codes = codes_of("".join(texts)).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    end = np.cumsum(size)
    own = np.ones(len(codes), bool)
    for k in range(1, width):
        own[end - k] = False  # the last places of a text reach into the next one
    h = h[own[: len(h)]]
    first = np.r_[0, np.cumsum(size - width + 1)[:-1]]
    out = np.empty((len(texts), SLOTS), np.uint32)
    for k in range(SLOTS):
        out[:, k] = np.minimum.reduceat(h * FACTOR[k] + ADD[k], first)
    return out


def roots(sig: np.ndarray) -> np.ndarray:
    """The RUNS first paths of each record."""
    slot = (mixed(np.arange(RUNS), 77) % np.uint64(SLOTS)).astype(np.int64)
    return mixed(np.arange(RUNS)[None, :], slot[None, :], sig[:, slot])


def four_bits(sig: np.ndarray) -> np.ndarray:
    """Four mixed bits of each slot, as SLOTS / 16 words a row."""
    bits = (mixed(sig, np.arange(SLOTS)[None, :]) & np.uint64(15)).reshape(len(sig), -1, 16)
    return np.bitwise_or.reduce(bits << (4 * np.arange(16, dtype=np.uint64)), axis=2)


def children(path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the next depth: each row goes on by the slots that its path samples."""
    row, parent = np.tile(np.arange(len(path)), CHILDREN), np.tile(path, CHILDREN)
    turn = np.repeat(np.arange(CHILDREN), len(path))
    slot = (mixed(parent, turn, 5) % np.uint64(SLOTS)).astype(np.int64)
    value = sketch[row, slot // 16] >> (4 * (slot % 16)).astype(np.uint64) & np.uint64(15)
    return row, mixed(parent, slot, value)


def words(column: pa.Array, n: int) -> np.ndarray:
    """Fixed-length binaries as rows of n 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, n)


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(rows)], pa.binary())


def signed(columns: list[str], width: int):
    """mapInArrow function: (key, title, text) -> (_id, class, roots, sketch); texts without a shingle are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            texts = [stripped(a, b) for a, b in zip(*cols, strict=True)]
            rows = [i for i, t in enumerate(texts) if len(t) >= width]
            texts = [texts[i] for i in rows]
            for part in chunks(len(texts), np.fromiter(map(len, texts), np.int64, len(texts))):
                own = texts[part]
                sig = min_hashes(own, width)
                yield pa.record_batch(
                    {
                        "_id": batch.column(0).take(pa.array(rows[part], pa.int64())),
                        "class": pa.array([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in own], pa.binary()),
                        "roots": binary(roots(sig)),
                        "sketch": binary(four_bits(sig)),
                    }
                )

    return run


def walked(hot: list[np.ndarray]):
    """mapInArrow function: (_id, roots, sketch) -> (depth, path, _id, sketch), with the hot paths split at once.

    hot has the sorted hot paths by depth; a row is given out at the first path that is not hot, or below the last depth.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = words(batch.column(2), SLOTS // 16)
            row = np.repeat(np.arange(len(sketch)), RUNS)
            path = words(batch.column(1), RUNS).reshape(-1)
            for depth in range(len(hot) + 1):
                on = inside(path, hot[depth]) if depth < len(hot) else np.zeros(len(path), bool)
                out, at = row[~on], path[~on]
                for k in range(0, len(out), 20_000):
                    pick = pa.array(out[k : k + 20_000])
                    yield pa.record_batch({"depth": np.full(len(pick), depth, np.int32), "path": at[k : k + 20_000].view(np.int64), "_id": batch.column(0).take(pick), "sketch": batch.column(2).take(pick)})
                if not on.any():
                    break
                own, old = row[on], path[on]
                step, path = children(old, sketch[own])
                row = own[step]

    return run


def inside(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.searchsorted(of, values).clip(max=len(of) - 1)] == values


def hot_paths(sigs: DataFrame) -> list[np.ndarray]:
    """By depth, the sorted paths that hold more than SMALL and more than one in HOT of a sample of the records.

    The sample is taken by a hash of the key. At most RUNS * HOT paths of a depth are hot whatever the size, and each is
    larger than SMALL, so that splitting it early changes nothing but the place.
    """
    rows = sigs.count()
    share = min(1.0, HOT_SAMPLE / max(rows, 1))
    some = sigs.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else sigs
    least = max(SMALL, int(rows * share / HOT))
    hot: list[np.ndarray] = []
    for depth in range(DEPTH - 1):
        here = some.mapInArrow(walked(hot), "depth int, path long, _id " + dict(sigs.dtypes)["_id"] + ", sketch binary").filter(F.col("depth") == depth)
        found = here.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select("path").toPandas().path.to_numpy(np.int64)
        if not len(found):
            break
        hot.append(np.sort(found.view(np.uint64)))
    return hot


def near_ones(ids: pa.Array, sketch: np.ndarray, bucket: np.ndarray, least: float, mine: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Pairs of rows of one bucket (rows are sorted by it) whose sketches agree in a share `least` of the slots.

    With `mine`, only rows of different blocks are paired, and those of one block where a bucket has only that block.
    """
    left, right = [], []
    ones = np.uint64(0x1111111111111111)
    at = np.arange(len(bucket))
    step = 1
    while True:
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        use = at if mine is None else at[mine[at] != mine[at + step]]
        x = sketch[use] ^ sketch[use + step]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        near = use[SLOTS - np.bitwise_count(x & ones).sum(1) >= least * SLOTS]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left or not len(both := np.concatenate(left)):
        return None
    a, b = ids.take(pa.array(both)), ids.take(pa.array(np.concatenate(right)))
    turned = pc.greater(a, b)
    pairs = pa.table({"a": pc.if_else(turned, b, a), "b": pc.if_else(turned, a, b)}).filter(pc.not_equal(a, b))
    return pairs.group_by(["a", "b"]).aggregate([]).combine_chunks() if len(pairs) else None


def buckets(least: float, small: int, deepest: int, held_rows: int):
    """mapInArrow function over (depth, path, _id, sketch) sorted by path: pairs of small buckets, and rows to go on with.

    Gives (a, b) of pairs with a null path, else (depth, path, a, sketch): rows of the next depth of a bucket of more than
    held_rows, or rows of a bucket that is still larger than small at the depth `deepest`, where nothing is split any more.
    """
    n = SLOTS // 16
    Rows = tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]

    def going_on(depth: np.ndarray, path: np.ndarray, ids: pa.Array, sketch: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"depth": depth.astype(np.int32), "path": path.view(np.int64), "a": ids, "b": pa.nulls(len(ids), ids.type), "sketch": binary(sketch)})

    def taken(rows: Rows, at: np.ndarray) -> Rows:
        return rows[0][at], rows[1][at], rows[2].take(pa.array(at)), rows[3][at]

    def whole(rows: Rows) -> Iterator[pa.RecordBatch]:
        """Complete buckets, sorted by path: compared, or split here until they can be."""
        while len(rows[1]):
            depth, path, ids, sketch = rows
            edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            size = np.diff(np.r_[edge, len(path)])
            large = np.repeat(size > small, size)
            few = np.flatnonzero(~large)
            if len(few) and (out := near_ones(ids.take(pa.array(few)), sketch[few], path[few], least)) is not None:
                for b in out.to_batches():
                    yield pa.record_batch({"depth": pa.nulls(len(b), pa.int32()), "path": pa.nulls(len(b), pa.int64()), "a": b.column(0), "b": b.column(1), "sketch": pa.nulls(len(b), pa.binary())})
            stuck = np.flatnonzero(large & (depth >= deepest))
            if len(stuck):
                yield going_on(*taken(rows, stuck))
            depth, path, ids, sketch = taken(rows, np.flatnonzero(large & (depth < deepest)))
            row, path = children(path, sketch)
            order = np.argsort(path, kind="stable")
            row = row[order]
            rows = depth[row] + 1, path[order], ids.take(pa.array(row)), sketch[row]

    def passing(rows: Rows) -> Iterator[pa.RecordBatch]:
        """Rows of a bucket that is too large to be held."""
        depth, path, ids, sketch = rows
        for k in range(0, len(path), 20_000):
            d, p, own = depth[k : k + 20_000], path[k : k + 20_000], sketch[k : k + 20_000]
            row, p = children(p, own) if d[0] < deepest else (np.arange(len(p)), p)
            yield going_on(np.minimum(d[row] + 1, deepest) if d[0] < deepest else d, p, ids.slice(k, len(own)).take(pa.array(row)), own[row])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None
        going: int | None = None  # the path whose rows are passing
        for batch in batches:
            rows = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2), words(batch.column(3), n)
            if going is not None:
                same = int(np.searchsorted(rows[1] != np.uint64(going), True))
                yield from passing((rows[0][:same], rows[1][:same], rows[2].slice(0, same), rows[3][:same]))
                if same == len(rows[1]):
                    continue
                going, rows = None, (rows[0][same:], rows[1][same:], rows[2].slice(same), rows[3][same:])
            if held is not None:
                rows = np.r_[held[0], rows[0]], np.r_[held[1], rows[1]], pa.concat_arrays([held[2], rows[2]]), np.concatenate([held[3], rows[3]])
                held = None
            if not len(rows[1]):
                continue
            cut = len(rows[1]) - int(np.searchsorted(rows[1][::-1] != rows[1][-1], True))
            yield from whole((rows[0][:cut], rows[1][:cut], rows[2].slice(0, cut), rows[3][:cut]))
            held = rows[0][cut:], rows[1][cut:], rows[2].slice(cut), rows[3][cut:]
            if len(held[1]) > held_rows:
                yield from passing(held)
                going, held = int(held[1][0]), None
        if held is not None:
            yield from whole(held)

    return run


def dealt(block: int):
    """mapInArrow function: (path, n, _id, sketch) -> (path, mine, _id, sketch): the records of a bucket of n in blocks.

    Each pair of blocks becomes a bucket of its own; a block paired with itself has -1 for mine.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            blocks = -(-n // block)
            row = np.repeat(np.arange(len(path)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = xxhash64_of(batch.column(2))
            mine = (mixed(own[row], 3) % blocks[row].astype(np.uint64)).astype(np.int64)
            to = mixed(path[row], np.minimum(mine, other), np.maximum(mine, other))
            pick = pa.array(row)
            yield pa.record_batch({"path": to.view(np.int64), "mine": np.where(mine == other, -1, mine), "_id": batch.column(2).take(pick), "sketch": batch.column(3).take(pick)})

    return run


def xxhash64_of(ids: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(str(x)) for x in ids.to_pylist()), np.uint64, len(ids))


def blockwise(least: float):
    """mapInArrow function over (path, mine, _id, sketch) sorted by path: pairs of two blocks, or of one with itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            path, mine = t.column(0).to_numpy(), t.column(1).to_numpy()
            ids, sketch = t.column(2).chunk(0), words(t.column(3).chunk(0), SLOTS // 16)
            alone = mine < 0
            for k, part in enumerate((np.flatnonzero(alone), np.flatnonzero(~alone))):
                if len(part) and (out := near_ones(ids.take(pa.array(part)), sketch[part], path[part], least, mine[part] if k else None)) is not None:
                    yield from out.to_batches()

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if not len(held):
                continue
            path = held.column(0).to_numpy()
            cut = int(np.searchsorted(path, path[-1]))
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield from pairs(held)

    return run


def verified(width: int, threshold: float):
    """mapInArrow function: (a, b, text_a, text_b) -> (a, b, jaccard) of the pairs that reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, set[str]] = (None, set())
        shingles = lambda s: {s[i : i + width] for i in range(len(s) - width + 1)}
        for batch in batches:
            out: list[tuple[object, object, float]] = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != a:
                    last = (a, shingles(x))
                other = shingles(y)
                both = len(last[1] & other)
                j = both / (len(last[1]) + len(other) - both)
                if j >= threshold:
                    out.append((a, b, j))
            if out:
                a, b, j = zip(*out, strict=True)
                yield pa.record_batch({"a": pa.array(a, batch.column(0).type), "b": pa.array(b, batch.column(1).type), "jaccard": pa.array(j, pa.float64())})

    return run


def near_copies(df: DataFrame, key: str = "doc_id", title: str = "title", text: str = "text", width: int = 5, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard), a < b, between class representatives, and members (member, representative) of the classes.

    A record's set is every substring of `width` code points of title followed by text without blanks; null counts as
    empty, and records without such a substring or with a null key have no pairs. Records of equal stripped text form a
    class whose representative is the smallest key; representatives are not listed as members. Keys must be unique and
    keep their type.
    """
    kind = dict(df.dtypes)[key]
    base = df.select(F.col(key).alias("_id"), F.col(title).alias("_title"), F.col(text).alias("_text")).filter("_id is not null")
    all_sigs = stage(spread(base).mapInArrow(signed(["_title", "_text"], width), f"_id {kind}, class binary, roots binary, sketch binary"), "signatures")
    again = all_sigs.groupBy("class").agg(F.min("_id").alias("representative"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(all_sigs.select("_id", "class").join(again, "class").filter("_id <> representative").select(F.col("_id").alias("member"), "representative"), "members")
    sigs = all_sigs.select("_id", "roots", "sketch")
    if not members.isEmpty():
        sigs = stage(sigs.join(members, F.col("_id") == F.col("member"), "left_anti"), "signatures")

    agree = 1 / 16 + 15 / 16 * threshold
    least = agree - 3 * math.sqrt(agree * (1 - agree) / SLOTS)
    hot = hot_paths(sigs)
    rows = sigs.mapInArrow(walked(hot), f"depth int, path long, _id {kind}, sketch binary")
    found = []
    while True:  # once, but for buckets of more than HELD records that are not hot
        out = rows.repartition("path").sortWithinPartitions("path").mapInArrow(buckets(least, SMALL, DEPTH - 1, HELD), f"depth int, path long, a {kind}, b {kind}, sketch binary")
        out = stage(out, "buckets")
        found.append(out.filter("path is null").select("a", "b"))
        left = out.filter("path is not null").select("depth", "path", F.col("a").alias("_id"), "sketch")
        if left.filter(F.col("depth") < DEPTH - 1).isEmpty():
            break
        rows = left
    if not left.isEmpty():
        sizes = left.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        blocks = left.join(sizes, "path").select("path", "n", "_id", "sketch").mapInArrow(dealt(BLOCK), f"path long, mine long, _id {kind}, sketch binary")
        found.append(blocks.repartition("path").sortWithinPartitions("path").mapInArrow(blockwise(least), f"a {kind}, b {kind}"))
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    candidates = stage(candidates.distinct(), "candidates")
    blanks = "[" + "".join(BLANKS) + "]"
    texts = base.select("_id", F.regexp_replace(F.concat(F.coalesce("_title", F.lit("")), F.coalesce("_text", F.lit(""))), blanks, "").alias("t"))
    ids = candidates.select(F.col("a").alias("_id")).union(candidates.select("b")).distinct()
    texts = stage(texts.join(ids, "_id", "left_semi"), "texts")
    both = candidates.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    pairs = both.sortWithinPartitions("a").mapInArrow(verified(width, threshold), f"a {kind}, b {kind}, jaccard double")
    return stage(pairs, "pairs"), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of records that the pairs of representatives and the classes stand for.

    A class of m records gives m * (m - 1) / 2 pairs, as asked for by whoever calls this; `groups`, or the pairs and members
    themselves, say the same in one row a record. The members of a class are paired in blocks of CLASS_BLOCK.
    """
    if members.isEmpty():
        return pairs.select("a", "b")
    whole = members.union(members.select(F.col("representative").alias("member"), "representative").distinct())
    sizes = members.groupBy("representative").agg(F.ceil((F.count(F.lit(1)) + 1) / CLASS_BLOCK).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("member"), F.col("_blocks")).cast("int")
    dealt_ = whole.join(sizes, "representative").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    left = dealt_.select(F.col("member").alias("a"), "representative", F.col("_own").alias("i"), F.col("_other").alias("j"))
    right = dealt_.select(F.col("member").alias("b"), "representative", F.col("_other").alias("i"), F.col("_own").alias("j"))
    within = left.join(right, ["representative", "i", "j"]).filter("a < b").select("a", "b")
    left, right = whole.toDF("ma", "ra"), whole.toDF("mb", "rb")
    across = pairs.join(left, F.col("a") == F.col("ra"), "left").join(right, F.col("b") == F.col("rb"), "left").select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
    return within.union(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group, links): the smallest id of the connected copies of each linked record, and its number of links.

    Labels spread along links and jump to their label's label, so a group of diameter d takes about log d rounds.
    """
    links = pairs.select("a", "b").union(members.select(F.col("representative").alias("a"), F.col("member").alias("b")))
    links = stage(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = stage(links.groupBy("a").agg(F.least("a", F.min("b")).alias("group"), F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = links.join(label.select(F.col("id").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("near"))
        new = label.join(near, F.col("id") == F.col("a")).select("id", F.least("group", "near").alias("to"), "links", F.col("group").alias("was"))
        jump = label.select(F.col("id").alias("to"), F.col("group").alias("beyond"))
        new = stage(new.join(jump, "to").select("id", F.least("to", "beyond").alias("group"), "links", "was"), "labels")
        label = new.drop("was")
        if new.filter("`group` <> was").isEmpty():
            return label
