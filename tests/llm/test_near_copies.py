import random

from lanternq.llm import near_copies as N

SCHEMA = "doc_id long, title string, text string"


def sets(rows):
    out = {}
    for k, a, b in rows:
        s = N.stripped(a, b)
        x = {s[i : i + 5] for i in range(len(s) - 4)}
        if x and k is not None:
            out[k] = x
    return out


def brute(rows, least=0.6):
    s = sets(rows)
    keys = sorted(s)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(s[a] & s[b]) >= least * len(s[a] | s[b])}


def corpus(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(60)]
        rows.append((k, f"t{k}", " ".join(words)))
        if k % 6 == 0:
            for m, edits in enumerate((2, 5, 9, 14), 1):
                w = list(words)
                for _ in range(edits):
                    w[r.randrange(len(w))] = "edited" + str(r.randrange(99))
                rows.append((1000 * m + k, f"t{k}", " ".join(w)))
    rows += [(90001, "same", "x" * 3 + "copy of a page"), (90002, "same", "x x x copy of a page"), (90003, None, None), (90004, "ab", ""), (None, "same", "xxxcopy of a page")]
    return rows


def found(spark, rows):
    pairs, members = N.near_copies(spark.createDataFrame(rows, SCHEMA))
    return {tuple(r) for r in N.expanded(pairs, members).collect()}


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(got) >= 0.98 * len(want) and (90001, 90002) in got


def test_large_buckets_are_split_without_loss(spark, monkeypatch):
    """Everything shares most of its text, so that no bucket is small and the last depth deals blocks."""
    monkeypatch.setattr(N, "SMALL", 8)
    monkeypatch.setattr(N, "DEPTH", 2)
    r = random.Random(2)
    base = [f"word{i}" for i in range(80)]
    rows = [(k, "", " ".join(f"own{k}" if r.random() < 0.03 else w for w in base)) for k in range(40)]
    assert found(spark, rows) == brute(rows)


def test_groups_and_empty(spark):
    rows = [(1, "", "abcdefghij klmnop"), (2, "", "abcdefghij klmnoq"), (3, "", "abcdefghij klmnop"), (4, "", "something else here")]
    got = {r[0]: (r[1], r[2]) for r in N.groups(*N.near_copies(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1}
    assert found(spark, [(1, None, None)]) == set()
    assert N.expanded(*N.near_copies(spark.createDataFrame([], SCHEMA))).count() == 0
    wide = spark.createDataFrame([(1, "t", "abcdefgh", 5, b"x"), (2, "t", "abcdefgh", 6, b"y")], SCHEMA + ", a int, sig binary")
    assert N.expanded(*N.near_copies(wide)).collect()[0][:] == (1, 2)


def test_string_keys_are_kept(spark):
    rows = [("b-2", "", "abcdefghij klmnop"), ("a-1", "", "abcdefghij klmnoq"), ("c", "", "abcdefghij klmnop"), (None, "", "abcdefghij klmnop")]
    pairs, members = N.near_copies(spark.createDataFrame(rows, SCHEMA.replace("long", "string")))
    assert {tuple(r) for r in N.expanded(pairs, members).collect()} == {("a-1", "b-2"), ("a-1", "c"), ("b-2", "c")}


def test_hot_paths_change_nothing_and_classes_are_paired_in_blocks(spark, monkeypatch):
    """The same pairs whether a bucket is split before or after the shuffle, and a class larger than a block."""
    r = random.Random(4)
    base = [f"word{i}" for i in range(60)]
    rows = [(k, "", " ".join(f"own{k}" if r.random() < 0.05 else w for w in base)) for k in range(60)] + [(1000 + k, "", "the very same text") for k in range(7)]
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "DEPTH", 3)
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "CLASS_BLOCK", 3)
    early = found(spark, rows)
    monkeypatch.setattr(N, "HOT", 1e-9)
    assert found(spark, rows) == early == brute(rows)
    monkeypatch.setattr(N, "HELD", 6)  # buckets pass from shuffle to shuffle
    assert found(spark, rows) == early


def test_comparisons_grow_with_the_records(monkeypatch):
    """Sixteen times the records (a split parts a bucket in sixteen), a third in one bucket: far below their square.

    A bucket is parted in 16 by each split and copied CHILDREN times; a third of the slots of these records part nothing.
    That gives about n^1.46 here, and n^1.25 where every slot parts a bucket. Buckets bounded by a share of n give n^2.
    """
    import numpy as np
    import pyarrow as pa

    def compared(n):
        rng = np.random.default_rng(1)
        sig = rng.integers(0, 1 << 32, (n, N.SLOTS), dtype=np.uint32)
        sig[: n // 3, :40] = 7
        ids, sketch, done = pa.array(range(n)), N.binary(N.four_bits(sig)), 0
        monkeypatch.setattr(N, "near_ones", lambda ids, sketch, bucket, *_: counts.append(sum(k * (k - 1) // 2 for k in np.unique(bucket, return_counts=True)[1])))
        counts = []
        rows = pa.Table.from_batches(list(N.walked([])(iter([pa.record_batch({"_id": ids, "roots": N.binary(N.roots(sig)), "sketch": sketch})]))))
        list(N.buckets(0.5, N.SMALL, N.DEPTH, N.HELD)(iter(rows.sort_by("path").to_batches(max_chunksize=1000))))
        return sum(counts)

    few, many = compared(2000), compared(32000)
    assert 0 < many <= 16**1.5 * few
