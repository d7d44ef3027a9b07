import random

import pytest

from lanternq.llm import leaks as L


def kept(t):
    return "".join(map(chr, L.kept_codes([t or ""])[0].tolist()))


def brute(docs, items):
    out = set()
    for d, t in docs:
        x = kept(t)
        for i, s in items:
            w = kept(s)
            need = -(-len(w) // 2)
            if w and any(w[k : k + need] in x for k in range(len(w) - need + 1)):
                out.add((d, i))
    return out


def data(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg中文字符测试") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(8))) for k in range(30)] + [(100, "?!"), (101, None), (102, "Ａ１"), (103, "ab cd ab cd ab cd")]
    docs = []
    for k in range(120):
        t = [word() for _ in range(40)]
        i = items[k % 30][1]
        a = r.randrange(0, len(i) // 2)
        t.insert(r.randrange(len(t)), i[a : a + r.randrange(10, len(i))].upper().replace(" ", "，"))
        docs.append((k, " ".join(t)))
    return docs + [(900, None), (901, ""), (902, "a-1"), (903, items[0][1] + "x" * 10000 + items[1][1]), (903, items[0][1])], items


def test_equal_to_brute_force(spark):
    docs, items = data()
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)


def test_blocks_of_items_and_empty(spark, monkeypatch):
    docs, items = data(4)
    monkeypatch.setattr(L, "ITEM_CODES", 100)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == brute(docs, items)
    assert L.leaked_items(d, i.limit(0)).count() == 0 and L.leaked_items(d.limit(0), i).count() == 0


@pytest.mark.parametrize("edits", [1, 2])
def test_runs_with_edits(edits):
    word = "thequickbrownfoxjumpsoverthelazydog"
    for text in (word, word[:8] + "X" + word[9:], word[:8] + word[9:], word[:8] + "Y" + word[8:]):
        items = L.Items([1], [word], (1, 1), edits)
        assert [r[0] for r in L.matches(items, *L.kept_codes(["zz" + text + "zz"]))] == [0]
    items = L.Items([1], [word], (1, 1), edits)
    assert not list(L.matches(items, *L.kept_codes([word[:5] + "XXXX" + word[9:20] + "XXXX" + word[24:]])))


def test_q_of_an_item_is_its_own():
    long = "thequickbrownfoxjumpsoverthelazydog"
    alone, both = L.Items([1], [long], (1, 2), 1), L.Items([1, 2], [long, "ab"], (1, 2), 1)
    assert set(alone.grams) == {8} and set(both.grams) == {1, 8}
    assert len(both.grams[8].hash) == len(alone.grams[8].hash)


def test_planted_edits_are_found_through_the_bands(spark):
    docs, items = data(5)
    r = random.Random(8)
    planted = []
    for k in range(60):
        item = kept(items[k % 30][1])
        at = r.randrange(5, len(item) - 5)
        planted.append((5000 + k, "zzzz" + (item[:at] + "Q" + item[at + k % 2 :] if k % 3 else item[:at] + item[at + 1 :]) + "yyyy"))
    d, i = spark.createDataFrame(docs + planted, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in L.leaked_items(d, i, share=(1, 1), edits=1).collect()}
    assert {(5000 + k, k % 30) for k in range(60)} <= got.keys()
    exact = L.leaked_items(d, i, edits=1).filter("run * 2 >= item_length").collect()
    assert {(x.doc_id, x.item_id) for x in exact} == brute(docs + planted, items)
