import random

import pandas as pd
import pytest

from stratavox.llm import leaks
from stratavox.llm.leaks import Q, _slices, index_items, leaked_passages, search, word_text

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, suite string"
VOCAB = [f"{a}{b}" for a in ("ba", "ke", "lo", "mu", "ti", "sor", "vex", "nal") for b in ("d", "rin", "th", "pol", "gun", "s", "7", "")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute(docs, items):
    found = set()
    for item, text, _ in items:
        w = word_text(text or "").split()
        grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for doc, body, _ in docs:
            d = word_text(body or "").split()
            if any(tuple(d[k : k + 13]) in grams for k in range(len(d) - 12)):
                found.add((item, doc))
    return found


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, rng.choice([5, 12, 13, 14, 30, 60])), "s") for i in range(12)] + [(50, None, "s"), (51, "", "s")]
    docs = []
    for d in range(80):
        parts = [sentence(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items[:12])[1].split()
            n = rng.choice([10, 12, 13, 14, len(w)])
            k = rng.randint(0, max(0, len(w) - n))
            parts += [rng.choice([" ", "\n** ", ", "]).join(w[k : k + n]).upper() if rng.random() < 0.3 else " _".join(w[k : k + n]), sentence(rng, rng.randint(0, 20))]
        docs.append((d, " ".join(parts), 0))
    return docs + [(900, None, 0), (901, "", 0), (902, docs[0][1], 0)], items


@pytest.mark.parametrize("seed,block", [(1, 3_000_000), (2, 300)])
def test_exact_passages_match_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    got = leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=block).filter("n_exact > 0").collect()
    assert len(got) == len({(r["item_id"], r["doc_id"]) for r in got})
    assert {(r["item_id"], r["doc_id"]) for r in got} == brute(docs, items)


def edits(a, b):
    row = list(range(len(b) + 1))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_passages_with_edits_match_alignment_everywhere():
    rng = random.Random(6)
    items = pd.DataFrame({"item_id": [7], "text": [sentence(rng, 22)]})
    index = index_items(items)
    base = index.texts[0].decode()
    for trial in range(40):
        s = list(base)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(s))
            kind = rng.random()
            s[k : k + 1] = [] if kind < 0.3 else [s[k], "q"] if kind < 0.6 else ["z"]
        text = word_text(sentence(rng, 8) + " " + "".join(s) + " " + sentence(rng, 8))
        want = sum(edits(base[b:e], text.decode()) <= a for b, e, a in zip(index.begin, index.end, index.edits))
        got = search([b"", text], index)
        assert (int(got["n_passages"].iloc[0]) if len(got) else 0) == want, trial
    assert (index.bound >= 1).all() and (index.end - index.begin >= Q).all()


def test_slices_lose_nothing_at_their_ends():
    rng = random.Random(11)
    for text in (word_text(sentence(rng, 700)), word_text(sentence(rng, 30) + " " + "9" * 3000 + " " + sentence(rng, 30))):
        for size, overlap in ((300, 90), (91, 90), (5000, 10)):
            pieces = list(_slices(text, size, overlap))
            assert max(map(len, pieces)) <= size + overlap + 2
            assert all(any(text[k : k + overlap] in p for p in pieces) for k in range(0, len(text) - overlap, 7))
            words = set(text.split())
            assert all(w in words for p in pieces for w in p.split() if b"\1" not in w)


def test_slices_and_frequent_grams_give_the_same_result(monkeypatch):
    rng = random.Random(12)
    items = pd.DataFrame({"item_id": [1, 2, 3], "text": [sentence(rng, 40), "0" * 300 + " " + sentence(rng, 14), sentence(rng, 13)]})
    index = index_items(items)
    texts = [word_text(" ".join([sentence(rng, 50), rng.choice(items["text"]), sentence(rng, 50), "0" * 4000, rng.choice(items["text"])])) for _ in range(12)]
    want = search(texts, index).to_dict("records")
    assert len(want) >= 12
    assert search(texts, index, slice_chars=500).to_dict("records") == want
    monkeypatch.setattr(leaks, "POSTINGS", 5000)
    monkeypatch.setattr(leaks._passages, "__defaults__", (5000,))
    assert search(texts, index).to_dict("records") == want


def test_recall_of_edited_passages_is_that_of_exhaustive_alignment():
    """40 documents with planted passages of up to 4 edits against 6 items: all 240 pairs, every passage aligned at every place."""
    rng = random.Random(13)
    items = pd.DataFrame({"item_id": range(6), "text": [sentence(rng, 15) for _ in range(6)]})
    index = index_items(items)
    docs = []
    for _ in range(40):
        s = list(rng.choice(index.texts).decode())
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [s[k], "q"], ["z"]])
        docs.append(word_text(sentence(rng, 6) + " " + "".join(s) + " " + sentence(rng, 6)))
    got = {(r["doc"], r["item_id"]) for r in search(docs, index).to_dict("records")}
    want = {(d, index.item[k]) for d, text in enumerate(docs) for k in range(len(index.begin)) if edits(index.texts[index.item[k]][index.begin[k] : index.end[k]], text) <= index.edits[k]}
    assert got == want and len(want) >= 20


def test_words_are_read_in_plain_form():
    assert word_text("Ｆｕｌｌ ｗｉｄｔｈ, café café zero​width _x_ аbc x² STRASSE straße") == b"full width cafe cafe zerowidth x abc x2 strasse strasse"
    assert word_text("") == b"" and word_text("--\n__") == b""


def test_empty_tables(spark):
    docs, items = corpus(3)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leaked_passages(d.limit(0), i).count() == 0 and leaked_passages(d, i.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(8)
    passage = sentence(rng, 13)
    text = "na " * 400_000 + passage + " no" * 400_000
    got = leaked_passages(spark.createDataFrame([(1, text, 0)], DOCS), spark.createDataFrame([(2, passage, "")], ITEMS)).collect()
    assert [(r["item_id"], r["doc_id"], r["n_exact"]) for r in got] == [(2, 1, 1)]


def test_null_ids_stay_null_and_long_ids_exact(spark):
    rng = random.Random(9)
    a, b = sentence(rng, 13), sentence(rng, 13)
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, a, 0), (None, f"x {a} y {b}", 0), (2, None, 0), (None, None, 0)], DOCS).coalesce(1)
    items = spark.createDataFrame([(big + 2, a, ""), (None, b, ""), (None, None, "")], ITEMS).coalesce(1)
    got = [(r["item_id"], r["doc_id"], r["n_exact"]) for r in leaked_passages(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(big + 2, big, 1), (big + 2, None, 1), (None, None, 1)], key=str)
