"""Benchmark passages against brute force, templates and slots."""

import random

from pyspark.sql import functions as F

from termwell.llm.decontaminate import Block, Tokens, with_leaks

ITEM = "Anna has 12 apples and gives 3 apples to Ben Miller in 5 hours. How many apples does Anna have after 1,250.5 km?"


def leaks(text, items=((1, ITEM),)):
    return {r["item_id"]: r["kind"] for r in Block.of(list(items)).leaks(text)}


def test_words_and_templates():
    around = "Some words before this. {} And some more after it."
    assert leaks(around.format(ITEM)) == {1: "words"}
    assert leaks(around.format(ITEM.lower())) == {1: "words"}
    assert leaks(around.format(ITEM.replace(",", " ").replace("?", " !!"))) == {1: "words"}
    other = ITEM.replace("Anna", "Tom").replace("12", "45").replace("Ben Miller", "Zoe").replace("1,250.5", "3").replace("hours", "days")
    assert leaks(around.format(other)) == {1: "template"}
    assert leaks("Nothing of the kind stands in this text, which has 12 apples and 3 hours.") == {}
    assert leaks(None) == leaks("") == {}


def test_slots_must_agree():
    item = "Ann met Bob and Ann gave Bob the red ball while Bob told Ann that Ann should give Bob more than Bob had"
    good = item.replace("Ann", "Eve").replace("Bob", "Max")
    names = iter("Kim Lee Sam Pat Joe Amy Ian Liz Ted".split())
    bad = " ".join(next(names) if w in ("Ann", "Bob") else w for w in item.split())
    assert leaks(f"see here: {good} .", [(7, item)]) == {7: "template"}
    assert leaks(f"see here: {bad} .", [(7, item)]) == {}


def test_partial_scattered_and_short():
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    item = " ".join(words)
    assert leaks("x " + " ".join(words[:55]) + " y", [(1, item)]) == {1: "words"}
    assert leaks("x " + " ".join(words[:40]) + " y", [(1, item)]) == {}
    scattered = (" " + "filler " * 40).join(" ".join(words[k:k + 10]) for k in range(0, 60, 6))
    assert leaks(scattered, [(1, item)]) == {}
    assert leaks("two words", [(1, "Two words!")]) == {1: "words"} and leaks("here are two words", [(1, "two words")]) == {}


def test_tokens():
    t = Tokens.of("In 2024 Ada Lovelace paid 3.50 euros; SHE left. É à İstanbul")
    kinds = [int(c) if c <= 3 else 0 for c in t.codes.tolist()]
    assert kinds[:8] == [2, 1, 2, 0, 1, 3, 0, 0]


def plain(docs, items):
    """Brute force over exact copies: an item leaks where its lower-cased words stand in a row."""
    fold = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    out = set()
    for d, text in docs:
        words = fold(text)
        for i, item in items:
            want = fold(item)
            if want and any(words[k:k + len(want)] == want for k in range(len(words) - len(want) + 1)):
                out.add((d, i))
    return out


def test_query_path_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(8, 50))) for k in range(30)] + [(30, None), (31, ""), (3, "repeated " + text(20))]
    docs = [(k, text(100) + (" " + rng.choice(items[:30])[1] + ". " if k % 3 == 0 else " ") + text(50)) for k in range(150)]
    docs += [(500, None), (501, ""), (None, items[4][1]), (502, text(30000) + " " + items[9][1] + " " + text(30000)), docs[0]]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, leaks string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.id) for r in with_leaks(df, bench).select("doc_id", F.explode("leaks.item_id").alias("id")).collect()}
    assert got == plain(docs, items)
    assert with_leaks(df, bench).count() == len(docs)
    none = with_leaks(df, bench.limit(0))
    assert none.filter(F.size("leaks") > 0).count() == 0 and none.count() == len(docs)
    assert with_leaks(df.limit(0), bench).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    import termwell.llm.decontaminate as module

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = lambda: sorted((r.doc_id, r.id) for r in with_leaks(docs, bench).select(
        "doc_id", F.explode("leaks.item_id").alias("id")).collect())
    one = found()
    monkeypatch.setattr(module, "BLOCK_WORDS", 300)
    assert found() == one and one


def test_items_dense_in_placeholders():
    item = "John ran 5 km in 30 minutes. Mary ran 8 km in 50 minutes. Who ran faster?"
    copy = "Zoe ran 7 km in 45 minutes. Adam ran 9 km in 61 minutes. Who ran faster?"
    assert leaks(f"a task: {copy} and so on", [(1, item)]) == {1: "template"}
    mixed_up = "Zoe ran 7 km in 45 minutes. Adam ran 9 miles over 61 hills. Who swam faster?"
    assert leaks(f"a task: {mixed_up} and so on", [(1, item)]) == {}


def test_one_common_phrase_is_no_leak():
    item = "Ann 5 km, Bob 8 kg, Eve 3 km, Max 9 at the end"
    assert leaks("He said that Joe 4 at the end was tired.", [(1, item)]) == {}
    assert leaks("so Kim 7 km, Joe 2 kg, Zoe 6 km, Ted 4 at the end", [(1, item)]) == {1: "template"}


def test_excerpts_and_short_items(spark):
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(500)]
    item = " ".join(words)
    docs = [(1, "x " + " ".join(words[100:490]) + " y"), (2, "x " + " ".join(words[40:53]) + " y"),
            (3, "x " + " ".join(words[40:52]) + " y " + " ".join(words[60:72])), (4, "here are Two words!"), (5, "two words"), (6, item)]
    found = with_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame([(1, item), (2, "two words")], "item_id long, text string"))
    got = {r.doc_id: [(k.item_id, k.kind, k.first_token, k.n_tokens) for k in r.leaks] for r in found.collect()}
    assert got.pop(5)[0][:2] == (2, "words") and got.pop(6)[0][:2] == (1, "words")
    assert got == {1: [(1, "excerpt", 1, 390)], 2: [(1, "excerpt", 1, 13)], 3: [], 4: [(2, "short", 2, 2)]}


def test_edited_templates_of_few_rich_windows():
    """Values changed and one word edited in an item of mostly placeholders; most windows agree all the same."""
    item = "Ada 5 km Bob 7 kg Eve 9 km Max 2 kg while Kim 4 km Joe 8 kg and Zoe 3 km Ted 6 kg Amy 1 km so who has most"
    copy = "Ida 6 km Rob 8 kg Eva 2 km Tim 3 kg while Jim 5 km Moe 9 kg and Lea 4 km Ned 7 kg Ann 2 km so who got most"
    windows = Tokens.of(item).windows()[1], Tokens.of(copy).windows()[1]
    assert 0.8 <= sum(x == y for x, y in zip(*windows, strict=True)) / len(windows[0]) < 1
    assert leaks(f"Here is a task. {copy}", [(1, item)]) == {1: "template"}
    assert leaks("Here 4 km Tim 5 kg Jim 7 km and that was it", [(1, item)]) == {}


def test_templates_that_repeat_themselves():
    item = " ".join(f"{n} 5 km in 30 minutes" for n in ("Ada", "Bob", "Eve", "Max", "Kim"))
    copy = " ".join(f"{n} 7 km in 45 minutes" for n in ("Ida", "Rob", "Eva", "Tim", "Jim"))
    assert leaks(copy, [(1, item)]) == {1: "template"}
    assert leaks(f"so it is said that {copy} and they were tired of it", [(1, item)]) == {1: "template"}
    assert leaks("Ida 7 km in 45 minutes Rob walked home to rest", [(1, item)]) == {}
