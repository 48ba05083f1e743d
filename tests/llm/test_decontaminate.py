from __future__ import annotations

import re

import pytest

from stratalog.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")


def reading(text: str | None, formed: bool) -> list[str]:
    out = []
    for raw in TOKEN.findall(text or ""):
        t = kind = raw.lower()
        for name, words in decontaminate.SLOTS.items():
            if t in words:
                kind = name
        name = formed and "A" <= raw[0] <= "Z" and not "A" <= raw[1:2] <= "Z"
        out.append("#name" if name else "#number" if t[0].isdigit() else kind)
    return out


def cut(kinds: list[str]) -> set:
    return {tuple(kinds[i : i + 5]) for i in range(len(kinds) - 4)}


def brute(docs: list, items: list) -> set:
    """Documents with 0.8 of an item's windows in one reading; slots agree by construction of the cases that use it."""
    found = set()
    for item, text in items:
        for formed in (False, True):
            want = {w for w in cut(reading(text, formed)) if sum(x.startswith("#") for x in w) <= 2}
            for doc, other in docs:
                got = want & (cut(reading(other, False)) | cut(reading(other, True)))
                if want and len(got) >= 0.8 * len(want):
                    found.add((doc, item))
    return found


def test_query_is_the_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_decontaminate(spark, SF).collect()}
    assert got == brute(docs, items) and got


ITEM = "If Alice has 12 apples and buys 7 more at the market, paying 3 dollars for each, and then Alice eats 12 of them, how many are left?"
CASES = {
    "verbatim": (f"Some words before. {ITEM} And after.", True, False),
    "other values, consistent": ("Before. " + ITEM.replace("12", "250").replace("Alice", "Maria").replace("dollars", "euros") + " After.", True, True),
    "other values, inconsistent": (ITEM.replace("12", "5", 1).replace("Alice", "Maria", 1).replace("7", "9"), False, None),
    "upper case and other marks": (ITEM.upper().replace(",", " --"), True, False),
    "half of it": (ITEM[: len(ITEM) // 2], False, None),
    "one word in the middle changed": (ITEM.replace("market", "shop"), False, None),
    "none": ("A text about nothing that is in the item, though it has apples and 12 dollars.", False, None),
    "null": (None, False, None),
}


def test_templates_and_slots(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(CASES.values())], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "too short an"), (3, None), (None, ITEM), (4, "12 7 3 5 9 11 dollars euros 8")], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {i: other for i, (_, leaks, other) in enumerate(CASES.values()) if leaks}
    assert got == want
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(CASES))) - set(want)


@pytest.mark.parametrize("rows", [1, 10_000])
def test_a_leak_in_many_documents(spark, rows):
    docs = spark.range(rows).selectExpr("id doc_id", f"concat('x ', id, ' {ITEM}') text")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontaminate.find_leaks(docs, bench).count() == rows


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, ITEM), (2, "no id but text and more")], "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(edge_docs, bench).count() == 0
    assert decontaminate.find_leaks(no_docs, bench).count() == 0 and decontaminate.find_leaks(edge_docs, nothing).count() == 0
    out = decontaminate.drop_leaks(edge_docs, bench)
    assert out.columns == edge_docs.columns and out.count() == 12
    nameless = spark.createDataFrame([(None, ITEM), (None, "other"), (7, ITEM), (7, ITEM)], "doc_id long, text string")
    assert decontaminate.find_leaks(nameless, bench).count() == 2
    assert [r["text"] for r in decontaminate.drop_leaks(nameless, bench).collect()] == ["other"]


LITERAL_CASES = [
    (1, "What is 12 + 7 * 3?", "Before. What is 12 + 7 * 3? After.", "What is 12 + 7 * 4? After."),
    (2, "12 7 3 5 9 11 dollars euros 8", "x 12 7 3 5 9 11 dollars euros 8 y", "12 7 3 5 9 dollars euros 8"),
    (3, "水的沸点是多少度", "题目 水的沸点是多少度 答案", "水的沸点"),
    (4, "capital of Mauritania", "The Capital of Mauritania, so", "capital and Mauritania"),
    (5, "yes", "Yes!", "well, yes"),
]


def test_items_without_usable_windows(spark):
    bench = spark.createDataFrame([*((i, text) for i, text, _, _ in LITERAL_CASES), (6, ""), (7, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(10 * i + k, text) for i, _, *texts in LITERAL_CASES for k, text in enumerate(texts)] + [(0, ""), (1, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_slots"], r["reparameterised"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(10 * i, i, 0, False) for i, *_ in LITERAL_CASES}


SHOP = "{a} has 12 apples and gives {b} 5 of them before they walk home, so how many apples does {a} still have to sell at the shop?"


@pytest.mark.parametrize(("a", "b"), [("Alice", "Bob"), ("Priya", "Ravi"), ("Chen", "Wei"), ("Zofia", "Jürgen")])
def test_names_that_no_list_has(spark, a, b):
    bench = spark.createDataFrame([(1, SHOP.format(a="Priya", b="Ravi"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Some words. " + SHOP.format(a=a, b=b).replace("12", "30").replace(" 5 ", " 9 ")), (2, SHOP.format(a=a, b=a))], "doc_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[1] is True


def test_a_very_long_text_and_a_common_window(spark):
    """Windows that many items and documents share do not hide a leak deep inside a long text, nor make one."""

    def item(i: int) -> str:
        own = "".join(chr(97 + int(c)) for c in str(i))
        return f"what is the value of thing{own} when word{own} meets other{own} in the place{own} at noon{own} today"

    bench = spark.createDataFrame([(i, item(i)) for i in range(200)], "item_id long, text string")
    long_text = "filler words and more of it " * 60_000 + item(7) + " what is the value of it" * 500
    docs = spark.createDataFrame([(1, long_text), *((10 + i, f"so what is the value of it {i} when what is the value of you") for i in range(300))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 7)]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, f"Before. {ITEM}", 5, 6), (2, "clean words only", 7, 8)], "doc_id long, text string, _lost_id long, _lost_row long")
    assert [tuple(r) for r in decontaminate.drop_leaks(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()] == [(2, "clean words only", 7, 8)]
