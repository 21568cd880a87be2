import re

from lodestone.llm import decontamination as D

UNITS = D.UNITS.split("|")


def tokens(text):
    """The template by plain Python."""
    text = re.sub(r"(?<=[a-zà-ÿ0-9,;] )([A-ZÀ-Þ][a-zà-ÿ]\w*)", lambda m: f"{D.SLOT}m{m[1]}", text or "")
    if re.search("[0-9]", text):
        text = re.sub(rf"(?<=[0-9])( ?)({D.UNITS})(?![^\W\d_])", lambda m: f" {D.SLOT}u{m[2]}", text)
        text = re.sub("[0-9]+", lambda m: f" {D.SLOT}n{m[0]}", text)
        text = re.sub(rf"(?<=[0-9]) ?([{D.SIGNS}])|([$€£])(?= ?{D.SLOT}n)", lambda m: f" {D.SLOT}u{m[1] or ''}{m[2] or ''}", text)
        text = text.translate(str.maketrans(D.SIGNS, D.SPELT))
    return [w for w in re.split("[^a-zà-ÿ0-9-]+", text.lower()) if w]


def brute(docs, items):
    def windows(t):
        w = tokens(t)
        return [(tuple(x[:2] if x[0] == D.SLOT else x for x in w[i : i + 5]), [x if x[0] == D.SLOT else "" for x in w[i : i + 5]], i) for i in range(len(w) - 4)]

    out = set()
    for item, text in items.items():
        own = [x for x in windows(text) if sum(s == "" for s in x[1]) >= 2]
        n = len({x[0] for x in own})
        for doc, t in docs.items():
            diagonals = {}
            for h, slots, p in windows(t):
                for g, mine, q in own:
                    if g == h:
                        diagonals.setdefault(p - q, []).append((h, list(zip(mine, slots))))
            hits = {}
            for rows in diagonals.values():
                pairs = {p for _, ps in rows for p in ps if p[0]}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    for h, _ in rows:
                        hits.setdefault(h, set()).add(any(a != b for a, b in pairs))
            if n and len(hits) >= 0.8 * n:
                out.add((doc, item, len(hits), n, any(min(v) for v in hits.values())))
    return out


ITEMS = {
    1: "Tom buys 12 apples for $3 each and then 12 pears; how much money does Tom spend in all on that day?",
    2: "A train runs 60 km in 45 minutes from Bern to Basel, so what is its speed in km per hour on this line?",
    3: "Too short here",
    4: "plain words only and no slot at all in this one item of the benchmark list",
    5: None,
    6: "7 8 9 10 11 12 13 14",
}
DOCS = {
    1: "Intro text. " + ITEMS[1] + " The end.",
    2: "x " + ITEMS[1].replace("12", "77").replace("$3", "$9").replace("Tom", "Ann") + " y",
    3: ITEMS[1].replace("12 apples", "15 apples").lower(),
    4: ITEMS[2].replace("60", "90").replace("45", "30"),
    5: "PLAIN words only, and no slot at all; in this one item of the benchmark list!",
    6: "plain words only and nothing else of the item",
    7: None,
    8: "",
    9: "7 8 9 10 11 12 13 14 and Too short here",
    10: ITEMS[2] + " and " + ITEMS[4] + " " + "filler words " * 3000,
    11: "clean text with 12 apples and $3 and other things that nobody asked about in any benchmark item",
}


def tables(spark):
    docs = spark.createDataFrame([(k, v, "a", 1) for k, v in DOCS.items()] + [(1, DOCS[1], "a", 1), (None, "no id", "b", 2)], "doc_id long, text string, item_id string, pos int")
    items = spark.createDataFrame([(k, v, 0) for k, v in ITEMS.items()] + [(1, ITEMS[1], 0)], "item_id long, text string, doc_id int")
    return docs, items


def test_template(spark):
    for text in [ITEMS[1], ITEMS[2], "Él dijo 3.5kg y 20% de Madrid, Été 4 €5", "Über 30°", ""]:
        from pyspark.sql import functions as F

        assert spark.createDataFrame([(text,)], "text string").select(F.expr(D.template("text")).alias("t")).first().t == tokens(text)


def test_against_brute_force(spark):
    docs, items = tables(spark)
    got = {tuple(r) for r in D.contaminated(docs, items).collect()}
    assert got == brute(DOCS, ITEMS)
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (2, 1), (4, 2), (5, 4), (10, 2), (10, 4)}
    assert {d for d, *_, changed in got if changed} == {2, 4}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = tables(spark)
    want = {tuple(r) for r in D.contaminated(docs, items).collect()}
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert {tuple(r) for r in D.contaminated(docs, items).collect()} == want


def test_clean_and_empty(spark, no_docs):
    docs, items = tables(spark)
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 6, 7, 8, 9, 11]
    assert D.contaminated(no_docs, items).collect() == []
    assert D.clean(docs, items.limit(0)).count() == docs.count()


def test_names_in_another_case_or_line_and_texts_under_one_id(spark):
    item, other = ITEMS[2], "another text of the same item that only one of the documents has inside"
    items = spark.createDataFrame([(1, item), (1, other), (1, "a third text with that id that no document holds at all")], "item_id long, text string")
    rows = [item.lower(), item.upper(), item.replace(" Bern", "\nBern").replace(" Basel", "\n  Basel"), item.replace(" Bern", "\nOslo").replace("60", "70"), other, item.replace("Bern", "rome").replace("Basel", "oslo")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.covered == r.windows, r.reparameterised) for r in D.contaminated(docs, items).collect()}
    assert got == {0: (1, True, False), 1: (1, True, False), 2: (1, True, False), 3: (1, True, True), 4: (1, True, False)}


def test_different_values_may_become_equal(spark):
    item = "we know that Alice has 3 apples and buys 5 pears at the market every week of the year"
    rows = [item.replace("Alice", "Bob").replace("3", "4").replace("5", "4"), item.replace("3", "9").replace("5", "6") + " and then " + item.replace("5", "7")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "we saw that 3 men and then 3 women came to see it in the end of the year")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in D.contaminated(docs, items).collect()}
    assert {(d, i) for d, i, _ in got} == {(0, 1), (1, 1)} and (0, 1, True) in got
