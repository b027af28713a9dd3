import random

from tessera.llm import decontamination as de


def distance(item, text):
    """The least edit distance of ``item`` to any part of ``text``, cell by cell."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(text, n, r):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        r.choice([lambda: t.__setitem__(k, "~"), lambda: t.insert(k, "~"), lambda: t.pop(k)])()
    return "".join(t)


def test_myers():
    r = random.Random(1)
    for _ in range(300):
        item = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        assert de.Pattern(item).best(text)[0] == distance(item, text)


def plain(rows, items):
    once = {}
    for k, t in items:
        f = de.fold(t)
        if k is not None and len(f) >= de.MIN_ITEM_CHARS:
            once[f] = min(once.get(f, k), k)
    return sorted(str((d, k, x)) for d, t in rows for f, k in once.items() if t and (x := distance(f, de.fold(t))) <= int(de.ERROR_RATE * len(f)))


def data(words):
    r = random.Random(3)
    items = [(k, words(12, 900 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "short"), (None, words(12, 999)), (60, words(12, 900).upper()), (7, "  " + words(12, 907))]
    rows = [(0, None), (1, ""), (None, items[0][1]), (2, items[1][1]), (2, items[1][1]), (3, items[2][1] + " " + items[3][1])]
    for i in range(60):
        item = r.choice(items[:12])[1]
        rows.append((10 + i, words(r.randint(0, 30), i) + " " + edited(item, r.randint(0, 6), r).title() + "\n" + words(r.randint(0, 30), i + 1)))
    return rows, items


def test_against_plain_version(spark, make_docs, words, monkeypatch):
    rows, items = data(words)
    benchmark = spark.createDataFrame([(*x, 1, "c") for x in items], "item_id long, text string, id int, folded string")
    docs = make_docs(rows)
    want = plain(rows, items)
    for size in (8_000_000, 150):  # one block, many blocks
        monkeypatch.setattr(de, "BLOCK_CHARS", size)
        got = de.contaminated(docs, benchmark).collect()
        assert sorted(str(tuple(r)) for r in got) == want
        clean = de.drop_contaminated(docs, benchmark)
        assert clean.columns == docs.columns
        bad = {str(x).strip("(").split(",")[0] for x in want}
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if str(d) not in bad)


def test_long_text(make_docs, spark, words):
    item = words(20, 1)
    text = words(60_000, 2) + " " + item.replace(" ", "  ") + " " + words(10, 3)
    assert [tuple(r) for r in de.contaminated(make_docs([(1, text)]), spark.createDataFrame([(4, item)], "item_id long, text string")).collect()] == [(1, 4, 0)]


def test_empty(spark, make_docs, words):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, words(20, 1))], "item_id long, text string")
    assert de.contaminated(make_docs([]), some).collect() == [] == de.contaminated(make_docs([(1, "x")]), none).collect()
    assert de.drop_contaminated(make_docs([]), some).collect() == [] and de.drop_contaminated(make_docs([(1, "x")]), none).count() == 1


def test_short_and_nameless_items(spark, make_docs, words):
    """Short items match exactly as whole words, items without an id drop documents."""
    items = [(1, "Who  wrote Emma?"), (2, "cat"), (None, words(12, 999)), (3, ""), (4, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "so: who wrote\nemma? nobody"), (2, "concatenate cats, bobcat"), (3, "a Cat."), (4, "x " + words(12, 999)), (5, "who wrote emna?"), (6, None), (7, "cat"), (8, "bobcat and cat")]
    docs = make_docs(rows)
    assert sorted(tuple(r) for r in de.contaminated(docs, benchmark).collect()) == [(1, 1, 0), (3, 2, 0), (7, 2, 0), (8, 2, 0)]
    assert sorted(r.doc_id for r in de.drop_contaminated(docs, benchmark).collect()) == [2, 5, 6]


def test_pieces_of_a_text_give_the_same(words, monkeypatch):
    """Whatever the size of pieces: items across cuts, short ones beside them, hits without number, one long word."""
    r = random.Random(8)
    items = [(k, de.fold(words(15, 700 + k))) for k in range(6)] + [(9, "cat"), (10, "ab " * 20 + "ab")]
    texts = []
    for i in range(30):
        parts = [words(r.randint(0, 40), i), edited(items[i % 6][1], r.randint(0, 5), r), "bobcat" if i % 2 else "cat", words(9, i + 99)]
        texts.append(" \n ".join(parts))
    texts += ["ab " * 3000, "x" * 4000 + " cat", "x" * 4000 + "cat", " " * 3000 + "cat"]
    matcher = de.Matcher(items, de.ERROR_RATE, 10)
    want = [matcher.matches(t) for t in texts]
    assert sum(map(len, want)) > 30
    for size in (7, 64, 301):
        monkeypatch.setattr(de, "PIECE", size)
        assert [matcher.matches(t) for t in texts] == want
