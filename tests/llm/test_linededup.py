from collections import Counter

from tessera.llm import linededup


def plain(rows, ratio):
    pages, seen = Counter(s for _, _, s in rows), Counter()
    for _, t, s in rows:
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[s, line] += 1
    gone = {k for k, n in seen.items() if n >= 2 and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone) for _, t, s in rows]


def rows_of(words):
    rows = []
    for i in range(200):
        site = ("a", "b", None, "tiny")[0 if i % 3 else 1 if i % 2 else 2 if i % 5 else 3]
        lines = [words(5, i), words(6, i % 40), "footer " + str(site)] + (["  all rights reserved "] if i % 4 == 0 else []) + ([""] if i % 7 == 0 else [])
        rows.append((i, "\n".join(lines), site))
    return rows + [(500, None, "a"), (501, "", "a"), (502, "footer a", "a"), (503, "footer a\nfooter a\nown line", "a"), (503, "footer a\nfooter a\nown line", "a"), (None, "footer a\nx", "a"), (601, "head\none", "two pages"), (602, "head\ntwo", "two pages"), (603, "lone\nlone", "one page"), (504, "long " + words(30_000, 4), "a")]


def test_against_plain_version(make_docs, words):
    rows, docs = rows_of(words), make_docs(rows_of(words))
    want = plain(rows, 0.1)
    limits = {"ratio": 0.1}
    out = linededup.drop_boilerplate(docs, **limits)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(str, ((r[0], t, r[2]) for r, t in zip(rows, want))))
    assert all(r.n_chars == len(r.text or "") for r in got)
    report = linededup.line_report(docs, **limits).collect()
    n = lambda t: 0 if t is None else len(t.split("\n"))
    assert sorted(str((r.doc_id, r.n_lines, r.n_dropped)) for r in report) == sorted(str((r[0], n(r[1]), 0 if r[1] is None else n(r[1]) - (n(t) if t or len(r[1]) == 0 or "\n" in t else 0))) for r, t in zip(rows, want))


def test_nothing_to_drop_and_empty(make_docs, words):
    docs = make_docs([(i, words(8, i)) for i in range(30)])
    assert sorted(linededup.drop_boilerplate(docs).collect()) == sorted(docs.collect())
    assert linededup.drop_boilerplate(make_docs([])).collect() == [] and linededup.line_report(make_docs([])).collect() == []
