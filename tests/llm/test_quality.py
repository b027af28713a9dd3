import math
import random

from tessera.llm import quality


def corpus(words, n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        site = f"host{r.randrange(6)}" + ("/part" if i % 3 == 0 else "")
        text = words(60, seed * 10_000 + i).replace(" a", ". a")
        good = r.random() < (0.2 if site.startswith("host0") else 0.9)
        if not good:
            text = " ".join(w + r.choice(["###", "$$$", "!!"]) for w in text.upper().split())
        rows.append((i, text, site))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs, words):
    rows, labels = corpus(words, 600, 1)
    got = {r.doc_id: r for r in quality.score(make_docs(rows), spark.createDataFrame(labels[:300], "doc_id long, quality int")).collect()}
    assert len(got) == 600
    right = sum(got[i].keep == bool(y) for i, y in labels[300:])
    assert right >= 295
    assert min(r.site_rate for r in got.values() if r.host != "host0") > max(r.site_rate for r in got.values() if r.host == "host0")


def test_shrinkage_against_plain_version(spark):
    r = random.Random(2)
    rows = [(f"h{r.randrange(5)}", f"s{r.randrange(3)}", r.choice([0, 200_000, 1_000_000])) for _ in range(400)] + [("rare", "one", 0)]
    sites = quality._sites(spark.createDataFrame(rows, "host string, section string, y long"), 0.5)
    mean, table = sites.mean, sites.table.select("of", "part", sites.rate(0, 0).alias("rate"), sites.rate(200_000, 1).alias("without"))
    got = {(x.of, x.part): x.rate for x in table.collect()}
    without = {(x.of, x.part): x.without for x in table.collect()}

    def fold(key):
        out = {}
        for x in rows:
            s, n = out.get(key(x), (0, 0))
            out[key(x)] = (s + x[2], n + 1)
        return {k: (s / 1e6, n) for k, (s, n) in out.items()}

    total, hosts, cells = fold(lambda x: 0)[0], fold(lambda x: x[0]), fold(lambda x: x[:2])
    assert math.isclose(mean, total[0] / total[1])

    def weight(groups, parent):
        q = sum(n * (s / n - parent[k]) ** 2 for k, (s, n) in groups.items())
        v = sum(parent[k] * (1 - parent[k]) for k in groups)
        n_all = sum(n for _, n in groups.values())
        spread = (q - v) / (n_all - sum(n * n for _, n in groups.values()) / n_all)
        if spread <= 0:
            return 1e6
        return min(max(sum(parent[k] * (1 - parent[k]) * n for k, (_, n) in groups.items()) / n_all / spread - 1, 1), 1e6)

    m = weight(hosts, {k: mean for k in hosts})
    host_rate = {k: (s + m * mean) / (n + m) for k, (s, n) in hosts.items()}
    host_weight, m = m, weight(cells, {k: host_rate[k[0]] for k in cells})
    for k, (s, n) in cells.items():
        hs, hn = hosts[k[0]]
        other = (hs - 0.2 + host_weight * mean) / (hn - 1 + host_weight)
        assert math.isclose(without[k], min(max((s - 0.2 + m * other) / (n - 1 + m), 1e-6), 1 - 1e-6), rel_tol=1e-3)
        assert math.isclose(got[k], (s + m * host_rate[k[0]]) / (n + m), rel_tol=1e-3)


def test_odd_rows(spark, make_docs, words):
    rows = [(1, None, None), (2, "", "a"), (3, "x" * 100_000, "a/b/c"), (None, "text", "a"), (4, words(30, 1), "a"), (4, words(30, 1), "a")]
    for labels in ([], [(1, 0), (1, 1), (4, 1), (4, None), (None, 1), (2, 7)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        docs = make_docs(rows)
        scored = quality.score(docs, table).collect()
        assert sorted(str(r.doc_id) for r in scored) == sorted(str(r[0]) for r in rows) and all(0 <= r.p_good <= 1 for r in scored)
        kept = quality.keep_good(docs, table)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored if r.keep)
        if not labels:
            assert all(r.keep for r in scored)
    assert quality.score(make_docs([]), spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    assert quality.keep_good(make_docs([]), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect() == []


def test_a_page_does_not_vouch_for_itself(spark, make_docs, words):
    """The one page of a site gets its host's and the global rate for its prior, whatever its own evidence."""
    rows, labels = corpus(words, 300, 3)
    bad = " ".join(w + "$$$" for w in words(60, 999).upper().split())
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(make_docs([*rows, (900, bad, "alone"), (901, words(60, 998), "single")]), table).collect()}
    for i in (900, 901):
        odds = lambda p: math.log(p / (1 - p))
        assert abs(odds(min(max(got[i].p_good, 1e-5), 1 - 1e-5)) - odds(min(max(got[i].p_doc, 1e-5), 1 - 1e-5))) < 0.05
