import math
import random
import re

import numpy as np

from tessera.llm import urls

PAGES = "page_id long, url string, html string, host string, x int, label int, suffix string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, "h", "clash", 1, 0, "s") for i, u in rows], PAGES)


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


ODD = [None, "", "no scheme", "://", "http://", "http://x.com", "http://X.COM/", "http://notcom/", "http://com/a", "https://example.com/en/x?y", "http://EXAMPLE.com/EN/", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://n.net/es/1", "http://net/fr", "http://net/fr/", "ftp://É.net/fr/#a://b", "http://a.org?b/c", "http://a.org#b/c", "a://b\nc.com/\nd", "http://h.com:80/x", "x" * 5000 + "://" + "y" * 5000]


def test_parts_and_rules(spark):
    rows = list(enumerate(ODD)) + [(3, "http://x.com/")] * 2 + [(None, "http://x.com/")]
    got = urls.judge(table(spark, rows)).collect()
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in got) == sorted(str((i, *plain(u)[:3])) for i, u in rows)
    for r in got:
        assert r.verdict in ("allow", "block")
    by_url = dict(rows)
    assert all(r.verdict == plain(by_url[r.page_id])[3] for r in got if r.rule)


def labelled(n, seed):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefghij") for _ in range(k))
    out = []
    for _ in range(n):
        if r.random() < 0.4:
            out.append((f"http://{word(6)}-{word(5)}-{r.randint(1000, 99999)}.biz/{word(3)}?a={r.randint(0, 999999)}&b={word(9)}&c=1", 1))
        else:
            out.append((f"https://{word(7)}.org/{word(4)}/{word(6)}", 0))
    return out


def test_held_out_accuracy(spark):
    kind = "url string, label int"
    model = urls.train(spark.createDataFrame(labelled(1500, 1), kind), trees=4)
    scored = urls.scored(spark.createDataFrame(labelled(500, 2), kind), model)
    right = scored.filter(f"(margin > 0) = (label = 1)").count()
    assert right >= 490
    assert model.trees and "Python" not in scored._jdf.queryExecution().toString()


def test_one_label_or_none(spark):
    kind = "url string, label int"
    for label, sign in ((0, -1), (1, 1)):
        model = urls.train(spark.createDataFrame([(f"http://a.b/{k}", label) for k in range(9)], kind))
        assert urls.scored(spark.createDataFrame([("http://c.d/", 0)], kind), model).first()["margin"] * sign > 0
    got = urls.judge(table(spark, [(1, "http://a.org/"), (2, None)])).collect()
    assert {r.verdict for r in got} == {"allow"}
    assert urls.judge(table(spark, [])).collect() == []


def test_same_trees_for_any_order(spark):
    rows = labelled(300, 5)
    kind = "url string, label int"
    a = urls.train(spark.createDataFrame(rows, kind).repartition(7), trees=2)
    b = urls.train(spark.createDataFrame(rows[::-1] * 2, kind).repartition(2), trees=2)
    assert a.trees == b.trees and a.base == b.base and a.cuts == b.cuts


def plain_features(u):
    host, path = plain(u)[:2]
    shares = [u.count(c) / len(u) for c in set(u)]
    query = (re.search(r"(?s)\?([^#]*)", u) or [None, ""])[1]
    params = 0 if not query else query.count("&") + 1
    entropy = round(-sum(p * math.log2(p) for p in shares), 9)
    return [len(u), len(host), len(path), path.count("/"), host.count("."), sum(c in "0123456789" for c in u) / max(len(u), 1), u.count("-"), entropy, params]


def plain_trees(rows, rates_of, folds, trees, depth, bins):
    """The same model, row by row: split places, and a function from features to a margin in millionths."""
    n, bad = len(rows), sum(y for _, y in rows)
    weight = {1: n / 2 / bad, 0: n / 2 / (n - bad)}
    x = [plain_features(u) + [rates_of(u, folds[u])] for u, _ in rows]
    y = [v for _, v in rows]
    cuts = []
    for k in range(len(x[0])):
        have = sorted({r[k] for r in x})
        places = set(np.percentile([r[k] for r in x], [100 * b / bins for b in range(1, bins)]).tolist())
        between = {(max(v for v in have if v <= c), min(v for v in have if v > c)) for c in places if have[0] <= c < have[-1]}
        cuts.append(sorted((a + b) / 2 for a, b in between))
    margin, grown = [0] * n, []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m / 1e6)) for m in margin]
        g = [round(weight[b] * (b - q) * 1e6) / 1e6 for b, q in zip(y, p)]
        h = [round(weight[b] * q * (1 - q) * 1e6) / 1e6 for b, q in zip(y, p)]
        splits, at = {}, [1] * n
        for level in range(depth):
            for node in sorted({a for a in at if 1 << level <= a < 2 << level}):
                mine = [i for i in range(n) if at[i] == node]
                all_g, all_h = sum(g[i] for i in mine), sum(h[i] for i in mine)
                best, found = 1e-6, None
                for k in range(len(cuts)):
                    for cut in cuts[k]:
                        left = [i for i in mine if x[i][k] <= cut]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = lg**2 / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g**2 / (all_h + 1)
                        if lh > 1e-3 and all_h - lh > 1e-3 and gain > best + 1e-9:
                            best, found = gain, (k, cut)
                if found:
                    splits[node] = found
                    for i in mine:
                        at[i] = 2 * node + (x[i][found[0]] > found[1])
        leaves = {a: round(urls.RATE * sum(g[i] for i in range(n) if at[i] == a) / (sum(h[i] for i in range(n) if at[i] == a) + 1) * 1e6) for a in set(at)}
        margin = [m + leaves[a] for m, a in zip(margin, at)]
        grown.append(splits)
    return cuts, grown, margin


def test_trees_against_plain_version(spark):
    r = random.Random(11)
    rows = sorted({u: y if r.random() < 0.9 else 1 - y for u, y in labelled(160, 6)}.items())
    frame = spark.createDataFrame(rows, "url string, label int")
    model = urls.train(frame, trees=3, depth=2, bins=8)
    folds = {x.url: x.fold for x in frame.select("url", urls._fold(frame.url).alias("fold")).collect()}
    n, bad = len(rows), sum(y for _, y in rows)
    weight = {1: n / 2 / bad, 0: n / 2 / (n - bad)}
    suffix = lambda u: plain(u)[0].rsplit(".", 1)[-1]

    def rate(u, fold):
        others = [(v, w) for v, w in rows if suffix(v) == suffix(u) and folds[v] != fold]
        return round((sum(weight[w] * w for _, w in others) + 5) / (sum(weight[w] for _, w in others) + 10), 9)

    cuts, grown, _ = plain_trees(rows, rate, folds, 3, 2, 8)
    assert [[round(c, 6) for c in cs] for cs in model.cuts] == [[round(c, 6) for c in cs] for cs in cuts]
    assert [{k: (f, round(c, 6)) for k, (f, c) in s.items()} for s, _ in model.trees] == [{k: (f, round(c, 6)) for k, (f, c) in s.items()} for s in grown]
    rates = {x.suffix: x.rate for x in model.suffix_rates.collect()}
    hashed = {x.url: x.s for x in frame.select("url", urls.suffix(urls.host_and_path(frame.url)[0]).alias("s")).collect()}

    def margin(u):
        x, total = [*plain_features(u), rates[hashed[u]]], 0
        for splits, leaves in model.trees:
            node = 1
            while node in splits:
                node = 2 * node + (x[splits[node][0]] > splits[node][1])
            total += leaves.get(node, 0)
        return total / 1e6

    for x in urls.scored(frame, model).collect():
        assert abs(x.margin - margin(x.url)) < 1e-9


def test_unseen_suffixes_are_neutral(spark):
    """URLs of a suffix that no label has are judged by the rest of their features; both verdicts occur."""
    r = random.Random(4)
    known = [(re.sub(r"[.](biz|org)/", lambda m: f".{r.choice(('biz', 'org', 'info'))}/", u), y) for u, y in labelled(600, 8)]
    truth = [(re.sub(r"[.](biz|org)/", ".xyz/", u), y) for u, y in labelled(200, 9)]
    pages = table(spark, [(i, u) for i, (u, _) in enumerate(truth)])
    got = urls.judge(pages, spark.createDataFrame(known, "url string, label int"), rules=()).collect()
    assert sum((x.verdict == "block") == bool(truth[x.page_id][1]) for x in got) >= 190
    assert {x.verdict for x in got} == {"allow", "block"}
