import inspect

import corpus_pipeline
from tessera.llm import linededup, quality, sentencepiece
from tests.llm.test_decontamination import plain as leaks
from tests.llm.test_linededup import plain as cleaned
from tests.llm.test_simhash import groups
from tests.llm.test_simhash import plain as fingerprint


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_against_plain_versions(spark, tmp_path, words):
    items = [(k, words(15, 5000 + k)) for k in range(5)]
    docs = []
    for i in range(300):
        text = words(40 + i % 50, i) + ".\n" + "All rights reserved by this site" * (i % 3 == 0)
        if i % 10 == 1:
            text = " ".join(w + "###" for w in text.upper().split())
        if i % 10 == 2:
            text = words(60, 20_000 + i % 4) + "." + " tail" * (i % 3)
        if i % 25 == 3:
            text += " " + items[i % 5][1]
        docs.append((i, text, "en", f"site{i % 2}", len(text)))
    docs += [(400, None, None, None, None), (401, "", "en", "site0", 0), (402, docs[4][1], "en", "site0", 1), (402, docs[4][1], "en", "site0", 1)]
    labels = [(i, int(i % 10 != 1), 0) for i in range(0, 150)]
    write(spark, tmp_path, docs, labels, items)
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.score(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.keep}
    assert good >= {i for i, y, _ in labels if y} and not good & {i for i in range(300) if i % 10 == 1}
    left = [d for d in docs if d[0] in good]
    texts = cleaned([(d[0], d[1], d[3]) for d in left], linededup.RATIO)
    rows = list(dict.fromkeys((d[0], t) for d, t in zip(left, texts)))
    component = {d: c for d, _, c in groups([(d, fingerprint(t, 5, 256, True)) for d, t in rows], 44)}
    rows = [(d, t) for d, t in rows if component[d] == d]
    bad = {eval(x)[0] for x in leaks(rows, items)}
    codec = sentencepiece.Codec(sentencepiece.read_vocabulary())
    assert bad and got == sorted((d, list(memoryview(codec.encode(t)).cast("i"))) for d, t in rows if d not in bad)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontaminate", "encode"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []




def test_boilerplate_of_small_hosts_goes(spark, make_docs, words):
    docs = make_docs([(i, words(20, i) + "\nAll rights reserved", "small") for i in range(19)])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()) == [(i, words(20, i)) for i in range(19)]


def test_each_stage_takes_odd_rows(spark, tmp_path, words):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash with inner ones."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, host_s long, part string, gone string, site int, kept_id long, kept_hash long, odds double"
    more = (1, "p", "g", 2, 3, 4, 0.5)
    item = words(15, 5000)
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, words(30_000, 1), "en", None, 1), (4, words(40, 2), "en", "s", 1)]
    rows += [rows[-1], (5, words(40, 2), None, "t", None), (None, words(40, 3), "en", "t", 7), (6, words(20, 4) + " " + item, "en", "t", 7)]
    docs = spark.createDataFrame([(*r, *more) for r in rows], kind)
    write(spark, tmp_path, [], [(4, 1, 0), (None, 0, 0), (5, None, None)], [(1, item), (None, None), (2, "")])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = sorted((r.doc_id for r in out.collect()), key=str)
    every = sorted((r[0] for r in rows), key=str)
    assert kept["quality_classifier"] == kept["line_dedup"] == every
    assert kept["near_dedup"] == [1, 3, 4, 6, None, None]
    assert kept["decontaminate"] == [x for x in every if x != 6]
    assert sorted((r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()), key=str) == every
