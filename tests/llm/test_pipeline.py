"""The pipeline stage by stage, and the registered queries over the smallest tables."""

import os

import duckdb

import corpus_pipeline
from econcheck.llm import decontaminate, langid, ngram_join, quality, queries


def table(sf, name):
    path = f"{sf}/{name}.parquet"
    return path + "/*.parquet" if os.path.isdir(path) else path


def test_stages_keep_what_they_should(llm, sf):
    docs = llm.read.parquet(f"{sf}/documents.parquet")
    labels = llm.read.parquet(f"{sf}/labels.parquet")
    bench = llm.read.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "decontamination", "byte_bpe"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, ngram_join.written(stage(llm, kept, sf))
        ids = {r.doc_id for r in kept.collect()}
        if name != "byte_bpe":
            assert kept.columns == docs.columns
        if name == "language_id":
            model = langid.fit_languages(before.select("doc_id", "lang", "text").where(langid.remainder(before.doc_id, 4) != 2))
            want = {r.doc_id for r in langid.identify(before, model).collect() if r.lang_pred != "und" and r.score >= 0.5}
        elif name == "quality":
            model = quality.fit_quality(before, labels.where(quality.remainder(labels.doc_id, 5) != 0))
            want = {r.doc_id for r in quality.score_quality(before, model).collect() if r.predicted == 1}
        elif name == "near_duplicates":
            want = {r.component_id for r in ngram_join.ngram_components(before).collect()}
        elif name == "decontamination":
            want = {r.doc_id for r in before.collect()} - {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
        else:
            want = {r.doc_id for r in before.collect()}
        assert ids == want and kept.count() == len(ids)
    assert 0 < len(ids) < docs.count()


def test_odd_documents_pass_the_stages(llm, sf, docs_of):
    docs = docs_of((1, None), (2, ""), (None, "the end of it"), (3, "!!"), (4, "a b c d e f", None), (4, "a b c d e f", None), (4, "k l m n o p", "en")).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            assert stage(llm, rows, sf).count() <= rows.count()
    kept = corpus_pipeline.one_of_each_group(llm, docs, sf)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "None"]


def test_texts_of_one_doc_id_are_judged_apart(llm, sf, docs_of):
    a, b, c = "a b c d e f g", "k l m n o p q", "u v w x y z"
    docs = docs_of((3, a), (5, a), (5, b), (5, b), (9, b), (7, c), (8, c), (None, c), (6, None), (6, "")).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.one_of_each_group(llm, docs, sf)
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("3", a), ("5", b), ("6", ""), ("7", c), ("None", c)]
    bench = llm.createDataFrame([(1, a)], "item_id long, text string")
    left = decontaminate.clean(docs, bench)
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("5", b), ("5", b), ("9", b), ("7", c), ("8", c), ("None", c), ("6", ""), ("6", "")])


def test_url_query_equals_its_sql(llm, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{table(sf, 'pages')}'")
    got = [tuple(r) for r in queries.op8_url_rules(llm, sf).collect()]
    assert sorted(map(str, got)) == sorted(str(r) for r in con.execute(queries.OP8_SQL).fetchall())


def test_names_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(corpus_pipeline.queries()) == {"pipeline"}
