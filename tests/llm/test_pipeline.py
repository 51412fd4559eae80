import corpus_pipeline
from partita.llm import language_id, line_dedup, mixing
from partita.llm.queries import ORACLE_SQL, QUERIES
from test_near_dedup import jaccard_components


def test_every_stage_works_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r for r in docs.collect()}
        if name == "language":
            gone = {r["doc_id"] for r in language_id.identify(docs, language_id.fit(docs)).collect() if r["rejected"]}
            assert {r["doc_id"] for r in got.collect()} == set(before) - gone
        elif name == "lines":
            want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
            assert {r["doc_id"]: r["text"] for r in got.collect()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
        elif name == "near_duplicates":
            want = set(jaccard_components([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
            assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
        elif name == "mixture":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
            assert got.groupBy("doc_id").count().collect() and {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == want
        else:
            assert {r["doc_id"] for r in got.collect()} == set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == names
        docs = got
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_registered():
    assert len([q for q in QUERIES if q.startswith("op")]) == 13 and "pipeline" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)
