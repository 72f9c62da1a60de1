import corpus_pipeline
from test_decontaminate import brute
from test_simhash import plain_fingerprint, roots

from veil.llm import langid, mixing, output
from veil.llm.common import stored


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        kept[name] = (before, docs)
        assert name == "token_output" or docs.columns == columns
    before, after = kept["language_id"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not any(c.isalpha() for c in r.text or "")}
    before, after = (x.orderBy("doc_id").collect() for x in kept["near_duplicates"])
    root = roots([plain_fingerprint(r.text) for r in before], 4)
    assert [r.doc_id for r in after] == sorted({before[i].doc_id for i in root})
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        gone.pop(r.doc_id)
    assert gone and all(brute(t, items)[1] for t in gone.values())
    before, after = kept["mixing"]
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(after.collect()) / words(before.collect()) - 1.5) < 0.05
    before, after = kept["token_output"]
    rows = after.collect()
    assert {d for r in rows for d in r.doc_ids} == {r.doc_id for r in before.collect()}
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert sum(r.n_tokens != output.LENGTH for r in rows) <= 1


def test_run_is_registered_and_gives_the_same(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    a = {(r.slot, r.sha256) for r in corpus_pipeline.run(spark, sf_dir).select("slot", "sha256").collect()}
    assert a


def test_empty_documents(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert langid.accepted(docs, langid.learn(docs)).where("doc_id IN (1, 2, 3)").isEmpty()
    assert mixing.mixed(docs).columns == docs.columns
