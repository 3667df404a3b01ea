import corpus_pipeline
from cotejo.llm import bag_minhash, ordinal_quality, templates, toxicity_mil

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    """The pipeline against its operators' own answers, stage by stage on plain Python sets."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    left = {r.doc_id for r in docs.select("doc_id").collect()}

    def now():
        return docs.where(docs.doc_id.isin(sorted(left)))

    left &= {r.doc_id for r in toxicity_mil.score_toxicity(now(), toxicity_mil.train_toxicity(now(), labels)).collect() if not r.predicted}
    left &= {r.doc_id for r in ordinal_quality.score_quality(now(), ordinal_quality.train_quality(now(), labels)).collect()
             if r.tail_probability >= 0.5}
    left &= {r.class_id for r in bag_minhash.near_duplicate_classes(now()).collect()}
    left -= {r.doc_id for r in templates.contaminated(now(), bench).collect()}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(left)
    assert all(r.piece_ids for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "benchmark decontamination",
                                                      "SentencePiece encoding"]
