import corpus_pipeline
from sentencepiece import SentencePieceProcessor

from hardwood.llm import mixing, near_dups, pieces, quality, toxicity
from tests.llm.helpers import frame, odd_documents, tables
from tests.llm.test_toxicity import LABELS, corpus


def test_stages_one_after_the_other(spark, tmp_path):
    rows, labels = corpus(240)
    rows = rows + [(5000 + i, r[1], "en", f"s{i % 2}", 1) for i, r in enumerate(rows[:40])] + [(7000 + i, *r[1:]) for i, r in enumerate(odd_documents())]
    d = tables(spark, tmp_path, documents=frame(spark, rows), labels=frame(spark, labels, LABELS))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, d).cache()
        seen[name] = docs
        if i < 4:
            assert docs.columns == before.columns
    labels_df = frame(spark, labels, LABELS)
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), labels_df)
    scores = {(r.doc_id, r.score) for r in toxicity.scored(spark.read.parquet(f"{d}/documents.parquet"), model).collect()}
    assert {r.doc_id for r in seen["toxicity"].collect()} == {i for i, s in scores if s < 0.5}
    judged = quality.judged(seen["toxicity"], quality.ratio_weights(seen["toxicity"], labels_df))
    assert seen["quality"].count() == judged.where("kept").count()
    groups = near_dups.near_duplicates(seen["quality"], 80, 5).collect()
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {r.component_id for r in groups}
    mixed = mixing.mix(mixing.with_sizes(seen["near_duplicates"])).collect()
    assert seen["mixing"].count() == sum(r.copies for r in mixed)
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r.doc_id: r.text for r in seen["mixing"].collect()}
    for r in seen["sentencepiece"].collect():
        assert r.pieces == library.encode(text[r.doc_id]) and r.n_pieces == len(r.pieces)
    key = lambda df: sorted((r.doc_id, r.n_pieces) for r in df.collect())
    assert key(corpus_pipeline.run(spark, d)) == key(seen["sentencepiece"])


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, documents=frame(spark, []), labels=frame(spark, [], LABELS))
    assert corpus_pipeline.run(spark, d).count() == 0
