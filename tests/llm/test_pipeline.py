from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from corvia.llm import language_id, packing, toxicity  # noqa: E402
from tests.llm.test_near_duplicates import brute_components, brute_fingerprint  # noqa: E402
from tests.llm.test_tokens import expected_pieces  # noqa: E402


def test_stages_are_as_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_against_brute_force(spark, sf_dir):
    """Models are the operators'; what is done with their decisions is by hand."""
    from tokenizers import Tokenizer

    from corvia.llm.queries import vocabulary

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir)
    accepted = {r["doc_id"] for r in language_id.identify_documents(docs, language_id.fit(docs)).where("accepted").collect()}
    one = docs.where(docs.doc_id.isin(list(accepted)))
    model = toxicity.fit(one, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(one, model).where("predicted = 0").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in one.select("doc_id", "text").collect() if r["doc_id"] in clean)
    comps = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    kept = [(i, t) for (i, t), c in zip(rows, comps) if c == i]
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    assert Counter(tuple(r[c] for c in packing.PIECE.names) for r in got.collect()) == expected_pieces(kept, tok, 4096)
    assert len(accepted) >= 0.99 * docs.count()


def test_filtering_stages_keep_columns(spark, sf_dir, odd_docs):
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd_docs, sf_dir)
        assert out.columns == odd_docs.columns
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0


def test_planted_documents_are_rejected_and_others_kept(spark, sf_dir):
    """Language ID: foreign and junk texts go, clean ones stay and get their language."""
    from tests.llm.test_text_models import FOREIGN

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = spark.createDataFrame([(10**9 + k, t, "en", "src0", len(t)) for k, t in enumerate([*FOREIGN, "12 34 -- 56", "", None]) for t in [t or ""]], docs.schema)
    left = corpus_pipeline.identify(spark, docs.unionByName(planted), sf_dir).select("doc_id", "lang").collect()
    assert {r["doc_id"] for r in left} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert sum(labels[r["doc_id"]] == r["lang"] for r in left) >= 0.98 * len(left)


def test_entry_lists_every_query():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
