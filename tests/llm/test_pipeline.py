"""The pipeline's stages, each against what its predecessor kept."""

import corpus_pipeline as C
from quarrylens.llm.langid import identify, train_pieces


def words(t):
    w = t.lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in C.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept = C.materialize(kept)
        ids = {r[0] for r in kept.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if name == "language ID":
            ok = identify(docs, train_pieces(docs), keep=["doc_id"]).where("lid_ok").count()
            assert len(ids) == ok and ok > 0.9 * docs.count()
        if name == "n-gram Jaccard join":  # brute force: of what is kept no two are alike, of what went each has a like one
            text = {r["doc_id"]: words(r["text"]) for r in before.collect()}
            like = lambda a, b: len(text[a] & text[b]) / len(text[a] | text[b]) >= 0.6
            left = sorted(ids)
            assert not any(like(a, b) for k, a in enumerate(left) for b in left[:k])
            assert all(any(like(a, b) for b in text if b != a) for a in text if a not in ids)
    tokens = C.STAGES[-1][1](spark, kept, sf)
    assert tokens.count() == kept.count()
    assert [n for n, _ in C.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_run_and_odd_rows(spark, sf, odd, none, tmp_path):
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for k, df in enumerate((base, base.limit(0))):
        at = str(tmp_path / f"sf{k}")
        df.write.parquet(f"{at}/documents.parquet")
        out = C.run(spark, at)
        assert out.count() <= df.count()
    assert C.run(spark, sf).count() > 0


def test_last_stage_returns_the_decoded_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    out = {r["doc_id"]: r["decoded"] for r in C.tokens(spark, docs, sf).collect()}
    assert out == {r["doc_id"]: r["text"] for r in docs.collect()}
