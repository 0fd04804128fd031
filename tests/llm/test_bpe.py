import hypothesis.strategies as st
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from pyspark.sql import functions as F
from quarrylens.llm.bpe import VOCABULARY, Dictionary, bpe_decode, bpe_encode, encode_slice, merges
from tokenizers import Tokenizer

REFERENCE = Tokenizer.from_file(VOCABULARY)
REFERENCE.encode_special_tokens = True


def encode(texts):
    b = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for _, ids, n, got, ends in encode_slice([b], "text", Dictionary(merges(VOCABULARY))):
        c = np.concatenate([[0], np.cumsum(n)])
        return [ids[x:y].tolist() for x, y in zip(c[:-1], c[1:])], [got[x:y].tobytes().decode() for x, y in zip(ends[:-1], ends[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\nstrevmld!aA0")), max_size=40), min_size=1, max_size=4))
def test_any_text_as_a_known_tokenizer_has_it(texts):
    ids, back = encode(texts)
    assert ids == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]
    assert back == texts


def test_runs_and_overlaps():
    texts = ["a" * 5001, "aaa", "'''s 't don't", "ab" * 333, "<|endoftext|>"]
    ids, back = encode(texts)
    assert ids == [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)] and back == texts


def test_odd_rows(odd, none):
    out = bpe_encode(odd.withColumns({c: F.lit("x") for c in ("a.b", "c0", "c1", "body")}))
    rows = out.collect()
    assert out.columns.count("tokens") == 1 and len(rows) == odd.count()
    for r in rows:
        assert (r["tokens"] is None) == (r["text"] is None) == (r["n_tokens"] is None)
        assert r["decoded"] == r["text"] and (r["text"] is None or len(r["tokens"]) == r["n_tokens"])
    again = bpe_decode(out.drop("decoded", "a.b"), to="back").where("back is distinct from text").count()
    assert again == 0
    assert bpe_encode(none).count() == 0


def test_query_is_whole(spark, sf):
    from quarrylens.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    want = REFERENCE.encode_batch([docs[r["doc_id"]] for r in rows], add_special_tokens=False)
    assert all(r["tokens"] == w.ids and r["decoded"] == docs[r["doc_id"]] for r, w in zip(rows, want))
