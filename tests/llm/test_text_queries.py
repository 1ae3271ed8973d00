"""The registered text queries against SQL and brute force, and the pipeline."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import check
import corpus_pipeline
from herdlens.llm.near_dedup import edits_within, split_words
from herdlens.llm.queries import llm_oracles, llm_queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "conversations"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, con, name):
    df = llm_queries()[name](spark, SMALL)
    found = con.execute(llm_oracles()[name])
    columns = [c[0] for c in found.description]
    rows = [tuple(r) for r in df.collect()]
    assert sorted(columns) == sorted(df.columns)
    assert check.sorted_rows(df.columns, rows) == check.sorted_rows(columns, found.fetchall())


def test_digests_of_ids(spark, con):
    texts = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in llm_queries()["op2_pieces"](spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    words, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in llm_queries()["op10_token_files"](spark, SMALL).orderBy("doc_id").collect():
        ids = words.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(data))
        start += len(ids)


def test_stages_of_the_pipeline_take_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "one_of_each", lambda docs: seen.append(spark.conf.get(name)))
    try:
        for given in (16 << 20, 1 << 20):
            spark.conf.set(name, str(given))
            corpus_pipeline.near_dedup(spark, None, SMALL)
    finally:
        spark.conf.set(name, before)
    assert [int(s.rstrip("b")) for s in seen] == [4 << 20, 1 << 20]


def test_pipeline(spark, con):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    texts = [(i, split_words(t or "")) for i, t in kept["near_dedup"].items()]
    for n, (_, a) in enumerate(texts):  # no two of those that stay are near duplicates
        for _, b in texts[:n]:
            longer = max(len(a), len(b))
            close = min(len(a), len(b)) >= 0.8 * longer
            assert not close or edits_within(a, b, int(0.2 * longer + 1e-9)) is None
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(kept["decontamination"]) and all(r.n_tokens == len(r.ids) for r in rows)
    assert all(r.decoded == (kept["decontamination"][r.doc_id] or "") for r in rows)
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_likeness_and_verdicts(spark):
    rows = llm_queries()["op9_fingerprints"](spark, SMALL).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
    assert {r.verdict for r in llm_queries()["op5_url_filters"](spark, SMALL).collect()} <= {"allow", "block"}
