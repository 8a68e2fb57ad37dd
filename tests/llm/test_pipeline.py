"""The registered queries against their oracles, and the pipeline against a brute-force version."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerlens.llm import oracle, quality_rules, queries
from ledgerlens.llm.common import table
from test_mixing import brute as mixed_by_hand, size
from test_quality import plain_stats
from test_simhash import brute as named_by_hand, plain_fingerprint

SF = "/root/testdata/sf0.001"


def rows_of(sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q = con.execute(sql)
    return [d[0] for d in q.description], q.fetchall()


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns, want = rows_of(oracle.ORACLE[name])
    assert plain(got.select(*columns).collect()) == plain(want) and set(columns) == set(got.columns)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_simhash_query_equals_brute_force(spark):
    _, rows = rows_of("SELECT doc_id, text FROM documents")
    want = named_by_hand([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows], 3)
    assert sorted(map(tuple, queries.op7_simhash(spark, SF).collect())) == sorted(want)


def test_sentencepiece_query_round_trips(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    _, rows = rows_of("SELECT doc_id, text FROM documents")
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    for i, t in rows:
        assert got[i].token_ids == sp.encode(t) and got[i].n_tokens == len(got[i].token_ids) and got[i].round_trip


def test_pipeline_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    names, rows = rows_of("SELECT doc_id, text, lang, source FROM documents")
    # quality: base rules, and the cutoffs that the labels prove (none at this size)
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert quality_rules.learn_cutoffs(docs.select("doc_id", "lang", quality_rules.stats_of("text").alias("s")), marks) == {}
    rows = [r for r in rows for n, *_, rep in [plain_stats(r[1])] if n >= 50 and 100 * rep <= 50 * n]
    last = {t: max(i for i, u, *_ in rows if u == t) for t in {r[1] for r in rows}}
    rows = [r for r in rows if last[r[1]] == r[0]]
    keep = {c for *_, c in named_by_hand([r[0] for r in rows], [plain_fingerprint(r[1]) for r in rows], 3)}
    rows = [r for r in rows if r[0] in keep]
    took = {i: t for i, *_, t in mixed_by_hand(rows)}
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    words = Counter()
    for r in got:
        words[r.doc_id] += size(r.text)
        assert r.token_ids == sp.encode(r.text) and r.round_trip
    assert +words == Counter({i: t for i, t in took.items() if t})
    assert got and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "token_ids", "round_trip"}


def test_last_stage_says_which_texts_come_back(spark):
    rows = [(1, "a plain text", 1, "x"), (2, "a mark ▁ inside", 2, "y"), (3, None, 3, None), (4, "", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, __in__ string").withColumn("decoded", F.lit(5))
    got = corpus_pipeline.sentencepiece_round_trip(spark, docs, SF)
    assert got.columns == ["doc_id", "text", "a.b", "__in__", "decoded", "token_ids", "round_trip"]
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    for r in got.collect():
        assert tuple(r[:4]) == rows[r.doc_id - 1] and r.decoded == 5 and r.token_ids == sp.encode(r.text or "")
        assert r.round_trip == (r.doc_id != 2) == (sp.decode(r.token_ids) == (r.text or ""))


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pii_query_spans_point_at_what_they_say(spark):
    _, rows = rows_of("SELECT doc_id, text FROM documents")
    text = dict(rows)
    got = queries.op3_pii(spark, SF).collect()
    assert {r.doc_id for r in got} == set(text)
    for r in got:
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            piece = text[r.doc_id][int(a):int(b)]
            assert piece and (kind != "email" or "@" in piece) and (kind != "ip" or piece.count(".") == 3)
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("email", "ip", "card", "phone"))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256


def test_token_count_and_warc_queries_cover_their_tables(spark):
    _, rows = rows_of("SELECT doc_id, text FROM documents")
    encode = queries.token_files._encoding(queries.public_tokenizers.PATTERN, queries.RANKS).encode_ordinary
    assert sorted(map(tuple, queries.op10_token_counts(spark, SF).collect())) == sorted((i, len(encode(t))) for i, t in rows)


def test_classifier_and_rules_queries_cover_their_table(spark):
    _, rows = rows_of("SELECT doc_id, text FROM documents")
    rules = {r.doc_id: r for r in queries.op2_quality_rules(spark, SF).collect()}
    assert len(rules) == len(rows) and all(tuple(rules[i])[1:6] == plain_stats(t) for i, t in rows)
    scores = queries.op4_quality_gam(spark, SF).collect()
    assert {r.doc_id for r in scores} == {i for i, _ in rows} and np.isfinite([r.score for r in scores]).all()
