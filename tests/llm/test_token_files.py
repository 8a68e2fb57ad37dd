from __future__ import annotations

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

from ledgerlens.llm import token_files as T

RANKS, PATTERN, SEP = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256


def write(tmp_path, name, tokens, width=2):
    np.array(tokens, dtype=T.token_type(width)).tofile(tmp_path / name)
    return f"file://{tmp_path}/{name}"


def brute(tokens, sep):
    out, n = [], 0
    for t in tokens:
        if t == sep:
            out.append((len(out), n, True))
            n = 0
        else:
            n += 1
    return out + [(len(out), n, False)] * (n > 0)


@pytest.mark.parametrize(("width", "block"), [(2, 1), (2, 2), (2, 7), (4, 7), (2, 1000)])
def test_counts_equal_a_plain_scan_across_block_borders(spark, tmp_path, monkeypatch, width, block):
    monkeypatch.setattr(T, "GROUP", 3)
    rng, sep = random.Random(block), 9
    files = {"none": [1, 2, 3] * 5, "only": [9, 9, 9], "open": [1, 9, 2, 2], "empty": [], "one": [9], "long": [5] * 60 + [9] + [4] * 13,
             "mixed": [rng.choice([1, 2, 3, 9]) for _ in range(100)]}
    paths = {name: write(tmp_path, name, tokens, width) for name, tokens in files.items()}
    got = T.token_counts(spark.createDataFrame([(p,) for p in paths.values()] * 2, "path string"), sep, width, block).collect()
    for name, tokens in files.items():
        assert sorted((r.ordinal, r.n_tokens, r.closed) for r in got if r.path == paths[name]) == brute(tokens, sep), name


def test_blocks_and_sizes_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    paths = [(write(tmp_path, f"f{i}", [1, 9] * 50), i) for i in range(40)]
    files = spark.createDataFrame(paths, "path string, file long").coalesce(1)
    monkeypatch.setattr(T, "TASK_FILES", 2)
    sized = T.checkpointed(T.file_sizes(files))
    assert sized.rdd.getNumPartitions() == 20
    # 1,000 blocks of 8 bytes: as many tasks as their bytes ask for, however small the descriptors are
    monkeypatch.setattr(T, "TASK_BYTES", 200)
    blocks = T.block_table(sized, block=4).persist()
    held = blocks.rdd.glom().map(len).collect()
    assert len(held) == 40 and sum(held) == 1000 and min(held) >= 20 and max(held) <= 30


def test_a_torn_file_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        T.token_counts(spark.createDataFrame([(f"file://{tmp_path}/x",)], "path string"), 9).collect()


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_corpus_counts_equal_the_tokenizer(spark, docs, block, monkeypatch):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE doc_id < 40").fetchall()
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|>"), (1003, "é🎉 \n"), (1003, "é🎉 \n"), (None, "no id"), (1004, "ab " * 30_000)]
    encode = T._encoding(PATTERN, RANKS).encode_ordinary
    got = T.corpus_token_counts(spark, docs(rows, path="p", ordinal=1, n_tokens="x"), RANKS, PATTERN, SEP, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, len(encode(t or ""))) for i, t in rows), key=str)


def test_files_turn_over_when_full(spark, docs, tmp_path, monkeypatch):
    manifest = T.write_token_files(docs([(i, "a b c") for i in range(10)]).coalesce(1), RANKS, PATTERN, SEP, folder=f"file://{tmp_path}")
    path = manifest.first().path
    tokens = np.fromfile(path[7:], dtype="<u2")
    assert (tokens == SEP).sum() == 10 and tokens[-1] == SEP and manifest.count() == 10


def test_empty_table(spark, docs):
    assert T.corpus_token_counts(spark, docs([(1, "a")]).where("false"), RANKS, PATTERN, SEP).count() == 0
