import numpy as np
import pytest

from lumenfield.llm import token_counts as tc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 13])
def test_counts_equal_direct_encoding(spark, block):
    texts = ["", None, "a b c", "", "word " * 50, "x", "é😀\n\n", "end"] * 3
    df = spark.createDataFrame([(i if i != 4 else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, file int").repartition(2)
    enc = tc.encoder(VOCABULARY)
    want = sorted([(-1 if i == 4 else i, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts)])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in tc.token_counts(df, VOCABULARY, block).collect())
    assert got == want
    assert tc.token_counts(df.limit(0), VOCABULARY, block).count() == 0


def test_flat_files_and_runs_of_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = []
    for f in range(2):
        lengths = rng.integers(0, 40, 200)
        lengths[50] = 900
        flat = np.concatenate([np.append(rng.integers(0, 50000, n), tc.EOD) for n in lengths]).astype("<u2")
        np.append(flat, [5, 6]).astype("<u2").tofile(tmp_path / f"{f}.bin")
        want += [(i, int(n)) for i, n in enumerate(lengths)]
    (tmp_path / "empty.bin").touch()
    for block, ranges in ((32, 4), (32, 10**6), (1 << 13, 1)):
        got = tc.stitch(tc.scan_files(tc.list_files(spark, str(tmp_path)), block, ranges), run=4).collect()
        assert sorted((r.ordinal, r.n_tokens) for r in got) == sorted(want)


def test_a_very_long_text_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "word " * 200_000), (2, "a b"), (2, "a b"), (2, "a b c")], "doc_id long, text string")
    got = sorted(map(tuple, tc.token_counts(df, VOCABULARY, 1000).collect()))
    enc = tc.encoder(VOCABULARY)
    assert got == sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in df.collect())
