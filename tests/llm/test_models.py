"""Language model, classifier and piece encoder against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lumenfield.llm import cotrain, merge_dropout, ngram_lm

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BIG = "/root/testdata/sf0.01"


# ---- deleted interpolation -----------------------------------------------------------------------


def brute_lm(rows):
    """(held_out, n_tokens, n_known, N, base, score) of each row, with exact expectation-maximisation."""
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    fold = [0 if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in rows]
    pairs = lambda ts: zip([b"", *ts[:-1]], ts, strict=True)

    def counted(folds):
        own = [t for t, f in zip(tokens, fold, strict=True) if f in folds]
        return Counter(x for t in own for x in t), Counter(p for t in own for p in pairs(t))

    def parts(c1, c2, a, b):
        return c2[a, b] / max(c1[a], 1), c1[b] / max(sum_of[id(c1)], 1), 1 / (len(c1) + 1)

    kept, both = counted({0, 3, 4}), counted({0, 2, 3, 4})
    sum_of = {id(c[0]): sum(c[0].values()) for c in (kept, both)}
    seen = {}
    for t, f in zip(tokens, fold, strict=True):
        if f == 2:
            for a, b in pairs(t):
                seen.setdefault(math.frexp(kept[0][a])[1], []).append(parts(*kept, a, b))
    weights, last = {}, np.array([0, 0.5, 0.5])
    for b in range(66):
        if b in seen:
            p, w = np.array(seen[b]), np.full(3, 1 / 3)
            for _ in range(20):
                share = w * p
                w = (share / share.sum(1, keepdims=True)).mean(0)
            last = np.maximum(w, 1e-9)
            last /= last.sum()
        weights[b] = last
    n, v = sum_of[id(both[0])], len(both[0])
    out = []
    for t, f in zip(tokens, fold, strict=True):
        base = sum(math.log10((both[0][x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        score = sum(math.log10(weights[math.frexp(both[0][a])[1]] @ np.array(parts(*both, a, b))) for a, b in pairs(t))
        out.append((f == 1, len(t), sum(both[0][x] > 0 for x in t), n, base, score))
    return out


@pytest.mark.parametrize("part_tokens,bucket_keys,fan", [(4_000_000, 2_000_000, 64), (3000, 500, 64), (2500, 2000, 3)])
def test_lm_scores_equal_plain_counts(spark, sf_dir, part_tokens, bucket_keys, fan):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "null id"), (5, None), (5, ""), (1, "A a b É"), (1, "A a b É")]
    df = spark.createDataFrame([(*r, 1.5, 2) for r in rows], "doc_id long, text string, score double, part int")
    got = sorted(map(tuple, ngram_lm.lm_scores(df, part_tokens, bucket_keys, fan).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted([(i, *w) for (i, _), w in zip(rows, brute_lm(rows), strict=True)], key=lambda r: (str(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-9)
    held = [(w[6], w[5]) for w in want if w[1]]
    assert sum(s for s, _ in held) > sum(b for _, b in held)  # better than the base model on text not learned from


def test_counts_beyond_32_and_53_bits():
    for n in (3, 2**32 + 5, 2**53 + 1, 2**62):
        counts = np.array([n, 1, 0], np.uint64)
        assert ngram_lm.unplanes(ngram_lm.planes(counts)).tolist() == [n, 1, 0]
        keys = ngram_lm.planes(np.array([1, 2**63, 2**64 - 1], np.uint64))
        rows = [(1, 0, 0, child, keys, ngram_lm.planes(counts), ngram_lm.planes(counts)) for child in (7, 9)]
        s = ngram_lm.Sum(pa.Table.from_batches([ngram_lm.arrow(rows, ngram_lm.COUNTS)]), {1: 0, 2: 0})
        assert s.kept.tolist() == s.both.tolist() == [2 * n, 2, 0] and s.keys.tolist() == [1, 2**63, 2**64 - 1]
        back = s.back(s.kept, s.both).to_pylist()
        assert [ngram_lm.unplanes(r["both"]).tolist() for r in back] == [[2 * n, 2, 0]] * 2


def test_lm_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngram_lm.lm_scores(df.limit(0)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = ngram_lm.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (True, 3, 0, 0) and math.isfinite(got.score)


# ---- co-training ---------------------------------------------------------------------------------


def test_classifier_on_labels_it_has_not_seen(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in cotrain.quality_scores(docs, labels.where("doc_id % 2 = 0")).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    unseen = [(r.quality, got[r.doc_id].kept) for r in labels.where("doc_id % 2 = 1 and quality is not null").collect()]
    share = sum(q for q, _ in unseen) / len(unseen)
    assert sum(bool(q) == k for q, k in unseen) / len(unseen) > max(0.95, share, 1 - share)


def test_classifier_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "text", None, None, None, 1), (None, None, "s", "l", 4, 2), (1, "text", None, None, None, 1)], "doc_id long, text string, source string, lang string, n_chars long, y int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert [(r.score, r.kept) for r in cotrain.quality_scores(docs, labels).collect()] == [(0.5, True)] * 3
        kept = cotrain.keep_good(docs, labels)
        assert kept.columns == docs.columns and kept.count() == 3
    assert cotrain.quality_scores(docs.limit(0), one).count() == cotrain.keep_good(docs.limit(0), one).count() == 0


def test_text_views_count_what_they_say():
    texts = [None, b"", b"One two two\n\nTHE end\nOne two two", "é\tx\x0by ".encode() * 3, b" ", b"a", b"lorem ipsum dolor " * 50_000]
    got = np.square(cotrain.text_views(texts))
    for row, raw in zip(got, texts, strict=True):
        raw = raw or b""
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
        n = max(1, len(words))
        shares = row[cotrain.CLASSES : cotrain.SHARES] * n
        want = [sum(w.isupper() and len(w) > 1 for w in words), sum(a == b for a, b in zip(words, words[1:])), len(words) - len(set(words))]
        assert shares[:3] == pytest.approx(want, rel=1e-3)
        assert row[cotrain.CLASSES + 3] == pytest.approx((len(lines) - len(set(lines))) / max(1, len(lines)), rel=1e-3)
        assert row[: cotrain.CLASSES].sum() == pytest.approx(float(bool(raw)), rel=1e-3)

        def hashed(w, odd=int(cotrain.ODD)):
            return plain_mix(sum((c + 1) * pow(odd, i, 2**64) for i, c in enumerate(w)) % 2**64)

        keys = {w: hashed(w) for w in set(words)}
        plain = np.bincount([keys[w] % cotrain.WORDS for w in words], minlength=cotrain.WORDS) / n
        assert row[cotrain.SHARES : cotrain.SHARES + cotrain.WORDS] == pytest.approx(plain, rel=1e-3)
        pairs = [plain_mix((keys[a] + plain_mix(keys[b] ^ int(cotrain.ODD))) % 2**64) % cotrain.PAIRS for a, b in zip(words, words[1:])]
        plain = np.bincount(pairs, minlength=cotrain.PAIRS) / max(1, len(words) - 1)
        assert row[cotrain.SHARES + cotrain.WORDS : cotrain.TEXT - cotrain.RUNS] == pytest.approx(plain, rel=1e-3)
        runs = [int.from_bytes(raw[i : i + 4], "little") * 0x9E3779B1 % 2**32 >> 24 for i in range(max(0, len(raw) - 3))]
        runs = np.bincount(runs, minlength=256)
        assert abs(row[cotrain.TEXT - cotrain.RUNS :] * max(1, len(raw) - 2) - runs).max() <= 1 + 1e-3 * runs.max()  # the line end after the text is in one run


def brute_cotraining(rows, labels, most, confident, rounds):
    """The scores of rows (id, text, source, lang, n_chars), with plain loops over all of them."""
    half = lambda x: x.astype(np.float16).astype(np.float32)
    text = cotrain.text_views([None if r[1] is None else r[1].encode() for r in rows])
    meta = np.stack([cotrain.meta_view(*r[2:]) for r in rows])
    votes = {}
    for i, q in labels:
        if i is not None and q is not None and any(r[0] == i for r in rows):
            votes.setdefault(i, []).append(q)
    y_of = {i: int(np.mean(v) > 0.5) for i, v in votes.items() if np.mean(v) != 0.5}
    tie = {}
    for k, r in enumerate(rows):
        if r[0] in y_of:
            tie[r[0]] = min(tie.get(r[0], (2**40, 0)), (zlib.crc32((r[1] or "").encode()), k))
    return text, meta, half, y_of, {i: k for i, (_, k) in tie.items()}


def test_cotraining_equals_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang", "n_chars").limit(500).collect()]
    rows += [(None, "no id", "s", None, 1), (7001, None, None, None, None), (7001, None, None, None, None), rows[3], (rows[4][0], "another text", None, "en", 5), (7002, "w" * 200_000, "s", "l", 9)]
    voted = [(r.doc_id, r.quality) for r in labels.select("doc_id", "quality").collect()] + [(None, 0), (7001, 0), (7001, None), (rows[0][0], 1), (rows[0][0], 0), (rows[0][0], 0)]
    df = spark.createDataFrame([(*r, 5, b"x", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, y int, meta binary, x_text int").repartition(3)
    lab = spark.createDataFrame(voted, "doc_id long, quality int")
    most, sure, rounds = 40, 0.9, 2
    model = cotrain.train(df, lab, max_exchanged=most, confident=sure, rounds=rounds)
    own = [model.used[k] for k in ("learn", "calibrate", "combine")]
    assert sum(map(len, own)) == len(set().union(*own)) and all(len(set(model.used[v])) == len(model.used[v]) for v in ("text", "meta"))
    assert not set().union(*own) & {*model.used["text"], *model.used["meta"]} and len(model.used["meta"]) > 20

    text, meta, half, y_of, row_of = brute_cotraining(rows, voted, most, sure, rounds)
    order = {r.doc_id: k for k, r in enumerate(spark.createDataFrame([(i,) for i in y_of], "doc_id long").orderBy(F.xxhash64("doc_id")).collect())}
    ids = sorted(y_of, key=order.get)
    y = np.array([y_of[i] for i in ids])
    fold, seen = np.zeros(len(ids), int), Counter()
    for k, c in enumerate(y.tolist()):
        fold[k], seen[c] = seen[c] % 5, seen[c] + 1
    x = {"text": half(text[[row_of[i] for i in ids]]), "meta": half(meta[[row_of[i] for i in ids]])}
    full, extra = {"text": text, "meta": meta}, {"text": [], "meta": []}
    of = lambda v: cotrain.RIDGE if v == "text" else 1.0

    def fitted(v):
        xs = np.concatenate([x[v][fold < 3], *(half(full[v][k])[None] for k, _ in extra[v])])
        return cotrain.fit(xs, np.concatenate([y[fold < 3], [c for _, c in extra[v]]]), None, of(v))

    for turn in range(rounds):
        models, got = {v: fitted(v) for v in full}, {}
        for to, by in (("text", "meta"), ("meta", "text")):
            p = cotrain.probability(models[by].logit(full[by]))
            taken = {*ids, *(rows[k][0] for k, _ in extra[to])}
            place = lambda i, turn=turn: plain_mix((i + plain_mix(turn + 1)) % 2**64)
            got[to] = []
            for c in (0, 1):
                ok = {rows[k][0]: k for k in range(len(rows)) if rows[k][0] is not None and rows[k][0] not in taken and (p[k] >= sure if c else p[k] <= 1 - sure)}
                got[to] += [(ok[i], c) for i in sorted(ok, key=place)[:most]]
        for v in got:
            extra[v] += got[v]
    assert [[rows[k][0] for k, _ in extra[v]] for v in ("text", "meta")] == [model.used[v] for v in ("text", "meta")]
    t, m = fitted("text"), fitted("meta")
    a, b = (f.logit(x[v])[:, None] for v, f in (("text", t), ("meta", m)))
    ca, cb = (cotrain.fit(v[fold == 3], y[fold == 3]) for v in (a, b))
    both = cotrain.fit(np.stack([ca.logit(a), cb.logit(b)], 1)[fold == 4], y[fold == 4])
    want = cotrain.probability(both.logit(np.stack([ca.logit(t.logit(text)[:, None]), cb.logit(m.logit(meta)[:, None])], 1)))
    got = cotrain.quality_scores(df, lab, max_exchanged=most, confident=sure, rounds=rounds).collect()
    name = lambda i, s: (-1 if i is None else i, round(s, 3))
    (gi, gs), (wi, ws) = (zip(*sorted(x), strict=True) for x in ([name(r.doc_id, r.score) for r in got], [name(r[0], s) for r, s in zip(rows, want, strict=True)]))
    assert gi == wi and gs == pytest.approx(ws, abs=2e-3)
    kept = cotrain.keep_good(df, lab, max_exchanged=most, confident=sure, rounds=rounds)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


# ---- pieces --------------------------------------------------------------------------------------

ODD = [None, "", " ", "  two  spaces  ", "\n", "a\n\nb \n c", "tab\there\r\n", "é😀 漢字   x", "word " * 3000, "x" * 5000, "▁ literal", "a b"]


def test_pieces_decode_to_the_text(spark, sf_dir):
    rows = list(enumerate(ODD)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(None, "null id"), (3, ODD[3])]
    df = spark.createDataFrame([(*r, "p") for r in rows], "doc_id long, text string, pieces string")
    encoded = {}
    for rate in (0.0, 0.1, 1.0):
        e = merge_dropout.encode_docs(df, MODEL, rate, seed=7)
        back = sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in merge_dropout.decode_docs(e, MODEL).collect()))
        assert back == sorted((-1 if i is None else i, t or "") for i, t in rows)
        encoded[rate] = {r.doc_id: r.pieces for r in e.collect()}
    total = [sum(map(len, encoded[rate].values())) for rate in (0.0, 0.1, 1.0)]
    assert total[0] < total[1] < total[2]
    again = {r.doc_id: r.pieces for r in merge_dropout.encode_docs(df.repartition(5), MODEL, 0.1, seed=7).collect()}
    other = {r.doc_id: r.pieces for r in merge_dropout.encode_docs(df, MODEL, 0.1, seed=8).collect()}
    assert again == encoded[0.1] != other
    digest = merge_dropout.encode_digest(df, MODEL)
    assert digest.count() == len(rows) and digest.where("not lossless").count() == 0
    assert merge_dropout.encode_docs(df.limit(0), MODEL).count() == merge_dropout.encode_digest(df.limit(0), MODEL).count() == 0


def test_no_dropout_gives_the_models_own_pieces(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = [t for t in texts if t and model.decode(model.encode(t)) == t][:150]
    pieces = merge_dropout.load(MODEL)
    got = pieces.encode(texts, merge_dropout.doc_keys(list(range(len(texts)))), 0.0, 1)
    assert len(texts) > 50 and [g.tolist() for g in got] == model.encode(texts)


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def brute_pieces(model, text, doc_id, rate, seed):
    """Merge-dropout in plain Python: of all adjacent symbols that make a piece and aren't dropped, the best score, leftmost, again and again."""
    score = {model.id_to_piece(i).replace("▁", " "): (-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    out = []
    for place, word in enumerate(re.findall(r"\n| *[^ \n]+| +", f" {text}") if text else []):
        key = plain_mix((plain_mix(plain_mix(doc_id + 1) ^ seed) + place) % 2**64)
        sym = [(i, c) for i, c in enumerate(word)]
        while True:
            best = None
            for k, ((at, a), (_, b)) in enumerate(zip(sym, sym[1:])):
                if (got := score.get(a + b)) and not plain_mix(key ^ plain_mix(at << 32 ^ got[1])) < int(rate * 2**64) and (best is None or got < best[0]):
                    best = got, k
            if best is None:
                break
            k = best[1]
            sym[k : k + 2] = [(sym[k][0], sym[k][1] + sym[k + 1][1])]
        for _, s in sym:
            out += [score[s][1]] if s in score else [model.piece_to_id(f"<0x{b:02X}>") for b in s.encode()]
    return out


def test_dropout_equals_plain_merging(spark, sf_dir):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD[:10], "the same word the same word the same word", "interpolation " * 40, "w" * 60 + " " + "abcdefghij" * 8, "漢é" * 30]
    texts += [r.text[:600] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(12).collect() if r.text]
    pieces = merge_dropout.Pieces(MODEL)
    for rate in (0.1, 0.4):
        got = pieces.encode(texts, merge_dropout.doc_keys(list(range(len(texts)))), rate, 5)
        assert [g.tolist() for g in got] == [brute_pieces(model, t, i, rate, 5) for i, t in enumerate(texts)]
        again = pieces.encode(texts[::-1], merge_dropout.doc_keys(list(range(len(texts)))[::-1]), rate, 5, remembered=0)
        assert [g.tolist() for g in again[::-1]] == [g.tolist() for g in got]


def test_a_word_has_many_segmentations():
    pieces = merge_dropout.Pieces(MODEL)
    got = pieces.encode(["interpolation"] * 500, merge_dropout.doc_keys(list(range(500))), 0.1, 1)
    assert len({tuple(g.tolist()) for g in got}) > 8
