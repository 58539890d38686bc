from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import labels, language_id, quality_rules, subword_quality, toxicity
from weft.llm.arrowtext import crc32_mod, slices

EDGE = [(1, None), (2, ""), (3, " \t\n "), (4, "a b c d e a b c d e"), (4, "a b c d e a b c d e"), (5, "x " * 30000), (None, "!? 123"), (6, "line one is here\nline two is here\nline one is here\n\nline one is here")]


def frame(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "en", "src") for i, t in rows], "doc_id long, text string, lang string, n_words string")


def brute(text):
    words = text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if text else []
    words = [w for w in words if w]
    seen, cover = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {i + k for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_ledger_measures_and_policies(spark):
    df = frame(spark)
    out = quality_rules.apply_policy(quality_rules.ledger(df), "base@1")
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in out.collect())
    want = []
    for i, t in EDGE:
        m = brute(t)
        want.append((i or 0, *m, not (m[0] < 10 or 100 * m[4] > 20 * m[0])))
    assert got == sorted(want)
    assert quality_rules.ledger(df.limit(0)).count() == 0


def test_ablations_match_counting(spark):
    entries = quality_rules.ledger(frame(spark)).select("fail_bits")
    bits = [r.fail_bits for r in entries.collect()]
    got = {r.rule: (r.n_failed, r.n_only_this, r.n_kept_without) for r in quality_rules.ablations(entries, "prose@1").collect()}
    for r in quality_rules.RULES:
        b = 1 << r.bit
        if r.name in got:
            assert got[r.name] == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x in (0, b) for x in bits))


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = language_id.codewords(n).astype(int)
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert far >= max(1, code.shape[1] // 4)


def test_wrong_bits_are_corrected():
    code = language_id.codewords(5)
    m = language_id.Model(list("abcde"), code, np.zeros((1, code.shape[1])), np.zeros(code.shape[1]))
    logits = 5.0 * code.astype(float)
    logits[:, :3] *= -1
    best, share, margin = m.decode(logits)
    assert best.tolist() == list(range(5)) and (share > 1 / 5).all() and (margin > 0).all()


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = crc32_mod("doc_id", 3) == 1
    out = language_id.identify(docs, language_id.learn(docs.where(~held))).where(held).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.9 and all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    docs = frame(spark)
    model = language_id.fit(["the and of", "der die und"], ["en", "de"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == got[None] == ("und", 0.0) and got[5][0] in ("en", "de")
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(docs.limit(0))).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learn(docs)).collect()} == {"en", "und"}


def test_crc_matches_zlib(spark):
    got = spark.createDataFrame([(i,) for i in (0, 7, 123456789)], "i long").select(crc32_mod("i", 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 for i in (0, 7, 123456789)]


def held_out_counts(spark, folder, label, mod, rest, fit, per_class, bytes_, from_):
    """(labelled 1 and predicted, labelled 1, predicted, rows) of the rows that nothing was learned from."""
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = crc32_mod("doc_id", mod) == rest
    rows = labels.sample(docs, marks, label, ~held, per_class, bytes_)
    model = fit([x for x, _ in rows], [y for _, y in rows])
    known = docs.where(held).join(marks.where(marks[label].isNotNull()), "doc_id").select("text", label).collect()
    got = np.concatenate([model.scores(pa.array([r.text for r in known[k : k + 100]], pa.string())) for k in range(0, len(known), 100)]) >= from_
    truth = np.array([r[label] == 1 for r in known])
    return int((got & truth).sum()), int(truth.sum()), int(got.sum()), len(known)


def test_quality_of_held_out_rows(spark):
    per = {0: subword_quality.PER_CLASS, 1: subword_quality.PER_CLASS}
    hit, good, said, n = held_out_counts(spark, "/root/testdata/sf0.01", "quality", 4, 2, subword_quality.fit, per, subword_quality.SAMPLE_BYTES, subword_quality.PREDICTED_FROM)
    assert n > 80 and hit >= 0.95 * good and said - hit <= 0.1 * (n - good)


def test_toxicity_of_held_out_rows(spark):
    # Some rows labelled toxic hold none of the words that the others share, so that no method finds them.
    per = {0: toxicity.CLEAN_TEXTS, 1: toxicity.TOXIC_TEXTS}
    hit, toxic, said, n = held_out_counts(spark, "/root/testdata/sf0.1", "toxic", 5, 0, toxicity.fit, per, toxicity.SAMPLE_BYTES, toxicity.PREDICTED_FROM)
    assert n > 800 and hit >= 0.9 * toxic and hit >= 0.95 * said


def test_toxicity_model_round_trip():
    model = toxicity.fit(["you fool there", "hello you there"] * 20, [1, 0] * 20, rounds=2)
    again = toxicity.Model.from_bytes(model.to_bytes())
    texts = pa.array(["you fool", "hello", "x " * 500, None], pa.string())
    assert np.array_equal(model.scores(texts), again.scores(texts))


def test_one_key_repeated_adds_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    assert sorted(labels.sample(docs, marks, "toxic", F.lit(True), {0: 9, 1: 9}, 10_000)) == [("b", 0), ("text 0", 1)]


def test_toxicity_learns(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i % 50}" for i in rng.integers(0, 50, 60)]
    texts, marks = [], []
    for k in range(160):
        words = [f"w{i}" for i in rng.integers(0, 50, 80)]
        if k % 2:
            words[int(rng.integers(0, 80))] = str(rng.choice(["vilewordone", "vilewordtwo", "vileotherx"]))
        texts.append(" ".join(words))
        marks.append(k % 2)
    model = toxicity.fit(texts, marks, batch=32)
    s = model.scores(pa.array([" ".join(plain), " ".join([*plain[:40], "vilewordthree", *plain[40:]]), "", None], pa.string()))
    assert s[0] < 0.5 <= s[1] and s[2] == s[3] == 0


def test_toxicity_gradients():
    m = toxicity.Model.fresh(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    w = toxicity.read(pa.array(["you are so very bad and dumb x", "hello there " + "a b c d " * 12]))
    idx, _ = w.windows()
    y = np.resize([1.0, 0.0], len(idx))

    def loss():
        z = m.run(m.inputs(w, np.arange(len(w.bucket)))[0], idx)
        return np.mean(np.logaddexp(0, z) - y * z)

    g = m.gradients(w, idx, y, np.ones(len(idx)))
    for k in m.p:
        at = np.abs(g[k]).ravel().argmax()
        v = m.p[k].ravel()
        keep = v[at]
        v[at] = keep + 1e-3
        up = loss()
        v[at] = keep - 1e-3
        down = loss()
        v[at] = keep
        assert g[k].ravel()[at] == pytest.approx((up - down) / 2e-3, rel=1e-3), k


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 200):
        w = toxicity.read(pa.array([" ".join(f"w{i}" for i in range(n))]))
        idx, offs = w.windows()
        assert set(idx[idx < len(w.bucket)].tolist()) == set(range(n)) and offs[-1] == len(idx)


def test_scores_of_edges(spark):
    docs = frame(spark)
    for module in (subword_quality, toxicity):
        model = module.fit(["a b c", "x y z"] * 8, [0, 1] * 8)
        rows = module.score(docs, model).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert module.score(docs.limit(0), module.fit([], [])).count() == 0


def test_slices_bound_the_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 100, 3, 3, 3, 0, 50)])], ["t"])
    assert [p.num_rows for p in slices(batch, "t", 10)] == [1, 1, 4, 1]
