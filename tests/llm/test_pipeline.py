from __future__ import annotations

import duckdb

import corpus_pipeline
from weft.llm import queries


def test_stages_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    n = out.count()
    assert 0.5 * docs.count() < n <= docs.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    first = corpus_pipeline.identify_language(spark, docs, sf)
    assert first.columns == docs.columns and first.count() >= n


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert cols == sorted(names)
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr), name


def test_stages_on_edges_and_clashing_columns(spark, sf):
    """Every stage but the last keeps the table's columns with their own values, whatever they are named, and takes odd rows."""
    names = ["lang_pred", "score", "margin", "n_lines_dropped", "n_words", "contaminated", "items_sha256"]
    plain = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    text = plain.first().text
    odd = [(1001, None), (1002, ""), (None, text), (None, text), (1003, text), (1003, text), (1004, "!?. 123"), (1005, " ".join(f"w{i} the" for i in range(60_000)))]
    rows = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select(*rows.columns).unionByName(rows)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id * 0 + k)
    docs = docs.cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[n] in (None, k) for r in got for k, n in enumerate(names)), name
        kept[name] = [r.doc_id for r in got if r.doc_id is None or r.doc_id > 1000]
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert {1001, 1002, 1004}.isdisjoint(kept["language_id"]) and kept["language_id"].count(1003) == 2 and 1005 in kept["language_id"]
    assert {1001, 1002, 1004, 1005} <= set(kept["line_dedup"])
    assert {1001, 1002, 1004, 1005} <= set(kept["ngram_jaccard"]) and kept["ngram_jaccard"].count(1003) + kept["ngram_jaccard"].count(None) == 0
    assert {1001, 1002, 1004} <= set(kept["decontamination"])
    last = corpus_pipeline.encode_pieces(spark, docs, sf).collect()
    assert len(last) == docs.count() and {r.n_tokens for r in last if r.doc_id in (1001, 1002)} == {0}


def test_rows_stay_where_no_language_can_be_learned(spark, sf):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.identify_language(spark, docs, sf).count() == 2


def test_operators_on_edges(spark):
    from weft.llm import chosen_path, decontaminate, language_id, piece_codec

    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "a b " * 100_000, "x"), (None, "one two three", "x")], "doc_id long, text string, score string")
    model = language_id.fit(["the and of", "der die und"], ["en", "de"])
    assert language_id.identify(rows, model).count() == 5 and language_id.identify(rows.limit(0), model).count() == 0
    out = chosen_path.join_ngrams(rows).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in out if r.doc_id != 3) == [(0, None, 0), (1, 1, 0), (2, 2, 0), (2, 2, 0)]
    assert chosen_path.join_ngrams(rows.limit(0)).count() == 0
    bench = spark.createDataFrame([(9, "one two three"), (9, "one two three"), (None, "a b"), (8, None)], "item_id long, text string")
    got = {r.doc_id or 0: (r.n_words, r.n_hit, r.n_items, r.score) for r in decontaminate.find_passages(rows, bench).collect()}
    assert got == {0: (3, 3, 1, "x"), 1: (0, 0, 0, "x"), 2: (0, 0, 0, "x"), 3: (200_000, 200_000, 0, "x")}
    assert decontaminate.find_passages(rows.limit(0), bench).count() == 0
    path = queries.tokenizer_path()
    assert piece_codec.encoded(rows.limit(0), path).count() == 0 and piece_codec.encoded(rows, path).columns == ["doc_id", "text", "score", "ids"]
