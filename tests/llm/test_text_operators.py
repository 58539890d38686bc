from __future__ import annotations

import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import chosen_path, components, decontaminate, host_consensus, line_dedup, piece_codec, skew, url_cascade
from weft.llm.queries import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pieces():
    path = tokenizer_path()
    return piece_codec.codec(piece_codec.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(pieces, spark, sf):
    codec, lib = pieces
    rng = random.Random(5)
    letters = ["▁", " ", " ", "a", "b", "in", "the", "é", "\n", "\x00", "𝕏", "日", "x", "<0x41>", "s", "⁇", "ü", "1", "."]
    texts = ["", " ", "   ", "▁", " " * 40, "x" * 3000] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        ids = lib.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == lib.decode(ids), t[:80]
        n, a, b = codec.digests(t)
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_any_ids_decode_as_in_the_library(pieces):
    codec, lib = pieces
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(300))) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_piece_tables(pieces, spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in piece_codec.decoded(piece_codec.encoded(df, tokenizer_path()), tokenizer_path()).collect()}
    assert rows[1].decoded == "hello world" and rows[2].ids == rows[3].ids == [] and rows[2].decoded == ""
    assert {r.n_tokens for r in piece_codec.with_digests(df, tokenizer_path()).collect()} == {len(rows[1].ids), 0}


# ---- line runs


def expected_lines(docs, least):
    """By trying every run of every document in corpus order."""
    seen, gone = {}, collections.defaultdict(set)
    for d, text in sorted({(i, t) for i, t in docs if t is not None}):
        lines = line_dedup.lines_with_words(text.encode())
        for a, b in itertools.combinations(range(len(lines) + 1), 2):
            if sum(x[2] for x in lines[a:b]) >= least:
                key = tuple(x[1] for x in lines[a:b])
                first_d, first_a = seen.setdefault(key, (d, a))
                if (first_d, first_a) != (d, a):
                    stays = range(first_a, first_a + b - a) if first_d == d else ()
                    gone[d] |= {lines[i][0] for i in range(a, b) if i not in stays}
    return {d: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]) if t is not None else None for d, t in docs}


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice((1, 1, 2, 3, 7)))) for _ in range(9)]
    docs = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    docs += [(100, docs[3][1]), (101, docs[3][1] + "\nmore"), (102, None), (103, "")]
    # runs that overlap themselves, with periods of one, two and three lines
    docs += [(200, "\n".join(["a b c"] * 9)), (201, "\n".join(["u v", "w", "x y z"] * 5)), (202, "\n".join(["p q r s", "o"] * 6)), (203, "\n".join(["a b c"] * 30 + ["q"] + ["a b c"] * 3))]
    df = spark.createDataFrame([(i, t, "x") for i, t in [*docs, docs[5], docs[5]]], "doc_id long, text string, i string")
    got = line_dedup.drop_repeated(df, min_words=6, report=True).collect()
    want = expected_lines(docs, 6)
    assert len(got) == len(docs) + 2 and {r.doc_id: r.text for r in got} == want and {r.i for r in got} == {"x"}
    assert line_dedup.drop_repeated(df.limit(0)).count() == 0


def test_a_run_that_overlaps_itself_keeps_its_first_copy(spark):
    line = " ".join("abcdefghij")
    docs = [(1, "\n".join([line] * 20)), (2, "\n".join([line] * 4)), (3, "\n".join([line] * 6))]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "\n".join([line] * 5), 2: docs[1][1], 3: ""}


def test_large_intervals_are_dealt_to_many_tasks(spark):
    docs = [(i, f"own line {i}\ncommon line of six words here\n" + f"tail {i % 3}") for i in range(300)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string"), min_words=6).collect()}
    assert got == expected_lines(docs, 6)


def test_join_with_large_groups(spark):
    rows = spark.createDataFrame([(k, i) for k in range(4) for i in range(1 + 500 * (k == 2))], "k int, i int")
    groups = rows.groupBy("k").count()
    got = skew.join_groups(rows, groups, ["k"], "count", ["i"], salts=8, large=300)
    assert sorted((r.k, r.i, r["count"]) for r in got.collect()) == sorted((k, i, 501 if k == 2 else 1) for k in range(4) for i in range(1 + 500 * (k == 2)))


def test_least_runs_cover_all_runs():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.randint(1, 5) for _ in range(rng.randint(0, 9))]
        starts, need = line_dedup.least_runs(words, 7)
        for a, b in itertools.combinations(range(len(words) + 1), 2):
            if sum(words[a:b]) >= 7:
                inside = {i for s in range(a, b) for m in starts[s] if s + m <= b for i in range(s, s + m)}
                assert inside == set(range(a, b))
        assert all(n == max([m for s in range(len(words)) for m in starts[s] if s <= i < s + m], default=0) for i, n in enumerate(need))


# ---- n-gram join


def test_join_equals_brute_force(spark):
    rng = random.Random(2)
    base = [[f"t{rng.randrange(500)}" for _ in range(rng.randint(30, 120))] for _ in range(25)]
    docs = []
    for k, words in enumerate(base):
        docs.append((k, " ".join(words)))
        for c in range(rng.randint(0, 6)):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = f"z{rng.randrange(99)}"
            docs.append((1000 + 10 * k + c, " ".join(near) + rng.choice(("", ".", " !"))))
    docs += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one two"), (None, "one two"), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = chosen_path.ngram_sets(pa.array([t for _, t in docs], pa.string()), 5)
    size = np.array([len(s) for s in sets])
    shared = chosen_path.intersections(sets)
    linked = (shared >= 0.8 * (size[:, None] + size - shared) - 1e-9) & (size[:, None] > 0) & (size > 0)
    same = np.array([[len(a) > 0 and np.array_equal(a, b) for b in sets] for a in sets])
    linked = (linked | same) & ~np.eye(len(sets), dtype=bool)
    group = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            group[i] = min([group[i], *(group[j] for j in np.flatnonzero(linked[i]))])
    heads = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    want = sorted((str(docs[i][0]), str(heads[group[i]]), int(linked[i].sum())) for i in range(len(docs)))
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in chosen_path.join_ngrams(df).collect())
    assert got == want
    kept = [r.doc_id for r in chosen_path.keep_one(df).collect()]
    assert sorted(map(str, kept)) == sorted({*(str(h) for g, h in heads.items() if size[g]), "5000", "5001"})


def test_large_buckets_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 6)
    monkeypatch.setattr(chosen_path, "BLOCK", 3)
    words = [f"t{i}" for i in range(400)]
    docs = [(i, " ".join([*words[:i], f"q{i}", *words[i:]])) for i in range(30)]
    got = chosen_path.join_ngrams(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 29)}


def test_join_equals_all_pairs_of_the_table(spark):
    """All pairs of whole texts, without the operator's buckets or sketches."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = chosen_path.ngram_sets(pa.array([r.text for r in rows], pa.string()), 5)
    size = np.array([len(s) for s in sets])
    shared = chosen_path.intersections(sets)
    ok = (10 * shared >= 8 * (size[:, None] + size - shared)) & (size[:, None] > 0)
    for i, s in enumerate(sets):
        ok[i, i] = False
    got = {r.doc_id: (r.n_links, r.class_id) for r in chosen_path.join_ngrams(docs).collect()}
    assert {r.doc_id: int(ok[i].sum()) for i, r in enumerate(rows)} == {k: v[0] for k, v in got.items()}
    for i, j in zip(*np.nonzero(ok), strict=True):
        assert got[rows[i].doc_id][1] == got[rows[j].doc_id][1]


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 60, 60, 9, 40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = chosen_path.intersections(sets)
    assert all(got[i][j] == want[i][j] for i in range(7) for j in range(7) if i != j)


def test_components(spark):
    edges = [(str(i), str(i + 1)) for i in range(20, 40)] + [("a", "b"), ("c", "b"), ("x", "x"), (None, "q")]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[str(i)] for i in range(20, 41)} == {"20"} and got["a"] == got["b"] == got["c"] == "a" and "x" not in got
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_of_random_edges(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000, i) for i in range(1001, 1400)]
    top = {x: x for e in edges for x in e}
    for _ in top:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: y for x, y in top.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_a_long_chain_take_few_rounds(spark):
    n = 400
    chain = [0, *range(n, 0, -1)]
    edges = spark.createDataFrame(list(zip(chain[:-1], chain[1:], strict=True)), "a int, b int")
    assert len(components.merges(edges)) <= 2 * np.log2(n)


def test_runs_reach_the_recall():
    n = chosen_path.runs_for(0.9998, 0.8)
    assert (1 - 0.8**chosen_path.DEPTH) ** n <= 0.0002 < (1 - 0.8**chosen_path.DEPTH) ** (n - 1)


# ---- passages


def test_passages_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["Alpha", "beta", "ÉTÉ", "x1", "über", "c"])
    items = [(i, " ".join(word() for _ in range(rng.choice((0, 1, 3, 12, 15))))) for i in range(8)] + [(50, None), (3, "alpha BETA")]
    docs = [(i, rng.choice((" ", "-", "\n")).join(word() for _ in range(rng.randint(0, 60)))) for i in range(20)] + [(70, None), (71, ""), (72, "..."), (73, items[5][1] or "c")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def expect(text):
        w, hit, found = decontaminate.words(text), set(), set()
        for i, t in items:
            q = decontaminate.words(t)
            for k in range(max(1, len(q) - 9)) if q else ():
                p = q[k : k + 10]
                for s in range(len(w) - len(p) + 1):
                    if w[s : s + len(p)] == p:
                        hit |= set(range(s, s + len(p)))
                        found.add(str(i))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    for most in (decontaminate.MOST_PATTERNS, 12):  # one automaton, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_passages(df, bench, keep=("doc_id",), most_patterns=most).collect()}
        assert got == {i: expect(t) for i, t in docs}
    assert decontaminate.find_passages(df, bench.limit(0)).where("contaminated").count() == 0


def test_offsets_lead_to_the_original():
    text = "Say: «One, TWO;three ÉTÉ  four»!"
    a = decontaminate.Automaton.of_items([("1", "two three"), ("2", "four")])
    assert [text[i:j] for i, j in decontaminate.spans(text, a)] == ["TWO;three"]
    assert decontaminate.spans("x four y", a) == [(2, 6)]


# ---- urls


def test_cascade_is_exact(spark):
    keys = [(f"host{i}.example", i % 7 == 0) for i in range(3000)]
    df = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = url_cascade.build(df)
    from pyspark.sql import functions as F

    got = {r.key: r.m for r in df.select("key", cascade.contains(F.col("key")).alias("m")).collect()}
    assert got == dict(keys) and len(cascade.levels) > 1
    assert not url_cascade.build(df.where("NOT listed")).levels


def test_url_verdicts(spark):
    urls = ["http://A.Example.com/en/x?y", "https://www.example.com/en/", "http://u.www.example.com/en/1#f", "http://x.net/es/1", "http://x.net/en/1", "http://spam-farm.org/", "http://x.org", "no url", None, "ftp://x.com?q", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    want = [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("u.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"),
        ("x.net", "/en/1", None, "allow"), ("spam-farm.org", "/", None, "block"), ("x.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"),
    ]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(df, url_cascade.hosts_with_words(df)).orderBy("page_id").collect()]
    assert got == want


def test_listed_hosts_of_a_table(spark):
    rows = [(i, f"http://h{i % 400}.org/{i}", "kept", "mine") for i in range(900)] + [(None, None, "kept", "mine"), (None, "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, extra string")
    names = [f"h{i}.org" for i in range(0, 400, 3)]
    listed = spark.createDataFrame([(x,) for x in [*names, *names, None, "nowhere.org"]], "name string")
    want = [(r[0] or -1, "block" if r[1] and r[1].split("/")[2] in names else "allow", None, r[3]) for r in rows]
    for most in (url_cascade.MOST_KEYS, 50):  # one cascade, and three passes
        out = url_cascade.judge(df, listed, most_keys=most)
        assert out.columns == ["page_id", "url", "rule", "extra", "host", "path", "verdict"]
        assert sorted(((r.page_id or -1, r.verdict, r.rule, r.extra) for r in out.collect()), key=repr) == sorted(want, key=repr)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.verdict for r in url_cascade.judge(df, listed.limit(0)).collect()} == {"allow"}
    assert url_cascade.judge(df.limit(0), listed).count() == 0


# ---- pages

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>a b</nav><div class="post-12 x"><h2>Title &amp; more</h2><p>First&nbsp;para <a href="x>y">link</a> text<br>line 2<p>Second<div class="advert">BUY</div>tail
<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><span class="share">tw</span><form><input>q</form><div class=comments><p>a long reader comment</div></div><script>var x="</p>";</script><footer>f</footer>"""


def test_extraction():
    assert host_consensus.vote(PAGE)[1] == "html/body.has-sidebar/div.post-#.x"
    assert host_consensus.extract(PAGE, None).split("\n") == ["Title & more", "First para link text", "line 2", "Second", "tail", "one", "two", "c1", "c2"]
    assert [host_consensus.extract(x, None) for x in ("plain", "", None, "<div", "<p>a<b>c</p> d <!-- x", "<script>x")] == ["plain", "", "", "", "ac\nd", ""]


def test_hosts_vote(spark):
    good = "<body><div class=main><p>{}</p></div><div class=extra><p>{}</p></div></body>"
    rows = [(i, "http://h.org/", good.format("the article text is long here " * 3, "short")) for i in range(5)]
    rows += [(9, "http://h.org/9", good.format("brief", "a longer piece of other text stands here")), (10, "http://other.org/", "<body><article><p>hello</p></article></body>"), (11, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (host_consensus.MOST_HOSTS, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in host_consensus.extract_pages(df, most_hosts=most).collect()}
        assert got[9] == ("brief", 5) and got[10] == ("hello", 5) and got[11] == ("", 0) and len(got) == 8


LONG = "a sentence of the article that goes on for a good while, word after word, until it is long enough to be one. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # an intro, a long list, an outro
        (f"<article><p>{LONG}</p><ul>{''.join(f'<li>{k} {LONG}{LONG}</li>' for k in range(5))}</ul><p>the end</p></article>", [LONG.strip(), *[f"{k} {LONG}{LONG}".strip() for k in range(5)], "the end"]),
        (f"<div><article><p>short intro of some eighty characters, which is less than a tenth of the rest.</p><section>{''.join(f'<p>{k} {LONG}</p>' for k in range(8))}</section></article><div>other</div></div>",
         ["short intro of some eighty characters, which is less than a tenth of the rest.", *[f"{k} {LONG}".strip() for k in range(8)]]),
        # no element named for it: own text beside a section
        (f"<body><div class=x><p>{LONG}</p><section><p>{LONG * 3}</p></section></div><div class=y><p>tail of the page</p></div></body>", [LONG.strip(), (LONG * 3).strip()]),
        # one article in sections, and something else beside it
        (f"<body><div class=text>{''.join(f'<section><p>{k} {LONG}</p></section>' for k in range(4))}</div><div class=y><p>aside</p></div></body>", [f"{k} {LONG}".strip() for k in range(4)]),
        (f"<main><p>{LONG}</p><table>{''.join(f'<tr><td>{k}<td>{LONG}' for k in range(6))}</table></main>", [LONG.strip(), *[x for k in range(6) for x in (str(k), LONG.strip())]]),
        # a table for the layout: its cell is the container
        (f"<table><tr><td><p><a href=/>menu</a></p><td><p>{LONG}</p><p>{LONG}</p></table>", [LONG.strip(), LONG.strip()]),
        # class names that only contain a word for something else
        (f'<div class="content no-sidebar"><p>{LONG}</p><p class="social-life">And more.</p></div><div class="x"><p>beside</p></div>', [LONG.strip(), "And more."]),
        (f'<div class="elementor-widget elementor-widget-text"><p>{LONG}</p></div>', [LONG.strip()]),
        (f'<article><p>{LONG}</p><div class="article__share">tell</div><div id="commentsArea"><p>{LONG * 9}</p></div><div class="ad-slot-2">buy</div><div class="site-header">x</div></article>', [LONG.strip()]),
        # a formula is part of its line
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be one.</p></article>", ["Let x=1 be one."]),
        ("<article><p title=it's>one</p><p data-x='>' title=\"a>b\">two</p></article>", ["one", "two"]),
    ],
)
def test_whole_articles(html, want):
    found = host_consensus.vote(html)
    assert host_consensus.extract(html, found[0]).split("\n") == want == host_consensus.extract(html, None).split("\n")


def test_deep_pages_take_linear_memory():
    import resource
    import time

    deep = '<div class="content">' * 100_000 + "<p>the text" + "</p></div></b></li>" * 100_000
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = host_consensus.vote(deep)
    assert host_consensus.extract(deep, found[0]) == "the text"
    assert time.time() - began < 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_pages_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert host_consensus.extract_pages(empty).count() == 0
    rows = [(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (3, "http://a.b/", "<p>" + "word " * 200_000), (None, "x", "<body>t")]
    df = spark.createDataFrame([(*r, "mine", 7) for r in rows], "page_id long, url string, html string, host string, key int")
    got = sorted(((r.page_id or 0, len(r.text), r.n_chars, r.host, r.key) for r in host_consensus.extract_pages(df, keep=("page_id", "host", "key")).collect()))
    assert got == [(0, 1, 1, "mine", 7), (1, 0, 0, "mine", 7), (2, 0, 0, "mine", 7), (2, 0, 0, "mine", 7), (3, 999_999, 999_999, "mine", 7)]


def test_pages_of_the_table_against_their_articles(spark, sf):
    """The table's pages have one article element each; its text, told by another parser, is what counts."""
    import html.parser

    class Article(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.lines = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in ("article", "h1", "p", "br"):
                self.lines.append("")

        def handle_endtag(self, tag):
            if tag in ("article", "h1", "p"):
                self.lines.append("")
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.lines[-1] += data

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in host_consensus.extract_pages(pages).collect()}
    for r in pages.collect():
        p = Article()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "\n".join(x for x in (" ".join(line.split()) for line in p.lines) if x)
