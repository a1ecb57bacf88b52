"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, decontam, htmltext, licenses, linedup, neardup, packing, quality, simhash, urlrules, warc

LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
TEXTS = [None, "", " \n\t", "one", "mit license", LONG, LONG + " tail", "a\n\na\nb", "a\n\na\nb", "same words here again " * 30]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, matches string, n string, fp string, spans int, h int"


@pytest.fixture(scope="module")
def docs(spark):
    data = [(k, t, None if k % 2 else "en", None if k % 3 == 0 else f"s{k % 3}", None, 7, "x", "y", "z", 1, 2) for k, t in enumerate(TEXTS)]
    data += [data[4], data[4], (None, "null id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


BENCH = "item_id long, text string"


def bench(spark):
    return spark.createDataFrame([(1, "one"), (1, "one"), (None, "mit license"), (3, None), (4, " ".join(LONG.split()[500:540]))], BENCH)


OPERATORS = {
    "licenses": lambda d: licenses.find_licenses(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "linedup": lambda d: linedup.remove_boilerplate(d),
    "packing": lambda d: packing.pack_documents(d).where("start = 0"),
    "quality": lambda d: quality.quality_verdicts(d),
    "decontam": lambda d: decontam.find_contamination(d, bench(d.sparkSession)),
    "neardup": lambda d: neardup.near_duplicate_groups(d),
}


CLASHES = [
    "_id", "_stamp", "_gone", "_lines", "_t", "_host", "_stays", "_n", "stamp", "host", "of", "node", "root", "component", "words", "lines", "gone", "id_key", "row", "part", "rank", "base",
    "key", "kind", "stack", "rules", "rest", "url_", "payload", "digest", "first", "surt", "file", "text_", "turns", "segments", "t", "s", "k",
]


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns])


THROUGH = {
    "linedup": lambda d: linedup.remove_boilerplate(d),
    "quality": lambda d: quality.quality_verdicts(d),
    "neardup": lambda d: neardup.one_per_group(d),
    "decontam": lambda d: decontam.find_contamination(d, bench(d.sparkSession), keep=d.columns),
}


@pytest.mark.parametrize("name", THROUGH)
def test_clashing_columns_pass_through(name, docs):
    mine = clashing(docs)
    plain, named = (THROUGH[name](d).drop("text") for d in (docs, mine))
    row = lambda r, c: tuple(str(r[x]) for x in c)
    shared = [c for c in plain.columns if c in docs.columns]
    assert sorted(row(r, shared) for r in plain.collect()) == sorted(row(r, shared) for r in named.collect())
    assert {r[c] for r in named.collect() for c in ("_id", "_gone", "_t")} == {"own _id", "own _gone", "own _t"}
    twice = THROUGH[name](docs.select("*", F.lit(1).alias("again"), F.lit(2).alias("again")))
    assert twice.columns.count("again") == 2 and twice.count() == plain.count()


def test_clashing_columns_are_not_read(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for make, df, n in ((warc.archive_pages, pages, 8), (htmltext.extract_pages, pages, 8), (lambda d: urlrules.judge_urls(d, urlrules.rules_frame(spark)), pages, 8), (chat.format_chats, turns, 1)):
        assert make(clashing(df)).count() == n


def test_very_long_texts(spark):
    long = "w" * 3_000_000 + " x"
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).select(F.length("formatted")).first()[0] > 6_000_000
    pages = spark.createDataFrame([(1, "http://" + "a." * 500_000 + "com/en/" + long, f"<div><p>{long}</p></div>")], "page_id long, url string, html string")
    assert htmltext.extract_pages(pages).first()["text"] == long
    r = urlrules.judge_urls(pages, urlrules.rules_frame(spark)).first()
    assert r["rule"] == "com/" and len(r["path"]) > 3_000_000


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_input(spark, docs, sf_dir, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    rows = clashing(docs.drop("id"))
    last = k == len(corpus_pipeline.STAGES) - 1
    for d in (rows, rows.limit(0)):
        got = stage(spark, d, sf_dir)
        assert got.columns == (["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] if last else corpus_pipeline.COLUMNS)
        assert got.count() == 0 if d is not rows else k == 0 or got.count() > 0
    again = stage(spark, rows.unionByName(rows), sf_dir)
    once = lambda df: {r["doc_id"] for r in df.collect()}
    assert once(again) == once(stage(spark, rows, sf_dir))


@pytest.mark.parametrize("name", OPERATORS)
def test_all_rows_come_back(name, docs):
    assert OPERATORS[name](docs).count() == docs.count()
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_license_values(docs):
    got = {r["doc_id"]: r for r in licenses.find_licenses(docs).collect() if r["doc_id"] is not None}
    assert got[0]["n_words"] == 0 and got[0]["matches"] == []
    assert [m["label"] for m in got[4]["matches"]] == ["mit", "mit"] and got[5]["n_words"] == 60_000


def test_simhash_values(docs):
    got = simhash.simhash_groups(docs).collect()
    zero = [r for r in got if r["fp"] == 0]
    assert {r["doc_id"] for r in zero} == {None, 0, 1, 2} and {r["component_id"] for r in zero} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7}


def test_components_of_edges_with_large_hashes(spark):
    from ledgerloom.llm.components import connected_components

    edges = spark.range(20_000).selectExpr("2 * id + 1 AS u", "2 * id AS v").where("xxhash64(u, v) > 1L << 62")
    roots = connected_components(edges)
    assert roots.count() == 2 * edges.count() > 4096 and roots.where("root <> 2 * (node div 2)").count() == 0


def test_near_duplicates_at_the_limit(spark):
    # four of five and 36 of 45 shingles in common: similarity 0.8 exactly
    pairs = [(k, " ".join(f"p{k}w{i}" for i in range(n))) for k, n in [(k, 9 if k < 600 else 49) for k in range(1200)]]
    data = [(2 * k, t) for k, t in pairs] + [(2 * k + 1, " ".join(t.split()[: 8 if k < 600 else 40])) for k, t in pairs]
    got = neardup.near_duplicate_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    of = {r["id"]: r["component"] for r in got}
    assert [k for k in range(1200) if of[2 * k] != of[2 * k + 1]] == [] and len(set(of.values())) == 1200


def test_no_pair_of_a_loose_group_is_left_out():
    import numpy as np

    to = lambda n: np.arange(n, dtype=np.uint32)
    assert neardup.jaccard_forest([to(9)], [to(10)], 0.8) == ([0], [1])
    assert neardup.jaccard_forest([to(9)], [to(12)], 0.8) == ([], [])
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(200, rng.integers(1, 40)).astype(np.uint32) if k % 3 else np.delete(to(40), rng.integers(0, 40, 4)).astype(np.uint32)) for k in range(90)]

    def groups(pairs):
        label = list(range(90))
        for u, v in pairs:
            label = [label[u] if x == label[v] else x for x in label]
        return {frozenset(k for k in range(90) if label[k] == x) for x in label}

    similar = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = groups([(i, j) for i in range(90) for j in range(i) if similar(sets[i], sets[j])])
    assert groups(zip(*neardup.jaccard_forest(sets, None, 0.8))) == want and len(want) < 90
    pairs = [p for s in (slice(0, 30), slice(30, 90)) for p in zip(*neardup.jaccard_forest(sets[s], None, 0.8)) for p in [(p[0] + s.start, p[1] + s.start)]]
    assert groups([*pairs, *zip(*neardup.jaccard_forest(sets[:30], sets[30:], 0.8))]) == want


def test_one_per_group(docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in neardup.one_per_group(docs).collect())
    assert got == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 7), (False, 9), (True, 0)]


def test_line_values(spark):
    data = [(k, f"shared line\nown {k}\n\nshared line", f"s{k}") for k in range(4)] + [(9, "two sites\nx", "s0"), (10, "two sites\ny", "s1"), (11, "shared line", None)]
    got = {r["doc_id"]: r for r in linedup.remove_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[0]["text"] == data[0][1] and got[0]["n_removed"] == 0
    assert got[2]["text"] == "own 2\n" and got[2]["n_removed"] == 2 and got[2]["n_lines"] == 4
    assert got[10]["text"] == "two sites\ny" and got[11]["text"] == ""


def test_quality_values(spark):
    text = "a b c d a b c e\nq\n\nq\n#$"
    r = quality.quality_verdicts(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (11, 12, 2, 1, 6)
    assert r["base_failed"] and not r["kept"]


def test_bad_host_takes_its_passing_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(60))
    data = [(h * 100 + k, good if h < 9 or k == 0 else "too short", f"host{h}") for h in range(10) for k in range(100)]
    got = quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, source string")).where("NOT own_failed")
    kept = {r["source"]: r["n"] for r in got.where("kept").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert kept == {f"host{h}": 100 for h in range(9)}
    gone = got.where("NOT kept").collect()
    assert [r["doc_id"] for r in gone] == [900] and gone[0]["host_rate"] > 0.95
    # one of two hosts fails more than the other, but passes more than it fails
    data = [(h * 100 + k, good if k >= 10 * h + 5 else "too short", f"host{h}") for h in range(2) for k in range(100)]
    fair = quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert fair.where("kept").count() == 180


def test_decontam_passages_and_small_bitmaps(docs, spark, monkeypatch):
    key = F.struct("doc_id", "n_words", "spans", "items").cast("string")
    one = sorted(r[0] for r in decontam.find_contamination(docs, bench(spark)).select(key).collect())
    got = {r["doc_id"]: r for r in decontam.find_contamination(docs, bench(spark)).collect()}
    assert got[3]["items"] == ["1"] and got[4]["items"] == [] and len(got[4]["spans"]) == 1
    assert (got[5]["spans"][0]["start"], got[5]["spans"][0]["end"]) == (500, 540) and got[5]["items"] == ["4"]
    empty = decontam.find_contamination(docs, bench(spark).limit(0))
    assert empty.where("size(spans) > 0").count() == 0 and empty.count() == docs.count()
    # a bitmap in which nearly every shingle passes changes no result
    monkeypatch.setattr(decontam, "MAX_BITS", 7)
    assert sorted(r[0] for r in decontam.find_contamination(docs, bench(spark)).select(key).collect()) == one


def test_decontam_long_items(docs, spark):
    words = LONG.split()
    long_item = spark.createDataFrame([(1, LONG), (2, " ".join(words[90:130]))], BENCH)
    made = decontam.benchmark_windows(long_item, 10, 3, "item_id", "text", 1000).collect()
    assert {r["text"] for r in made if r["item"] == "1"} == {" ".join(words[i : i + 10]) for i in range(len(words) - 9)}
    assert sum(r["item"] == "1" for r in made) == len(words) - 9 and all(len(r["codes"]) == 8 for r in made)
    huge = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(2_200_000)))], BENCH)
    assert decontam.benchmark_windows(huge, 10, 3, "item_id", "text").count() == 2_200_000 - 9


def test_decontam_does_not_grow_with_documents_times_benchmark(docs, spark, monkeypatch):
    """Ten times the benchmark: the texts are read as often, and no more places are joined."""
    scans, joined, read = [], [], docs.__class__.mapInArrow
    monkeypatch.setattr(docs.__class__, "mapInArrow", lambda self, *a, **k: (scans.append(self.columns), read(self, *a, **k))[1])
    find = decontam.prefix_places
    monkeypatch.setattr(decontam, "prefix_places", lambda *a: (joined.append(find(*a).count()), find(*a))[1])
    other = lambda n: bench(spark).unionByName(spark.range(n).selectExpr("id + 100 AS item_id", "array_join(transform(sequence(0, 60), k -> concat('u', id * 61 + k)), ' ') AS text"))
    few = sorted(map(str, decontam.find_contamination(docs, other(20)).collect()))
    n = len(scans)
    many = sorted(map(str, decontam.find_contamination(docs, other(200)).collect()))
    assert few == many and len(scans) == 2 * n
    assert joined[1] < 2 * joined[0]  # what passes the bitmap without being known


def test_decontam_against_plain_version(spark):
    import random

    random.seed(9)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(k % 9 if k % 7 else None, text(random.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for k in range(25)]
    rows = [(k, text(random.choice([0, 1, 3, 30, 80]))) for k in range(60)]
    rows += [(100 + k, f"{text(4)} {items[k % 25][1]}, {items[(k + 3) % 25][1].upper()} {text(3)}") for k in range(40)]
    windows = [(item, tuple(ws[i : i + min(10, len(ws))])) for item, t in items for ws in [t.split()] if ws for i in range(len(ws) - min(10, len(ws)) + 1)]
    got = {r["doc_id"]: r for r in decontam.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect()}
    for k, t in rows:
        ws = t.lower().replace(",", " ").split()
        at = [(item, i, i + len(w)) for item, w in windows for i in range(len(ws) - len(w) + 1) if tuple(ws[i : i + len(w)]) == w]
        hit = sorted({q for _, a, b in at for q in range(a, b)})
        assert sorted(q for s in got[k]["spans"] for q in range(s["start"], s["end"])) == hit and got[k]["n_words"] == len(ws)
        assert got[k]["items"] == sorted({str(i) for i, _, _ in at if i is not None})


PAGES = [
    (1, "http://a.com/x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a.com/x\r\nWARC-Type: x", None), (3, "http://a.com/x\r\nWARC-Type: x", None),
    (4, "http://b.com/\u00e9?q=1#f", ""), (5, "", "<p>\r\n\r\nother"), (None, "http://c.com", "<p>null id"), (7, "http://a.com/x", LONG),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert sorted(r["id"] or 0 for r in got) == [0, 1, 2, 3, 3, 4, 5, 7]
    by = {r["id"]: r for r in got}
    assert by[2]["record_type"] == "revisit" and by[2]["refers_to"] == 1 and by[2]["payload_bytes"] == 11 and by[2]["payload"] is None
    assert by[1]["payload"] == b"<p>same</p>" and by[7]["payload"].decode() == LONG
    assert by[4]["record_type"] == "revisit" and by[4]["refers_to"] == 3
    assert warc.archive_pages(pages.limit(0)).count() == 0
    big = {r["id"]: r for r in warc.archive_pages(pages, min_bytes=12).collect()}
    assert big[2]["record_type"] == "response"


def test_warc_index_blocks_and_hot_keys(spark):
    caps = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS surt", "id", "'f' AS file", "id * 10 AS offset", "10L AS length")
    from ledgerloom.llm.common import fresh_dir

    folder = fresh_dir(spark, "test")
    shards = warc.build_index(caps, folder, lines_per_block=7)
    keys = spark.createDataFrame([("hot",), ("k1",), ("k4999",), ("none",), (None,), ("k1",)], "surt string")
    found = warc.lookup(shards, folder, keys).collect()
    assert sorted(r["id"] for r in found) == sorted([k for k in range(5000) if k % 3 == 0] + [1, 4999])


def test_url_rules(spark):
    urls = [
        (1, "http://WWW.Example.com/en/x", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/", "example.com/en/", "block"),
        (3, "https://a.com", None, "allow"), (4, "https://a.com/q?x#y", "com/", "allow"), (5, None, None, "allow"), (6, "nothing", None, "allow"),
        (7, "x://net/fr/", "net/fr/", "block"), (8, "x://internet/fr/", None, "allow"), (9, "x://example.com.evil.net/es/1", "net/es/", "block"), (9, "x://example.com.evil.net/es/1", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, urlrules.rules_frame(spark)).collect())
    assert got == sorted((u[0], u[2], u[3]) for u in urls)
    assert urlrules.judge_urls(pages.limit(0), urlrules.rules_frame(spark)).count() == 0


def test_url_rules_without_rules_and_with_odd_ones(spark):
    pages = spark.createDataFrame([(1, "http://x.com,evil/"), (2, "http://www.net,b/es/q"), (3, "http://\u00c9.com:80/"), (4, None), (5, "http://A.\U0010ffffz.com/")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, urlrules.rules_frame(spark)).collect()}
    assert got == {1: ("x.com,evil", None, "allow"), 2: ("www.net,b", None, "allow"), 3: ("\u00c9.com:80", None, "allow"), 4: ("", None, "allow"), 5: ("a.\U0010ffffz.com", "com/", "allow")}
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in urlrules.judge_urls(pages, none, default="block").collect()} == {"block"}
    odd = [("block", None, "/"), (None, "com", "/"), ("block", "com", None), ("block", "", ""), ("block", "\u00c9.com:80", "/"), ("allow", "\u00c9.com:80", "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, urlrules.rules_frame(spark, odd)).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("\u00c9.com:80/", "block"), 4: ("", "block"), 5: (None, "allow")}


@pytest.mark.parametrize("seed", [3, 4])
def test_url_rules_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "a,b", "a-", "a0", "\u00e9"]) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(["/", "/x", "/x/y"])) for _ in range(60))}.values())
    urls = [(k, f"http://{host()}{rng.choice(['', '/', '/x', '/xx', '/x/y/z'])}") for k in range(400)]
    got = {r["page_id"]: r["rule"] for r in urlrules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), urlrules.rules_frame(spark, rules)).collect()}
    for k, url in urls:
        h, _, p = url[7:].partition("/")
        p = "/" + p if "/" in url[7:] else ""
        fit = [(len(rh + rp), len(rh), rh + rp) for _, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        assert got[k] == (max(fit)[2] if fit else None)


def test_chat_edges(spark):
    turns = [(1, 0, None, None), (1, None, "user", "x"), (2, 1, "assistant", ""), (None, 0, "user", "y"), (None, 0, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("turns", F.lit(2))
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert got[1]["formatted"] == "<s>[INST]user[/INST]x</s><s>[INST][/INST]</s>"
    assert got[None]["formatted"] == "<s>[INST]user[/INST]y[SEP]y</s>"
    assert chat.format_chats(df.limit(0)).count() == 0


HTML = {
    None: "", "": "", "plain text only": "plain text only",
    "<div class=sidebar>menu text here</div><div id=content><p>First para, long enough to matter.</p><p>Second &amp; last&nbsp;one.</p></div><div class='comments'><p>Nice post!</p></div>": "First para, long enough to matter.\nSecond & last one.",
    "<article><header><h1>Title</h1></header><p>One <b>bold</b>\n word.</p><script>if (a<b) '</p>'</script><aside>x</aside></article><form><p>mail</p></form>": "Title\nOne bold word.",
    "<div class='site-header'><p>Brand</p></div><div><h1>Head</h1><div class=text><p>One long paragraph of the article.</p><p>Another long paragraph of it.</p></div></div><div id=cookie-banner>We use cookies</div>": "Head\nOne long paragraph of the article.\nAnother long paragraph of it.",
    "<main><p>Body text of the page.</p></main><ol><li class=comment><article>I disagree with all of this, at length and loudly.</article></li></ol>": "Body text of the page.",
    "<p>a < b and <!-- c --> d": "a < b and d", "<!--": "", "<p": "",
    "<body><main><ul><li>one<li>two</ul></main><footer>f</footer>": "one\ntwo",
    "<div class=ad>An advert with much more text than the page itself has to offer.</div><article><h1>Short</h1><p><b>Short.</article><footer>Footer</footer>": "Short\nShort.",
    "<main><div class='post social'><p>The text of the article stands in here.</p></div><div class=ad>Buy</div></main>": "The text of the article stands in here.",
}


def test_html_cases(spark):
    for source, want in HTML.items():
        assert htmltext.main_text(source) == want, source
    deep = "<div>" * 3000 + "deep text" + "</div>" * 10
    assert htmltext.main_text(deep) == "deep text"
    pages = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in htmltext.extract_pages(pages).collect()) == ["", "x", "x"]
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


def test_html_split_article():
    one, two, three = ("".join(f"<p>{w} part, sentence {i}, long enough to be read as prose by anyone.</p>" for i in range(n)) for w, n in (("First", 6), ("Second", 4), ("Third", 3)))
    links = "<ul>" + "<li><a href=/x>Some other page</a></li>" * 5 + "</ul>"
    got = htmltext.main_text(f"<div><div>{one}</div><div>{links}</div><div>{two}</div></div><div>{links}</div><div><div>{three}</div></div>")
    assert [got.count(w) for w in ("First", "Second", "Third", "Some other page")] == [6, 4, 3, 0]
    got = htmltext.main_text(f"<div><div>{one}</div><div>Short</div><div>{two}</div></div>")
    assert [got.count(w) for w in ("First", "Second", "Short")] == [6, 4, 0]
    got = htmltext.main_text(f"<main>{two}</main><div>{three}</div><article>{one}</article>")
    assert [got.count(w) for w in ("First", "Second", "Third")] == [6, 4, 0]


PROSE = "Prose that goes on for a while, as the text of an article does, sentence after sentence."
UNNAMED = [
    # no element has a name, a role or a tag that says furniture: density alone decides
    f"<div><div>{'<p>' + PROSE + '</p>'}{'<p>' + PROSE + '</p>'}<p>{PROSE}</p></div><div>{'<div><a href=/x>Go on</a></div>' * 12}</div></div><div>{'<span>x</span>' * 8}</div>",
    f"<div>{'<span><a href=/y>Elsewhere</a></span>' * 9}</div><section><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></section><div>{'<div><span><b>Call us</b></span></div>' * 3}</div>",
]


@pytest.mark.parametrize("page", UNNAMED)
def test_html_density_decides(page, monkeypatch):
    assert htmltext.main_text(page) == "\n".join([PROSE] * 3)
    monkeypatch.setattr(htmltext, "_density", lambda *a: 1.0)
    assert htmltext.main_text(page) != "\n".join([PROSE] * 3)


def test_html_threshold_is_that_of_the_path_below_the_body():
    part = lambda n: f"<p>{PROSE}</p>" * n
    links = "<div><a href=/x>Somewhere else</a></div>" * 10
    thin = "<div><span>Tel.</span><span>Fax</span><span>Map</span></div>"
    # as dense as the path: taken; less dense, though the body is less dense still: left out
    page = f"<div>{part(4)}</div><div>{links}</div><div>{part(4)}</div><div>{thin}</div>"
    assert htmltext.main_text(page) == "\n".join([PROSE] * 8)
    assert htmltext.main_text(f"<p>One <span>{'w ' * 9}</span></p>".replace("<p>", "<div>").replace("</p>", "</div>")) != ""


@pytest.fixture
def no_lists(monkeypatch):
    for name in ("NOISE_WORDS", "COMMENT_WORDS", "NOISE_ROLES", "NOISE_TAGS"):
        monkeypatch.setattr(htmltext, name, set())


def _production(page):
    return htmltext.main_text(page, htmltext.FURTHER, htmltext.LONE)


def test_html_production_parameters():
    for source, want in (HTML | {p: "\n".join([PROSE] * 3) for p in UNNAMED}).items():
        assert _production(source) == want, source
    links = "<div>" + "<span><a href=/x>Somewhere else</a></span>" * 6 + "</div>"
    page = f"<div><div>{f'<p>{PROSE}</p>' * 4}</div>{links}</div><div><a href=/>Home</a></div><div>%s</div>"
    # a lone line beside the article goes, a small region of several lines stays
    assert _production(page % "All rights are ours.") == "\n".join([PROSE] * 4)
    assert _production(page % f"<p>{PROSE}</p><p>Its end.</p>") == "\n".join([PROSE] * 5 + ["Its end."])
    assert _production(page % "<p>Ours.</p><p>All.</p>") == "\n".join([PROSE] * 4)
    assert "All rights" in htmltext.main_text(page % "All rights are ours.")


@pytest.mark.usefixtures("no_lists")
def test_html_density_comes_before_the_lists(spark, sf_dir, monkeypatch):
    # an article of less text than the furniture around it has no density to show
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    article = lambda p: htmltext.main_text(re.search(r"(?s)<article>.*</article>", p).group())
    pages = [p for p in pages if len(article(p)) >= 400]
    want = [article(p) for p in pages]
    unnamed = [re.sub(r"<(/?)(?:article|nav|footer|aside|div)\b[^>]*>", r"<\1div>", p) for p in pages]
    assert sum(map(lambda p, w: _production(p) == w, unnamed, want)) >= 0.95 * len(pages)
    monkeypatch.setattr(htmltext, "_density", lambda *a: 1.0)
    assert sum(map(lambda p, w: _production(p) == w, unnamed, want)) < 0.1 * len(pages)


def test_html_furniture_denser_than_the_article():
    # density picks the comments and the advert first; the lists say what they are
    loud = "<p>I disagree with all of this, at length, loudly, and without a single link in it.</p>"
    art = f"<div><h2>Head</h2><p>{PROSE}</p><p>{PROSE} <a href=/x>More</a></p></div>"
    for other in (f"<div class=comments>{loud * 4}</div>", f"<div class=ad>{loud * 2}</div>", f"<aside>{loud * 9}</aside>"):
        assert _production(f"<div>{art}{other}</div>") == f"Head\n{PROSE}\n{PROSE} More", other


def test_html_head_without_its_end_tag():
    assert htmltext.main_text("<html><head><meta charset=utf-8><title>t</title><body><p>Text") == "Text"
    assert htmltext.main_text("<head><title>t</title><script>x</script><div>Text</div>") == "Text"


def test_html_against_a_plain_version():
    import math
    import random

    def grow(rng, depth, in_link):
        node = {"tag": rng.choice(["div", "section", "span"] + ([] if in_link else ["a"])), "kids": []}
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.6:
                node["kids"].append(grow(rng, depth - 1, in_link or node["tag"] == "a"))
            else:
                node["kids"].append(" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice([1, 2, 15, 40]))))
        return node

    def markup(n):
        return n if isinstance(n, str) else f"<{n['tag']}>{' '.join(map(markup, n['kids']))}</{n['tag']}>"

    def words(n):
        return n.split() if isinstance(n, str) else [w for k in n["kids"] for w in words(k)]

    def below(n):
        return [n] + [x for k in n["kids"] if not isinstance(k, str) for x in below(k)]

    def measure(n, link=False):
        link = link or n["tag"] == "a"
        own = sum(len(w) for k in n["kids"] if isinstance(k, str) for w in k.split())
        n["own"], n["c"], n["t"], n["lc"], n["lt"] = own, own, 0, own if link else 0, 0
        for k in (k for k in n["kids"] if not isinstance(k, str)):
            measure(k, link)
            k["up"] = n
            n["c"], n["lc"], n["t"], n["lt"] = n["c"] + k["c"], n["lc"] + k["lc"], n["t"] + k["t"] + 1, n["lt"] + k["lt"] + (k["tag"] == "a")

    def density(c, t, lc, lt, share):
        t, lc_, lt = max(t, 1), max(lc, 1), max(lt, 1)
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
        return c / t * math.log(max(1, c * t / (lc_ * lt)), max(base, 1 + 1e-6)) if c else 0.0

    differ = 0
    for seed in range(150):
        rng = random.Random(seed)
        body = {"tag": "body", "kids": [grow(rng, 3, False) for _ in range(3)]}
        measure(body)
        nodes, share = below(body), body["lc"] / max(body["c"], 1)
        for n in nodes:
            n["d"] = density(n["c"], n["t"], n["lc"], n["lt"], share)
        for n in nodes:
            n["sum"] = (density(n["own"], 1, 0, 0, share)) + sum(k["d"] for k in n["kids"] if not isinstance(k, str))
            n["reach"] = n["d"] if body["lc"] else n["c"] / max(n["t"], 1)
        best = max(nodes, key=lambda n: n["sum"])
        limit, at = best["reach"], best
        while at is not body and at["up"] is not body:
            at = at["up"]
            limit = min(limit, at["reach"])
        taken = []

        def visit(n):
            if any(n is y for x in taken for y in below(x)) or n is not body and (n["reach"] < limit or not n["c"]):
                return
            taken.append(max(below(n), key=lambda x: x["sum"]))
            for k in (k for k in n["kids"] if not isinstance(k, str)):
                visit(k)

        visit(body)
        inside = [x for n in nodes if any(n is y for x in taken for y in below(x)) for x in [id(n)]]
        kept = lambda n: [w for k in n["kids"] for w in ((k.split() if id(n) in inside else []) if isinstance(k, str) else kept(k))]  # noqa: B023, E731
        assert htmltext.main_text("<body>" + " ".join(map(markup, body["kids"])) + "</body>").split() == kept(body), seed
        differ += kept(body) != words(body)
    assert differ > 50


@pytest.mark.parametrize(
    "attrs", ["class='content with-sidebar'", "id='page' class='menu-open'", "class='post social'", "class='job-notice'", "class='post has-comments'", "class='post feedback'"]
)
def test_html_article_in_a_wrapper_named_like_furniture(attrs):
    prose = "".join(f"<p>Sentence {i} of the article, long enough to be read as prose.</p>" for i in range(5))
    extra = "<div class='sidebar'><p>Furniture of the page.</p></div><ul class='comments'><li class='comment'><p>I disagree with it.</p></li></ul>"
    got = htmltext.main_text(f"<div {attrs}><div>{prose}</div>{extra}</div><div><a href=/>Home</a></div>")
    assert got.count("Sentence") == 5 and "Furniture" not in got and "disagree" not in got


def test_packs_fill_well():
    import random

    rng = random.Random(1)
    histogram = {n: rng.randint(0, 50) for n in range(1, 2049)}
    packs = packing.shortest_pack_first(histogram, 2048)
    used = {}
    for pattern, count in packs:
        assert sum(pattern) <= 2048
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == {n: c for n, c in histogram.items() if c}
    assert packing.shortest_pack_first({}, 2048) == []
    assert sum(c for _, c in packing.shortest_pack_first({512: 1000}, 2048)) == 250


def plain_components(n, pairs):
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in pairs:
        label[top(v)] = top(u)
    seen = {}
    return [seen.setdefault(top(k), len(seen)) for k in range(n)]


def test_jaccard_forest_connects_what_all_pairs_do():
    import numpy as np

    rng = np.random.default_rng(3)
    for t in range(120):
        make = lambda m, top: [np.unique(rng.integers(0, top, rng.integers(1, 12), dtype=np.uint32)) for _ in range(m)]
        top = int(rng.choice([9, 14, 200]))
        a, b = make(int(rng.integers(1, 60)), top), None if t % 2 else make(int(rng.integers(1, 60)), top)
        sets = [set(x.tolist()) for x in [*a, *(b or [])]]
        pairs = [(i, j) for i in range(len(a)) for j in (range(i + 1, len(a)) if b is None else range(len(a), len(sets)))]
        want = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) + 1e-9 >= 0.8 * len(sets[i] | sets[j])]
        u, v = neardup.jaccard_forest(a, b, 0.8)
        assert len(u) < len(sets) and plain_components(len(sets), zip(u, v)) == plain_components(len(sets), want)


def test_jaccard_forest_is_linear_in_unlike_sets():
    import time

    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**32, 5, dtype=np.uint32)) for _ in range(48_000)]
    began = time.process_time()
    assert neardup.jaccard_forest(sets, None, 0.8) == ([], []) and time.process_time() - began < 15  # over all pairs: minutes
