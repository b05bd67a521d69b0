"""Every operator on nulls, ties, repeats, empty tables, long texts and clashing columns, against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tremorlake.llm import bpe, common, fingerprints, html_text, licenses, line_dedup, linking, mixing, ngram_join
from tremorlake.llm import quality_classifier, quality_rules, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) + str(rng.randrange(vocabulary)) for _ in range(words))


@pytest.fixture
def edge_rows():
    base = _prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, base, "en", "a"),
        (2, near, "en", "a"),
        (3, base, "en", "b"),
        (3, base, "en", "b"),
        (4, None, "en", None),
        (5, "", None, "a"),
        (6, " \t\n", "de", "b"),
        (None, _prose(2, 90), None, None),
        (7, "one", "fr", "c"),
        (8, "é漢🙂 " * 30000, "fr", "c"),
        (9, "two words", "fr", "c"),
    ]


def test_fingerprints_against_brute_force(documents, edge_rows):
    got = fingerprints.compare_with_next(documents(*edge_rows)).collect()
    assert len(got) == len(edge_rows)
    rows = {r[0]: r[1] or "" for r in edge_rows}
    order = sorted((r[0] for r in edge_rows if r[0] is not None), reverse=True) + [None]
    for r in got:
        text = rows[r.doc_id]
        assert r.n_chars == len(text)
        if r.doc_id == 3:
            continue  # its repeat or the next one follows
        follower = rows[order[(order.index(r.doc_id) + 1) % len(order)]]
        changed = text[: len(text) - len(text) // 3] + follower[: len(text) // 3]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[3].fingerprint != by[2].fingerprint
    assert by[4].fingerprint == by[5].fingerprint and by[5].near_next == 1.0
    assert by[3].near_next > 0.6


def test_prefix_hashes_answer_spans_and_extensions():
    a, b = fingerprints.PrefixHash("xxabcdefyy"), fingerprints.PrefixHash("abcdefzz")
    assert a.span(2, 8) == b.span(0, 6) != a.span(1, 7)
    assert a.extension(b, 2, 0) == 6 and a.extension(b) == 0
    assert len(np.unique(a.spans(3))) == 8


def test_fingerprints_of_nothing_and_of_one(documents):
    assert fingerprints.compare_with_next(documents().where("false")).count() == 0
    only = fingerprints.compare_with_next(documents((1, "abcdef", "en", "a"))).first()
    assert only.near_next == 1.0 and only.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_url_filters_follow_the_dates(spark):
    entries = spark.sql(
        "select * from values ('bad.example', 'spam', date'2024-01-10', 'add'), ('bad.example', 'spam', date'2024-02-01', 'remove'),"
        " ('bad.example/ok', 'allow', date'2024-01-15', 'add'), (null, 'spam', date'2024-01-01', 'add'),"
        " ('bad.example', 'spam', date'2024-02-01', 'remove') as t(pattern, category, dated, action)"
    )
    captures = spark.sql(
        "select * from values (1, 'http://www.bad.example/x', date'2024-01-10'), (2, 'http://bad.example/ok/y', date'2024-01-20'),"
        " (3, 'http://bad.example/ok', date'2024-01-12'), (4, 'http://bad.example', date'2024-02-01'), (5, null, date'2024-01-20'),"
        " (6, 'nonsense', date'2024-01-20'), (7, 'http://bad.example', null), (1, 'http://www.bad.example/x', date'2024-01-10')"
        " as t(page_id, url, fetched)"
    )
    got = sorted((r.page_id, r.blocked, r.n_active) for r in url_filters.evaluate(captures, entries).collect())
    assert got == [(1, True, 1), (1, True, 1), (2, False, 2), (3, True, 1), (4, False, 0), (5, False, 0), (6, False, 0), (7, False, 0)]
    assert url_filters.evaluate(captures.limit(0), entries.limit(0)).count() == 0


def test_url_filters_keep_categories_apart(spark):
    entries = spark.sql(
        "select * from values ('bad.example', 'malware', date'2024-01-01', 'add'), ('bad.example', 'adult', date'2024-01-05', 'add'),"
        " ('bad.example', 'adult', date'2024-01-08', 'remove'), ('bad.example', 'allow', date'2024-01-20', 'add') as t(pattern, category, dated, action)"
    )
    captures = spark.sql(
        "select cast(n as int) as page_id, 'http://bad.example/' as url, date_add(date'2024-01-01', cast(n as int) - 1) as fetched"
        " from explode(array(1, 5, 8, 20)) as t(n)"
    )
    got = sorted((r.page_id, r.n_active, r.category, r.blocked) for r in url_filters.evaluate(captures, entries).collect())
    assert got == [(1, 1, "malware", True), (5, 2, "adult", True), (8, 1, "malware", True), (20, 2, "allow", False)]


def test_url_filters_normalise_both_sides(spark):
    listed = ("Bad.Example", "x.example/A", "2.3.4", "http://user@port.example:80//deep/", "1.2.3.9", "[::1]", "  ", "co.example.")
    entries = spark.createDataFrame([(p, "spam") for p in listed], "pattern string, category string")
    entries = entries.selectExpr("*", "date'2024-01-01' as dated", "'add' as action")
    long = "http://www.bad.example/" + "a/" * 30000
    urls = {
        "HTTP://bad.example./": True, " http://bad.example": True, "//bad.example/x": True, "http://x.example/A/b": True,
        "http://x.example/a": False, "http://1.2.3.4/": False, "http://1.2.3.9/x": True, "http://PORT.example/deep/er": True,
        "https://[::1]:8080/": True, "http://notbad.example": False, "http://www.co.example": True, long: True, "": False,
        "http://x.example?/A": False,
    }
    captures = spark.createDataFrame([(i, u, "c", "k") for i, u in enumerate(urls)], "page_id long, url string, category string, pattern string")
    captures = captures.withColumn("fetched", F.expr("date'2024-02-01'"))
    got = {r.url: r.blocked for r in url_filters.evaluate(captures, entries).collect()}
    assert got == urls


def test_license_scans(documents):
    rows = [
        (1, "intro\nLicensed under the APACHE license, version 2.0!\nend", "en", "a"),
        (2, "Released under\nthe MIT License.", "en", "a"),
        (3, None, "en", "a"),
        (4, "", "en", "a"),
        (5, "word " * 100000, "en", "a"),
        (6, "All rights reserved.", None, None),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(documents(*rows)).collect()}
    assert got == {1: "apache-2.0", 2: "mit", 3: "", 4: "", 5: "", 6: "all-rights-reserved"}
    assert licenses.scan(documents().where("false")).count() == 0


def test_mixing_meets_targets(documents, edge_rows):
    got = mixing.mix(documents(*edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert sum(r["size"] for r in got) == sum(len(WORD.findall(r[1] or "")) for r in edge_rows)
    sums = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sums.setdefault(r.source, [0, r.target])[0] += r.taken
    for taken, target in sums.values():
        assert abs(taken - target) < 1
    assert sum(t for _, t in sums.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    order = mixing.training_order(documents(*edge_rows)).collect()
    places = [r.position for r in order]
    assert places == sorted(places) and sum(r["take"] for r in order) == sum(r.taken for r in got)
    assert mixing.mix(documents().where("false")).count() == 0
    assert [r.taken for r in mixing.mix(documents((1, None, None, None))).collect()] == [0]


def test_line_dedup_keeps_one_of_a_group(documents):
    line = "the quick brown fox jumps over the lazy dog near the old river bank every single morning before breakfast"
    rows = [
        (2, f"{line}\nno", "en", "a"),
        (1, f"Some line of its own here\n{line}!!", "en", "a"),
        (3, f"{line} 77\n{line}", "en", "a"),
        (4, None, "en", "a"),
        (5, "", "en", "a"),
        (None, _prose(3, 40), None, None),
    ]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(documents(*rows)).collect()}
    assert got[1] == (rows[1][1], 2, 0) and got[2] == ("no", 2, 1) and got[3] == ("", 2, 2)
    assert got[4] == (None, 1, 0) and got[5] == ("", 1, 0) and got[None][2] == 0
    assert line_dedup.dedup(documents().where("false")).count() == 0


def test_line_dedup_finds_small_edits(documents):
    long = _prose(5, 200).translate(str.maketrans("0123456789", "bcdfghjkmp"))
    changed = long.replace(long.split()[100], long.split()[100] + "q", 1)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(documents((1, long, "en", "a"), (2, changed, "en", "a"))).collect()}
    assert got == {1: 0, 2: 1}


@pytest.mark.parametrize("words", [5, 10, 20, 40])
def test_line_dedup_finds_a_changed_word_in_any_length(documents, words):
    rows = []
    for i in range(30):
        line = _prose(1000 * words + i, words).translate(str.maketrans("0123456789", "bcdfghjkmp")).split()
        line[i % words] = "cat" if words > 5 else "ab"
        rows.append((2 * i, " ".join(line), "en", "a"))
        line[i % words] = "dog" if words > 5 else "abc"
        rows.append((2 * i + 1, " ".join(line), "en", "a"))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(documents(*rows)).collect()}
    assert got == {i: i % 2 for i in range(60)}


def test_line_dedup_takes_short_lines_and_all_scripts(documents):
    chinese = "这是一个关于数据处理的很长的句子没有任何空格用来测试重复行的删除效果如何"
    lines = ["Read more!", "2024-01-02", "  ", chinese]
    rows = [(1, "\n".join(lines), "en", "a"), (2, "\n".join(["read MORE", " 2024-01-02", "  ", chinese + "吗", "2024-01-03"]), "en", "a")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(documents(*rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("  \n2024-01-03", 3)}


def test_bpe_equals_tiktoken(documents, edge_rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*edge_rows, (10, "<|endoftext|> it's\x1c\x85  x  \n\n y", "en", "a"), (11, "ab" * 3000 + " " * 999, "en", "a")]
    got = bpe.encode_documents(documents(*rows), path, public_tokenizers.PATTERN).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(documents().where("false"), path, public_tokenizers.PATTERN).count() == 0


def _links(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    lowest = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0] or 0), len(s), lowest[g] or 0) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize("spare", [None, 0])
def test_ngram_join_against_all_pairs(documents, edge_rows, monkeypatch, spare):
    if spare is not None:  # rounds of leaders
        one = linking.link
        monkeypatch.setattr(ngram_join, "link", lambda *a, **k: one(*a, **k | {"spare": spare}))
    base = _prose(7, 300).split()
    rng = random.Random(4)
    copies = []
    for i in range(20, 50):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
        copies.append((i, " ".join(words), "en", "a"))
    rows = [*edge_rows, *copies]
    got = ngram_join.join(documents(*rows)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == _links(rows)


def test_ngram_join_of_nothing(documents):
    assert ngram_join.join(documents().where("false")).count() == 0


def test_quality_classifier_on_held_out_labels(documents, spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        text = _prose(i, rng.randrange(20, 80))
        rows.append((i, text if good else text.upper().replace(" ", "!! ## "), rng.choice(["en", None]), "a"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(500, None, None, None), (501, "", "en", "a"), (None, _prose(1, 50), "en", "a")]
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality_classifier.classify(documents(*rows), marks).collect()
    assert len(got) == len(rows)
    held = [(r.accepted, r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2 == 0]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[0].label == "z"
    blind = quality_classifier.classify(documents(*rows), marks.limit(0)).collect()
    assert all(r.accepted and r.score is None for r in blind)
    assert quality_classifier.classify(documents().where("false"), marks).count() == 0


def test_co_training_helps_the_weaker_view_and_never_takes_what_harms():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 3000)
    good = np.c_[rng.normal(size=(3000, 20)) + 1.5 * (2 * y[:, None] - 1) * (np.arange(20) < 6), np.ones(3000)]
    weak = np.c_[rng.normal(size=(3000, 40)) + 0.5 * (2 * y[:, None] - 1) * (np.arange(40) < 8), np.ones(3000)]
    known, free, test = slice(0, 250), slice(250, 1800), slice(1800, 3000)

    def lend(wrong):
        def exchange(model):
            loans = []
            for p in model.score(good[free], weak[free])[:2]:
                sure = np.maximum(p, 1 - p) >= 0.95
                loans.append((good[free][sure], weak[free][sure], ((p[sure] > 0.5) ^ wrong).astype(int)))
            return loans

        return exchange

    def errors(model, view):
        p = model.score(good[test], weak[test])[view]
        return int(((p > 0.5) != y[test]).sum())

    alone = quality_classifier.co_train(good[known], weak[known], y[known], lend(False), rounds=1)
    helped = quality_classifier.co_train(good[known], weak[known], y[known], lend(False), rounds=3)
    misled = quality_classifier.co_train(good[known], weak[known], y[known], lend(True), rounds=3)
    assert errors(helped, 1) < errors(alone, 1) and errors(helped, 2) <= errors(alone, 2)
    assert errors(misled, 2) <= errors(alone, 2)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site <a href=/>home</a></header><nav><ul><li><a>x</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
 text<br>here<p>Second &lt;one&gt;<form><input><p>mail us</form><div class="comments"><p>great post</div></article>
<aside>side</aside><footer>&copy; all</footer></body></html>"""


def test_html_extraction(spark):
    wanted = "Head & line\nFirst bold text here\nSecond <one>"
    long = "the cat and the dog of the house was in the garden " * 6
    plain = f"<body><div><a href=1>menu one</a></div><h2>Short title</h2><p>{long}</p><p>so short</p><p>{long}</p></body>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", plain), (5, "u", "<article><p>cut <b>off &am"), (5, "u", "<article><p>a<a hre")]
    got = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(got).orderBy("page_id", "text").collect()]
    block = " ".join(long.split())
    four = f"Short title\n{block}\nso short\n{block}"
    expected = [(1, wanted), (2, ""), (3, ""), (4, four), (5, "a"), (5, "cut off &am")]
    assert got == [(i, t, len(t)) for i, t in expected]


@pytest.mark.parametrize("outer", ["site has-sidebar", "no-sidebar", "share-something", "content sidebar-wrapper"])
def test_html_keeps_articles_in_named_wrappers(outer):
    page = f"<body><div class='{outer}'><main><article><p>the text</p><div class='site-footer'>foot</div></article></main></div></body>"
    assert html_text.main_text(page) == "the text"
    assert html_text.main_text("<div class='comments'><article>great post</article></div><nav><article>x</article></nav>") == ""


@pytest.mark.parametrize(
    "text",
    [
        "Это был длинный рассказ о том, как он жил в городе и не знал, что с ним будет. " * 4,
        "To jest długi tekst o tym, jak się żyło w mieście, i nie było to łatwe dla nikogo. " * 4,
        "这是一个很长的故事，讲述了他在城市里的生活，他不知道将来会发生什么。" * 4,
        "Tämä on pitkä kertomus siitä, miten hän asui kaupungissa eikä tiennyt tulevasta mitään. " * 4,
    ],
)
def test_html_judges_other_languages(text):
    page = f"<body><div><a href=1>menu</a></div><p>{text}</p><p>{text}</p><div>© us</div></body>"
    assert html_text.main_text(page) == f"{text.strip()}\n{text.strip()}"


def test_html_passes_find_articles_that_nothing_names(monkeypatch, spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    wanted = [html_text.main_text(page) for page in pages]
    known = html_text._inside

    def unnamed(*args):
        inside, off_by = known(*args)
        return min(inside, 0), off_by

    monkeypatch.setattr(html_text, "_inside", unnamed)
    assert sum(html_text.main_text(page) == text for page, text in zip(pages, wanted)) >= 0.95 * len(pages)


def test_html_keeps_paragraphs_of_links_and_drops_lists_of_them():
    page = "<article><p>See <a href=1>this whole sentence of a link</a></p><ul><li><a>x</a><li><a>y</a></ul><p><a>all link</a></p></article>"
    assert html_text.main_text(page) == "See this whole sentence of a link\nall link"
    assert html_text.main_text("<div>Site</div><div><a>menu</a></div><article><p>Short text.</p></article><div>Imprint</div>") == "Short text."


def test_html_reads_long_nested_pages():
    page = "<div>" * 60000 + "<p>deep</p>" + "</div></em></p>" * 60000
    assert len(page) > 1 << 20 and html_text.main_text(f"<article>{page}</article>") == "deep"


def test_quality_rules_against_brute_force(documents, edge_rows):
    repeated = "a b c d e f g h i " * 5
    rows = [*edge_rows, (20, repeated, "en", "a"), (21, "same line\nsame line\n\n\nother | # $", "en", "a")]
    rows += [(100 + i, _prose(i, 60), "en", "a") for i in range(80)] + [(300, _prose(1, 60).replace(" ", " ### "), "en", "a")]
    got = quality_rules.judge(documents(*rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        text = texts[r.doc_id]
        words, places = WORD.findall(text), {}
        for i in range(len(words) - 7):
            places.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None and 100 <= r.doc_id < 200:
            assert r.kept
    assert not {r.doc_id: r.kept for r in got}[300]
    assert quality_rules.judge(documents().where("false")).count() == 0


def test_quality_rules_reject_repetition_in_groups_of_any_size(documents):
    def lines(seed, again):
        texts = [_prose(1000 * seed + i, 12) for i in range(20 - again)]
        return "\n".join(texts + texts[:1] * again)

    rows = [(i, lines(i, 0), "en", "a") for i in range(80)] + [(100 + i, lines(100 + i, 0), "en", f"s{i}") for i in range(5)]
    rows += [(200, lines(200, 5), "en", "a"), (201, lines(201, 5), "en", "s1"), (202, lines(202, 5), "fi", None)]
    got = quality_rules.judge(documents(*rows)).collect()
    assert {r.doc_id for r in got if not r.kept} == {200, 201, 202} and not any(r.base_failed or r.distance == 0 for r in got)


def test_registered_sql_agrees(spark):
    import __spark_entry__ as entry
    import oracle
    from tremorlake.llm.queries import QUERIES, SQL

    sf_dir = "/root/testdata/sf0.001"
    con = oracle.connect(sf_dir)
    for name, sql in SQL.items():
        got = QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        cursor = con.execute(sql)
        names = [item[0] for item in cursor.description]
        assert sorted(names) == columns
        expected = sorted((tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()), key=str)
        assert sorted((tuple(row[c] for c in columns) for row in got.collect()), key=str) == expected, name
    assert set(QUERIES) <= set(entry.queries())


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.staged(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        if "mixing" not in name:
            assert docs.select("doc_id").distinct().count() == docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() == corpus_pipeline.run(spark, sf_dir).count()
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_pipeline_drops_copies_with_one_word_in_fifty_replaced(documents, spark):
    import corpus_pipeline

    words = _prose(11, 300).split()
    near = [f"w{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    docs = documents((1, " ".join(words), "en", "a"), (2, " ".join(near), "en", "a"))
    assert [r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()] == [1]


def test_line_dedup_and_ngram_join_delete_their_tables(documents):
    line = _prose(5, 20).translate(str.maketrans("0123456789", "bcdfghjkmp"))
    docs = documents((1, line, "en", "a"), (2, line + " q", "en", "a"))
    before = len(common._STAGED)
    left = line_dedup.dedup(docs)
    assert len(common._STAGED) == before + 1  # what the result reads
    joined = ngram_join.join(docs)
    assert len(common._STAGED) == before + 2
    assert sorted((r.doc_id, r.n_removed) for r in left.collect()) == [(1, 0), (2, 1)]
    assert joined.count() == 2


@pytest.mark.parametrize("changed", [(6, 14), (0, 30)])
def test_ngram_join_of_a_crowd_around_one_text(documents, monkeypatch, changed):
    rng = random.Random(8)
    base = _prose(12, 400).split()
    rows = []
    for i in range(0, 240, 2):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(*changed)):
            words[at] = f"w{rng.randrange(9999)}"
        rows.append((i, " ".join(words), "en", "a"))
        if i % 6 == 0:  # one word off the last: linked wherever it stands against the others
            words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
            rows.append((i + 1, " ".join(words), "en", "a"))
    met, one = [], linking.link

    def counted(members, near, verify, *args, **kwargs):
        def seen(pairs):
            met.append(pairs.count())
            return verify(pairs)

        return one(members, near, seen, **kwargs)  # every candidate is verified

    monkeypatch.setattr(ngram_join, "link", counted)
    monkeypatch.setattr(linking, "CROWD", 0, raising=False)
    got = ngram_join.join(documents(*rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _links(rows)
    if changed[0]:  # few are linked; all pairs would be 12,720
        assert sum(met) < 1500, met


def test_line_dedup_compares_texts_of_few_pairs(documents, monkeypatch):
    rng = random.Random(9)
    words = _prose(9, 40).translate(str.maketrans("0123456789", "bcdfghjkmp")).split()
    rows = [(i, " ".join(rng.sample(words, len(words))), "en", "a") for i in range(20)]  # the same letters in another order
    rows.append((20, rows[0][1].replace(" ", " a ", 1), "en", "a"))
    seen, one = [], linking.link

    def counted(members, near, verify, **kwargs):
        def watched(pairs):
            left = [str(t.path) for t in common._STAGED]
            assert not any("marks" in path for path in left), left
            monkeypatch.setattr(line_dedup, "staged", lambda df, label: seen.append(common.staged(df, label)) or seen[-1])
            return verify(pairs)

        return one(members, near, watched, **kwargs)

    monkeypatch.setattr(line_dedup, "link", counted)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(documents(*rows)).collect()}
    assert got == {i: int(i == 20) for i in range(21)}
    assert not any("norm" in df.columns for df in seen)  # texts are carried to the last pairs alone


def test_line_dedup_ends_candidates_by_letters_where_they_meet(documents, monkeypatch):
    rng = random.Random(12)
    shared = "the committee published another remarkable statement"
    own = [rng.sample("abcdefghijklmnopqrstuvwxyz", 13) for _ in range(8)]
    rows = [(i, f"{shared} " + " ".join("".join(rng.choices(few, k=6)) for _ in range(20)), "en", "a") for i, few in enumerate(own)]
    rows += [(20 + i, text.replace("statement", "statements"), "en", "a") for i, text, *_ in rows[:2]]
    met, one = [], linking.link

    def counted(members, near, verify, **kwargs):
        def seen(pairs):
            met.append(pairs.count())
            return verify(pairs)

        def kept():
            rows = members()
            left = [str(t.path) for t in common._STAGED]
            assert sum("shared" in path for path in left) == 2, left  # one table for each kind of keys, counted as it was made
            return rows

        return one(kept, near, seen, **kwargs)

    monkeypatch.setattr(line_dedup, "link", counted)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(documents(*rows)).collect()}
    assert got == {i: int(i >= 20) for i, *_ in rows}
    assert met == [2]  # all ten share keys


@pytest.mark.parametrize("bits", [8, 12])
def test_letter_codes_differ_no_more_than_counts(spark, bits):
    numbers = spark.range(80).select(F.col("id").cast("int").alias("x"))
    pairs = numbers.join(numbers.select(F.col("x").alias("y")))
    bits_apart = F.bit_count(line_dedup._turned(F.col("x") % (2 * bits), bits).bitwiseXOR(line_dedup._turned(F.col("y") % (2 * bits), bits)))
    apart = F.abs(F.col("x") - F.col("y"))
    assert pairs.where((bits_apart > apart) | ((apart <= bits) & (bits_apart != apart))).count() == 0


def test_sparse_lines_need_no_more_edits(spark):
    rng = random.Random(10)
    lines = ["".join(rng.choice("aeionrst bcdé这🙂") for _ in range(rng.randrange(40))) for _ in range(60)]
    lines += ["".join(c if rng.random() > 0.1 else rng.choice("xa ") for c in line) for line in lines]
    pairs = spark.createDataFrame([(a, b) for a in lines for b in lines[:60]], "a string, b string")
    a, b = F.col("a"), F.col("b")
    least = F.greatest(F.levenshtein(line_dedup.sparse(a), line_dedup.sparse(b)), line_dedup.edits_at_least(line_dedup.letter_counts(a), line_dedup.letter_counts(b)))
    assert pairs.where(least > F.levenshtein(a, b)).count() == 0


def test_line_dedup_spares_pairs_that_links_have_joined(documents, monkeypatch):
    text = _prose(21, 60).translate(str.maketrans("0123456789", "bcdfghjkmp"))
    words = text.split()
    rows = [(i, " ".join(w if k != 2 * i else "changed" for k, w in enumerate(words)), "en", "a") for i in range(10)]
    rows += [(20 + i, " ".join(w + "x" if k % 3 else "other" for k, w in enumerate(words)) + f" end{'abc'[i]}", "en", "a") for i in range(3)]
    met, one = [], linking.link

    def counted(members, near, verify, **kwargs):
        def seen(pairs):
            met.append(pairs.count())
            return verify(pairs)

        return one(members, near, seen, **kwargs)

    monkeypatch.setattr(line_dedup, "link", counted)
    # Few rows of keys make slices only where asked.
    for module, name, value in ((linking, "LIKELIEST", 0), (linking, "SLICE", 100), (linking, "SLICES", 2), (line_dedup, "_FEW", 4)):
        monkeypatch.setattr(module, name, value, raising=False)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup(documents(*rows)).collect()}
    assert got == {i: int(i not in (0, 20)) for i, *_ in rows}
    assert sum(met) < 30, met  # all pairs of the groups are 48


def test_line_keys_take_short_runs_last(documents):
    rng = random.Random(22)
    lines = [" of the to ".join("".join(rng.choices("bcdfgklmnprstuvwz", k=9)) for _ in range(30)) for _ in range(2)]
    rows = [(i, line, "en", "a") for i, line in enumerate(lines)] + [(2, "of the to of the to be", "en", "a")]
    found = line_dedup.occurrences(documents(*rows), line_dedup.MIN_WORDS, line_dedup.SIMILAR)
    runs = {r.doc_id: set(r.runs) for r in found.collect()}
    assert len(runs[0]) == len(runs[1]) == line_dedup.RUNS
    assert not runs[0] & runs[1]  # they share nothing else, over and over
    assert len(runs[2]) == 5  # a line of no other runs has these
