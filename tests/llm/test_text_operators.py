"""HTML extraction, exact dedup, line dedup and quality rules against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

from llm_helpers import LOWER, SF, oracle, words
from pyspark.sql import functions as F

from timberline.llm import exact_dedup, html_extract, line_dedup, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_extraction_keeps_the_article_alone(spark):
    import html

    for r in queries.op1_html_extraction(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|<h1>|</h1>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"])


def test_extraction_without_semantic_tags():
    prose = "This is the story of a river and of the people who lived by it for a long time, as it was told to me. " * 3
    page = f"""<html><head><title>T</title></head><body class="has-sidebar"><div id="header"><a href=/>Home</a></div>
    <div class="menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
    <div id=story><h2>The river</h2><p>{prose}</p><p>Short.</p><p>{prose} &eacute;&#233;</p></div>
    <div class="sidebar">{prose}</div><form>Search the site <input></form>
    <div class="comments"><p>{prose}</p></div><div>&copy; 2020 Someone</div></body></html>"""
    text = html_extract.main_text(page)
    assert text.split("\n") == ["The river", prose.strip(), "Short.", f"{prose} éé".replace("  ", " ")]


def test_extraction_reads_names_of_layout_as_no_boilerplate():
    prose = "This is the story of a river and of the people who lived by it for a long time, as it was told to me. " * 3
    for opened, closed in (
        ("<main class='has-sidebar'>", "</main>"), ("<div class='content with-sidebar'>", "</div>"), ("<article class='post tag-social'>", "</article>"), ("<section class='post-share-enabled'><article>", "</article></section>"),
        ("<div class='sidebar-right'><article>", "</article></div>"), ("<div class='sidebar'><main>", "</main></div>"), ("<div id='page-widget'><div role='main'>", "</div></div>"),
    ):
        assert html_extract.main_text(f"<body>{opened}<p>{prose}</p>{closed}</body>") == prose.strip(), opened
    # what the names do say still holds
    for opened, closed in (
        ("<div class='ad'>", "</div>"), ("<div class='site-footer'>", "</div>"), ("<div class='comments-area'><article class='comment-body'>", "</article></div>"), ("<div class='related-posts'><article>", "</article></div>"),
        ("<div id='sidebar'>", "</div>"), ("<div class='share-buttons'>", "</div>"), ("<aside><article>", "</article></aside>"),
    ):
        assert html_extract.main_text(f"<body><article><p>{prose}</p></article>{opened}<p>{prose} Not this.</p>{closed}</body>") == prose.strip(), opened


PROSE = "This is the story of a river and of the people who lived by it for a long time, as it was told to me. " * 3
SOUP = "Quartz lantern anvil copper saddle kettle pewter ledger thimble bellows gantry trestle sluice hopper mandrel. " * 3
LINKS = "<ul>" + "".join(f"<li><a href={i}>Another story of the river, number {i}, with more of it to read and to look at on the way</a>" for i in range(3)) + "</ul>"


def test_density_decides_without_tags():
    """Pages without semantic tags or telling names: each feature decides."""
    page = f"<body><div><p>{PROSE}</p></div><div>{SOUP}</div><div>{LINKS}</div><div><p>{PROSE} Again.</p></div><div>Posted at noon</div></body>"
    assert html_extract.main_text(page).split("\n") == [PROSE.strip(), PROSE + "Again."]


def test_each_feature_changes_pages(monkeypatch):
    """Switched off one by one, stop words, link density and length each change a page, in an article and outside it."""
    outside = f"<body><div><p>{PROSE}</p></div><div>{LINKS}</div><div>{SOUP}</div><div>{LINKS}</div><div>An aside of the editor, short and plain.</div><div>{LINKS}</div></body>"
    within = f"<body><article>{LINKS}<p>{PROSE}</p><p>Short.</p><p>{SOUP}</p><p>x</p><p>y</p>{LINKS}</article></body>"
    want = {page: html_extract.main_text(page) for page in (outside, within)}
    assert want[outside] == PROSE.strip() and want[within].split("\n") == [PROSE.strip(), "Short.", SOUP.strip()]
    for name, off in (("STOP_WORDS", frozenset()), ("LINKED", 2.0), ("LONG", 1e9)):
        with monkeypatch.context() as m:
            m.setattr(html_extract, name, off)
            if name == "LINKED":
                m.setattr(html_extract, "LINKED_INSIDE", off)
            for page in want:
                assert html_extract.main_text(page) != want[page], (name, page[:20])


def test_density_alone_recovers_the_articles(spark):
    """The given pages with their articles, menus and names taken away: nearly all text is found again, and little else."""
    import re

    def bare(page):
        page = re.sub(r"<(/?)(article|nav|header|footer|aside|main|section|form|menu|dialog)\b", r"<\1div", page)
        return re.sub(r"""\s(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)

    both = more = less = 0
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        want, got = (Counter(html_extract.main_text(p).split("\n")) for p in (page, bare(page)))
        size = lambda c: sum(len(k) * n for k, n in c.items())
        both, more, less = both + size(want & got), more + size(got - want), less + size(want - got)
    assert both / (both + more) > 0.95 and both / (both + less) > 0.95


def test_extraction_takes_linear_time():
    import time

    begin = time.time()
    for unit in ('<b "', "<b a='", '<b a="', "<script ", "<script>", "</", "<!", "<!--", "<", "<p>x", "<div>", "<div></section>", "<b a=>", "=", "<a href=x>y", "<li>x</li>", "</script", "&", " "):
        html_extract.main_text("<body><p>a" + unit * (1_000_000 // len(unit)))
    assert time.time() - begin < 60  # 19 MB


def test_extraction_edges(spark):
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p><!-- open") == ""
    assert html_extract.main_text("<article><p>One") == "One"
    assert html_extract.main_text('<article><p title="a > b">x<br>y</p><script>var t="</p>";</script><aside>no</aside></article>') == "x y"
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<main>z</main>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()) == [("", 0), ("", 0), ("z", 1)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_exact_dedup(spark, awkward, empty):
    index = exact_dedup.DigestIndex(spark, "digests_test", buckets=4)
    index.drop()
    rows = awkward.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    out = index.deduplicate(awkward).collect()
    assert len(out) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_digest[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    # a later batch: what the index holds is a duplicate, what is new is appended
    later = spark.createDataFrame([(900, "one two three"), (901, "Fresh text"), (902, "fresh TEXT")], "doc_id long, text string")
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.deduplicate(later).collect()}
    assert again == {900: (9, False), 901: (902, False), 902: (902, True)}
    assert index.table().count() == len(groups) + 1
    assert index.deduplicate(empty).count() == 0 and index.table().count() == len(groups) + 1
    index.drop()


def test_batches_meet_a_bucketed_index(spark, awkward):
    """Batches of any split give the verdicts of one; a batch run twice changes nothing; the index side is not shuffled."""
    index = exact_dedup.DigestIndex(spark, "digests_batches", buckets=4)
    index.drop()
    newer = F.coalesce(F.col("doc_id") > 50, F.lit(False))
    parts = [awkward.filter(newer), awkward.filter(~newer & F.col("doc_id").isNotNull()), awkward.filter("doc_id is null")]
    got = sorted(map(str, index.deduplicate_batches(parts).collect()))
    rows = index.table().count()
    index.drop()
    assert got == sorted(map(str, index.deduplicate(awkward, "all").collect())) and index.table().count() == rows
    assert sorted(map(str, index.deduplicate(awkward, "all").collect())) == got and index.table().count() == rows
    again = index.deduplicate_batches(parts).collect()
    assert not any(r["kept"] for r in again) and index.table().count() == rows
    groups = spark.createDataFrame([(b"x",)], "digest binary").hint("merge")
    plan = groups.join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1
    index.drop()


def test_first_batch_meets_the_index(spark, monkeypatch):
    """The first batch, too, is judged against the (empty) bucketed index, and the query leaves no table."""
    read = []
    table = exact_dedup.DigestIndex.table
    monkeypatch.setattr(exact_dedup.DigestIndex, "table", lambda self: read.append(self.name) or table(self))
    out = queries.op3_digest_index_dedup(spark, SF)
    assert read and not any(spark.catalog.tableExists(name) for name in read)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_line_dedup(spark, awkward, empty):
    rows = [(i, f"common line\n{'rare' if i % 40 == 0 else 'own'} {i}\n\n  common line  \n", "a") for i in range(100)] + [(200 + i, "common line", "b") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("clash"))
    out = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, F.col("source"), report=True).collect()}
    for i in range(100):
        assert out[i]["text"] == f"{'rare' if i % 40 == 0 else 'own'} {i}\n\n" and out[i]["n_dropped"] == 2 and out[i]["n_lines"] == 3
    assert all(out[200 + i]["text"] == "common line" for i in range(5))  # the host has too few pages
    assert line_dedup.drop_boilerplate(empty, F.col("source")).count() == 0
    assert line_dedup.drop_boilerplate(awkward, F.col("source")).count() == awkward.count()


def test_line_dedup_without_broadcast(spark, monkeypatch):
    oracle(spark, "op6_line_dedup")
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    oracle(spark, "op6_line_dedup")


def test_line_dedup_equals_sql_where_lines_go(spark, monkeypatch):
    import llm_helpers

    monkeypatch.setattr(llm_helpers, "SF", "/root/testdata/sf0.1")
    assert queries.op6_line_dedup(spark, llm_helpers.SF).filter("n_dropped > 0").count() > 0
    oracle(spark, "op6_line_dedup")


def _measures(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_words_are_cut_at_six_white_bytes():
    import random

    import pyarrow as pa

    from timberline.llm.common import lower_words, split_words

    r = random.Random(1)
    texts = [None, "", " ", "a", *("".join(r.choice("aB É\t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003 ") for _ in range(r.randrange(30))) for _ in range(500))]
    words, numbers, ends = split_words(pa.array(texts))
    begins = [0, *ends[:-1]]
    for t, a, b in zip(texts, begins, ends):
        assert [words[k] for k in numbers[a:b]] == lower_words(t) == [w.translate(LOWER).encode() for w in WORD.findall(t or "")]


def test_quality_ledger(spark, awkward, empty):
    out = quality.ledger(awkward.withColumn("doc_id", F.struct("doc_id", "text"))).collect()
    assert len(out) == awkward.count()
    for r in out:
        n, chars, symbols, dup, rep = _measures(r["doc_id"]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert bool(r["failed"] & 3) == (n < 50 or 100 * rep > 50 * n)
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(not r["failed"] & quality.mask_of("v3") for r in out)
    assert quality.ledger(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_ablation(spark, awkward):
    rows = quality.ledger(awkward)
    bits = [r["failed"] & quality.mask_of("v3") for r in rows.collect()]
    for r in quality.ablation(rows).collect():
        bit = quality.BITS[r["rule"]]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits)
        assert r["n_failed_alone"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(not b & ~bit for b in bits)


def test_policies_keep_their_versions(spark):
    """Four lines of which two repeat one: half is not above a half, but above three tenths."""
    text = "\n".join([words(30, 1), words(30, 2), words(30, 3), words(30, 3)])
    few = "\n".join([words(60, 1), "stone path", "stone path"])
    rows = quality.ledger(spark.createDataFrame([(1, text), (2, few)], "doc_id long, text string"))
    verdicts = {p: [r["kept"] for r in quality.with_verdict(rows, p).orderBy("doc_id").collect()] for p in quality.POLICIES}
    assert verdicts["v2"] == verdicts["v1"] == [True, False] and verdicts["v3"] == verdicts["base"] == [True, True]


def test_sql(spark):
    for name in ("op3_digest_index_dedup", "op10_quality_rules"):
        oracle(spark, name)
