from collections import Counter

import pyarrow as pa
import pytest

from opswell.llm import pages

SCHEMA = "page_id long, url string, html string, main string, host string, text string"


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)
    return {r.page_id: r.text for r in pages.main_text(df, ["page_id", "url"]).collect()}


def test_article_without_furniture(spark):
    html = page(
        "<header>Site</header><nav><ul><li><a href='/a'>A</a></ul></nav><!-- <p>no</p> --><div class='ad'>Buy</div>"
        "<article><h1>Head &amp; more</h1><p>One\n two&nbsp;<b>bold</b><br>three<p>Four &lt;x&gt;</p><form><p>Mail</p></form><aside>Side</aside>"
        "<div class='cookie-notice'>Cookies</div><ul><li>a<li>b</ul><script>x<p></script><section id='comments'><p>I say</p></section></article>"
        "<footer>&copy; us</footer>"
    )
    assert run(spark, [(1, "http://h/1", html)]) == {1: "Head & more\nOne two bold three\nFour <x>\na\nb"}


def test_articles_keep_what_other_pages_repeat(spark):
    html = page("<article><p>the same words on each of the pages here</p></article>")
    assert set(run(spark, [(i, "http://h/x", html) for i in range(4)]).values()) == {"the same words on each of the pages here"}


def test_unique_runs_of_pages_without_article(spark):
    menu = "<div>Home News Sport Weather Contact About Shop</div>"
    foot = "<div>All of this is under the house rules of the site</div>"
    rows = [(i, "http://Host.example/a", page(f"{menu}<div>no{i} story told no{i}</div>{foot}")) for i in range(3)]
    rows.append((9, "http://other/", page(f"{menu}<p>lone</p>")))
    got = run(spark, rows)
    assert [got[i] for i in range(3)] == [f"no{i} story told no{i}" for i in range(3)]
    assert got[9] == "Home News Sport Weather Contact About Shop\nlone"  # another host's menu is its own


def test_runs_inside_a_block_are_cut_out(spark):
    rows = [(i, "http://h/", page(f"<p>a{i} b{i} c{i} subscribe to our letter for more news daily d{i} e{i}</p>")) for i in range(3)]
    assert run(spark, rows)[1] == "a1 b1 c1 d1 e1"


def test_phrases_and_copies_stay(spark):
    """Two pages with a common phrase among many, and a page that comes twice, keep all their words."""
    own = [f"start{i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(12)]
    for i in (3, 4, 5):
        own[i] += " as far as anyone could tell then"
    got = run(spark, [(i, "http://h/", page(f"<p>{t}</p>")) for i, t in enumerate(own)] + [(50, "http://h/", page(f"<p>{own[0]}</p>"))])
    assert got == {**dict(enumerate(own)), 50: own[0]}


def test_long_runs_of_several_pages_are_cut(spark):
    run_ = " ".join(f"rule{k}" for k in range(30))
    rows = [(i, "http://h/", page(f"<p>a{i} b{i} {run_ if i < 3 else ''} c{i}</p>")) for i in range(12)]
    assert run(spark, rows) == {i: f"a{i} b{i} c{i}" for i in range(12)}


def test_boilerplate_inside_articles(spark):
    notice = "please read the rules of this house before you write"
    rows = [(i, "http://h/", page(f"<article><p>story {i} <span class='advert'>Buy</span>told</p><p>{notice}</p></article>")) for i in range(8)]
    copies = [(100 + i, "http://copies/", page(f"<nav>{i}</nav><article><p>{notice}</p></article>")) for i in range(8)]
    got = run(spark, rows + copies)
    assert got == {**{i: f"story {i} told" for i in range(8)}, **{100 + i: notice for i in range(8)}}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "<"), (4, "http://h", "plain &eacute;"), (5, "http://h", "<article><p>cut <scr"), (6, "http://h", "<article></article><p>out"), (None, "http://h", "<main>m</main>")]
    rows += [(7, "http://h", "<div>" * 3000 + "deep" + "</p></span>" * 10), (8, "http://h", "<p>" + "long text " * 50_000)]
    got = run(spark, rows)
    assert [got[i] for i in (1, 2, 4, 5, 6, None, 7)] == ["", "", "plain é", "cut", "", "m", "deep"]
    assert len(got[8].split()) in (0, 100_000)
    assert run(spark, []) == {}


def test_repeated_rows_are_pages_each(spark):
    df = spark.createDataFrame([(1, "http://h", "<article>a</article>", "", "", "")] * 3, SCHEMA)
    assert pages.main_text(df, ["page_id"]).count() == 3


def test_whole_table(spark, tables):
    """The articles of the given pages are texts of documents under their first line."""
    from opswell.llm.queries import QUERIES

    rows = QUERIES["op3_html_text"](spark, tables.folder).collect()
    texts = {" ".join(r.text.split()) for r in tables.documents.collect() if r.text}
    assert len(rows) == tables.pages.count()
    assert all(" ".join(r.text.split("\n")[1:]) in texts and r.n_chars == len(r.text) for r in rows)


def rows_of(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("slab", [1, pages.SLAB])
def test_grams_of_many_pages_at_once(monkeypatch, slab):
    """They are each page's own, none goes over from one page into the next, and a part of a batch is a few batches."""
    monkeypatch.setattr(pages, "SLAB", slab)
    words = [f"w{k % 11}" for k in range(60)]
    inside = [None, [" ".join(words[:7]), "short"], [], [" ".join(words[:7])] * 2, None, None]
    outside = [[" ".join(words)] * 2, [" ".join(words[:30])], [], ["a b c"], [" ".join(words[3:]), "x"], []]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array(["h", "h", "h", "i", "h", "i"]), pa.array(inside, pa.list_(pa.string())), pa.array(outside, pa.list_(pa.string()))], ["row", "host", "inside", "outside"]
    )
    held, placed = Counter(), []
    for i in range(len(batch)):
        one = batch.slice(i, 1)
        for host, kind, gram, n in rows_of(pages._distinct(iter([one]))):
            assert n == 1
            held[host, kind, gram] += 1
        placed += rows_of(pages._placed(iter([one])))
    got = list(pages._distinct(iter([batch])))
    assert len(got) <= 4 * (1 if slab > 1 else len(batch))
    total = Counter()
    for host, kind, gram, n in rows_of(got):
        total[host, kind, gram] += n
    assert total == held and max(held.values()) > 1
    again = rows_of(pages._placed(iter([batch])))
    assert sorted(again) == sorted(placed) and len(set(again)) == len(again)


def test_texts_stay_in_place_while_few_are_cut(spark, monkeypatch):
    """The same texts with and without a small side that is sent to the pages."""
    menu = "<div>Home News Sport Weather Contact About Shop</div>"
    rows = [(i, "http://h/", page(f"{menu}<p>a{i} story told</p>")) for i in range(4)] + [(9, "http://h/", page(f"{menu}<p>a1 story told</p>"))]
    df = spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], SCHEMA)
    plan = lambda: pages.main_text(df, ["page_id"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = run(spark, rows)
        assert "SortMergeJoin" not in plan()
        monkeypatch.setattr(pages, "FEW", -1)
        assert "SortMergeJoin" in plan()
        assert run(spark, rows) == want == {**{i: f"a{i} story told" for i in range(4)}, 9: "a1 story told"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
