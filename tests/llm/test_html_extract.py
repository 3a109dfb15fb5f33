import pytest

from gridloom.llm import html_extract
from gridloom.llm.html_extract import Page, extract, vote

SCHEMA = "page_id bigint, url string, html string"

BODY = "<p>" + "</p><p>".join(f"Sentence number {k} of the story goes on for a while." for k in range(6)) + "</p>"
WANT = "\n\n".join(f"Sentence number {k} of the story goes on for a while." for k in range(6))


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("a < b &amp;&lt; c &copy 2 &am", "a < b &< c © 2 &am"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p><b>bold<br><p>next</b> tail", "bold\n\nnext tail"),
        ("<div>a <i>b</i>c\n\n d</div>", "a bc d"),
        ("<ul><li>x<li>y</ul><dl><dt>t<dd>d</dl>", "x\n\ny\n\nt\n\nd"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"),
        ('<script>var t="</p><p>no</p>";</script><p>yes', "yes"),
        ("<p>a<!-- <p>no --></p><!-- never closed <p>no", "a"),
        ('<p title="x > y" data-a=\'<p>\'>a</p><p class=it\'s>b', "a\n\nb"),
        ("<p>a</p><a href='unclosed", "a"),
        ("<p>a</p><p hidden>b</p><p style='display: none'>c</p><div aria-hidden=true>d</div>", "a"),
        ("<article>x</article><nav>menu</nav><aside>side</aside><footer>foot</footer>", "x"),
        ("<article>x <span class='ad'>buy</span>y<form><input>mail</form></article>", "x y"),
        ("<article>heading and sharing are words of text</article>", "heading and sharing are words of text"),
    ],
)
def test_pieces_of_markup(html, want):
    assert extract(html, []) == want


PAGES = {
    "semantic": f"<body><header><h1>Site</h1></header><nav>Menu</nav><article class='post-12'><h1>T</h1>{BODY}</article><section id='comments'><article>{BODY}</article></section><footer>f</footer>",
    "classes": f"<div id='top-nav'>Menu menu</div><div class='page'><div class='sidebar'>{BODY}</div><div class='content'><h1>T</h1>{BODY}</div><ol class='commentlist'><li>{BODY}{BODY}</li></ol></div>",
    "sections": f"<main><h1>T</h1>{''.join(f'<section>{p}</p></section>' for p in BODY.split('</p>')[:-1])}</main><div class='cookie-notice'>We use cookies</div>",
    "wrapper": f"<div class='content-sidebar-wrap'><main role='main'><h1>T</h1>{BODY}</main><div class='widget'>w</div></div>",
    "page form": f"<form action='x'><div class='story'><h1>T</h1>{BODY}</div><input value='a'></form>",
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    assert extract(PAGES[name], []) == "T\n\n" + WANT
    path, chars = vote(PAGES[name])
    assert chars == len("T\n\n" + WANT)
    assert extract(PAGES[name], [path]) == "T\n\n" + WANT


def test_paths_are_generalised():
    one, two = (vote(f"<body class='p{k}'><div class='b post-{k} a'>{BODY}</div>")[0] for k in (1, 22))
    assert one == two == ">body>div.a.b.post-#"


def test_deep_and_long_pages_end():
    deep = "<div>" * 20000 + "x" + "<b>" * 20000
    assert extract(deep, []) == "x"
    long = "<article>" + "<p>word &amp; word" * 50000 + "</article>"
    assert extract(long, []).count("\n\n") == 49999
    assert Page("<p" + " a='" * 20000).blocks == []


def consensus_pages():
    rows = []
    # Nine pages agree on the story; on one the remark beside it is longer than the story.
    for k in range(9):
        rows.append((k, f"http://h.example/{k}", f"<div class='story s{k}'><p>{'told here ' * 30}{k}</p></div><div class='extra'><p>aside</p></div>"))
    rows.append((9, "http://h.example/9", f"<div class='story s9'><p>{'told here ' * 30}</p></div><div class='extra'><p>{'remark ' * 60}</p></div>"))
    # A page of another template keeps its own best, as do hosts of one page and pages without a host.
    rows.append((10, "http://H.example/10", f"<section><p>{'other ' * 50}</p></section>"))
    rows.append((11, None, "<p>alone"))
    rows.append((12, "", None))
    rows.append((13, "http://empty.example", ""))
    rows.append((13, "http://empty.example", ""))
    return rows


@pytest.mark.parametrize("bound", [16 << 20, -1])
def test_the_host_decides(spark, monkeypatch, bound):
    monkeypatch.setattr(html_extract.common, "BROADCAST_BYTES", bound)
    pages = spark.createDataFrame(consensus_pages(), SCHEMA).repartition(3)
    got = html_extract.main_text(pages)
    assert got.columns == ["page_id", "url", "html", "text"]
    rows = got.collect()
    assert len(rows) == 15
    text = {r.page_id: r.text for r in rows}
    assert extract(consensus_pages()[9][2], []) == ("remark " * 60).strip()
    assert text[9] == ("told here " * 30).strip()
    assert text[0] == "told here " * 30 + "0"
    assert text[10] == ("other " * 50).strip()
    assert (text[11], text[12], text[13]) == ("alone", "", "")


def test_votes_against_brute_force(spark):
    pages = spark.createDataFrame(consensus_pages(), SCHEMA)
    voted = {}
    for _, url, html in consensus_pages():
        told = vote(html or "")
        if told:
            host = (url or "").lower().removeprefix("http://").split("/")[0]
            voted.setdefault(host, []).append(told[0])
    want = {}
    for host, paths in voted.items():
        best = [p for p in set(paths) if paths.count(p) >= 0.1 * len(paths)]
        want[host] = set(best)
    from pyspark.sql import functions as F

    rows = pages.withColumn("html", F.coalesce("html", F.lit("")))
    got = html_extract.host_paths(rows, html_extract.host_of(F.col("url")), F.col("html")).collect()
    assert {r.host: set(r.paths) for r in got} == want
    first = next(r for r in got if r.host == "h.example")
    assert first.pages == 11 and first.paths[0] == ">div.s#.story"


def test_clashing_columns_and_an_empty_table(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example", "<p>x", 5, "b", [1], "t")],
        SCHEMA + ", _row int, _site string, paths array<int>, TEXT string",
    )
    got = html_extract.main_text(pages).collect()[0]
    assert (got._row, got._site, got.paths, got.text) == (5, "b", [1], "x")
    assert html_extract.main_text(pages.limit(0)).collect() == []
