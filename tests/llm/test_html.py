"""Main text of pages: planted articles, site templates, broken markup."""

import html as entities
import os
import re

import random
import time
import pytest
from pyspark.sql import functions as F

from tracewell.llm import html, queries

PAGES = "page_id long, url string, html string"


def article_of(source):
    """The article's text by a plain reading, for pages of the small tables' form."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1].replace("<br>", " ")
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|ul|li|div)>", inside)]
    return "\n".join(x for x in parts if x)


def test_small_tables(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = {r["page_id"]: r for r in queries.op3_html(spark, sf_dir).collect()}
    assert out.keys() == pages.keys()
    for i, r in out.items():
        assert r["text"] == article_of(pages[i]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[i]["url"]


def page(i, body):
    return f"<html><head><title>t{i}</title></head><body><div><p>Welcome to our site</p></div>{body}<div><span>Made by us &amp; you</span></div></body></html>"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_template_without_names_goes_by_recurrence(spark):
    rows = [(i, f"https://u:p@Site.org:80/{i}", page(i, f"<section><p>Story {i} is here</p></section>")) for i in range(6)]
    rows += [(10 + i, f"http://two.org/{i}", page(i, f"<p>Other {i}</p>")) for i in range(2)]
    out = texts(spark, rows)
    assert all(out[i] == f"Story {i} is here" for i in range(6))
    assert out[10] == "Welcome to our site\nOther 0\nMade by us & you"  # two pages are no template


def test_notice_on_a_small_share_of_a_large_host(spark):
    notice = "<div><p>We moved to a new address</p></div>"
    rows = [(i, f"http://l.org/{i}", f"<body>{notice if i < 18 else ''}<section><p>Story {i}</p></section></body>") for i in range(120)]
    rows.append((120, "http://l.org/120", f"<body><article><p>They said:</p>{notice}</article></body>"))
    assert texts(spark, rows) == {i: f"Story {i}" for i in range(120)} | {120: "They said:\nWe moved to a new address"}


def test_copies_of_a_page_are_no_template(spark):
    same = "<body><article><p>Only text.</p></article></body>"
    rows = [(i, f"http://c.org/{i}", same) for i in range(50)] + [(50 + i, f"http://c.org/x{i}", f"<body><article><p>Shared.</p><p>{i}</p></article></body>") for i in range(5)]
    out = texts(spark, rows)
    assert set(out[i] for i in range(50)) == {"Only text."} and out[52] == "Shared.\n2"


def test_recurring_notice_inside_articles(spark):
    rows = [(i, f"http://n.org/{i}", f"<article><p>Text {i}</p><div><p>Read more at our shop</p></div></article>") for i in range(20)]
    assert texts(spark, rows) == {i: f"Text {i}" for i in range(20)}


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain text\n only", "plain text only"),
        ("<article><p>a<br>b &lt;c&gt; &#233;&nbsp;d<p>e <b>f</i> g</article>tail", "a b <c> é d\ne f g"),
        ("<article><h1>T</h1><nav>menu</nav><p>x</p><aside>s</aside><form><p>f</p></form><script>if (a < b) '</p>'</script><style>p{}</style><div class='side comments'><p>c</p></div><p>y</p></article>", "T\nx\ny"),
        ("<header>h</header><div class=ad>buy</div><div id='cookie-notice'>ok</div><p>body</p><div role=navigation>n</div><footer>f</footer>", "body"),
        ("<main><p>m</p></main><div>other</div>", "m"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "one\ntwo\n1\n2"),
        ("<article><p>a<!-- <p>no</p> --> b<!-- never ends <p>c", "a b"),
        ("<article><a title=it's href='x>y'>l</a> 1 < 2 <b", "l 1 < 2 <b"),
        ("<ARTICLE><P>up</P></ARTICLE>", "up"),
        ("<div class='comments'><article>reply</article></div><article>main</article>", "main"),
        ("<div>" * 50_000 + "deep" + "</div>" * 50_000, "deep"),
        ("<article>" + "<a<a" * 100_000, "<a<a" * 100_000),
        ("<article><p>" + "w " * 300_000, ("w " * 300_000).strip()),
        ("<div>" * 50_000 + "</section></li>" * 50_000 + "x", "x"),
    ],
)
def test_markup(source, want):
    assert html.main_text(source) == want


def varied(i, inner="article"):
    """A page whose menu, notice and footer differ in text from all others."""
    menu = "".join(f"<li><a href='/{i}{j}'>item {chr(97 + i)}{chr(97 + j)}</a></li>" for j in range(2 + i % 3))
    prose = "".join(f"<p>Paragraph {chr(97 + i)}{chr(97 + j)} says something of its own in quite a few words more than the rest.</p>" for j in range(4))
    return f"<body><div class='m{i}'><ul>{menu}</ul></div><div class='box'>Only today {chr(97 + i)}</div><{inner}><h2>Title {chr(97 + i)}</h2>{prose}</{inner}><section>Owner {chr(97 + i)}</section></body>"


@pytest.mark.parametrize("inner, keys", [("article", 0), ("div", 1000)])
def test_template_with_text_that_varies_goes_by_its_shell(spark, monkeypatch, inner, keys):
    monkeypatch.setattr(html, "BROADCAST_KEYS", keys)
    rows = [(i, f"http://v.org/{i}", varied(i, inner)) for i in range(12)]
    own = lambda x: re.sub(r"(?s).*?(?=Title)|Owner.*", "", x).strip()
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, PAGES), rules=False).collect()}
    for i, _, source in rows:
        assert out[i] == own(html.main_text(source, rules=False)) and out[i].startswith("Title") and out[i].count("Paragraph") == 4


def test_counts_are_those_of_a_plain_count(spark, sf_dir):
    """Shells and subtrees that Spark calls template, against counts in plain Python."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.union(pages.limit(3))
    by_host: dict = {}
    for r in pages.withColumn("host", html.host_of(F.col("url"))).collect():
        if r["html"] is not None:
            by_host.setdefault(r["host"], {})[r["html"]] = html.features(r["html"])
    want = set()
    for host, of in by_host.items():
        seen: dict = {}
        for body, (article, found) in of.items():
            for f in found:
                sig = article if f["kind"] in (html.INSIDE, html.INSIDE_BOX) else body
                held = seen.setdefault((f["kind"], f["key"]), [set(), 0, 0, f["up"]])
                held[0].add(sig)
                held[1] += f["chars"]
                held[2] += f["total"]
        pages_of = len(seen[html.PAGE, 0][0])
        rated = {k: (len(v[0]), v[1] / v[2] if v[2] else 0.0, v[3]) for k, v in seen.items() if k[0] != html.PAGE and len(v[0]) >= 3}
        main = {k for k, v in rated.items() if k[0] == html.SHELL and v[1] >= 0.5}
        outer = {rated[k][2] for k in main}
        for (kind, key), (n, part, _) in rated.items():
            often = n >= 10 or n / pages_of >= 0.2
            if (kind, key) in main:
                if key not in outer:
                    want.add((host, kind, key, True))
            elif (often and part < 0.1) if kind == html.SHELL else often if kind == html.OUTSIDE else n >= 10 and (kind == html.INSIDE_BOX or n / pages_of >= 0.5):
                want.add((host, kind, key, False))
    got = {tuple(r) for r in html.template_of_hosts(html.page_features(pages, "url", "html")).collect()}
    assert got == want and got


def test_tables_by_the_template_alone(spark, sf_dir):
    pages = spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.01/pages.parquet")
    hosts = {r["h"] for r in pages.groupBy(html.host_of(F.col("url")).alias("h")).count().where("count >= 4").collect()}
    out = html.extract(pages, rules=False).withColumn("h", html.host_of(F.col("url"))).collect()
    known = [r for r in out if r["h"] in hosts]
    same = sum(r["text"] == article_of(r["html"]) for r in known)
    assert known and same >= 0.9 * len(known)


def test_null_repeated_clashing_and_no_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>a</p>"), (2, "", "<p>b</p>"), (2, "", "<p>b</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("own"), "host": F.lit(1), "template": F.lit(2), "a.b": F.lit(3)})
    out = html.extract(df)
    assert sorted((r["page_id"] or 0, r["text"], r["host"]) for r in out.collect()) == [(0, "a", 1), (1, "", 1), (1, "", 1), (2, "b", 1), (2, "b", 1)]
    assert html.extract(df.limit(0)).count() == 0


def test_every_main_and_the_title_beside_an_article():
    page = "<body><main><h2>One</h2><p>First main.</p></main><main><p>Second main.</p></main></body>"
    assert html.main_text(page) == "One\nFirst main.\nSecond main."
    page = "<body><div><h1>The title</h1><article><p>Body.</p></article><p>after</p><h1>not this</h1></div></body>"
    assert html.main_text(page) == "The title\nBody."
    page = "<main><main><p>Inner.</p></main><p>Outer.</p></main>"
    assert html.main_text(page) == "Inner.\nOuter."


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<p><button>" + "<i>" * n + "<h1></h1>" * n,
        lambda n: "<a " * n + '=">"',
        lambda n: '<a ="' + "<b " * n + '" =">"',
        lambda n: "<div>" * n + "</p>" * n,
        lambda n: "<b>" * n + "</i>" * n,
        lambda n: "<!" * n,
        lambda n: "<a b='" * n,
        lambda n: "<a " + '<b=" ' * n + '=">"',
        lambda n: "<a<a" * n + ' =">"',
    ],
)
def test_hostile_pages_take_linear_time(page):
    """A megabyte of each takes seconds at most."""
    began = time.process_time()
    html.parse(page(1_000_000 // len(page(1))))
    assert time.process_time() - began < 8


def test_tags_that_nothing_closes_are_text():
    """As the plain pattern has it, wherever the failing tag stands."""
    r = random.Random(6)
    for _ in range(3000):
        page = "".join(r.choice(["<a ", "<b>", "=", '"', "'", ">", "x", " ", "</a", "<!--", "-->", '="', "='"]) for _ in range(r.randrange(1, 25)))
        token, at, got, want = html.tokens(page), 0, [], []
        while m := token(at):
            got.append(m.span())
            at = m.end()
        at = 0
        while m := html.TOKEN.search(page, at):
            want.append(m.span())
            at = m.end()
        assert got == want, page
