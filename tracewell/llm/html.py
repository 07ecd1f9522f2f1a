"""Main text of web pages by removing the site's template.

Each page is parsed into elements, and every element subtree gets a hash of its tags and text. Spark
counts in how many pages of a host a subtree occurs; those that recur across many of them are template (menus, banners, notices, footers) and are deleted. A menu or
footer need not have the same text everywhere. So containers outside articles also have a shell: the
path of tags and names that leads to them, whatever they hold. A shell that recurs across the host's
pages is template if it holds a small part of their text, and is not inside the shell that holds most
of it, which is where the host keeps its articles.

Inside articles the bar is higher, since articles may share sentences: containers must recur on
MANY_PAGES, other elements on half of the pages too, and pages whose articles have the same three
longest pieces of text (copies of one article) count once. Equal pages count once everywhere, so a host's copies
of one page don't make that page a template.

What is left after that is the text. As a last step, for hosts with too few pages to show a template,
elements go by tag and by a class, id or role that names something other than prose, and where there is
an article only articles count, with a first-level heading that stands before one of them, and else all
main elements.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.llm.common import append_arrow, fresh, materialise, quoted

#: Outside articles a subtree or shell is template if in so many pages of its host, and in this share of them or MANY_PAGES.
LEAST_PAGES, LEAST_SHARE, MANY_PAGES = 3, 0.2, 10
#: Inside an article, an element that is no container must be in this share of them.
ARTICLE_SHARE = 0.5
#: Of the text of the pages where it occurs, a template shell holds less than the first, the article's shell the second or more.
SMALL_PART, MAIN_PART = 0.1, 0.5
#: Template subtrees and shells of all hosts up to which they are broadcast.
BROADCAST_KEYS = 200_000
#: What is counted: subtrees outside articles, inside them, containers inside them, shells, pages.
OUTSIDE, INSIDE, INSIDE_BOX, SHELL, PAGE = range(5)

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never text of the page, and those that hold no prose by their tag.
HIDDEN = frozenset("head script style noscript template title button select textarea input iframe object embed noembed noframes svg math canvas audio video xmp".split())
NO_PROSE = frozenset("nav header footer aside form dialog menu".split())
CONTAINERS = frozenset("article aside center dialog div footer form header main menu nav section table".split())
#: Opening one of these closes an open element of the set, up to the nearest of the second set.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot option legend summary figcaption".split())
#: What a p can be inside of, seen from an element that would close it.
P_SCOPE = frozenset("article aside blockquote body button caption center dd details div dl figure footer form header html li main nav object ol section table td th ul".split())
#: Words in class, id or role that name something other than the article.
SIDE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|promotion|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|header|masthead|cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comment|comments|respond|replies|disqus|related|recommended|recommendations|widget|toolbar|pagination|pager|skip|complementary|contentinfo|search|tablist|dialog)(?:$|[\s_-])"
)
TOKEN = re.compile(r"""<!--(?P<comment>.*?)(?:--!?>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""", re.S)
NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
START, QUOTED = re.compile(r"<(?:[!?]|/?[a-zA-Z])"), re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
DIGITS, LETTER = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]")
ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)


class Element:
    __slots__ = ("tag", "parts", "side", "cut", "hash", "shell", "chars", "letters")

    def __init__(self, tag: str, side: bool, shell: int):
        self.tag, self.parts, self.side, self.cut, self.shell = tag, [], side, tag in HIDDEN, shell


def names_of(attrs: str) -> tuple[str, bool]:
    """class, id and role of an element, and whether it is hidden."""
    names, hidden = [], False
    for name, a, b, c in ATTR.findall(attrs):
        value, name = (a or b or c).lower(), name.lower()
        if name in ("class", "id", "role"):
            names.append(value)
        elif name == "hidden" or value == "true":
            hidden = True
    return " ".join(names), hidden


def tokens(source: str):
    """A function that gives the first token at or after a place, or None.

    A tag that nothing closes is read to the end of the page once: a tag whose name ends behind it
    where it read no quoted value isn't closed, either."""
    failed: list[tuple[int, list[int], list[int]]] = []  # ends of names, and the quoted values behind them
    named = [0]

    def known(end: int) -> bool:
        for first, starts, ends in reversed(failed):
            k = bisect.bisect_left(starts, end) - 1
            if end >= first and (k < 0 or end >= ends[k]):
                return True
        return False

    def token(at: int) -> re.Match | None:
        while s := START.search(source, at):
            i = s.start()
            if source[i + 1] in "!?":
                return TOKEN.match(source, i)
            if i + 1 >= named[0]:  # else it is in the name of one that failed
                named[0] = NAME.match(source, i).end()
                if not known(named[0]):
                    if m := TOKEN.match(source, i):
                        return m
                    spans = [q.span() for q in QUOTED.finditer(source, named[0])]
                    failed.append((named[0], [x for x, _ in spans], [y for _, y in spans]))
            at = i + 1
        return None

    return token


def parse(source: str) -> Element:
    """The tree of a page, as far as text needs it. Broken markup is closed where a browser would."""
    root = Element("", False, 0)
    stack, at, n, token = [root], 0, len(source), tokens(source)
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of a tag are

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(entities.unescape(piece) if "&" in piece else piece)

    def close(names: frozenset | set, until: frozenset) -> None:
        """Ends the nearest open element of names, unless one of until is nearer."""
        nearest = max((places[x][-1] for x in names if places.get(x)), default=0)
        if nearest and nearest >= max((places[x][-1] for x in until if places.get(x)), default=0):
            while len(stack) > nearest:
                places[stack.pop().tag].pop()

    while at < n:
        m = token(at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "p":
                close({"p"}, P_SCOPE)
            elif tag in BLOCK:
                close({tag}, frozenset())
            else:
                close({tag}, BLOCK)
            continue
        if tag in ENDS_P:
            close({"p"}, P_SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        names, hidden = names_of(m["attrs"]) if m["attrs"].strip() else ("", False)
        side = tag in NO_PROSE or hidden or bool(names and tag not in ("html", "body") and SIDE.search(names))
        element = Element(tag, side, xxhash.xxh3_64_intdigest(f"{tag} {DIGITS.sub('0', names)}", stack[-1].shell))
        stack[-1].parts.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            inside = source[at : end.start() if end else n]
            element.parts.append(entities.unescape(inside) if tag in ("textarea", "title") else inside)
            at = end.end() if end else n
        elif tag not in VOID:
            places[tag].append(len(stack))
            stack.append(element)
    return root


def walk(root: Element):
    """Elements with whether they are inside an article, every parent before its children."""
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        yield e, inside
        inside = inside or e.tag in ("article", "main")
        todo += [(x, inside) for x in reversed(e.parts) if x.__class__ is Element]


def add_hashes(root: Element) -> list[tuple[Element, bool]]:
    """Gives every element the hash of its subtree (tags, and text with white space made even), the
    characters of prose in it, and whether it has letters."""
    order = list(walk(root))
    for e, _ in reversed(order):
        h = hashlib.blake2b(e.tag.encode(), digest_size=8)
        e.chars, e.letters = 0, False
        for x in e.parts:
            if x.__class__ is Element:
                h.update(b"\0" + x.hash.to_bytes(8, "little"))
                e.letters = e.letters or x.letters
                if not x.side and not x.cut:
                    e.chars += x.chars
            else:
                even = " ".join(x.split())
                e.chars += len(even)
                e.letters = e.letters or LETTER.search(even) is not None
                h.update(b"\1" + even.encode("utf-8", "surrogatepass"))
        e.hash = int.from_bytes(h.digest(), "little")
    return order


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def features(source: str) -> tuple[int, list[dict]]:
    """A page's signature (hash of the three longest pieces of text in its articles) and what is counted of it, each once:
    kind, key, up (a shell's parent), chars and total (characters of prose in a shell and in the page)."""
    root, pieces = parse(source), []
    order = add_hashes(root)
    out: dict[tuple[int, int], dict] = {(PAGE, 0): {"kind": PAGE, "key": 0, "up": 0, "chars": 0, "total": 0}}
    up = {id(root): 0}
    for e, inside in order:
        box = e.shell if e.tag in CONTAINERS else up[id(e)]
        for x in e.parts:
            if x.__class__ is Element:
                up[id(x)] = box
            elif inside or e.tag in ("article", "main"):
                pieces.append(" ".join(x.split()))
        if e.cut or not e.parts or e.tag in ("", "html", "body"):
            continue
        if e.tag not in ("article", "main") and (e.letters or not inside):
            kind = (INSIDE_BOX if e.tag in CONTAINERS else INSIDE) if inside else OUTSIDE
            out[kind, e.hash] = {"kind": kind, "key": signed(e.hash), "up": 0, "chars": 0, "total": 0}
        if not inside and e.tag in CONTAINERS:
            held = out.setdefault((SHELL, e.shell), {"kind": SHELL, "key": signed(e.shell), "up": signed(up[id(e)]), "chars": 0, "total": root.chars})
            held["chars"] += 0 if e.side else e.chars
    longest = "\n".join(heapq.nlargest(3, pieces, key=len))
    return signed(xxhash.xxh3_64_intdigest(longest.encode("utf-8", "surrogatepass"))), list(out.values())


def blocks_of(tops: list[Element], rules: bool) -> list[str]:
    """Text blocks below the given elements, in page order."""
    blocks, held = [], []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            blocks.append(line)

    todo: list = [*reversed(tops)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            held.append(x)
        elif x.tag in VOID:
            flush() if x.tag == "hr" else held.append(" ")
        elif x.cut or x.side and rules:
            if x.tag in BLOCK:
                flush()
        else:
            edge = x.tag in BLOCK
            if edge:
                flush()
                todo.append(None)
            todo += reversed(x.parts)
    flush()
    return blocks


@dataclass(frozen=True)
class Template:
    """What a host's pages have in common, as far as a page holds it: subtrees outside and inside of
    articles, shells of template, and shells that hold the host's articles."""

    outside: frozenset = frozenset()
    inside: frozenset = frozenset()
    shells: frozenset = frozenset()
    main: frozenset = frozenset()


def cut_template(root: Element, t: Template) -> None:
    """Marks the elements that are template."""
    add_hashes(root)
    todo = [(root, False, False)]
    while todo:
        e, inside, main = todo.pop()
        if e.parts and e.tag not in ("", "html", "body", "article", "main"):
            e.cut = e.cut or signed(e.hash) in (t.inside if inside else t.outside)
        if not inside and not main and e.tag in CONTAINERS and signed(e.shell) in t.shells:
            e.cut = True
        inside, main = inside or e.tag in ("article", "main"), main or signed(e.shell) in t.main
        todo += [(x, inside, main) for x in e.parts if x.__class__ is Element]


def main_text(source: str, template: Template = Template(), rules: bool = True) -> str:
    """The page's main text, given its host's template. Without rules: all that the template leaves."""
    root = parse(source)
    if template != Template():
        cut_template(root, template)
    if not rules:
        return "\n".join(blocks_of([root], rules))
    tops: list[Element] = []
    mains: list[Element] = []
    todo = [(root, False, False)]
    while todo:  # the outermost articles that are no side matter, with a title that stands before one of them
        e, beside, within = todo.pop()
        if e.side or e.cut:
            continue
        if e.tag == "article":
            tops.append(e)
            continue
        if e.tag == "h1" and beside:
            tops.append(e)
            continue
        if e.tag == "main" and not within:
            mains.append(e)
        children = [x for x in e.parts if x.__class__ is Element]
        first = next((i for i, x in enumerate(children) if x.tag == "article" and not x.side and not x.cut), 0)
        todo += [(x, i < first, within or e.tag == "main") for i, x in reversed([*enumerate(children)])]
    return "\n".join(blocks_of(tops or mains or [root], rules))


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(found)


FEATURE = StructType([StructField("kind", IntegerType()), *[StructField(x, LongType()) for x in ("key", "up", "chars", "total")]])


def page_features(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, page (hash of its html), sig (what pages count by), and the page's features (see features). Equal pages have equal rows."""
    rows = pages.where(quoted(html).isNotNull()).select(host_of(quoted(url)).alias("host"), quoted(html).alias("html"), F.xxhash64(quoted(html)).alias("page"))
    kind = pa.struct([("kind", pa.int32()), *[(x, pa.int64()) for x in ("key", "up", "chars", "total")]])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [features(x) for x in batch.column("html").to_pylist()]
        return [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(kind))]

    found = append_arrow(rows, [StructField("sig", LongType()), StructField("features", ArrayType(FEATURE))], lambda: make, "html")
    each = found.select("host", "page", "sig", F.explode("features").alias("f")).select("host", "page", "sig", "f.*")
    return each.withColumn("sig", F.when(F.col("kind").isin(INSIDE, INSIDE_BOX), F.col("sig")).otherwise(F.col("page")))


def template_of_hosts(features: DataFrame) -> DataFrame:
    """host, kind, key, main: the template subtrees and shells of each host; main marks the shells that
    hold its articles, which are no template."""
    once = features.groupBy("host", "kind", "key", "sig").agg(*[F.max(x).alias(x) for x in ("chars", "total", "up")])
    counts = once.groupBy("host", "kind", "key").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("chars", "total")], F.max("up").alias("up"))
    counts = materialise(counts.where((F.col("kind") == PAGE) | (F.col("n") >= LEAST_PAGES)), "subtree_counts")
    pages = counts.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    kind, n, share = F.col("kind"), F.col("n"), F.col("n") / F.col("pages")
    part = F.when(F.col("total") > 0, F.col("chars") / F.col("total")).otherwise(F.lit(0.0))
    often = (n >= MANY_PAGES) | (share >= LEAST_SHARE)
    in_article = (n >= MANY_PAGES) & ((kind == INSIDE_BOX) | (share >= ARTICLE_SHARE))
    rated = counts.where(kind != PAGE).join(pages.hint("merge"), "host").withColumn("main", (kind == SHELL) & (part >= MAIN_PART))
    chosen = materialise(rated.where(F.col("main") | F.when(kind == SHELL, often & (part < SMALL_PART)).when(kind == OUTSIDE, often).otherwise(in_article)).select("host", "kind", "key", "up", "main"), "template_subtrees")
    outer = chosen.where("main").select("host", F.col("up").alias("key"), F.lit(True).alias("main")).distinct()  # only the innermost holds the articles
    return materialise(chosen.join(outer, ["host", "key", "main"], "left_anti").select("host", "kind", "key", "main"), "template")


def templates(features: DataFrame, template: DataFrame) -> DataFrame:
    """host, page (hash of its html), and the page's part of the host's template as four arrays, those of
    Template: a row for each different page of a host that holds any."""
    held = features.where(F.col("kind") != PAGE).join(template.hint("merge"), ["host", "kind", "key"])
    kind, main = F.col("kind"), F.col("main")
    sets = {"outside": kind == OUTSIDE, "inside": kind.isin(INSIDE, INSIDE_BOX), "shells": (kind == SHELL) & ~main, "main": main}
    return materialise(held.groupBy("host", "page").agg(*[F.collect_set(F.when(x, F.col("key"))).alias(name) for name, x in sets.items()]), "templates")


def by_host(template: DataFrame) -> dict[str, Template]:
    """The template of each host, on the driver; for templates within BROADCAST_KEYS."""
    out: dict[str, dict[str, set]] = {}
    for r in template.collect():
        name = "main" if r["main"] else {OUTSIDE: "outside", SHELL: "shells"}.get(r["kind"], "inside")
        out.setdefault(r["host"], {}).setdefault(name, set()).add(r["key"])
    return {host: Template(**{k: frozenset(v) for k, v in t.items()}) for host, t in out.items()}


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", rules: bool = True) -> DataFrame:
    """pages with the main text of each row's whole html in column out.

    Null urls share the host ''. Null and empty html give an empty text, as does a page without prose.
    Character references are decoded; white space inside a block is one space; blocks are joined by \\n.
    Repeated rows give equal texts. Other columns may have any names; one named like out is replaced.
    Without rules the template alone decides. No rows: no rows.

    Templates within BROADCAST_KEYS are broadcast; beyond, each page gets the part of its host's
    template that it holds, by shuffle. The texts are the same."""
    template = template_of_hosts(page_features(pages, url, html))
    host, page, part = (fresh(pages, x) for x in ("host", "page", "template"))
    met, shared = pages.withColumn(host, host_of(quoted(url))), None
    if template.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        shared = pages.sparkSession.sparkContext.broadcast(by_host(template))
    else:
        found = templates(page_features(pages, url, html), template)
        found = found.select(F.col("host").alias(host), F.col("page").alias(page), F.struct("outside", "inside", "shells", "main").alias(part))
        met = met.withColumn(page, F.xxhash64(quoted(html))).join(found.hint("merge"), [host, page], "left")

    def start():
        known = shared.value if shared else {}

        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            if shared:
                own = [known.get(h, Template()) for h in batch.column(host).to_pylist()]
            else:
                own = [Template(**{k: frozenset(v) for k, v in t.items()}) if t else Template() for t in batch.column(part).to_pylist()]
            return [pa.array([main_text(x, t, rules) if x else "" for x, t in zip(batch.column(html).to_pylist(), own, strict=True)], pa.string())]

        return make

    done = append_arrow(met, [StructField(out, StringType())], start, html)
    return done.select(*[quoted(c) for c in done.columns if c not in (host, page, part)])
