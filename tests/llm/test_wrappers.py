import random
import re
from collections import Counter

from deskwise.llm import wrappers
from deskwise.llm.wrappers import extract, main_texts, parse, wrap

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header>Site</header>
<div id="cookie-notice">We use cookies</div><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="layout"><div class="post-content"><h2>T &eacute;&#8217; <i>x</i></h2><p>One<br>two  three<ul><li>a<li>b</ul>
<form>mail <input></form><blockquote>q &amp;lt;</blockquote></div><div class="sidebar">side</div><div id="comments"><p>nice</p></div></div>
<footer>&copy; f</footer>"""
MAIN = "T é’ x\n\nOne two three\n\na\n\nb\n\nq &lt;"


def test_single_pages():
    assert extract(PAGE, None) == MAIN
    assert extract(None, None) == extract("", None) == extract("<p", None) == ""
    assert extract("plain text & more", None) == "plain text & more"
    assert extract("<div>" * 3000 + "deep text" + "</div>" * 3000, None) == "deep text"
    assert extract("<article><p>a<p>b</article><p>outside", None) == "a\n\nb"


def test_class_words_and_styles_do_not_discard_the_text():
    text = "<p>A line of running text.</p><p>Another line of it.</p>"
    whole = "A line of running text.\n\nAnother line of it."
    for name in ("right-sidebar", "has-sidebar", "post with-sidebar", "comments-open", "hidden-xs no-ads"):
        for tag in ("body", "main", "article", "div", "section"):
            assert extract(f'<html class="{name}"><{tag} class="{name}">{text}</{tag}>', None) == whole, (tag, name)
        assert extract(f'<div class="x {name}"><h1>T</h1><article>{text}</article></div><div>Legal</div>', None) == whole, name
    for attribute in ('style="overflow:hidden"', "style=visibility:hidden", 'data-hidden title="role=menu"', 'aria-hidden="false"', 'data-class="ad"'):
        assert extract(f"<body><article {attribute}>{text}</article>", None) == extract(f"<div><div {attribute}>{text}</div>", None) == whole, attribute
    for attribute in ("hidden", 'hidden="until-found"', "HIDDEN=''", 'aria-hidden="true"', 'role="navigation"', "class=sidebar", "id='comments'"):
        assert extract(f"<div>{text}</div><div {attribute}><p>Not this.</p></div>", None) == whole, attribute
    assert extract(f"<article hidden>{text}</article>", None) == ""
    talk = "<p>A long comment.</p>" * 20
    for page in (f"<div>{text}</div><div id=comments>{talk}</div>", f"<article>{text}<article class=comment>{talk}</article></article>"):
        assert extract(page, None) == whole, page


def test_depth_changes_nothing(spark):
    for deep in (3, 149, 200, 20_000):
        nest = "<div>text" * deep + "</div>" * deep
        inside = "\n\n".join(["text"] * deep)
        assert extract(f"<div class=x><article>{nest}<p>after</p></article></div><p>outside", None) == f"{inside}\n\nafter"
        for other in ("<nav>Menu</nav>", "<aside>Side</aside>", "<form>Mail</form>", "<div class=comments>Nice</div>"):
            assert extract("<article>" + "<div>" * deep + f"<p>one</p>{other}<p>two", None) == "one\n\ntwo", (deep, other)
        assert extract("<div>" * deep + "lead<article>main text</article>", None) == "main text"
        merged = wrap(parse(f"<div>{nest}"))
        for more in (f"<div>{nest}<p>x", f"<div>{nest}{nest}"):
            merged = wrappers._same_part(merged, wrap(parse(more)))
        assert wrappers._load(wrappers._dump(merged)).dump() == merged.dump()
    unclosed = [(k, "http://h.org", "<html><body>" + "<div>" * 400 + f"<nav>Menu</nav><article><p>{k} text") for k in range(6)]
    table = spark.createDataFrame(unclosed, "page_id long, url string, html string")
    assert {r.text for r in main_texts(table, wrappers.infer_wrappers(table)).collect()} == {f"{k} text" for k in range(6)}


def test_class_words_differ_between_pages_of_a_host(spark):
    text = "<p>{0} running text of a page</p><p>{0} and more of it</p>"
    bodies = ["<body class='home right-sidebar'><div class='with-sidebar'>{0}</div>", "<body><div class='with-sidebar'>{0}</div><div class=sidebar>s</div>"]
    table = spark.createDataFrame([(k, "http://h.org", bodies[k % 2].format(text.format(k))) for k in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_texts(table, wrappers.infer_wrappers(table)).collect()}
    assert got == {k: f"{k} running text of a page\n\n{k} and more of it" for k in range(12)}


def test_alignment_makes_optional_and_repeated_parts():
    one, two = (wrap(parse(x)) for x in ("<h1>a</h1><p>x</p><p>y</p>", "<h1>a</h1><table></table><p>z</p>"))
    merged = wrappers._same_part(one, two)
    assert [(p.sig, p.optional, p.repeated) for p in merged.kids] == [("h1", False, False), ("table", True, False), ("p", False, True)]
    assert merged.kids[0].kids[0].same is not None and merged.kids[2].kids[0].same is None
    pairs = wrap(parse("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"))
    assert [(p.sig, p.repeated) for p in pairs.kids[0].kids] == [("dt", True), ("dd", True)]


def test_common_subsequence_is_a_longest_one():
    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    rng = random.Random(5)
    for k in range(1500):
        a, b = (rng.choices("abcdefghij"[: 1 + k % 10] + end, k=rng.randint(0, 30)) for end in "xy")
        pairs = wrappers._common(a, b)
        assert len(pairs) == brute(a, b) and all(a[i] == b[j] for i, j in pairs) and wrappers._common(a, b, room=0) == pairs
        assert all(i < x and j < y for (i, j), (x, y) in zip(pairs, pairs[1:]))
    base = [str(rng.randrange(9)) for _ in range(12_000)]
    assert len(wrappers._common(["hr", *base], [*base, "hr"])) == len(base)


def test_long_pages_align_as_short_ones():
    rng = random.Random(6)
    for n in (50, 1800):
        names = rng.choices(["one", "two", "three", "four", "five", "six", "seven"], k=n)
        pages = []
        for k in range(6):
            blocks = "".join(f"<div class={name}>{k} text {at} of its own</div>" for at, name in enumerate(names))
            line = "<div class=line>The line of all pages</div>"
            pages.append(f"<hr>{blocks}{line}" if k % 2 else f"{blocks}{line}<hr>")
        merged = wrap(parse(pages[0]))
        for page in pages[1:]:
            merged = wrappers._same_part(merged, wrap(parse(page)))
        assert len(merged.kids) <= len(wrap(parse(pages[0])).kids) + 1
        for page in pages:
            assert "The line of all pages" not in extract(page, merged)


def test_pages_of_a_host(spark, empty):
    body = "<div class=top>Shared line of all pages</div><div class=x><p>{0} first of many words here</p><p>{0} second</p></div><div class=low>Shared end</div>"
    pages = [(k, f"http://h.org/{k}", f"<html><body>{body.format(k)}") for k in range(8)]
    pages += [(100, None, PAGE), (101, "http://h.org/x", None), (102, "HTTPS://Other.org?x", PAGE), (103, "", ""), (0, *pages[0][1:])]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    found = wrappers.infer_wrappers(table, held_wrappers=1)
    for limit in (32 << 20, -1):  # by broadcast and by join
        got = [tuple(r) for r in main_texts(table, found, broadcast_bytes=limit).collect()]
        texts = {i: t for i, _, t, _ in got}
        assert len(got) == len(pages) and all(n == len(t) for _, _, t, n in got)
        assert texts[3] == "3 first of many words here\n\n3 second" and texts[100] == texts[102] == MAIN and texts[101] == texts[103] == ""
    none = table.limit(0)
    assert main_texts(none, wrappers.infer_wrappers(none)).count() == 0


def test_given_pages_lose_nothing(spark, sf):
    import html
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:h1|p)>", inner)]
        return "\n\n".join(filter(None, parts))

    pages = sf("pages")
    got = {r.page_id: r.text for r in main_texts(pages, wrappers.infer_wrappers(pages)).collect()}
    assert got == {r.page_id: article(r.html) for r in pages.collect()}


def test_slots_decide_where_no_element_names_the_text(spark):
    """The given pages with every landmark element renamed and every class, id and role taken away."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = [
        (r.page_id, r.url, re.sub(r"(<\w+[^>]*?)\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", r"\1", re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b[^>]*>", r"<\1div>", r.html, flags=re.I)))
        for r in pages.collect()
    ]
    table = spark.createDataFrame(plain, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in main_texts(table, wrappers.infer_wrappers(table)).collect()}
    whole = {r.page_id: r.text for r in main_texts(pages, wrappers.infer_wrappers(pages)).collect()}
    hosts = Counter(wrappers._host(url) for _, url, _ in plain)
    known = [i for i, url, _ in plain if hosts[wrappers._host(url)] >= 4]
    assert len(known) > 150 and sum(found[i] == whole[i] for i in known) >= 0.95 * len(known)


def test_wrappers_do_not_depend_on_the_order_of_pages(spark):
    """Pages without any element or word that names their parts, in three orders, over 1, 4 and 211 partitions."""
    rng = random.Random(9)
    rows = []
    for host in range(6):
        for k in range(14):
            body = "".join(f"<div><p>{host} {k} line {i} of running text</p></div>" for i in range(rng.randrange(1, 5)))
            extra = "".join(rng.choice(["<hr>", "<section><b>x</b></section>", "<table><tr><td>1</td></tr></table>", "<dl><dt>a<dd>b</dl>"]) for _ in range(rng.randrange(4)))
            rows.append((host * 100 + k, f"http://h{host}.org/{k}", f"<body><div>Site {host}</div><div>{extra}</div><div>{body}</div>{extra}<div>End</div>"))
    schema, seen = "page_id long, url string, html string", set()
    for seed, partitions, group, held in ((0, 1, 256, 4096), (1, 4, 256, 3), (2, 211, 256, 1)):
        random.Random(seed).shuffle(rows)
        table = spark.createDataFrame(rows, schema).repartition(partitions)
        found = wrappers.infer_wrappers(table, group=group, held_wrappers=held).collect()
        assert len(found) == 6
        seen.add(tuple(sorted(map(tuple, found))))
    assert len(seen) == 1
    for partitions in (1, 4):  # and with a tree of several levels
        found = wrappers.infer_wrappers(spark.createDataFrame(rows, schema).repartition(partitions), group=1).collect()
        seen.add(tuple(sorted(map(tuple, found))))
    assert len(seen) == 2 and len(found) == 6
