import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronoframe.llm.html import extract_main_text, main_text
from chronoframe.llm.licenses import BASE, NOTICES, Index, scan_licenses, templates
from chronoframe.llm.urls import RULES, filter_urls

TEXTS = [
    "Foo.\nLicensed under CC BY-NC 4.0", "ALL RIGHTS RESERVED. all rights reserved", "the GNU General Public License, version 3. general general public license", None, "", "cc", "by cc by cc by",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "nothing here éà all rights\u212areserved " * 50, "rights reserved all rights reserved", "Released under the MIT License.",
]


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_license_base_is_complete(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[1], "x")], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
        at = [(k, label) for phrase, label in BASE.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(sorted({x for _, x in at}))), t
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[10]["labels"] == "mit" and got[7]["labels"] == "mit" and got[0]["labels"] == "cc-by,cc-by-nc-4.0" and got[2]["labels"] == "gpl,gpl-3.0"
    assert got[None]["n_base"] == 2
    assert scan_licenses(df.limit(0)).count() == 0


def test_license_labels_equal_brute_force():
    """Every template at every start whose mandatory phrases stand in place, with its weight's share."""
    made, rng = templates(), random.Random(5)
    vocabulary = sorted({w for x in made for w in x.words})
    index = Index(made, {w: rng.random() for w in vocabulary})
    for case in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):  # whole templates, or with a word changed
            x = list(rng.choice(made).words)
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = b"changed"
            at = rng.randint(0, len(words))
            words[at:at] = x
        want = set()
        for t, x in enumerate(made):
            for start in range(-len(x.words), len(words)):
                if all(start + o >= 0 and tuple(words[start + o : start + o + len(k)]) == k for o, k in x.keys):
                    want.add((t, start))
        assert [f[:2] for f in index.scan(words)] == sorted(want), case


def test_license_whole_texts(spark):
    rows = [(i, "Copyright 2020 X. " + text.capitalize() + ".") for i, (_, text, _) in enumerate(NOTICES)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(NOTICES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == pytest.approx(1.0)


def test_license_long_text(spark):
    text = ("filler " * 200_000) + "all rights reserved " + ("cc by " * 1000)
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (202_003, 1001, 200_000, 202_001)


def _rule(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = _lower(host)
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, *rule


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1", "https://example.net/fr/2?x=/en/", "http://example.com/de/", "http://xexample.com/de/1", "http://b.org/fr/9#t", "http://b.org/frx", "http://net", "ftp://net?x", "no host", None, "", "x://HÖST.org/fr/é"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for r in filter_urls(df).collect():
        host, path, rule, verdict = _rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert filter_urls(df.limit(0)).count() == 0


def test_url_tree_generalises(spark):
    rows = [(i, f"http://s.test/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}/x") for i in range(200)] + [(1000 + i, f"http://s.test/news/{i}") for i in range(50)]
    labels = [(u, "block" if "/tag/" in u else "allow") for i, u in rows if i % 3 == 0]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "url string, label string")).collect()
    assert {(r["template"], r["verdict"]) for r in got} == {("/tag/*/x", "block"), ("/news/<n>", "allow")}


def test_url_tree_merges_similar(spark):
    rows = [(i, f"http://s.test/{d}/page-{i}") for i, d in enumerate(["a", "b"] * 60)]
    labels = [(u, "block" if i % 9 else "allow") for i, u in rows]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "url string, label string")).collect()
    assert {(r["template"], r["verdict"]) for r in got} == {("/+/page-<n>", "block")}


def _tree(known, levels=4, fan_out=20, thin=5.0, z=1.96, prior=0.5, strength=2.0, min_labels=5, min_hosts=3, purity=0.8):
    """Brute force of the tree over (host, shape, label): (host, shape) -> template, share, rejected."""
    leaves = {}
    for host, path, label in known:
        x = leaves.setdefault((host, path), {"n": 0, "bad": 0, "lab": 0, "left": path.split("/")[1:], "done": ""})
        x["n"] += 1
        x["bad"] += label == "block"
        x["lab"] += label is not None
    for _ in range(levels):
        parents = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (host, _), x in leaves.items():
            if x["left"]:
                b = parents[host, x["done"]][x["left"][0]]
                for i, k in enumerate(("n", "bad", "lab")):
                    b[i] += x[k]
        chosen = {}
        for parent, branches in parents.items():
            n, bad, lab = (sum(b[i] for b in branches.values()) for i in range(3))
            for segment, (_, b_bad, b_lab) in branches.items():
                near = lab and b_lab and sum(b[2] > 0 for b in branches.values()) > 1 and abs(b_bad - b_lab * bad / lab) <= z * (b_lab * bad / lab * (1 - bad / lab)) ** 0.5
                chosen[parent, segment] = "*" if len(branches) >= fan_out and n < thin * len(branches) else "+" if near else segment
        for (host, _), x in leaves.items():
            if x["left"]:
                x["done"] += "/" + chosen[(host, x["done"]), x["left"].pop(0)]
    own, pooled = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0, 0])
    for (host, path), x in leaves.items():
        x["template"] = "/".join([x["done"], *x["left"]])
        for i, v in enumerate((x["bad"], x["lab"])):
            own[host, x["template"]][i] += v
        for i, v in enumerate((x["bad"], x["lab"], x["lab"] > 0)):
            pooled[path][i] += v
    out = {}
    for (host, path), x in leaves.items():
        (bad, lab), (p_bad, p_lab, hosts) = own[host, x["template"]], pooled[path]
        share = (bad + strength * (p_bad + strength * prior) / (p_lab + strength)) / (lab + strength)
        out[host, path] = x["template"], share, (lab >= min_labels or p_lab >= min_labels and hosts >= min_hosts) and share >= purity
    return out


def test_url_tree_equals_brute_force(spark):
    rng = random.Random(9)
    urls = []
    for i in range(1500):
        host = rng.choice(["big.test"] * 6 + [f"h{k}.test" for k in range(6)])
        first = rng.choice(["tag", "shop", "news", "a", "b"])
        rest = rng.choice([f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", "x", f"id-{i}", ""])
        urls.append((host, f"/{first}/{rest}" + rng.choice(["", "/deep/er/and/more"])))
    rates = {"tag": 0.95, "shop": 0.9, "news": 0.05, "a": 0.5, "b": 0.5}
    labels = [(f"http://{h}{p}", "block" if rng.random() < rates[p.split("/")[1]] else "allow") for h, p in urls if h != "h0.test" and rng.random() < 0.4]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = filter_urls(df, rules=[], labels=spark.createDataFrame(labels, "url string, label string")).collect()
    generalised = lambda p: re.sub("[0-9]+", "<n>", p)
    known = [(h, generalised(p), None) for h, p in urls] + [(u[7:].split("/", 1)[0], generalised("/" + u[7:].split("/", 1)[1]), x) for u, x in labels]
    want = _tree(known)
    for r in got:
        template, share, rejected = want[r["host"], generalised(r["path"])]
        assert (r["template"], r["verdict"]) == (template, "block" if rejected else "allow") and r["share"] == pytest.approx(share)
    assert {r["verdict"] for r in got if r["host"] == "h0.test"} == {"allow", "block"}  # a host without labels is judged by the others


def test_url_without_rule_is_judged_by_other_hosts(spark):
    """Rules alone label the urls; a section that every labelled host has blocked is blocked elsewhere too."""
    rules = [("block", f"h{i}.test", "/ads/") for i in range(4)] + [("allow", f"h{i}.test", "/doc/") for i in range(4)]
    rows = [(100 * i + j, f"http://h{i}.test/{d}/{j}") for i in range(5) for j in range(10) for d in ("ads", "doc")]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect()
    assert {(r["rule"], r["path"][1:4], r["verdict"]) for r in got if r["host"] == "h4.test"} == {(None, "ads", "block"), (None, "doc", "allow")}


def test_url_literal_wildcards_are_no_templates(spark):
    rows = [(i, f"http://s.test/{d}/q") for i, d in enumerate(["a", "b"] * 20)] + [(90 + i, f"http://s.test/{d}/q") for i, d in enumerate("+*")]
    labels = [(u, "block") for i, u in rows if i < 90]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "url string, label string")).collect()
    assert {r["verdict"] for r in got if r["page_id"] >= 90} == {"allow"} and {r["verdict"] for r in got if r["page_id"] < 90} == {"block"}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy &amp; save on this very long advert text that goes on and on and on for quite some time indeed.</div><article><h1>Title &eacute;</h1><p>One<br>two  three
 four &lt;b&gt;.<p>Hm.</p><aside>Related things</aside><p>Last &#8212; one.</p><div id="comments"><p>First!</p></div></article><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


def test_html_article():
    assert main_text(PAGE) == "Title é\n\nOne two three four <b>.\n\nHm.\n\nLast — one."


@pytest.mark.parametrize("html", ["", "<", "<p", "<!--", "<script>x", "plain", "<article></article>", "<div class=\"ad\">" + "x" * 200, "&am", "</p></p>"])
def test_html_odd(html):
    assert isinstance(main_text(html), str)


def test_html_without_article():
    body = "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(4))
    menu = "<ul>" + "<li><a href=x>Menu item of some length</a></li>" * 6 + "</ul>"
    text = main_text(f"<body>{menu}<div>Short</div><nav>x</nav>{body}<p>Ok.</p><footer>f</footer></body>")
    assert text.startswith("word") and text.endswith("Ok.") and "Menu" not in text and "Short" not in text
    assert main_text("<p>tiny</p>") == ""


@pytest.mark.parametrize("apart", ["<p class=notice>Gone", "<ul><li class=related>Gone<li>Kept item</ul>", "<p>Kept item<span class=ad>Gone", "<div><div class=ad>Gone<div>Gone</div></div></div>", "<section><div class=ad>Gone<p>Gone</section>", "<dl><dd class=share>Gone<dt>Kept item</dl>", "<table><tr><td class=promo>Gone<td>Kept item<tr class=ad><td>Gone</table>"])
def test_html_optional_end_tags(apart):
    text = main_text(f"<body><article><h1>Title</h1>{apart}<p>First.<p>Last.</article><p>Outside</p></body>")
    kept = ["Kept item"] if "Kept" in apart else []
    assert text.split("\n\n") == ["Title", *kept, "First.", "Last."]


def test_html_unclosed_container_ends_with_its_parent():
    page = "<body><main><div>One<div class=ad>Gone<ul><li>Gone</div></div><article>Two<div class=ad>Gone</article><p>Three</main></body>"
    assert main_text(page) == "One\n\nTwo\n\nThree"
    nested = "<article><div><div><p class=notice>Gone</div><div class=ad>Gone<p>Gone</div>Kept</div>Last</article>"
    assert main_text(nested) == "Kept\n\nLast"


def test_html_without_article_keeps_short_and_linked_blocks():
    menu = "<ul>" + "<li><a href=x>Menu item of some length</a></li>" * 6 + "</ul>"
    links = "".join(f"<p><a href=x>Source number {i} of the article</a></p>" for i in range(5))
    long = f"<p>{'word ' * 20}</p>"
    page = f"<body><nav>n</nav>{menu}<div id=story><h1>Title</h1><div class=ad>Buy</div>{long}{links}<p>Hm.</p><aside>Gone</aside>{long}<div class=share>Gone</div><p>End.</p></div><footer>f</footer></body>"
    want = ["Title", ("word " * 20).strip(), *(f"Source number {i} of the article" for i in range(5)), "Hm.", ("word " * 20).strip(), "End."]
    assert main_text(page).split("\n\n") == want
    short = f"<body><div><h1>Title</h1><div class=ad>Buy</div><p>{'word ' * 9}</p><aside>Gone</aside><p>{'word ' * 9}</p></div></body>"
    assert main_text(short).startswith("Title") and main_text(short).count("word") == 18


def test_html_surge_and_window_decide():
    assert main_text(PAGE, surge=10**9) == ""  # inside a marked article, too
    block = lambda c, n: f"<p>{c * n}</p>"
    page = f"<body>{block('a', 30)}{block('b', 30)}<nav>x</nav>{block('c', 50)}<p></p>{block('d', 50)}</body>"
    assert main_text(page) == "c" * 50 + "\n\n" + "d" * 50
    assert main_text(page, window=1) == "" and main_text(page, surge=55).startswith("aaa")


@pytest.mark.parametrize("part", ['<a "', "<a '", "<!", "<!--", "<p", "<", "<script>", "<svg", "</script", "<a b='\"", "&amp", "<div class=ad>", "<p>"])
def test_html_scan_is_linear(part):
    def seconds(n):
        start = time.process_time()
        main_text(part * n)
        main_text(part * n + ">" + "tail " * n)
        return time.process_time() - start

    assert seconds(40_000) < 12 * seconds(10_000) + 0.2


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 1)], "page_id long, url string, html string, n_chars int")
    got = Counter((r["page_id"], r["url"], r["n_chars"]) for r in extract_main_text(df).collect())
    assert got == {(1, "u", len(main_text(PAGE))): 2, (2, None, 0): 1}
    assert extract_main_text(df.limit(0)).count() == 0


def test_html_of_fixture(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    for r in rows:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert main_text(r["html"]) == "\n\n".join(filter(None, blocks))
    assert F is not None
