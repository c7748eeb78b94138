from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from roamframe.llm import html_template as H
from roamframe.llm import matroska as M
from roamframe.llm import url_reputation as U

from .conftest import corpus


# -- matroska


@pytest.mark.parametrize("lacing", [M.NO_LACING, M.XIPH, M.FIXED, M.EBML_LACING])
@pytest.mark.parametrize("size", [1, 191, 192, 5000, 192 * 3000])
def test_round_trip(lacing, size):
    data = bytes((k * 7 + k // 300) % 256 for k in range(size))
    media = M.write_audio(data, laced=1 if lacing == M.NO_LACING else 8, lacing=lacing)
    found, cues = M.packets(media, {1: 24_000_000})
    assert b"".join(media[p.offset : p.offset + p.length] for p in found) == data
    assert [p.timestamp for p in found] == [k * 24_000_000 for k in range(len(found))]
    assert {c.cluster for c in cues} == {p.cluster for p in found}


def test_unequal_frames_by_ebml_and_xiph_lacing():
    frames = [b"a" * n for n in (300, 5, 700, 699, 1, 40000)]
    for kind in (M.XIPH, M.EBML_LACING):
        cluster = M._element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 5) + M._block(3, -2, frames, kind))
        found, _ = M.packets(M._element(M.SEGMENT, cluster))
        assert [(p.track, p.length, p.timestamp) for p in found] == [(3, len(f), 3_000_000) for f in frames]


def test_block_groups_and_unknown_sizes():
    block = M._size(1) + struct.pack(">hB", 0, 0) + b"payload"
    body = M._id(M.CLUSTER) + b"\xff" + M._uint(M.CLUSTER_TIME, 0) + M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block))
    media = M._id(M.SEGMENT) + b"\x01" + b"\xff" * 7 + body + body
    found, _ = M.packets(media)
    assert [media[p.offset : p.offset + p.length] for p in found] == [b"payload", b"payload"]


@pytest.mark.parametrize("media", [b"\x00", M.write_audio(b"x" * 400)[:-30], b"\x1a"])
def test_broken_files_raise(media):
    with pytest.raises(ValueError):
        M.packets(media)


def test_media_query_rows(docs, empty):
    media = M.to_media(docs)
    texts = {r[0]: r[1] for r in corpus()}
    rows = M.media_features(media).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > r["payload_bytes"]
    same = {}
    for r in rows:
        same.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    packets = M.packet_table(media.filter("doc_id = 1"))
    assert packets.agg(F.sum("length")).first()[0] == next(r["payload_bytes"] for r in rows if r["doc_id"] == 1)
    assert M.media_features(M.to_media(empty)).count() == 0


# -- html


def text_of(html: str | None) -> list[str]:
    text, _ = H.page_text(H.parse_page(html), (), (), ())
    return text.split("\n") if text else []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<article><h1>A&nbsp;b</h1><p>one\n  two<p>three<br>four</article><p>out", ["A b", "one two", "three four", "out"]),
        ("<nav>no</nav><main><p>x <b>y</b>z</p><aside>no</aside><form>no</form></main><footer>no</footer>", ["x yz"]),
        ("<body><div class='site-header ad'>no</div><div class='heading'>yes</div><script>var a='<p>no</p>'</script><style>p{}</style>", ["yes"]),
        ("<article><p>a<!-- <p>no --></p><div id=comments>no</div><div class='cookie-notice'>no</div><ul><li>1<li>2</ul></article>", ["a", "1", "2"]),
        ("<article><p>5 &lt; 6 and x < y</p><p title='a > b'>&#8364;&eacute;</p></article>", ["5 < 6 and x < y", "€é"]),
        ("<article><p>text <span class='ad'>no</span>more</p></article>", ["text more"]),
        ("<script>never closed <p>x", []),
        ("</div></p><p>odd</b>", ["odd"]),
    ],
)
def test_blocks(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><meta charset=utf-8><title>no</title><body><p>yes</p></body></html>", ["yes"]),
        ("<head><link rel=x href=y><script>no</script><p>yes</p>", ["yes"]),
        ("<head>\n<meta charset=utf-8>\nyes", ["yes"]),
        ("<head><title>no</title></head><p>yes", ["yes"]),
        ("<p>a</p><svg class=x /><p>b</p><svg><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
        ("<p>a <math/>b</p><object data='x'/><p>c</p>", ["a b", "c"]),
        ("<p>a</p><video src=x><p>b</p><video src=y><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><video><p>no</p></VIDEO ><p>b</p>", ["a", "b"]),
        ("<video-player id=v></video-player><p>a</p><select-box><p>b</p></select-box><title-bar>c</title-bar>", ["a", "b", "c"]),
    ],
)
def test_open_heads_and_embedded_elements_hide_no_text(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<article style="overflow:hidden"><p>kept</p></article>', ["kept"]),
        ('<p data-hidden="no">kept</p><p hidden>no</p><p aria-hidden="true">no</p>', ["kept"]),
        ('<p>A <span class="ad"><b>x</span> kept text</p>', ["A kept text"]),
        ("<p>a</p><math><mi>x</mi></math><figure><img src=x><figcaption>seen here</figcaption></figure>", ["a", "x", "seen here"]),
        ('<section class="related work"><p>kept</p></section>', ["kept"]),
        ('<div class="has-sidebar"><div class=menu>no</div><article class="post comments-open"><p>kept</p></article></div>', ["kept"]),
        ('<div id="comments"><article class="comment"><p>no</p></article><article><p>no</p></article></div><p>kept', ["kept"]),
        ("<p>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "<p>after", ["deep", "after"]),
        ("<p>" + "long " * 200000, [("long " * 200000).strip()]),
    ],
)
def test_no_article_text_is_lost(html, want):
    assert text_of(html) == want


def plain_main_text(rows: list[tuple]) -> dict:
    """Templates counted with dictionaries."""
    parsed = [(i, U_host(url), H.parse_page(html)) for i, url, html in rows]
    pages, seen = {}, {}
    for _, host, page in parsed:
        whole = tuple(b.text for b in page.blocks)
        pages.setdefault(host, set()).add(whole)
        for digest, _, _ in page.subtrees:
            seen.setdefault((host, digest), set()).add(whole)
    out = {}
    for i, host, page in parsed:
        share = {d: len(seen[host, d]) / len(pages[host]) for d, _, _ in page.subtrees}
        least = 0.05 if any(b.inside for b in page.blocks) else 0.3
        weak = {d for d in share if len(seen[host, d]) >= 4 and share[d] >= least}
        strong = {d for d in share if len(seen[host, d]) >= 12 and share[d] >= 0.6}
        gone = {k for d, a, b in page.subtrees for k in range(a, b) if d in (strong if page.blocks[a].inside and page.blocks[b - 1].inside else weak)}
        out[i] = ("\n".join(b.text for k, b in enumerate(page.blocks) if k not in gone and not b.junk), len(gone))
    return out


def U_host(url: str | None) -> str:
    return url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else ""


@pytest.mark.parametrize("broadcast_templates", [0, 1 << 20])
def test_main_text_against_a_plain_version(spark, broadcast_templates):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        h = min(rng.randrange(1, 6), rng.randrange(1, 6))
        menu = "".join(f"<li>entry {h} {j}</li>" for j in range(rng.choice([4, 4, 4, 5])))
        own = "".join(f"<p>story {k} part {j}</p>" for j in range(rng.randrange(4)))
        tail = rng.choice(["<div><p>All rights kept</p></div>", "<footer>the end</footer>", ""])
        notice = f"<p>Notice {rng.randrange(3)}</p>"
        rows.append((k, rng.choice([f"http://H{h}.example/x/{k}", f"http://h{h}.example?{k}"]) if k % 50 else None, f"<div><ul>{menu}</ul></div>" + rng.choice([f"<article>{own}{notice}</article>", f"<div>{own}</div>{notice}"]) + tail))
    want = {i: v for i, v in plain_main_text([(i, u.replace("?", "/?") if u else u, x) for i, u, x in rows]).items()}
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), broadcast_templates)
    assert {r["page_id"]: (r["text"], r["n_template"]) for r in got.collect()} == want
    assert sum(n for _, n in want.values()) > 400


def test_site_templates_go_and_articles_stay(spark):
    rows = []
    for k in range(40):
        body = f"<p>story {k} " + " ".join(f"w{k}x{j}" for j in range(20)) + "</p>"
        rows.append((k, f"http://a.example/{k}", f"<div><p>Welcome to our site</p></div><div>{body}</div><div><p>All rights kept</p></div>"))
        rows.append((100 + k, f"http://b.example/{k}", f"<article>{body}<p>Read this first</p></article>"))
    rows += [(200 + k, "http://c.example/x", "<div><p>copy of one page</p><p>told twice</p></div>") for k in range(30)]
    got = {r["page_id"]: r for r in H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(40):
        assert got[k]["text"].startswith(f"story {k} ") and "\n" not in got[k]["text"] and got[k]["n_template"] == 2
        assert got[100 + k]["text"].startswith(f"story {k} ") and "Read this" not in got[100 + k]["text"]
    # copies of one page are no evidence of a template
    assert got[200]["text"] == "copy of one page\ntold twice" and got[200]["n_chars"] == 27


def test_pages_that_share_most_blocks_stay_distinct_evidence(spark):
    """8 shared and 4 own blocks a page: every page counts, though most have a shared block as their least."""
    shared = [f"<div><p>site part {j}</p></div>" for j in range(8)]
    rows = []
    for h in range(30):
        for k in range(20):
            own = [f"<div><p>text {h} {k} {j}</p></div>" for j in range(4)]
            rows.append((h * 100 + k, f"http://h{h}.example/{k}", "".join(shared[:4] + own + shared[4:]).replace("site", f"site {h}")))
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    wrong = {r["page_id"] // 100 for r in got if r["text"] != "\n".join(f"text {r['page_id'] // 100} {r['page_id'] % 100} {j}" for j in range(4))}
    assert len(got) == 600 and not wrong


def test_text_beside_an_article_goes_by_the_counts_only(spark):
    def page(k: int) -> str:
        return f"<div><p>Welcome to our site</p></div><h1>heading {k}</h1><div><p>body {k} first</p><p>body {k} last</p></div><article><p>card {k}</p></article>"

    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(20)]
    rows += [(100, "http://b.example/", "<h1>beside</h1><main><p>within</p></main>")]
    got = {r["page_id"]: r for r in H.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(20):
        assert got[k]["text"] == f"heading {k}\nbody {k} first\nbody {k} last\ncard {k}" and got[k]["n_template"] == 1
    assert got[100]["text"] == "beside\nwithin"


def test_pages_edge_cases(spark):
    schema = "page_id bigint, url string, html string, host string, blocks int, sketch int"
    rows = [(1, None, "<p>x", "h", 1, 1), (1, None, "<p>x", "h", 1, 1), (None, "no scheme", None, None, None, None), (2, "http://h/", "", "h", 1, 1)]
    got = H.extract_main_text(spark.createDataFrame(rows, schema))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert H.extract_main_text(spark.createDataFrame([], schema)).count() == 0


# -- urls


RULES = (U.Rule("net", "/", "block"), U.Rule("example.net", "/en/", "allow"), U.Rule("example.com", "/de/", "block"))


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.NET/en/1?x=/", "a.example.net", "/en/1", "example.net/en/"),
        ("http://example.net/fr#/en/", "example.net", "/fr", "net/"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None),
        ("https://x.example.com/de/a", "x.example.com", "/de/a", "example.com/de/"),
        ("http://foo.net", "foo.net", "", None),
        ("http://foo.net?/a", "foo.net", "", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("://É.net/x", "É.net", "/x", "net/"),
        ("", "", "", None),
    ],
)
def test_split_and_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url)], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, bad int")
    r = U.filter_urls(pages, RULES, none).first()
    verdicts = {x.name(): x.verdict for x in RULES}
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdicts.get(rule, "allow"))


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.farm.example", 1)] * 60 + [("bad.farm.example", 0)] * 4 + [("ok.shop.example", 0)] * 80 + [("ok.shop.example", 1)] * 10 + [("tiny.shop.example", 1)] + [("x.news.co.uk", 0)] * 50
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    urls = ["http://bad.farm.example/1", "http://ok.shop.example/1", "http://tiny.shop.example/1", "http://new.shop.example/", "http://y.news.co.uk/", "http://unknown.tld/"]
    got = {r["host"]: r for r in U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), RULES, outcomes).collect()}
    assert got["bad.farm.example"]["verdict"] == "block"
    assert {h for h, r in got.items() if r["verdict"] == "block"} == {"bad.farm.example"}
    # one bad page says little against the domain's record
    assert got["tiny.shop.example"]["bad_bound"] < 0.5


def test_domain_levels(spark):
    rows = [("a.b.co.uk:80",), ("b.example",), ("example",), ("10.0.0.1",), ("",), ("u@h.x.org",), ("dot.example.",)]
    domain, suffix = U.domain_levels(F.col("h"))
    got = spark.createDataFrame(rows, "h string").select(domain.alias("d"), suffix.alias("s")).collect()
    assert [(r["d"], r["s"]) for r in got] == [("b.co.uk", "co.uk"), ("b.example", "example"), ("example", "example"), ("10.0.0.1", ""), ("", ""), ("x.org", "org"), ("dot.example", "example")]


def plain_bounds(outcomes: list[tuple[str, int]], hosts: set[str]) -> tuple[dict, float]:
    """Lower posterior bounds with dictionaries; hosts are of the form x.domain.suffix."""
    overall = (sum(b for _, b in outcomes) + 0.5) / (len(outcomes) + 2)
    levels = [lambda h: h.rsplit(".", 1)[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h]
    above: dict = {"": None}
    post: list[dict] = []
    for k, key in enumerate(levels):
        n, bad, parent = {}, {}, {}
        for h, b in outcomes:
            n[key(h)], bad[key(h)] = n.get(key(h), 0) + 1, bad.get(key(h), 0) + b
            parent[key(h)] = levels[k - 1](h) if k else ""
        table = {}
        for p in set(parent.values()):
            own = [c for c in n if parent[c] == p]
            rate = overall if k == 0 else above[p][0] / sum(above[p])
            even, total = rate * (1 - rate), sum(n[c] for c in own)
            spread = sum(n[c] * (bad[c] / n[c] - rate) ** 2 for c in own) - (len(own) - 1) * even
            between = spread / max(total - sum(n[c] ** 2 for c in own) / total, 1e-9)
            strength = 2.0 if len(own) < 2 else 1000.0 if between <= 0 or even <= 0 else min(max(even / between - 1, 2.0), 1000.0)
            for c in own:
                table[c] = (bad[c] + strength * rate, n[c] - bad[c] + strength * (1 - rate))
        post.append(table)
        above = table
    out = {}
    for h in hosts:
        a, b = next((t[key(h)] for t, key in zip(reversed(post), reversed(levels)) if key(h) in t), (2 * overall, 2 * (1 - overall)))
        out[h] = 1 / (1 + math.exp(1.645 * math.sqrt(1 / a + 1 / b) - math.log(a / b)))
    return out, overall


def test_reputation_against_a_plain_version(spark):
    rng = random.Random(12)
    hosts = [f"h{k}.d{k % 9}.{['com', 'org', 'net'][k % 3]}" for k in range(60)]
    rates = {h: rng.choice([0.05, 0.1, 0.6]) for h in hosts}
    outcomes = [(h, int(rng.random() < rates[h])) for h in hosts[:50] for _ in range(rng.randrange(1, 60))]
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(hosts)], "page_id bigint, url string")
    got = U.filter_urls(pages, [], spark.createDataFrame(outcomes, "host string, bad int")).collect()
    want, overall = plain_bounds(outcomes, set(hosts))
    for r in got:
        assert r["bad_bound"] == pytest.approx(want[r["host"]], abs=2e-6)
        assert r["verdict"] == ("block" if r["bad_bound"] > overall else "allow")
    # hosts are told apart: the bad ones with evidence go, no good one does
    known = {r["host"]: r["verdict"] for r in got if sum(h == r["host"] for h, _ in outcomes) >= 20}
    assert {known[h] for h in known if rates[h] == 0.6} == {"block"} and {known[h] for h in known if rates[h] < 0.6} == {"allow"}


def test_urls_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, host string, rule string")
    assert U.filter_urls(pages, RULES, spark.createDataFrame([], "host string, bad int")).count() == 0
