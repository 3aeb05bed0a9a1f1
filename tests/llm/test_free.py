"""Quality classifier, license scan, decontamination, HTML extraction, WARC
derivatives: against brute force, held-out accuracy and round trips."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialake.llm import decontaminate, html, licenses, quality, warc

SF001 = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string"


# ---- quality ----

def test_statistics_edges():
    for t in (None, "", " \n\t ", "x", "é" * 10, "w " * 50_000, "\x00\x01", "A" * 300_000):
        s = quality.statistics(t)
        assert s.shape == (len(quality.NAMES),) and np.isfinite(s).all() and (0 <= s).all() and (s <= 1).all()
    assert quality.basis(np.zeros((0, len(quality.NAMES)))).shape[0] == 0


def test_solve_minimises_the_non_negative_risk():
    rnd = np.random.default_rng(3)
    pos, neg = rnd.normal(1, 1, (300, 3)), rnd.normal(-1, 1, (700, 3))
    p, u = (np.c_[np.ones(len(x)), x] for x in (pos, np.r_[rnd.normal(1, 1, (300, 3)), neg]))
    m = {"AP": p.T @ p / len(p), "bP": p.mean(0), "AU": u.T @ u / len(u), "bU": u.mean(0)}

    def risk(w, prior):
        fp, fu = p @ w, u @ w
        return prior * ((fp - 1) ** 2).mean() / 4 + max(0, ((fu + 1) ** 2).mean() / 4 - prior * ((fp + 1) ** 2).mean() / 4)

    for prior in (0.3, 0.6, 0.95):
        w = quality.solve(m, prior, 1e-9)
        best = risk(w, prior)
        assert all(risk(w + rnd.normal(0, s, 4), prior) >= best - 1e-6 for s in (0.01, 0.1, 1) for _ in range(200))


def test_prior_from_bins():
    rnd = np.random.default_rng(5)
    p, n = rnd.normal(70, 8, 4000), rnd.normal(30, 8, 6000)
    bins = lambda x: np.bincount(np.clip(x.astype(int), 0, 99), minlength=100)
    assert abs(quality.prior_from_bins(bins(p), bins(np.r_[rnd.normal(70, 8, 4000), n])) - 0.4) < 0.05


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    seen = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == q for r, q in seen) >= 0.9 * len(seen)
    # held-out labels have no influence
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in got.items())


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    df = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "some text", "b")], "doc_id bigint, text string, stats string")
    got = quality.score_quality(df, empty).collect()
    assert [r["score"] for r in got] == [0.5] * 3 and {r["predicted"] for r in got} == {1}
    assert quality.keep_quality(df, empty).columns == df.columns
    assert quality.score_quality(df.limit(0), empty).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (3, 1), (3, 0)], "doc_id bigint, quality int")
    assert {r["pid"] for r in quality.trusted_positives(labels).collect()} <= {1}


# ---- licenses ----

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_patience_is_a_common_subsequence():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = ([rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and len(got) <= lcs(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert len(licenses.patience(a, a)) == len(a)


def test_scan_finds_edited_license_in_long_text(spark):
    rnd = random.Random(7)
    filler = [rnd.choice(["the", "software", "is", "to", "of", "and", "license", "copy", "x1", "x2"]) for _ in range(20_000)]
    mit = licenses.words(licenses.TEMPLATES["MIT-text"])
    edited = [w for i, w in enumerate(mit) if i not in (5, 30, 60)]
    edited[20] = "changed"
    texts = {1: " ".join(filler[:9000] + edited + filler[9000:]), 2: " ".join(filler), 3: None, 4: "",
             5: "Foo. Released under the MIT   License!\nReleased under the MIT License.", 6: "released under the BSD license",
             7: " ".join(mit[:60])}
    df = spark.createDataFrame(list(texts.items()), DOC)
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(df).collect()}
    assert set(got) == {(1, "MIT-text"), (5, "MIT")}
    r = got[(1, "MIT-text")]
    assert abs(r["coverage"] - (len(mit) - 4) / len(mit)) < 0.02 and abs(r["first_word"] - 9000) <= 1
    assert (got[(5, "MIT")]["first_word"], got[(5, "MIT")]["last_word"]) == (1, 5)


def test_scan_equals_exhaustive_windows():
    """Every stretch of template length, aligned as a whole: same verdicts."""
    rnd = random.Random(8)
    template = "alpha beta gamma delta eps zeta eta theta iota kappa"
    scanner = licenses.Scanner({"t": template}, 0.8)
    t = licenses.words(template)
    for _ in range(200):
        x = [rnd.choice(t + ["o1", "o2", "o3"]) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.7:
            copy = [w if rnd.random() > 0.1 else "o9" for w in t]
            at = rnd.randint(0, len(x))
            x[at:at] = copy
        exact = any(sum(a == b for a, b in zip(t, x[i:i + len(t)])) >= 8 for i in range(len(x)))
        found = bool(scanner.scan(" ".join(x)))
        assert found or not exact
        if found:
            assert lcs(t, x) >= 8


def test_scan_edges(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "z")] * 2, DOC + ", license string")
    assert licenses.scan_licenses(df).count() == 2
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert licenses.scan_licenses(df, {}).count() == 0 and licenses.scan_licenses(df, {"e": " ! "}).count() == 0


def found(text):
    return [r[0] for r in licenses.Scanner(licenses.TEMPLATES).scan(text)]


def test_relatives_of_a_license_are_told_apart():
    line = "This work is licensed under the GNU %s, version %s. Ask us."
    assert found(line % ("General Public License", 2)) == ["GPL-2.0"]
    assert found(line % ("General Public License", 3)) == ["GPL-3.0"]
    assert found(line % ("General Public License", 9)) == []
    assert found("this work is licensed under the gnu general public license version 2 3 more") == ["GPL-2.0"]
    assert found(line % ("Lesser General Public License", "2.1")) == ["LGPL-2.1"]
    assert found(line % ("Affero General Public License", 3)) == ["AGPL-3.0"]
    cc = "x. This work is licensed under a Creative Commons %s License. y"
    assert found(cc % "Attribution 4.0 International") == ["CC-BY-4.0"]
    assert found(cc % "Attribution-ShareAlike 4.0 International") == ["CC-BY-SA-4.0"]
    assert found(cc % "Attribution 3.0 Unported") == ["CC-BY-3.0-notice"]
    assert found(cc % "Attribution-NoDerivatives 4.0 International") == ["CC-BY-ND-4.0-notice"]
    assert found("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and found("Licensed under CC BY 4.0.") == ["CC-BY-4.0-tag"]
    assert found("All rights reserved.") == ["All-rights-reserved"]
    # a text that has both notices has both licenses
    assert found(line % ("General Public License", 2) + cc % "Attribution 4.0 International") == ["CC-BY-4.0", "GPL-2.0"]


def test_headers_and_whole_texts():
    for name, text in licenses.TEMPLATES.items():
        assert found(f"Copyright 2020 someone\n\n{text}\n\nint main") == [name]
    gpl = licenses.TEMPLATES["GPL-3.0-header"]
    assert found(gpl.replace("version 3 of", "version 2 of").replace("software:", "software;")) == ["GPL-2.0-header"]
    assert found(gpl.replace("GNU General", "GNU Lesser General").replace("program", "library")) == ["LGPL-3.0-header"]
    assert found(gpl.replace("version 3 of", "version 7 of")) == []
    bsd2, bsd3 = (licenses.TEMPLATES[f"BSD-{n}-Clause-text"] for n in (2, 3))
    assert found(f"{bsd3}\n\n{'own words ' * 30}\n\n{bsd2}") == ["BSD-2-Clause-text", "BSD-3-Clause-text"]


def test_names_tags_and_titles():
    assert found("// SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0-spdx"]
    assert found("This software is licensed under the MIT license.") == ["MIT-named"]
    assert found("Licensed under the Apache License 2.0") == ["Apache-2.0-named"]
    assert found("it is licensed under the GPLv3") == ["GPL-3.0-named"]
    assert found("You may use it under the terms of the GNU Lesser General Public License v2.1.") == ["LGPL-2.1-named"]
    assert found("Distributed under the Boost Software License, Version 1.0.") == ["BSL-1.0-named"]
    boost = "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"
    assert found(f"Distributed under the Boost Software License, Version 1.0. {boost}") == ["BSL-1.0-notice"]
    assert found("GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991") == ["GPL-2.0-title"]
    # not a license, or not one of a known version
    for text in ("under the license", "under the GPL", "released under the BSD license", "under the GPL version 9",
                 "ein Text mit License", "SPDX-License-Identifier: unknown", "SPDX-License-Identifier:"):
        assert found(text) == [], text


def test_tag_expressions():
    tag = "SPDX-License-Identifier: "
    assert found(tag + "GPL-2.0-only") == ["GPL-2.0-only-spdx"] and found(tag + "GPL-2.0") == ["GPL-2.0-spdx"]
    assert found(tag + "(MIT OR Apache-2.0)\nint x") == ["Apache-2.0-spdx", "MIT-spdx"]
    text = tag + "GPL-2.0-or-later WITH Classpath-exception-2.0 OR (BSD-3-Clause AND ISC) OR unknown"
    assert found(text) == ["BSD-3-Clause-spdx", "GPL-2.0-or-later-spdx", "ISC-spdx"]
    assert found(tag + "MIT or") == ["MIT-spdx"] and found(tag + "MIT with") == ["MIT-spdx"]
    got = {r[0]: r[1:] for r in licenses.Scanner(licenses.TEMPLATES).scan("a " + tag + "MIT OR Apache-2.0 b")}
    assert got == {"MIT-spdx": (1.0, 1, 4), "Apache-2.0-spdx": (1.0, 6, 8)}


def test_every_wording_names_its_license():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, w, _ in scanner.templates:
        assert [r[0] for r in scanner.scan(f"x {' '.join(w)} y")] == [name], w


# ---- decontamination ----

def edits_in(p, text):
    """Smallest edit distance of p to any part of text, by the full matrix."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_matrix():
    rnd = random.Random(9)
    for _ in range(300):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))) for n in (90, 120))
        assert decontaminate.myers(p, t)[0] == edits_in(p, t)
    assert decontaminate.myers("abc", "") == (3, 0)


def mutate(rnd, p, k):
    s = list(p)
    for _ in range(k):
        if not s:
            break
        i = rnd.randrange(len(s))
        op = rnd.random()
        if op < 0.4:
            s[i] = rnd.choice("xyz")
        elif op < 0.7:
            del s[i]
        else:
            s.insert(i, rnd.choice("xyz"))
    return "".join(s)


def test_contamination_equals_brute_force(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 12, 30])))) for i in range(25)] + [(90, None), (91, " ")]
    docs = []
    for i in range(120):
        t = " ".join(word() for _ in range(rnd.randint(0, 40)))
        if rnd.random() < 0.7:
            p = decontaminate.normalize(rnd.choice(items[:25])[1])
            t += " " + mutate(rnd, p, rnd.randint(0, 2 + int(0.1 * len(p)))).upper().replace(" ", "\n\t") + " " + word()
        docs.append((i, t))
    docs += [(500, None), (501, "")]
    want = set()
    for d, t in docs:
        x = decontaminate.normalize(t)
        for i, p in items:
            p = decontaminate.normalize(p)
            if p and x and (e := edits_in(p, x)) <= int(0.08 * len(p)):
                want.add((d, i, e))
    df = spark.createDataFrame(docs, DOC)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_contamination(df, bench).collect()}
    assert got == want and any(e > 1 for _, _, e in want)
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in want}


def test_contamination_blocks_and_edges(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"benchmark passage number {i} with its own words") for i in range(6)], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "a benchmark passage number 3 with its own words b", "x")] * 2 + [(2, "q" * 200_000, "x")],
                               DOC + ", item_id string")
    whole = sorted(map(tuple, decontaminate.find_contamination(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted(map(tuple, decontaminate.find_contamination(df, bench).collect())) == whole and len(whole) == 12
    assert decontaminate.drop_contaminated(df, bench).columns == df.columns
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 3
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


# ---- html ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-banner">We use cookies</div>%s<aside><p>Side</p></aside>
<div id="comments"><p>First!</p></div><form><p>Mail</p><input></form><footer>&copy; F</footer><script>var a="<p>no</p>";</script></body></html>"""


def blocks(page):
    return [t for t, _ in html.main_blocks(page)]


def test_main_blocks():
    art = ("<article><header><h1>Title &amp; more</h1></header><p>One<br>two <b>bold</b> &#233;&lt;x&gt;<p>Next\n  <a href='x>y'>link</a>"
           "<div class='ad-slot'>Buy</div><ul><li>a<li>b</ul><section class='comments'><p>nope</p></section></article>")
    assert blocks(PAGE % art) == ["Title & more", "One two bold é<x>", "Next link", "a", "b"]
    assert blocks(PAGE % "<main><p>m</p></main>") == ["m"]
    assert blocks(PAGE % "<div><p>plain</p></div>") == ["plain"]
    for none in (None, "", "<html>", "<p", "<!-- x", "<script>x", "&amp"):
        assert blocks(none) in ([], ["&"])
    assert blocks("<article><p>cut off he") == ["cut off he"] and blocks("<p>a<p>b &am") == ["a", "b &am"]
    assert blocks("<div>" * 5000 + "deep") == ["deep"] and blocks("a < b <1> c") == ["a < b <1> c"]
    assert blocks("<article>" + "x" * 500_000) == ["x" * 500_000]
    assert blocks("<p title=\"unclosed>text</p><p>more</p>")[-1] == "more"


def test_wrappers_keep_what_they_hold():
    story = "<h1>Title</h1><p>A story of some length, told in one paragraph.</p>"
    want = ["Title", "A story of some length, told in one paragraph."]
    for wrap in ('<div class="layout has-sidebar">', '<div class="no-sidebar">', '<div class="with-comments">', '<div id="page-nav-left">',
                 '<section class="paywall">', '<div class="left-sidebar">', '<div class="sidebar">', '<div class="comments">',
                 '<form id="aspnetForm">', '<div role="form">', '<div class="page-header">', '<div class="modal overlay">'):
        end = f"</{wrap[1:].split()[0]}>"
        for part in ("article", "main", "div"):
            assert blocks(PAGE % f"{wrap}<{part}>{story * 3}</{part}>{end}") == want * 3, (wrap, part)
        assert blocks(PAGE % f"{wrap}<form><div class='menu'><p>Go</p></div><article>{story}</article></form>{end}") == want
    for wrap in ('<section class="related-work">', '<div class="social-history">', '<section id="notice-of-intent">'):
        assert blocks(PAGE % f"<article>{story}{wrap}<p>Part</p></{wrap[1:].split()[0]}></article>") == [*want, "Part"]
    # most of an article's text behind one mark, and the page-wide form of a page without marks
    assert blocks(PAGE % f"<article><h1>T</h1><div class='paywall'>{story}</div></article>") == ["T", *want]
    # real furniture stays out, also where it holds articles of its own or more text than the story
    for name in ("sidebar", "site-footer", "related-posts", "adSlot-2", "share-buttons", "cookie_consent", "ad-300x250", "main-menu"):
        assert blocks(PAGE % f"<article>{story}<div class='x {name}'><p>out</p></div></article>") == want, name
    for mark in ("id='comments'", "class='related'", "class='sidebar'"):
        assert blocks(PAGE % f"<article>{story}</article><div {mark}><article><p>Teaser</p></article></div>") == want
    assert blocks(PAGE % f"<article>{story}<div class='comments'><p>{'I say. ' * 99}</p></div></article>") == want
    assert blocks(PAGE % f"<main>{story}</main><section id='comments'><article><p>{'I say. ' * 99}</p></article></section>") == want


def test_site_template_removal(spark):
    def page(i, host, extra=""):
        return (i, f"http://{host}/p{i}", f"<body><div class='w'><div><p>Read our partner offers</p></div><div><p>Story {i}</p>"
                                          f"<p>Shared passage in every story</p></div>{extra}</div></body>")

    rows = [page(i, "a.org") for i in range(12)] + [page(100 + i, "b.org") for i in range(3)]
    rows += [(200 + i, f"http://c.org/{i}", "<article><div><p>Same story</p></div></article>") for i in range(20)]
    rows += [(300 + i, f"http://d.org/{i}", f"<article><p>Own {i}</p><p>Shared</p><div>Follow us</div></article>") for i in range(9)]
    rows += [(900, None, None), (901, "http://[bad", ""), (0, "http://a.org/p0", rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    got = {}
    for r in html.extract_main_text(df).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]] = r["text"]
    assert got[3] == "Story 3"  # outside of an article, whatever recurs on the site
    assert got[101].startswith("Read our partner offers")  # too few pages to tell
    assert got[205] == "Same story"  # copies of one page are one page
    assert got[304] == "Own 4\nShared"  # inside one, containers only
    assert got[900] == got[901] == ""
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_templates_by_recurrence_and_size(spark):
    """A box on 9 % of a large host goes, prose that a small host repeats in articles stays, so does most of a page."""
    quote = "A long quotation of real article text. " * 8
    big = [(i, f"http://big.org/{i}", f"<article><p>Own {i} text of the story</p>{'<div>Box</div>' if i < 60 else ''}</article>")
           for i in range(700)]
    links = "<div>" + "<a href='x'>Another story to read</a> " * 20 + "</div>"
    small = [(1000 + i, f"http://small.org/{i}", f"<article><h1>H {i}</h1><p>{f'Own {i} words. ' * 200}</p><blockquote>{quote}</blockquote>"
                                                 f"{links}</article>") for i in range(6)]
    same = [(2000 + i, f"http://same.org/{i}", f"<article><h1>Headline {i}</h1><div>A short story</div></article>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(
        spark.createDataFrame(big + small + same, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Own 3 text of the story" and got[650] == "Own 650 text of the story"
    assert got[1002].endswith("of real article text.") and "Another story" not in got[1002]
    assert got[2003] == "Headline 3\nA short story"


class Plain(HTMLParser):
    """Visible text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.skip = [], [], 0

    def flush(self):
        t = " ".join("".join(self.run).split())
        self.run = []
        if t:
            self.out.append(t)

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style"):
            self.skip += 1
        if tag in html.BLOCK:
            self.flush()
        if tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style"):
            self.skip -= 1
        if tag in html.BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.run.append(data)


def test_visible_text_equals_standard_parser(spark):
    for r in spark.read.parquet(f"{SF001}/pages.parquet").collect():
        if r["html"].rstrip().endswith("</html>"):
            p = Plain()
            p.feed(r["html"])
            p.flush()
            assert html.visible_text(r["html"]) == "\n".join(p.out)


# ---- warc ----

def test_derivatives_link_and_verify(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", PAGE % "<article><p>Hi &eacute;</p></article>"), (2, None, None), (2, None, "")],
                                  "page_id bigint, url string, html string")
    src = {(r["page_id"], bytes(r["record"])) for r in warc.page_responses(pages).collect()}
    got = warc.build_derivatives(warc.page_responses(pages), id_col="page_id").collect()
    assert len(got) == 6 and {r["warc_type"] for r in got} == {"metadata", "conversion"}
    for r in got:
        record = bytes(r["record"])
        head, _, body = record.partition(b"\r\n\r\n")
        fields = dict(warc.parse_headers(head))
        source = next(rec for i, rec in src if i == r["page_id"] and r["refers_to"].encode() in rec)
        s_head, _, s_block = source.partition(b"\r\n\r\n")
        s_fields = dict(warc.parse_headers(s_head))
        assert fields["WARC-Refers-To"] == s_fields["WARC-Record-ID"] == r["refers_to"]
        assert fields.get("WARC-Target-URI") == s_fields.get("WARC-Target-URI") and fields["WARC-Date"] == s_fields["WARC-Date"]
        assert int(fields["Content-Length"]) == len(body) == r["content_length"]
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        if r["warc_type"] == "metadata":
            meta = dict(warc.parse_headers(b"x\r\n" + body))
            assert meta["source-payload-digest"] == s_fields["WARC-Payload-Digest"] and meta["source-payload-digest-valid"] == "true"
            assert meta["source-header-content-type"] == "text/html; charset=utf-8" and meta["source-status"] == "HTTP/1.1 200 OK"
            conv = [x["record_id"] for x in got if x["warc_type"] == "conversion" and x["refers_to"] == r["refers_to"]]
            assert meta["conversion-record-id"] in conv
        elif r["page_id"] == 1:
            assert "Hi é" in body.decode() and "<" not in body.decode()
        else:
            assert body == b""


def test_derive_edges(spark):
    def record(kind="response", block=b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png\r\nX-A: 1\r\n  2\r\n\r\n\x89PNG", extra=()):
        return warc.make_record([("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), *extra], block)

    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"\x89PNG").digest()).decode()
    one = warc.derive_record(record(extra=[("WARC-Payload-Digest", sha1)]))
    assert [r["warc_type"] for r in one] == ["metadata"] and one[0]["block_digest"].startswith("sha1:")
    assert b"conversion-record-id: none" in one[0]["record"] and b"source-header-x-a: 1 2" in one[0]["record"]
    assert b"source-payload-digest-valid: true" in one[0]["record"]
    bad = warc.derive_record(record(extra=[("WARC-Payload-Digest", "sha1:AAAA")]))
    assert b"source-payload-digest-valid: false" in bad[0]["record"]
    assert warc.derive_record(record("request")) == []
    assert [r["error"] for r in warc.derive_record(record()[:-2])] == ["truncated"]
    assert [r["error"] for r in warc.derive_record(None) + warc.derive_record(b"junk")] == ["no WARC header"] * 2
    plain = warc.derive_record(record(block=b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9 <b>"))
    assert plain[1]["record"].endswith("café <b>".encode())
    df = spark.createDataFrame([(1, None, "a"), (2, bytearray(record()), "b")], "id bigint, record binary, warc_type string")
    assert warc.build_derivatives(df).count() == 2 and warc.build_derivatives(df.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    src = warc.page_responses(pages)
    for compression in ("none", "gzip"):
        path = str(tmp_path / compression)
        warc.write_warc(src, path, compression=compression)
        back = warc.read_warc(spark, path)
        assert sorted(bytes(r[0]) for r in back.collect()) == sorted(bytes(r["record"]) for r in src.collect())
    derived = warc.build_derivatives(back)
    assert derived.filter("warc_type = 'invalid'").count() == 0 and derived.count() == 2 * pages.count()


def foreign(kind, block, version="1.0", i=1):
    return (f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block


def http(body, *fields):
    return "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *fields, "", ""]).encode() + body


def test_foreign_files(spark, tmp_path):
    """WARC/1.0 with a warcinfo first, other versions, separators and any bytes in payloads, a cut-off record."""
    image = http(bytes(range(256)) * 3).replace(b"text/html", b"image/png")
    records = [foreign("warcinfo", b"software: x\r\n"), foreign("response", http(b"<p>one</p>"), i=2), foreign("response", image, i=3),
               foreign("response", http(b"<p>a\r\n\r\nWARC/1.0\r\nb\r\n\r\nWARC/x</p>"), i=4), foreign("response", b"", i=5),
               foreign("response", http(b"<p>17</p>"), "0.17", i=6), foreign("response", http(b"<p>11</p>"), "1.1", i=7),
               foreign("resource", b"WARC/1.0 in front", i=8), foreign("response", http(b"<p>cut</p>"), i=9)[:-6],
               foreign("response", http(b"<p>last</p>"), i=10)]
    data = b"".join(r + b"\r\n\r\n" for r in records)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))
    (tmp_path / "empty.warc").write_bytes(b"")
    back = warc.read_warc(spark, str(tmp_path))
    assert sorted(bytes(r[0]) for r in back.collect()) == sorted(records * 2)
    got = Counter((r["warc_type"], r["refers_to"], r["error"]) for r in warc.build_derivatives(back).collect())
    assert got[("invalid", "<urn:uuid:9>", "truncated")] == 2 and sum(n for k, n in got.items() if k[0] == "invalid") == 2
    assert sum(n for k, n in got.items() if k[0] == "conversion") == 2 * 5  # all of text/html but the empty and the cut one
    # in splits that are smaller than the file
    many = [foreign("response", http(f"<p>{i} é</p>".encode()), i=i) for i in range(500)]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "m.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = warc.read_warc(spark, str(tmp_path / "many"))
        assert back.rdd.getNumPartitions() > 1 and sorted(bytes(r[0]) for r in back.collect()) == sorted(many)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_payload_encodings_and_left_bytes():
    page = "<p>caf\u00e9 au lait</p>".encode()

    def conversion(block):
        rows = warc.derive_record(foreign("response", block))
        return [r["error"] or bytes(r["record"]).partition(b"\r\n\r\n")[2].decode() for r in rows if r["warc_type"] != "metadata"]

    def chunks(b):
        return b"".join(b"%x;q=1\r\n%s\r\n" % (len(b[i:i + 9]), b[i:i + 9]) for i in range(0, len(b), 9)) + b"0\r\n\r\n"

    raw = zlib.compressobj(wbits=-15)
    want = ["caf\u00e9 au lait"]
    assert conversion(http(page)) == conversion(http(chunks(page), "Transfer-Encoding: chunked")) == want
    assert conversion(http(page, "Transfer-Encoding: chunked", "Content-Encoding: gzip")) == want  # stored decoded
    for name, data in (("gzip", gzip.compress(page)), ("x-gzip", gzip.compress(page[:5]) + gzip.compress(page[5:])),
                       ("deflate", zlib.compress(page)), ("deflate", raw.compress(page) + raw.flush()), ("identity", page)):
        assert conversion(http(data, f"Content-Encoding: {name}")) == want
        assert conversion(http(chunks(data), f"Content-Encoding: {name}", "Transfer-Encoding: chunked")) == want
    assert conversion(http(page, "Content-Encoding: br")) == conversion(http(gzip.compress(page)[:-9], "Content-Encoding: gzip")) == [
        "content encoding"]
    left = warc.derive_record(foreign("warcinfo", b"x") + b"\n\nWARC/1.0\nmore")
    assert [r["error"] for r in left] == ["bytes after Content-Length"]
    assert [r["warc_type"] for r in warc.derive_record(foreign("response", http(page)) + b"more")] == ["metadata", "conversion", "invalid"]
    for body in (page, chunks(page)):  # digests of the content or of the chunked bytes
        block = http(chunks(page), "Transfer-Encoding: chunked")
        head = f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n".encode()
        about = warc.derive_record(foreign("response", block).replace(b"Content-Length", head + b"Content-Length", 1))[0]
        assert b"source-payload-digest-valid: true" in about["record"]


def test_recurring_recipe_parts_stay(spark):
    """Lists and quotes of an article are text, however often they recur."""
    parts = "<ul><li>200 g flour</li><li>2 eggs</li></ul><blockquote>Best served warm.</blockquote><table><tr><td>oven</td><td>180</td></tr></table>"
    for pages in (5, 80):
        rows = [(i, "http://food.example/r", f"<article><h1>Cake {i}</h1><p>Number {i} of many cakes.</p>{parts}<div>Mix well, then wait.</div>"
                 f"<p>Bake it {i} minutes.</p><div><a href='/a'>More cakes</a> <a href='/b'>More pies</a></div></article>") for i in range(pages)]
        got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        for r in got:
            i = r["page_id"]
            assert r["text"].split("\n") == [f"Cake {i}", f"Number {i} of many cakes.", "200 g flour", "2 eggs", "Best served warm.", "oven", "180",
                                             "Mix well, then wait.", f"Bake it {i} minutes."]


def test_malformed_markup_loses_no_text():
    def text(page):
        return "\n".join(t for t, _ in html.main_blocks(page))

    assert text("<p don't>Hello it's</p><p>me</p>") == "Hello it's\nme"
    assert text("<p>a</p><!--><p>b</p><!---><p>c</p><!-- x > y --><p>d</p>") == "a\nb\nc\nd"
    assert text("<p title='a > b' data-x=\"1 > 0\" y = 'z>'>in</p>") == "in"
    assert text("<p a=b'c>one</p><p>two's</p>") == "one\ntwo's"


def test_unclosed_and_nested_markup_in_linear_time():
    import time

    for page in ("<b>word <i>more " * 60_000, "<div>" * 90_000 + "x", "<p><span>a " * 60_000, "</i>" * 200_000 + "<p>x"):
        began = time.process_time()
        assert html.main_blocks(page)
        assert time.process_time() - began < 8
