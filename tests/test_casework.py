"""Operators over listings, pages, people, claims and prose against plain Python."""

import datetime as dt
import random
import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import claims, evidence, listings, pages, people, wording
from caseloom.sources import casefiles


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- pages


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.depth, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.links += [v for k, v in attrs if tag == "a" and k == "href" and v]
        self.depth += tag in pages.SKIPPED
        if tag in pages.BLOCKS and not self.depth:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in pages.SKIPPED:
            self.depth = max(self.depth - 1, 0)
        elif tag in pages.BLOCKS and not self.depth:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.out.append(data)


def plain(page):
    p = Plain()
    p.feed(page)
    return "\n".join(x for x in (" ".join(y.split()) for y in "".join(p.out).splitlines()) if x), p.links


PARTS = st.sampled_from(
    "<p>|</p>|<nav>|</nav>|<div class='a>b'>|</div>|<br/>|<script>if (a<b) '<p>x</p>'</script>|<style>p{}</style>|<!-- <p>no</p> -->|text|  |two words|&amp;|&#233;t&eacute;|<b>|</b>|<a href=\"/a?x=1&amp;y=2\">|<a class=x href='b.html'>|<a HREF=c>|</a>|<a name=n>|\n|<footer>|</footer>|<li>|<h2>".split("|")
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=25))
def test_visible_text_and_links_of_any_page(parts):
    page = " ".join(parts)
    text, links = plain(page)
    assert pages.visible_text(page) == text and pages.anchor_links(page) == links


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(1, "https://A.example/x/y", "<nav><a href='../about'>us</a></nav><p>Body"), (2, None, None), (3, "https://a.example", "")], "id bigint, url string, html string")
    assert rows(df.select("id", pages.page_text("html"))) == [(1, "Body"), (2, None), (3, "")]
    assert rows(pages.linked_pages(df, "id", "url", "html")) == [(1, 0, "../about", "https://A.example/about")]
    links = [(1, "https://a.example/", "https://A.example/About?x#y", 1), (1, "https://a.example/", "http://a.example/About", 2), (1, "https://a.example/", "https://b.example/team", 3), (1, "https://a.example/", "mailto:team@a.example", 4), (1, "https://a.example/", "https://a.example/prices", 5), (2, "https://c.example/company", "https://c.example/company", 1)]
    df = spark.createDataFrame(links, "id int, entry string, target string, pos int")
    assert rows(pages.about_pages(df, "id", "entry", "target", "pos")) == [(1, "https://A.example/About")]
    assert pages.about_pages(df.limit(0), "id", "entry", "target", "pos").count() == 0


def test_clean_lines(spark):
    df = spark.createDataFrame([("a  b\r\n\n\t c d \x0b\x0c e",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(pages.clean_lines(F.col("t"))).collect()] == ["a b\nc d\ne", "", None]


# -- wording


def test_quotations_exempt_only_what_lies_inside_one(spark):
    pattern = re.compile(r"\b(fraud|tax refund)\b", re.I)
    assert wording.open_terms("fraud fraud fraud", ["fraud fraud"], pattern) == ["fraud"]
    assert wording.open_terms("a tax refund b", ["a tax", "refund b"], pattern) == ["tax refund"]
    assert wording.open_terms("see https://x.example/fraud or Fraud", [], pattern) == ["fraud"]
    assert wording.open_terms("a fraud b", ["", "  ", None, "a fraud"], pattern) == [] and wording.open_terms("", None, pattern) == []
    df = spark.createDataFrame([(1, "fraud liar fraud, con  artist; frauds éfraud", None), (2, None, ["x"])], "id int, t string, q array<string>")
    assert rows(df.select("id", wording.gate(F.col("t"), F.col("q")))) == [(1, ["fraud", "liar", "fraud", "con  artist"]), (2, [])]
    assert rows(df.select("id", wording.listed_terms(F.col("t")))) == [(1, ["fraud", "liar", "fraud", "con  artist"]), (2, None)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=40), st.lists(st.text("ab ", max_size=5), max_size=4))
def test_open_terms_of_any_text(prose, quotes):
    spans = []
    for q in quotes:
        at = prose.find(q) if q.strip() else -1
        while at >= 0:
            spans.append((at, at + len(q)))
            at = prose.find(q, at + len(q))
    pattern = re.compile(r"\b(ab|b)\b")
    want = [m[0] for m in pattern.finditer(prose) if not any(s <= m.start() and m.end() <= e for s, e in spans)]
    assert wording.open_terms(prose, quotes, pattern) == want


def test_regions_of_memos(spark):
    memo = "fraud\n## Claims\n\nWhat it says: fraud\n## End\nfraud"
    assert wording.region_of(memo, "## Claims", ("What",)) == (6, 37)
    assert wording.region_of(memo, "## Claims", ("Other",)) is None and wording.region_of("## Claims\nWhat", "## Claims", ("What",)) is None and wording.region_of(None, "## C", ("",)) is None
    df = spark.createDataFrame([(1, memo, ["fraud"], None), (2, "fraud", ["fraud"], ["x"]), (3, None, None, None)], "id int, m string, c array<string>, n array<string>")
    got = df.select("id", wording.memo_gate(F.col("m"), F.col("c"), F.col("n"), "## Claims", ("What",)).alias("g")).select("id", "g.*")
    assert rows(got) == [(1, 6, 37, ["fraud", "fraud"]), (2, None, None, ["fraud"]), (3, None, None, [])]


@pytest.mark.parametrize(
    ("text", "years"),
    [
        ("Founded in 2015, trading since 14 May 2012.", [2012, 2015]), ("Since June 1999 we grow", [1999]), ("We grow since 1999", []), ("operating from 2014 and established 2014", [2014]),
        ("It was not founded in 2010", []), ("The firm has ceased to say that it was established in 2001", []), ("without " + "x" * 60 + " founded in 2003", [2003]), ("founded in 1700", []), ("founded in 20155", []),
        ("began operations in 2016", [2016]), ("TRADED SINCE SEPTEMBER 1987", [1987]), ("", []), (None, []), ("knot founded in 2002", [2002]),
    ],
)
def test_years_of_origin(spark, text, years):
    assert spark.createDataFrame([(text,)], "t string").select(wording.origin_years(F.col("t"))).first()[0] == years


# -- listings


def walked(pages_, most, per_page, keyed, without_total):
    items, seen, total, clamped, stopped, stuck, received, n = [], set(), None, False, False, False, 0, 0
    for keys, said in pages_[:most]:
        n += 1
        received += len(keys)
        total = said if said is not None else total
        real = [k for k in keys if k is not None]
        if keyed:
            fresh = [k for i, k in enumerate(real) if k not in seen and k not in real[:i]]
            seen |= set(fresh)
            if n > 1 and not fresh:
                stuck = stopped = True
                break
            items += fresh
        else:
            items += real
        if not keys or (total is not None and len(items) >= total) or (without_total and total is None):
            stopped = True
            break
        clamped = clamped or len(keys) < per_page
    truncated = total is not None and len(items) < total
    return n, received, len(items), total, truncated, truncated and not stopped, clamped, stuck


@pytest.mark.parametrize(("keyed", "without_total"), [(True, False), (False, False), (False, True)])
def test_walks_over_pages(spark, keyed, without_total):
    rng = random.Random(3)
    made = {r: [([rng.choice([None, *"abcdefgh"]) for _ in range(rng.choice([0, 2, 3, 3, 3]))], rng.choice([None, 4, 6, 9])) for _ in range(rng.randint(1, 5))] for r in range(150)}
    df = spark.createDataFrame([(r, i + 1, total, keys) for r, p in made.items() for i, (keys, total) in enumerate(p)], "resource int, page int, total int, items array<string>")
    got = {r.resource: tuple(r)[1:9] for r in listings.walk_pages(df, 4, 3, keyed, without_total).collect()}
    assert got == {r: walked(p, 4, 3, keyed, without_total) for r, p in made.items()}
    assert listings.walk_pages(df.limit(0), 4, 3, keyed).count() == 0


# -- evidence and people


def test_names_are_never_given_twice(spark):
    bases = ["a", "a", "a-2", "a-2", "b", "b-2-3", "b", "c", None]
    df = spark.createDataFrame(list(enumerate(bases)), "i int, base string").where("base is not null")
    got = {r.i: r.name for r in evidence.unique_names(df, "base", "i", "name").collect()}
    taken, want = set(), {}
    for i, b in enumerate(bases[:-1]):
        name, k = b, 2
        while name in taken:
            name, k = f"{b}-{k}", k + 1
        taken.add(name)
        want[i] = name
    assert got == want and len(set(got.values())) == len(got)


def test_resolving_hits(spark):
    df = spark.createDataFrame([("1234567", "x", "9"), ("Alpha", "Beta Ltd", "1"), ("Gamma", "GAMMA.", "2"), ("Gamma", "Gamma Two", "3"), ("Gamma", "Gamma Two", "3"), ("Delta", "delta", "4"), ("Delta", "Delta!", "5"), ("None", None, None)], "query string, title string, company_number string")
    assert rows(evidence.resolve_hits(df)) == [("1234567", "number", "01234567", 1, 0), ("Alpha", "single", "1", 1, 0), ("Delta", "ambiguous", None, 2, 0), ("Gamma", "exact", "2", 2, 1), ("None", "empty", None, 0, 0)]


def test_owners_and_subjects(spark):
    officers = spark.createDataFrame([(2, "c", "SMITH, Ann", 1970, 5), (1, "c", "Smith Ann", 1970, 5), (3, "c", "JONES, Bo", None, None)], "officer_row_id bigint, company_number string, name string, year int, month int")
    owners = spark.createDataFrame([(9, "c", "Mrs Ann Smith", 1970, 5), (8, "c", "Ann Smith", 1970, None), (7, "c", "Bo Jones", None, None), (9, "c", "Mrs Ann Smith", 1970, 5)], "owner_id bigint, company_number string, name string, year int, month int")
    merged = people.merge_owners(owners, officers)
    assert {(r.owner_id, r.merged_officer) for r in merged.collect()} == {(9, 1), (8, None), (7, None)}
    subjects = people.screening_subjects(spark.createDataFrame([("c", "C Ltd")], "company_number string, name string"), officers, merged)
    assert [(r.query_id, r.kind, r.birth) for r in subjects.orderBy("ord").collect()] == [("q001", "company", None), ("q002", "officer and psc", "1970-05"), ("q003", "officer", "1970-05"), ("q004", "officer", None), ("q005", "psc", None), ("q006", "psc", "1970")]


def test_disqualifications(spark):
    d, today = dt.date, dt.date(2026, 1, 1)
    folk = spark.createDataFrame([(1, "SMITH, Ann", False, 1970, 5, None), (2, "Smith Ann", False, 1971, 5, None), (3, "Smith Ann", False, None, None, None), (4, "Acme", True, None, None, " ab1 "), (5, "Nobody", False, 1970, 5, None)], "person_id int, name string, corporate boolean, year int, month int, number string")
    made = [("/natural/1", "Ann Smith", d(1970, 5, 9), None, [d(2025, 1, 1)]), ("/natural/2", "Ann Smith", d(1970, 5, 1), None, [None, d(2027, 1, 1)]), ("/corporate/3", "Acme", None, "AB1", [None]), ("/natural/4", "Other Name", d(1970, 5, 1), None, [d(2030, 1, 1)])]
    details = spark.createDataFrame(made, "link string, name string, birth_date date, number string, until array<date>")
    hits = spark.createDataFrame([(["ann", "smith"], 1, "/natural/1"), (["ann", "smith"], 2, "/corporate/3"), (["ann", "smith"], 3, "/natural/2"), (["ann", "smith"], 4, ""), (["ann", "smith"], 5, "/natural/4"), (["ann", "smith"], 6, "/natural/1"), (["acme"], 1, "/corporate/3")], "name_tokens array<string>, ord int, link string")
    got = {r.person_id: (r.n_candidates, r.n_followed, r.tier, r.link) for r in people.disqualification_tiers(folk, hits, details, today).collect()}
    assert got == {1: (6, 3, "strong_active", "/natural/2"), 2: (6, 3, "mismatch", "/natural/1"), 3: (6, 3, "name_only", "/natural/1"), 4: (1, 1, "name_only", "/corporate/3"), 5: (0, 0, "none", None)}


# -- claims


def test_claims_meet_their_own_section(spark):
    said = [("c", 1, "Founded  in ‘2015’", "deck"), ("c", 2, "Founded in '2015'", "site"), ("c", 3, "word", "deck"), ("c", 4, "  ", "deck"), ("c", 5, "Founded in ‘2015’", "deck"), ("c", 6, "not there", "deck"), ("d", 1, "x y", None)]
    sections = spark.createDataFrame([("c", "deck", "WE WERE FOUNDED IN '2015'. One word."), ("c", "site", "nothing")], "company string, source string, text string")
    checked = claims.checked_claims(spark.createDataFrame(said, "company string, ord int, text string, source string"), sections)
    assert {(r.company, r.ord, r.state, r.claim_id) for r in checked.collect()} == {("c", 1, "kept", "CLM-001"), ("c", 2, "dropped", None), ("c", 3, "thin", None), ("c", 6, "dropped", None), ("d", 1, "dropped", None)}
    assert rows(claims.claim_counts(checked)) == [("c", 1, 2, 1), ("d", 0, 1, 0)]


def test_basis_of_assessments(spark):
    a = spark.createDataFrame([("k", "1", 2, ["z"]), ("k", "1", 1, ["b", "x", "a"]), ("k", "2", 1, [])], "case string, claim string, ord int, basis array<string>")
    f = spark.createDataFrame([("a", "A"), ("b", "B2"), ("b", "B1")], "id string, evidence string")
    assert rows(claims.basis_evidence(a, f)) == [("k", "1", 3, 1, ["B1", "B2", "A"]), ("k", "2", 0, 0, [])]
    c = spark.createDataFrame([("k", "1", True), ("k", "3", True), ("k", "4", False)], "case string, claim string, checkable boolean")
    s = spark.createDataFrame([("k", "1", 1, "supported"), ("k", "1", 2, "contradicted"), ("k", "4", 1, "supported")], "case string, claim string, ord int, status string")
    assert rows(claims.back_filled(c, s)) == [("k", "1", "supported", True), ("k", "3", "unverified", False), ("k", "4", "not checkable", False)]


# -- files


def test_evidence_sections_and_case_folders(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.json").write_text('{"name":"deck_text","url":"deck.pdf","params":{},"status":200,"body":{"pages":{"1":"one","2":""}}}')
    (tmp_path / "e/b.json").write_text('{"name":"site_001","url":"https://x.example/about?q","status":200,"body":{"text":"hello","url":"https://x.example/moved"}}')
    (tmp_path / "e/c.json").write_text('{"name":"site_002","url":"https://x.example/about","body":{"text":"again"}}')
    (tmp_path / "e/d.json").write_text("{broken")
    found = casefiles.evidence_sections(casefiles.read_envelopes(spark, str(tmp_path / "e")))
    joined = casefiles.sections(found.withColumn("case", F.lit("k")), "case")
    assert rows(joined) == [("k", "deck p.1", "one"), ("k", "site /about", "hello\nagain")]

    case = spark.createDataFrame([("k", "K Ltd")], "case string, name string")
    memo = spark.createDataFrame([("k", "line one\nline two")], "case string, memo string")
    log = spark.createDataFrame([("k", "u", {"api_key": "s", "q": "x"})], "case string, url string, params map<string,string>")
    ev = spark.createDataFrame([("k", "site_001", "u", 200, "t", "body")], "case string, name string, url string, status int, retrieved_at string, body string")
    out = str(tmp_path / "out")
    casefiles.write_case_folders(case, memo, log, ev, out)
    with pytest.raises(AnalysisException):
        casefiles.write_case_folders(case, memo, log, ev, out)
    casefiles.write_case_folders(case, memo, log, ev, out, overwrite=True)
    assert casefiles.read_casefiles(spark, out + "/casefile/*", "name string").first().name == "K Ltd"
    assert spark.read.json(out + "/fetch_log").first().params.asDict() == {"q": "x"}
    assert spark.read.json(out + "/evidence_index").count() == 1 and spark.read.text(out + "/memo").count() == 2


def test_decks_and_cache(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"hello"), ("c.pdf", b""), ("d.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: (r.state, r.sha256 is None) for r in casefiles.read_decks(spark, str(tmp_path), 50).collect()}
    assert got == {"a.pdf": ("ok", False), "b.pdf": ("not a pdf", False), "d.pdf": ("oversize", True)}
    df = spark.createDataFrame([(1, "f", 200, True, "abc", "2024-01-01"), (1, "f", 200, True, "abc", "2024-01-01"), (2, None, 200, False, None, "2025-01-01"), (3, "f", 404, False, "x", "2025-01-01")], "fetch_id int, feed string, status int, from_cache boolean, body string, retrieved_at string")
    assert rows(casefiles.cache_stats(df)) == [("", 1, 0, 0), ("f", 1, 1, 3)]
    assert casefiles.clear_cache(df).count() == 0 and casefiles.clear_cache(df, F.lit("2025-01-01")).count() == 2


def test_small_forms(spark):
    df = spark.createDataFrame([("ab12", "a|b", "```json\n{}\n```", '{"release":{"name":""},"index":"v"}', {"b": None, "a": "1"}), ("../x", None, None, "{", None)], "n string, t string, f string, j string, m map<string,string>")
    got = df.select(X.folder_number(F.col("n")), X.escape_bars(F.col("t")), X.without_fence(F.col("f")), casefiles.first_name(F.col("j"), ("release", "index")), X.canonical_json(F.col("m")), X.marked(F.col("t"), r"a(.)b"))
    assert [tuple(r) for r in got.collect()] == [("ab12", "a\\|b", "{}", "v", '{"a":"1","b":""}', "|"), (None, None, None, None, None, None)]
    w = spark.createDataFrame([([(dt.date(2020, 1, 1), None), (None, dt.date(2021, 1, 1))],)], "w array<struct<from_day:date,until_day:date>>")
    assert w.select(people.window_text(F.col("w"))).first()[0] == "2020-01-01 to unknown end; unknown start to 2021-01-01"
    dates = spark.createDataFrame([("2020-02-30",), ("2020-2-3",), (" 2020-02-03 ",), (None,)], "t string")
    assert [r[0] for r in dates.select(people.iso_date(F.col("t"))).collect()] == [None, None, dt.date(2020, 2, 3), None]
