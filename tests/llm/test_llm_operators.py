"""The operators of the llm subpackage against libraries, brute force and held-out rows."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from caseloom.llm import banding, matching, mixing, names, pagebody, places, stuffed, tokens, variants
from caseloom.llm.addressparts import parts_of, postcode_of
from caseloom.llm.matching import propagate
from caseloom.session import ship_package

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_package(spark)


# -- tokens


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.BYTE_BPE_50K)
    t.encode_special_tokens = True
    return t


def by_library(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    flat, sizes = tokens.encoder(tokens.BYTE_BPE_50K).encode(texts)
    return [p.tolist() for p in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []


def test_tokens_of_all_documents(library):
    texts = [t for (t,) in duckdb.connect().execute(f"select text from '{SF}/documents.parquet' where text is not null").fetchall()]
    assert ours(texts) == by_library(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcXYZ 0189\t\n\r'sßéü漢字한😀👍🏽-_.,!?\x85\xa0​", max_size=80))
def test_tokens_of_any_text(library, text):
    assert ours([text]) == by_library(library, [text])


def test_tokens_of_long_words(library):
    texts = ["a" * 3000, "ab" * 900, " " * 2000, "=" * 1500, "<|endoftext|>", ""]
    assert ours(texts) == by_library(library, texts)


def test_token_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "  ", 5), (3, "  ", 5), (4, "hello world", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in tokens.token_ids(df).collect())
    assert got == [(1, []), (2, []), (3, [220, 220]), (3, [220, 220]), (4, [31373, 995])]
    assert tokens.token_ids(df.limit(0)).count() == 0


# -- stuffed pages

STUFFED = [
    "cheap loans | best loans | loans near me | cheap loans 24h | fast loans | loans online | best cheap loans | loans uk",
    "\n".join(f"https://top-{x}.example/?k=cheap+loans" for x in "abcdefg"),
    "#cheaploans #bestloans #loans24h #loansonline #fast_loans #loansuk",
    "The court dismissed the claim.\n" + "\n".join(f"* [Cheap Loans {i}](https://w{i}.example/x)" for i in range(9)),
    "\n".join(f"Cheap Parts SKU{10_000 + i} £{i},999 sale" for i in range(8)),
]
SOUND = [
    "The tribunal dismissed the claim and awarded costs of £80,839. Its auditor qualified the opinion.",
    "Officers\n" + "\n".join(f"Ann Other – director, appointed {d} May 2011" for d in range(1, 9)),
    "SIC codes: 57370 haulage; 62620 horticulture; 52304 paving; 75622 quarrying",
    "Nothing is known of it.\nSources:\n" + "\n".join(f"[{i}] https://registry.example/filing/{i}" for i in range(1, 9)),
    "\n".join(f"{d} July 2014\tMR01\tconfirmation statement" for d in range(1, 9)),
    "Q: When was the lease filed?\nA: In May, by the agent of the landlord.\nQ: Who paid for it?\nA: The parent company did.",
    "",
    "   \n ",
    None,
    "Es liegt keine Meldung vor. Die Prüfer konnten Vorräte nicht bestätigen.",
]


def test_stuffed_pages(spark):
    data = [(i, t, "x") for i, t in enumerate(STUFFED + SOUND)]
    df = spark.createDataFrame([*data, data[0], (99, "word " * 100_000, "x")], "doc_id bigint, text string, kind string")
    got = {r.doc_id for r in stuffed.stuffed_pages(df).collect()}
    assert got == {*range(len(STUFFED)), 99}
    assert stuffed.stuffed_pages(df.limit(0)).count() == 0


# -- page bodies

PAGE = """We use cookies, to measure traffic. See our privacy notice for details.
Accept all
Home | Products | Contact
Zanord Paving Ltd
We started in 2005 with one bench and a borrowed lathe, and today 22 people work from our yard.
Our advice on cookies, consent and record keeping is written by Robert Tal.
- Since 2018
Sybil Rusk, director
Latest news
Regulator closes file on Porarr Sailing Ltd
Tweet
Board of Zanord Film Ltd reshuffled
Get a quote from Zanord Paving Ltd in under 6 minutes and save on your first order.
© 2025 Zanord All rights reserved.
Privacy
"""
BODY = [3, 4, 5, 6, 7]


def test_seed_labels():
    assert [i for i, x in enumerate(pagebody.seed_labels(PAGE.split("\n"))) if x] == BODY


def test_labeller_on_held_out_pages():
    texts = [t for (t,) in duckdb.connect().execute(f"select distinct text from '{SF}/site_page.parquet' where text <> '' order by 1").fetchall()]
    random.Random(3).shuffle(texts)
    model = pagebody.train(texts[100:])
    found = pagebody.label_pages(model, texts[:100], {})
    want = [set(np.flatnonzero(pagebody.seed_labels(t.split("\n")))) for t in texts[:100]]
    agree = sum(len(w & set(f.tolist())) for w, f in zip(want, found, strict=True))
    assert agree > 0.93 * sum(map(len, want))
    assert agree > 0.93 * sum(map(len, found))


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(1)
    model = pagebody.BlockLabeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    lines = PAGE.split("\n")[:6]
    x, mask = model.batch([pagebody.page_vectors(lines, {}), pagebody.page_vectors(lines[:3], {})])
    y = rng.integers(0, 2, mask.shape).astype(float)
    loss = lambda: -(mask * (y * np.log(model.forward(x, mask)) + (1 - y) * np.log(1 - model.forward(x, mask)))).sum()
    kept = {}
    p = model.forward(x, mask, kept)
    d = ((p - y) * mask)[..., None]
    grad, _, _ = model._unroll(x, kept["kf"], model.w["wf"], (d @ model.w["wo"].T)[..., : pagebody.HIDDEN])
    for i, j in ((2, 5), (30, 40), (50, 80)):
        model.w["wf"][i, j] += 1e-4
        up = loss()
        model.w["wf"][i, j] -= 2e-4
        down = loss()
        model.w["wf"][i, j] += 1e-4
        assert grad[i, j] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-3)


def test_long_pages_are_read_in_windows():
    model = pagebody.BlockLabeller()
    found = pagebody.label_pages(model, ["\n".join(f"line {i} of it." for i in range(1500)), "", "x"], {})
    assert len(set(found[0].tolist())) == len(found[0]) and (not len(found[0]) or found[0].max() < 1500)


def test_all_words_of_long_lines_are_read():
    line = "We moved twice. " * 40
    (a, _), (b, n) = (pagebody.word_hashes([line + end], {}) for end in ("Accept all", "Robert Tal"))
    assert n[0] == 2 * 122 + 1 and len(a) == len(b) and (a != b).any()


def test_long_pages_are_read_whole():
    model = pagebody.BlockLabeller()
    lines = [f"Line {i} of it{'.' if i % 3 else ''}" + " | more" * (i % 2) for i in range(1500)]
    x, mask = model.batch([pagebody.page_vectors(lines, {})])
    want = np.flatnonzero(model.forward(x, mask)[:, 0] >= 0.5)
    found = pagebody.label_pages(model, ["x", "\n".join(lines)], {})
    assert found[1].tolist() == want.tolist()
    seen = []
    model.fit = pagebody.BlockLabeller.fit
    pagebody.BlockLabeller.fit = lambda self, pages: seen.extend(pages)
    try:
        pagebody.train(["\n".join(lines)])
    finally:
        pagebody.BlockLabeller.fit = model.fit
    assert sum(len(p[3]) for p in seen) == 1500 and all(len(p[1]) == p[2].sum() for p in seen)


def test_body_rows(spark):
    df = spark.createDataFrame([(1, PAGE, 0), (1, PAGE, 0), (2, None, 0), (3, "", 0), (4, "\n\n", 0)], "page_id bigint, text string, line_no int")
    got = pagebody.body_lines(df).collect()
    assert {r.page_id for r in got} <= {1} and len(got) == len(set(got))
    assert pagebody.body_lines(df.limit(0)).count() == 0


# -- names


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("DAROD, Katherine", "K D Darod", True), ("DAROD, Kate", "Katherine Darod", True), ("Ostesmarsh, Rebecca, Esq", "Dr Rebeca OSTEMARSH", True),
        ("DAROD, Katherine", "DAROD, Thomas", False), ("Lars Kelackgate", "Lars Kelondgate", False), ("Alex Nor", "NOR, Alexander J.", True),
    ],
)
def test_person_likeness(a, b, same):
    assert (names.person_likeness(names.person_parts(a), names.person_parts(b)) > 0.6) == same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("BELIPPJACK QUARRYING PROPERTIES LTD", "Belippjack Prop. Quarrying Limited", True), ("LANABFORD LEISURE SERVICES LTD", "LanabfordLeisure Serv. Limited", True),
        ("BRADOM STAFFING ASSOCIATES LTD", "BRADOM STAFFING DEVELOPMENTS LTD", False), ("BELAR LIGHTING LTD", "BELAR LIGHTING DISTRIBUTION LTD", False),
        ("WALEDHAM DRAINAGE LTD", "wALEDHA dRAINAGE lIMITED", True), ("A B LTD", "A B LLP", True),
    ],
)
def test_company_likeness(a, b, same):
    assert (names.company_likeness(names.company_words(a), names.company_words(b)) >= variants.COMPANY_LIKENESS) == same


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2, j - 2] + 1)
            d[i, j] = best
    assert names.osa(a, b) == min(d[len(a), len(b)], 4)


def test_bands_meet_the_collision_curve(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(400)]
    pairs = [(w, w[:5] + "zz" + w[7:]) for w in words]
    bands = banding.bands_for(0.5, 3, 0.97)
    df = spark.createDataFrame([(2 * i + k, w) for i, p in enumerate(pairs) for k, w in enumerate(p)], "id bigint, name string")
    codes = banding.band_codes(df, "id", "name", 2, bands, 3).select("id", "band", "code").toPandas()
    by = codes.groupby("id").apply(lambda g: set(zip(g.band, g.code, strict=True)), include_groups=False)
    assert np.mean([bool(by[2 * i] & by[2 * i + 1]) for i in range(len(pairs))]) > 0.97


def test_star_clusters(spark):
    nodes = spark.createDataFrame([(i, w) for i, w in enumerate([9, 2, 1, 5, 1, 0])], "id bigint, weight int")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 4, 1.0)], "a bigint, b bigint, likeness double")
    got = {r.id: r.center for r in banding.star_clusters(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_name_variants_of_small_tables(spark):
    officers = spark.createDataFrame(
        [
            (1, "KELACKGATE, Lars", (5, 1960)), (2, "Lars Kelackgaet", (5, 1960)), (3, "KELACKGATE, Lars", (6, 1971)), (4, None, None), (5, "", (1, 1950)),
            (6, "Dr. KELACKGATE, L", (5, 1960)), (6, "Dr. KELACKGATE, L", (5, 1960)), (7, "漢字", (5, 1960)),
        ],
        "officer_row_id bigint, name string, date_of_birth struct<month:int,year:int>",
    )
    appointments = spark.createDataFrame(
        [
            (1, ("BRADOMDINE STAFFING LTD", "1")), (2, ("Bradomdine Stafing Limited", None)), (3, ("BRADOMDINE MARINE LTD", "2")), (4, None), (5, ("", None)), (6, ("Ltd", None)),
        ],
        "appointment_id bigint, appointed_to struct<company_name:string,company_number:string>",
    )
    got = {(r.entity_kind, r.id_a, r.id_b) for r in variants.name_variants(officers, appointments).collect()}
    assert got == {("officer", 1, 2), ("officer", 1, 6), ("officer", 2, 6), ("company", 1, 2)}


@pytest.mark.parametrize(("a", "b"), [("wilanvaen", "wlianvane"), ("marapdpine", "marappdien"), ("ostephaxwell", "ostefakswel"), ("o maraxwick", "omaraxwcik")])
def test_surnames_with_swaps_and_sounds_are_linked(spark, a, b):
    assert names.same_surname(a, b) > 0
    links = variants.surname_links(spark.createDataFrame([(a, 2), (b, 1)], "surname string, n bigint"))
    assert {(a, b), (b, a)} <= {(r.surname, r.linked) for r in links.collect()}


def test_no_surname_in_a_crowd_is_missed(spark):
    rng = random.Random(4)
    crowd = sorted({"walwe" + "".join(rng.choice("hmckx") for _ in range(rng.randint(0, 4))) for _ in range(350)} | {"wal we", "wal", "wla", "x" * 90, "x" * 91 + "y" + "x" * 400, "x" * 400 + "yx" + "x" * 91, "a" * 30 + "bc", "a" * 30 + "cb"})
    want = {(a, b) for a in crowd for b in crowd if names.same_surname(a, b) > 0}
    got = variants.surname_links(spark.createDataFrame([(w, 1) for w in crowd], "surname string, n bigint")).collect()
    assert {(r.surname, r.linked) for r in got} == want and len(got) == len(want)


def test_all_colliding_companies_are_paired(spark):
    typed = [f"Optical {a}{b}" for a in ("Frostadver", "Frostadvre", "Frostdaver", "Frosatdver") for b in (" Holdings", " Hldgs", " Holdigns", " Holdinsg", "Holdings")]
    keys = [" ".join(sorted(names.company_words(n))) for n in typed]
    df = spark.createDataFrame([(i, k.split(), 0, 7) for i, k in enumerate(keys)], "node int, words array<string>, band int, code int")
    got = {tuple(r) for r in banding.colliding_pairs(df, "node", "words", variants.may_be_one_company).collect()}
    alike = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if names.company_likeness(tuple(keys[i].split()), tuple(keys[j].split())) > 0}
    assert len(alike) > 6 * len(keys) and alike <= got


def test_no_likeness_of_companies_is_dropped(spark):
    rng = random.Random(11)
    words = "optical holdings frostadver management partners north sea drainage bradom services abc investments".split()

    def other(w):
        k, i = rng.randrange(6), rng.randrange(max(len(w) - 1, 1))
        return [w, w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w[:i] + w[i + 1 :], w[: max(3, len(w) // 2)], w[0] + "".join(c for c in w[1:] if c not in "aeiou"), w[:3] + "s"][k]

    pairs = set()
    for _ in range(4000):
        a = rng.sample(words, rng.randint(1, 4))
        b = [other(w) for w in a]
        if len(b) > 1 and rng.random() < 0.4:
            b = [b[1] + b[0] if rng.random() < 0.5 else b[0] + b[1], *b[2:]]
        pairs |= {(" ".join(sorted(x)), " ".join(sorted(y))) for x, y in ((a, b), (b, a))}
    pairs = [p for p in pairs if names.company_likeness(tuple(p[0].split()), tuple(p[1].split())) > 0]
    assert len(pairs) > 1500
    df = spark.createDataFrame([(a.split(), b.split()) for a, b in pairs], "wa array<string>, wb array<string>")
    assert df.where(~variants.may_be_one_company(df.wa, df.wb)).collect() == []
    far = [("bradom marine", "bradom staffing"), ("bradom", "bradom marine staffing"), ("frostadver marine", "frostadver media")]
    far = spark.createDataFrame([(a.split(), b.split()) for a, b in far], "wa array<string>, wb array<string>")
    assert far.where(variants.may_be_one_company(far.wa, far.wb)).count() == 0


def test_companies_whose_weightiest_words_differ(spark):
    official = ["FROSTADVER OPTICAL HOLDINGS LTD", *(f"FROSTADVER {w} LTD" for w in ("MARINE", "STAFFING", "CATERING", "HAULAGE"))]
    typed = ["Optiacl Holdings Frostadver", "Optiacl Brewing Limited", "Optiacl Joinery Limited", "Holdings Tirvaul", "Holdings Gralmoor", "Holdings Peskell"]
    df = spark.createDataFrame([(i, n, i < len(official)) for i, n in enumerate(official + typed)], "id int, name string, registered boolean")
    cluster = {r.name: r.cluster for r in variants.company_clusters(df).collect()}
    assert cluster[typed[0]] == cluster[official[0]]
    assert len({cluster[n] for n in official}) == len(official)


# -- matching


def brute_marginals(s):
    """Marginals of all one-to-one assignments, by enumeration."""
    n, m = s.shape
    weight, total = np.zeros_like(s), 0.0

    def go(i, used, w, chosen):
        nonlocal total
        if i == n:
            total += w
            for c in chosen:
                weight[c] += w
            return
        go(i + 1, used, w, chosen)
        for j in range(m):
            if j not in used and np.isfinite(s[i, j]):
                go(i + 1, used | {j}, w * np.exp(s[i, j]), [*chosen, (i, j)])

    go(0, frozenset(), 1.0, [])
    return weight / total


def test_propagation_is_exact_on_trees(spark):
    s = np.full((3, 3), -np.inf)
    s[0, 0], s[0, 1], s[1, 1], s[2, 1], s[2, 2] = 1.0, 2.0, 0.5, -1.0, 3.0
    df = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(3) for j in range(3) if np.isfinite(s[i, j])], "i bigint, j bigint, s double")
    want = brute_marginals(s)
    for r in propagate(df).collect():
        assert 1 / (1 + np.exp(-r.belief)) == pytest.approx(want[r.i, r.j], abs=5e-3)
    assert propagate(df.limit(0)).count() == 0


def shuffles(spark, run):
    """Planned shuffles of each execution in run: the driver keeps a thread for each, and plans again after each."""
    spark.range(1).count()
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def listed():
        bus.waitUntilEmpty()
        executions = store.executionsList()
        return [executions.apply(k).executionId() for k in range(executions.size())]

    last = max(listed())
    run()
    graphs = [store.planGraph(k).allNodes() for k in listed() if k > last]
    return [sum(g.apply(k).name() == "Exchange" for k in range(g.size())) for g in graphs]


def test_shuffles_of_matching(spark):
    each = shuffles(spark, lambda: entry.queries()["p3_found"](spark, "/root/testdata/sf0.001").count())
    assert max(each) <= 16
    assert sum(each) <= 170


def test_names_that_fit(spark):
    # a pair of names fits if two of its persons' years are equal or one of them has none
    years = [None, 1960, 1961]
    sides = [spark.createDataFrame([(k, f"smith{'x' * k}", "john", y, None) for k, y in enumerate(years)], "name bigint, surname string, givens string, year int, month int") for _ in "ab"]
    keys = variants.surname_key_table(sides[0]).withColumn("keys", F.array(F.lit(0).cast("bigint")))
    left, right = matching._names(sides[0], "left", "right"), matching._names(sides[1], "right", "left")
    met = variants.meeting_names(left.select(F.col("name").alias("a"), "surname", "blocks"), right.select((F.col("name") + 10).alias("b"), "surname", "blocks"), keys)
    want = {(a, b + 10) for a, x in enumerate(years) for b, y in enumerate(years) if x is None or y is None or x == y}
    assert {(r.a, r.b) for r in met.collect()} == want


# -- addresses


@pytest.mark.parametrize(
    ("lines", "number", "unit", "postcode", "street"),
    [
        (("c/o Brackwater Filing,207 Gileshaw Court", None, "North Drayton", "QL14 0DP"), "207", "", "QL140DP", "gileshaw"),
        (("Mercer Works,Flat 11,181 Morickmore Drive", None, None, "XMI9 IZS"), "181", "11", "XM191ZS", "morickmore"),
        (("Crodolham Place 194", None, None, None), "194", "", "", "crodolham"),
        (("56D Ostanstow Road", "Hollow Mill", "Kelford", ""), "56d", "", "", "ostanstow"),
        (("190, Daribthorp Road., Milford, XG28 9PA", None, None, None), "190", "", "XG289PA", "daribthorp"),
    ],
)
def test_parts_of_addresses(lines, number, unit, postcode, street):
    p = parts_of(*lines)
    assert (p.number, p.unit, p.postcode, p.street) == (number, unit, postcode, street)


def test_no_address():
    assert parts_of(None, "", "  ", None) is None


def test_same_place(spark):
    streets = ["morickmore", "gileshaw", "daribthorp", "ostanstow", "luskavden", "torarholt"]
    data, k = [], 0
    for i, s in enumerate(streets):
        for n in (7, 19):
            for kind, town in (("Road", "Kelford"), ("Rd", "Kelford"), ("rd.", "KELFORD")):
                k += 1
                data.append((f"{k:08d}", (f"{n} {s.title()} {kind}", None, town, f"QX{i + 10} 1AB", None), 1))
    data += [("90", (None, None, None, None, None), 1), ("91", None, 1), ("92", ("7 Morickmoer Road", None, "Kelford", "QX10 1AB", None), 1), ("92", ("7 Morickmoer Road", None, "Kelford", "QX10 1AB", None), 1)]
    schema = "company_number string, registered_office_address struct<address_line_1:string,address_line_2:string,locality:string,postal_code:string,country:string>, retrieved_at int"
    df = spark.createDataFrame(data, schema)
    got = {tuple(r) for r in places.same_place(df).collect()}
    want = {(f"{3 * g + a + 1:08d}", f"{3 * g + b + 1:08d}") for g in range(12) for a in range(3) for b in range(a + 1, 3)}
    want |= {(f"{a:08d}", "92") for a in (1, 2, 3)}
    assert got == want


def test_surnames_meet_within_blocks_only(spark):
    """200 alike surnames, of 20 birth dates: all alike ones of one date meet, and none of other dates does."""
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("ab", k=3)) + "landerby" for _ in range(8)} | {"smith", "smyth", "li"})
    rows = [(i, rng.choice(words), [i % 20]) for i in range(200)]
    each = spark.createDataFrame(rows, "id bigint, surname string, blocks array<int>")
    keys = variants.surname_key_table(each)
    got = {(r.a, r.b) for r in variants.meeting_names(each.withColumnRenamed("id", "a"), each.withColumnRenamed("id", "b"), keys).collect()}
    same = [(i, j, s, t) for i, s, b in rows for j, t, c in rows if i != j and b == c]
    assert {(i, j) for i, j, s, t in same if names.same_surname(s, t) > 0} <= got <= {(i, j) for i, j, _, _ in same}


# -- mixing


def test_raking_holds_sources_and_bounds():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(s, lang, t, int(rng.integers(50, 5000))) for s in "abc" for lang in ("en", "de") for t in ("x", "y")], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame({"source": list("abc"), "target_weight": [0.5, 0.3, 0.2], "max_repeats": [1, 3, 2]})
    out = mixing.rake(cells, targets)
    got = (out["ratio"] * out["tokens"]).groupby(out["source"]).sum()
    assert np.allclose(got / got.sum(), [0.5, 0.3, 0.2], atol=1e-6)
    assert (out["ratio"] <= out["max_repeats"] + 1e-9).all()


def test_mix_of_the_documents(spark):
    documents, targets = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "mix_target"))
    mixed = mixing.mix(documents, targets).toPandas()
    t = targets.toPandas().set_index("source")
    assert mixed["doc_id"].is_unique
    assert (mixed["copies"] <= mixed["source"].map(t["max_repeats"])).all()
    share = (mixed["copies"] * mixed["n_tokens"]).groupby(mixed["source"]).sum()
    share /= share.sum()
    # A source's share is right up to the length of one document.
    assert (share - t["target_weight"]).abs().max() < 0.02
    empty = mixing.mix(documents.limit(0), targets)
    assert empty.count() == 0 and empty.columns == ["doc_id", "source", "n_tokens", "copies"]


def _told_by_dense_models(texts, labels):
    """(language, topic) of texts by models that are fitted on all of them at once, with dense tables."""
    flat, sizes = tokens.encoder(tokens.BYTE_BPE_50K).encode(texts)
    tf = np.log1p(mixing.features(flat, sizes).astype(float))
    often = pd.Series(labels).value_counts()
    languages = sorted(often.index[often >= 0.005 * len(labels)])
    own = np.array([languages.index(x) if x in languages else -1 for x in labels])
    for _ in range(2):
        total = np.stack([tf[own == k].sum(0) + 0.1 for k in range(len(languages))], 1)
        own = (tf @ np.log(total / total.sum(0)) + np.log([(own == k).sum() + 1.0 for k in range(len(languages))])).argmax(1)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    vectors = unit(tf * np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))))
    vectors = unit(vectors - np.stack([vectors[own == k].mean(0) for k in range(len(languages))])[own])
    centers = vectors[:1]
    while len(centers) < mixing.TOPICS:
        centers = np.concatenate((centers, vectors[(vectors @ centers.T).max(1).argmin()][None]))
    for _ in range(mixing.FIT_ROUNDS):
        near = (vectors @ centers.T).argmax(1)
        centers = unit(np.stack([vectors[near == k].sum(0) for k in range(mixing.TOPICS)]))
    return [languages[k] for k in own], (vectors @ centers.T).argmax(1)


def test_mixing_models_are_fitted_on_all_documents(spark):
    """4,000 documents, of which the 24 in Polish would be too few of any 2,000 to be told by, and none is left out of the topics."""
    rng = random.Random(4)
    words = {"en": "the court filed a notice of charge against company and officers in london".split(), "pl": "spółka złożyła wniosek przed sądem rejonowym w warszawie przeciwko zarządowi".split()}
    labels = ["pl" if i % 160 == 7 else "en" for i in range(4000)]
    texts = [" ".join(rng.choices(words[x], k=rng.randint(4, 30))) for x in labels]
    want = _told_by_dense_models(texts, labels)
    rows = [(i, x, "a", t) for i, (x, t) in enumerate(zip(labels, texts, strict=True))]
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    for parts in (1, 7):
        documents = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string").repartition(parts)
        got = mixing.cells_of(documents, targets).toPandas().sort_values("doc_id")
        assert got["lang"].tolist() == want[0] and got["topic"].tolist() == want[1].tolist()


def test_runs_and_long_words_in_reasonable_time(library):
    rng = random.Random(9)
    texts = ["a" * 5001, "ab" * 3000 + "a", "".join(rng.choice("etaoinshrdlu") for _ in range(40_000)), "aaa bbb", "x", "", None]
    flat, sizes = tokens.Encoder(tokens.BYTE_BPE_50K).encode(texts)
    ends = np.cumsum(sizes)
    for t, size, end in zip(texts, sizes, ends, strict=True):
        assert flat[end - size : end].tolist() == (library.encode(t, add_special_tokens=False).ids if t else [])


def test_pair_tables_of_any_size():
    n = 300_000
    left, right = np.arange(n, dtype=np.int32) % 5000, np.arange(n, dtype=np.int32) // 5000
    table = tokens.PairTable(left, right)
    assert (table.rank(left, right) == np.arange(n)).all() and table.rank(np.array([4999]), np.array([9999]))[0] == 2**31 - 1


@pytest.mark.parametrize(("text", "code"), [("M1 1AE", "M11AE"), ("SW1A 1AA", "SW1A1AA"), ("W1A 0AX", "W1A0AX"), ("B33 8TH", "B338TH"), ("EC1A 1BB", "EC1A1BB"), ("xmi9 izs", "XM191ZS"), ("nowhere", "")])
def test_postcodes_of_all_forms(text, code):
    assert postcode_of(text, whole=True)[0] == code
    assert postcode_of(f"7 Mill Road, {text.upper()}")[0] == (code if code != "XM191ZS" else code)
    assert postcode_of("Flat B3 2nd Floor")[0] == ""


@pytest.mark.parametrize(("a", "b"), [("ИВАНОВ, Иван", "Иван Ивановв"), ("ΠΑΠΑΔΟΠΟΥΛΟΣ, Νίκος", "Νικος Παπαδόπουλος"), ("山本太郎左衛門", "山本太郞左衛門")])
def test_names_of_other_scripts_are_linked(spark, a, b):
    officers = spark.createDataFrame([(1, a, (5, 1960)), (2, b, (5, 1960)), (3, a, (6, 1971))], "officer_row_id bigint, name string, date_of_birth struct<month:int,year:int>")
    firms = spark.createDataFrame([(1, ("株式会社トヨタ自動車", "1")), (2, ("ООО Ромашка Плюс", "2")), (3, ("ООО Ромашка Плюс.", None))], "appointment_id bigint, appointed_to struct<company_name:string,company_number:string>")
    got = {(r.entity_kind, r.id_a, r.id_b) for r in variants.name_variants(officers, firms).collect()}
    assert got == {("officer", 1, 2), ("company", 2, 3)}
    members = {(r.entity_kind, r.id): r for r in variants.name_members(officers, firms).collect()}
    assert len(members) == 6 and members["officer", 1].cluster == members["officer", 2].cluster != members["officer", 3].cluster


def test_clusters_of_long_chains(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(12)], "id bigint, weight int")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)], "a bigint, b bigint, likeness double")
    assert {r.center for r in banding.star_clusters(nodes, edges).collect()} == {11}


def test_stuffed_documents_by_phrases_and_templates_not_clauses(spark):
    found = {r.doc_id for r in stuffed.stuffed_pages(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    phrases, templates, clauses = {325, 380, 554, 562, 669, 690, 902, 977}, {251, 711, 835, 995}, {227, 323, 381}
    assert phrases | templates <= found and not clauses & found


def test_marginals_of_the_mix(spark):
    documents, targets = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "mix_target"))
    for r in mixing.marginals(documents, targets).collect():
        assert abs(r.wanted_share - r.actual_share) < {"source": 1e-3, "topic": 0.02, "lang": 0.03}[r.kind], r


def test_shapes_of_odd_texts(spark):
    long = "The lender agreed to extend the facility until Monday. " * 30_000
    texts = [None, "", " \n\t ", "a", "!", "🙂 🙂", "\ud83d"[:0], "http://x.example", "no stop at all but few words", "https://a.example/?k=x\n" * 3000, long, "x" * 300_000, "1.", "漢字。" * 50, "buy cheap loans, " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, texts[9])], "doc_id int, text string").withColumn("shape", F.lit("clash"))
    got = {r.doc_id: r for r in stuffed.page_shapes(df.withColumn("doc_id", F.col("doc_id").cast("bigint"))).collect()}
    assert {i for i, r in got.items() if r.stuffed} == {7, 9, 14} and not {0, 1, 2} & set(got)
    assert got[10].chars == len(long) - 30_000 and got[3].chars == 1
    assert stuffed.stuffed_pages(df).count() == 3


def test_pieces_of_a_text_are_told_as_the_whole(monkeypatch):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["Visit us. It is good.", "cheap loans cheap loans cheap loans now", "https://x.example/a", "Officers", "Need loans in Rome? Our loans Rome team offers loans."]) for _ in range(60)) for _ in range(40)]
    whole = stuffed.stuffed_characters(texts)
    monkeypatch.setattr(stuffed, "BLOCK_CHARS", 100)
    pieces = stuffed.stuffed_characters(texts)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
