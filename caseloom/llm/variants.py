"""Variant spellings of persons' and companies' names.

Distinct spellings, not rows, are compared: companies that collide in MinHash
bands, and persons of one birth date (or first letter of a given name, where one
has no date) whose surnames become the same by deleting letters, which no pair
that is alike escapes. All such pairs are verified by Monge-Elkan likeness, and
clustered by stars. Entries without birth date join the one person their name
fits. Companies: a spelling typed by hand goes to
the registered name it is likest to; those without one are clustered among
themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm import names as N
from caseloom.llm.banding import band_codes, bands_for, colliding_pairs, gram_weights, star_clusters
from caseloom.llm.spread import dealt, spread
from caseloom.session import cut

#: Likeness of q-gram sets at which the bands must find a pair, with what recall, and rows per band.
COMPANY_SIMILARITY, RECALL = 0.45, 0.96
COMPANY_ROWS = 3
#: Words taken as given names stand at least so often after a comma; others are decided by form.
GIVEN_MIN = 5
#: Least Monge-Elkan likeness of persons with one birth date, and of those where one has none.
DATED_LIKENESS, UNDATED_LIKENESS = 0.7, 0.85
COMPANY_LIKENESS = 0.6


def given_words(rows: DataFrame) -> DataFrame:
    """(word): those that stand as given names in names with a comma, far more often than as surnames."""

    @F.pandas_udf("array<string>")
    def parts(names: pd.Series) -> pd.Series:
        return names.map(lambda n: ["s" + N.person_parts(n)[0], *("g" + w for w in N.person_parts(n)[1] if len(w) > 1)])

    words = rows.where(F.col("name").contains(",")).select(F.explode(parts("name")).alias("w"))
    counts = words.groupBy(F.expr("substring(w, 2)").alias("word")).agg(
        F.count_if(F.col("w").startswith("g")).alias("given"), F.count_if(F.col("w").startswith("s")).alias("surname")
    )
    return counts.where((F.col("given") >= GIVEN_MIN) & (F.col("given") > 3 * F.col("surname"))).select("word")


def person_profiles(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(side, id, name, year, month) -> the same with surname, givens (joined by blanks) and profile, the id of their combination.

    Rows of different sides never meet, so several lists of persons can be worked on together.

    known: the given words that tell where the surname of a name without comma
    stands. Rows whose name has no letters or digits are left out. A month
    without a year, or out of 1..12, counts as missing.
    """
    known = cut(given_words(rows)) if known is None else known

    @F.pandas_udf("surname string, givens string")
    def parse(names: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        parts = [N.person_parts(n, frozenset(w for w in (a, b) if w)) for n, a, b in zip(names, first, last, strict=True)]
        return pd.DataFrame({"surname": [p[0] for p in parts], "givens": [" ".join(p[1]) for p in parts]})

    @F.pandas_udf("first string, last string")
    def ends(names: pd.Series) -> pd.DataFrame:
        words = [[w for w in N.fold(n).split() if w not in N.TITLES] or [""] for n in names]
        return pd.DataFrame({"first": [w[0] for w in words], "last": [w[-1] for w in words]})

    # A name without comma is looked up by its outer words, once for all rows that have it.
    bare = dealt(rows.select("name").where(~F.col("name").contains(",")).distinct(), "name").withColumn("e", ends("name")).select("name", "e.*")
    for end in ("first", "last"):
        bare = bare.join(known.select(F.col("word").alias(end), F.col("word").alias(f"known_{end}")), end, "left")
    bare = bare.select("name", parse("name", "known_first", "known_last").alias("p"))
    none = F.lit(None).cast("string")
    with_comma = rows.where(F.col("name").contains(",")).withColumn("p", parse("name", none, none))
    rows = with_comma.unionByName(rows.where(~F.col("name").contains(",")).join(bare, "name"))

    year = F.col("year").cast("int")
    month = F.when(year.isNotNull() & F.col("month").between(1, 12), F.col("month").cast("int"))
    parsed = rows.select("side", "id", "name", year.alias("year"), month.alias("month"), "p")
    return parsed.select("side", "id", "name", "year", "month", "p.surname", "p.givens").where("surname <> ''").withColumn(
        "profile", F.xxhash64("side", "surname", "givens", F.coalesce("year", F.lit(0)), F.coalesce("month", F.lit(0)))
    )


def deletion_keys(word: str, most: int) -> set[str]:
    """What word becomes by deleting up to most letters: two words at most that many edits apart (see names.osa), most being 2 or less, have one in common.

    Keys are made of a word's beginning: what two words have in common after the
    deletions begins alike too.
    """
    out = last = {word[:20]}
    for _ in range(most):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return {x[:18] for x in out}


def surname_keys(surname: str) -> list[str]:
    """Keys of a surname: two that same_surname finds alike have one in common."""
    n, plain = len(surname), surname.replace(" ", "")
    most = 0 if n < 4 else 1 if n < 7 else 2
    return [*deletion_keys(plain, most), *("~" + k for k in (deletion_keys(N.sounded(plain), most - 1) if most else ()))]


@F.pandas_udf(T.DoubleType())
def person_like(sa: pd.Series, ga: pd.Series, sb: pd.Series, gb: pd.Series) -> pd.Series:
    return pd.Series(
        [N.person_likeness((a, tuple(b.split())), (c, tuple(d.split()))) for a, b, c, d in zip(sa, ga, sb, gb, strict=True)], dtype="float64"
    )


person_like = person_like.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def given_letters(givens: pd.Series) -> pd.Series:
    """First letters a first given name may be known by; '' for none."""

    def letters(g: str) -> list[str]:
        words = g.split()[:2]
        return sorted({w[0] for w in words} | {f[0] for w in words for f in N._FULL.get(w, ())} | {s[0] for w in words for s in N.SHORT_FORMS.get(w, "").split()}) or [""]

    return givens.map(letters)


def surname_key_table(surnames: DataFrame) -> DataFrame:
    """(surname) -> (surname, keys), made once for each surname; keys are hashes of surname_keys."""

    @F.pandas_udf("array<string>")
    def made(words: pd.Series) -> pd.Series:
        return words.map(surname_keys)

    each = dealt(surnames.select("surname").distinct(), "surname").select("surname", made("surname").alias("keys"))
    return each.select("surname", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys"))


def meeting_names(left: DataFrame, right: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, surname, blocks), (b, surname, blocks) -> (a, b): all of one block whose surnames same_surname finds alike, and some that it doesn't.

    keys: the surname_key_table of both. Surnames meet by what deletions make of
    them, within a block only: links of all surnames with all others would grow
    with the square of their number.
    """

    def keyed(rows: DataFrame, end: str) -> DataFrame:
        each = rows.join(keys, "surname").select(end, "keys", F.explode("blocks").alias("block"))
        return each.select(end, "block", F.explode("keys").alias("key")).select(end, F.xxhash64("block", "key").alias("key"))

    return keyed(left, "a").join(keyed(right, "b"), "key").where("a <> b").select("a", "b").distinct()


def surname_links(surnames: DataFrame) -> DataFrame:
    """(surname, n) -> (surname, linked, likeness) both ways, each with itself as well: all that same_surname finds alike, for short lists of surnames."""

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([N.same_surname(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    like = like.asNondeterministic()  # a filter on it is then not put below, and it is computed once
    rows = surnames.select("surname", F.array(F.lit("")).alias("blocks"))
    met = meeting_names(rows.withColumn("a", F.col("surname")), rows.withColumn("b", F.col("surname")), surname_key_table(surnames))
    good = met.select(F.col("a").alias("surname"), F.col("b").alias("linked"), like("a", "b").alias("likeness")).where("likeness > 0")
    return good.unionByName(surnames.select("surname", F.col("surname").alias("linked"), F.lit(1.0).alias("likeness")))


def person_clusters(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of person_profiles and the surname_key_table of their surnames -> (side, id, name, year, month, surname, givens, cluster): entries that are one person's, by name and birth date.

    Entries with different full birth dates are never one person. An entry
    without birth date joins the person that its name fits best if there is
    one; if it fits two alike, it stays with its likes that have no date either.
    """
    profiles = cut(
        parsed.groupBy("profile").agg(
            F.first("side").alias("side"), F.first("surname").alias("surname"), F.first("givens").alias("givens"), F.first("year").alias("year"), F.first("month").alias("month"), F.count(F.lit(1)).alias("n")
        )
    )
    # Entries meet by month; those without one under every month, and among themselves under 0.
    months = F.when(F.col("month").isNotNull(), F.array("month")).otherwise(F.sequence(F.lit(0), F.lit(12)))
    born = profiles.where("year is not null").select("profile", "surname", "month", F.transform(months, lambda m: F.xxhash64("side", "year", m)).alias("blocks"))
    met = meeting_names(born.withColumnRenamed("profile", "a"), born.withColumnRenamed("profile", "b"), keys).where("a < b")
    first, second = (profiles.select(F.col("profile").alias(x), F.col("surname").alias(f"s{x}"), F.col("givens").alias(f"g{x}")) for x in "ab")
    met = met.join(first, "a").join(second, "b").select("a", "b", person_like("sa", "ga", "sb", "gb").alias("likeness")).where(F.col("likeness") >= DATED_LIKENESS)
    # Full dates and full given names lead.
    weight = (
        F.when(F.col("month").isNotNull(), 1000).otherwise(0) + F.least("n", F.lit(400)).cast("int") + 20 * F.least(F.length("givens"), F.lit(20))
    ).cast("int")
    dated = profiles.where("year is not null").select(F.col("profile").alias("id"), weight.alias("weight"))
    clusters = star_clusters(dated, met)

    # Names of dated persons: how many persons bear each.
    held = profiles.join(clusters.withColumnRenamed("id", "profile"), "profile")
    borne = held.groupBy("side", "surname", "givens").agg(F.min("center").alias("person"), F.max("center").alias("other_person"))
    borne = cut(borne.withColumn("b", F.xxhash64("side", "surname", "givens")))
    undated = profiles.where("year is null")
    letters = F.transform(given_letters("givens"), lambda x: F.xxhash64("side", x)).alias("blocks")
    asked = meeting_names(undated.select(F.col("profile").alias("a"), "surname", letters), borne.select("b", "surname", letters), keys)
    asked = cut(
        asked.join(first, "a").join(borne.select("b", F.col("surname").alias("sb"), F.col("givens").alias("gb"), "person", "other_person"), "b")
        .select(F.col("a").alias("profile"), "person", "other_person", person_like("sa", "ga", "sb", "gb").alias("likeness"))
        .where(F.col("likeness") >= UNDATED_LIKENESS)
    )
    best = asked.groupBy("profile").agg(F.max("likeness").alias("most"))
    fits = (
        asked.join(best, "profile").where("likeness >= most - 0.02")
        .groupBy("profile").agg(F.min(F.least("person", "other_person")).alias("center"), F.max(F.greatest("person", "other_person")).alias("last"))
    )
    joined = fits.where("center = last").select(F.col("profile").alias("id"), "center")
    rest = cut(undated.join(joined.withColumnRenamed("id", "profile"), "profile", "left_anti"))
    alike = meeting_names(rest.select(F.col("profile").alias("a"), "surname", letters), rest.select(F.col("profile").alias("b"), "surname", letters), keys).where("a < b")
    alike = alike.join(first, "a").join(second, "b").select("a", "b", person_like("sa", "ga", "sb", "gb").alias("likeness")).where(F.col("likeness") >= UNDATED_LIKENESS)
    loose = star_clusters(rest.select(F.col("profile").alias("id"), weight.alias("weight")), alike)
    every = cut(clusters.unionByName(joined).unionByName(loose))
    return parsed.join(every.withColumnRenamed("id", "profile"), "profile").select(
        "side", "id", "name", "year", "month", "surname", "givens", F.col("center").alias("cluster")
    )


def may_be_one_company(wa: Column, wb: Column) -> Column:
    """Whether two lists of telling words may be alike: true wherever company_likeness is above 0, and computed in the JVM.

    Swaps count one in company_likeness and two here. An abbreviation has its
    word's first letter and is as many edits away as it is shorter, with an s at
    its end two more at most; one with a typo is like its word's beginning.
    """

    def like(x: Column, y: Column) -> Column:
        m, n = F.length(x), F.length(y)
        least = F.least(m, n)
        typo = (F.abs(m - n) <= 2) & F.levenshtein(x, y, 4).between(0, F.when(least < 4, 0).when(least < 8, 2).otherwise(4))
        short, full = F.when(m < n, x).otherwise(y), F.when(m < n, y).otherwise(x)
        cut_short = F.levenshtein(x, y) <= F.abs(m - n) + F.when(short.endswith("s"), 2).otherwise(0)
        mistyped = (least >= 4) & (F.levenshtein(short, F.left(full, least), 2) >= 0)
        return typo | ((F.left(x, F.lit(1)) == F.left(y, F.lit(1))) & (m != n) & (mistyped | cut_short))

    def all_like(words: Column, others: Column) -> Column:
        return F.forall(words, lambda x: F.exists(others, lambda y: like(x, y)))

    def alone(words: Column, others: Column) -> Column:
        return F.size(F.filter(words, lambda x: ~F.exists(others, lambda y: like(x, y))))

    def glued(few: Column, many: Column) -> Column:
        """One word of few is two of many, all others are alike."""
        whole = F.exists(few, lambda w: F.exists(many, lambda x: w.startswith(x) | F.exists(many, lambda y: F.levenshtein(w, F.concat(x, y), 4) >= 0)))
        return (alone(few, many) <= 1) & (alone(many, few) <= 2) & whole

    more = F.size(wb) - F.size(wa)
    joined = F.levenshtein(F.array_join(wa, ""), F.array_join(wb, ""), 4) >= 0
    return (
        F.when(more == 0, all_like(wa, wb) & all_like(wb, wa))
        .when(more == 1, joined | glued(wa, wb))
        .when(more == -1, joined | glued(wb, wa))
        .otherwise(joined)
    )


def company_clusters(rows: DataFrame) -> DataFrame:
    """(id, name, registered BOOLEAN) -> (id, name, cluster): spellings of one company.

    registered says that the row's name is the register's own spelling. Names
    without letters or digits are left out; legal forms don't tell companies apart.
    """

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        return names.map(lambda n: " ".join(sorted(N.company_words(n))))

    spellings = rows.where("name is not null").groupBy("name").agg(F.max("registered").alias("registered"), F.count(F.lit(1)).alias("n"))
    keyed = cut(spread(spellings, "name").select("name", "registered", "n", key("name").alias("key")).where("key <> ''").withColumn("node", F.xxhash64("key")))
    nodes = cut(keyed.groupBy("node").agg(F.first("key").alias("key"), F.max("registered").alias("registered"), F.sum("n").alias("n")))
    weights = gram_weights(nodes, "key", 3)
    bands = bands_for(COMPANY_SIMILARITY, COMPANY_ROWS, RECALL)
    codes = cut(band_codes(spread(nodes, "node"), "node", "key", 3, bands, COMPANY_ROWS, weights).join(nodes.select("node", "registered", F.split("key", " ").alias("words")), "node"))
    named = nodes.select("node", "key")

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([N.company_likeness(tuple(x.split()), tuple(y.split())) for x, y in zip(a, b, strict=True)], dtype="float64")

    like = like.asNondeterministic()
    typed = codes.where("not registered").select(F.col("node").alias("a"), F.col("words").alias("wa"), "band", "code")
    official = codes.where("registered").select(F.col("node").alias("b"), F.col("words").alias("wb"), "band", "code")

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(named.withColumnsRenamed({"node": "a", "key": "ka"}), "a").join(named.withColumnsRenamed({"node": "b", "key": "kb"}), "b")
        return full.select("a", "b", like("ka", "kb").alias("likeness")).where(F.col("likeness") >= COMPANY_LIKENESS)

    # What collided but can't be alike is dropped before it is shuffled.
    found = verify(typed.join(official, ["band", "code"]).where(may_be_one_company(F.col("wa"), F.col("wb"))).select("a", "b").distinct())
    ranked = found.withColumns(
        {
            "k": F.row_number().over(Window.partitionBy("a").orderBy(F.desc("likeness"), "b")),
            "next": F.lead("likeness").over(Window.partitionBy("a").orderBy(F.desc("likeness"), "b")),
        }
    )
    attached = ranked.where("k = 1 and (next is null or next < likeness)").select(F.col("a").alias("node"), F.col("b").alias("center"))
    attached = cut(attached)
    loose = cut(nodes.where("not registered").join(attached, "node", "left_anti"))
    loose_codes = codes.join(loose.select("node"), "node")
    edges = verify(colliding_pairs(loose_codes, "node", "words", may_be_one_company))
    stars = star_clusters(loose.select(F.col("node").alias("id"), F.col("n").cast("int").alias("weight")), edges).withColumnRenamed("id", "node")
    own = nodes.where("registered").select("node", F.col("node").alias("center"))
    every = own.unionByName(attached).unionByName(stars)
    spelled = keyed.select("name", "node").join(every, "node").select("name", F.col("center").alias("cluster"))
    return rows.select("id", "name").distinct().join(spelled, "name")


def variant_pairs(clustered: DataFrame) -> DataFrame:
    """(id, name, cluster) -> (id_a, id_b): rows of one cluster whose names differ as strings, the smaller id first."""
    clustered = cut(clustered)
    spelled = clustered.select("cluster", "name").distinct()
    pairs = spelled.alias("x").join(spelled.alias("y"), F.expr("x.cluster = y.cluster and x.name < y.name")).select(
        F.col("x.cluster").alias("cluster"), F.col("x.name").alias("na"), F.col("y.name").alias("nb")
    )
    rows = clustered.select("cluster", "name", "id").distinct()
    out = pairs.join(rows.withColumnsRenamed({"name": "na", "id": "ia"}), ["cluster", "na"]).join(rows.withColumnsRenamed({"name": "nb", "id": "ib"}), ["cluster", "nb"])
    return out.where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def officer_rows(officers: DataFrame) -> DataFrame:
    return officers.select(
        F.lit("officer").alias("side"), F.col("officer_row_id").alias("id"), "name", F.col("date_of_birth.year").alias("year"), F.col("date_of_birth.month").alias("month")
    ).where("id is not null").distinct()


def company_rows(appointments: DataFrame) -> DataFrame:
    return appointments.select(
        F.col("appointment_id").alias("id"), F.col("appointed_to.company_name").alias("name"), F.col("appointed_to.company_number").isNotNull().alias("registered")
    ).where("id is not null").distinct()


def name_clusters(officers: DataFrame, appointments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name, cluster) of officers' entries, and of appointments' companies."""
    parsed = cut(person_profiles(officer_rows(officers)))
    return person_clusters(parsed, cut(surname_key_table(parsed))).select("id", "name", "cluster"), company_clusters(company_rows(appointments)).select("id", "name", "cluster")


def name_members(officers: DataFrame, appointments: DataFrame) -> DataFrame:
    """entity_kind, id, cluster, n_spellings: which rows are one person's or company's; a row per row, linear however large a cluster is."""
    people, firms = name_clusters(officers, appointments)
    every = people.withColumn("entity_kind", F.lit("officer")).unionByName(firms.withColumn("entity_kind", F.lit("company")))
    spelled = every.groupBy("entity_kind", "cluster").agg(F.count_distinct("name").alias("n_spellings"))
    return every.select("entity_kind", "id", "cluster").distinct().join(spelled, ["entity_kind", "cluster"]).select("entity_kind", "id", "cluster", "n_spellings")


def name_variants(officers: DataFrame, appointments: DataFrame) -> DataFrame:
    """entity_kind, id_a, id_b of all linked rows with different spellings."""
    people, firms = (variant_pairs(x) for x in name_clusters(officers, appointments))
    return people.select(F.lit("officer").alias("entity_kind"), "id_a", "id_b").unionByName(firms.select(F.lit("company").alias("entity_kind"), "id_a", "id_b"))
