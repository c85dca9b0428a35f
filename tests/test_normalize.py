"""Cleaning of names and addresses: behaviours to keep, on small frames."""

import pytest
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.phonetic import double_metaphone, register
from kindred.functions.scripts import to_ascii
from kindred.functions.similarity import jaro_winkler_of
from kindred.operators.normalize import FIELDS, normalize

NAMES = {
    "Café Résumé INC.": ("cafe resume inc", "cafe resume"),
    "A & B -- Corp.": ("a and b corp", "a and b"),
    "Orelee's Barbershop": ("orelee s barbershop", "orelee s barbershop"),
    "B+ Retail Inc": ("b retail inc", "b retail"),
    "Private Limited": ("private limited", ""),
    "Co-op Inc Private Ltd Foods": ("co op inc private ltd foods", "op foods"),
    "Straße Ærø": ("strasse aero", "strasse aero"),
    "_under": ("under", "under"),
    "--lead": ("lead", "lead"),
    "": ("", ""),
}
ADDRESSES = {
    "123 Main St, New York, NY 10001-1234": ("123 main street new york ny 10001 1234", "10001", "new york", "123"),
    "MG Road, Bangalore 560001": ("mg road bangalore 560001", "560001", "mg road", ""),
    "10 Rue de la Paix, Paris 75002": ("10 rue de la paix paris 75002", "75002", "paris", "10"),
    "1600 Amphitheatre Pkwy": ("1600 amphitheatre parkway", "", "parkway", "1600"),
    "100 Main St, 10001": ("100 main street 10001", "10001", "street", "100"),
    "Main Street": ("main street", "", "street", ""),
    "456 5th Ave., Suite #10": ("456 5th avenue suite 10", "", "suite", "456"),
    "17560 Ellis Road, Tahlequah, OK": ("17560 ellis road tahlequah ok", "17560", "tahlequah", "17560"),
    "1795 Westchester Drive, High Point, NC": (None, "", "high point", "1795"),
    "2100 Cameron Drive, Unit APARTMENT G, Dundalk, MD": (None, "", "dundalk", "2100"),
    "2505, Tower 1, Oakwood, Bhandup West, Mumbai, Maharashtra": (None, "", "mumbai", "2505"),
    "12345 Ring Rd, Pune 411001": ("12345 ring road pune 411001", "12345", "pune", "12345"),
    "10001": ("10001", "10001", "", "10001"),
    "5 A, St. Louis, MO": ("5 a street louis mo", "", "st louis", "5"),
    "221B Baker St, Unit 4": ("221b baker street unit 4", "", "unit", "221"),
    "Café Sq, Orléans, 45000": ("cafe square orleans 45000", "45000", "orléans", ""),
    "12-14 Oak Ct, Block C, Delhi 110001": ("12 14 oak court block c delhi 110001", "110001", "delhi", "12"),
    "": ("", "", "", ""),
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(f"n{k}", n, None, " US ") for k, n in enumerate(NAMES)] + [(f"a{k}", None, a, None) for k, a in enumerate(ADDRESSES)]
    return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")


@pytest.mark.parametrize("every", [True, False])
def test_names_and_addresses(frame, every):
    got = {r.entity_id: r for r in normalize(frame, every_script=every).collect()}
    for k, (name, (plain, bare)) in enumerate(NAMES.items()):
        r = got[f"n{k}"]
        assert (r.normalized_name, r.aggressive_normalized_name) == (plain, bare), name
        assert r.name_tokens == plain.split() and r.name_tokens_no_suffix == bare.split()
        padded = f" {plain} "
        assert r.name_char_ngrams == ([padded[i : i + 3] for i in range(len(plain))] if plain else [])
        assert r.name_missing == (not name.strip()) and r.address_missing and r.postal_missing and r.city_missing and r.country == "US"
    for k, (address, (plain, postal, city, number)) in enumerate(ADDRESSES.items()):
        r = got[f"a{k}"]
        assert plain is None or (r.normalized_address, r.address_tokens) == (plain, plain.split()), address
        assert (r.postal_code_guess, r.city_guess, r.street_number_guess) == (postal, city, number), address
        assert r.name_missing and r.raw_name == "" and r.country == "" and r.postal_missing == (postal == "") and r.city_missing == (city == "")


def test_every_legal_form_goes(spark):
    df = spark.createDataFrame([(w, f"Acme {w.upper()}", "", "") for w in T.LEGAL_FORMS], "w string, business_name string, business_address string, country string")
    for r in normalize(df, every_script=False, only=("normalized_name", "aggressive_normalized_name")).collect():
        assert (r.normalized_name, r.aggressive_normalized_name) == (f"acme {r.w}", "acme")


def test_normalizing_twice_changes_nothing(frame):
    once = normalize(frame, every_script=False, only=("normalized_name",)).select(F.col("normalized_name").alias("business_name"), F.lit("").alias("business_address"), F.lit("").alias("country"))
    for r in normalize(once, every_script=False, only=("raw_name", "normalized_name")).collect():
        assert r.raw_name == r.normalized_name


def test_schema_and_native_plan(frame):
    assert set(FIELDS) <= set(normalize(frame).columns)
    plan = normalize(frame, every_script=False, only=("normalized_name", "normalized_address", "postal_code_guess"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "*(1)" in plan


def test_double_metaphone(spark):
    for word, code in {"orelee s barbershop": "ARLSPRPRXP", "prime money": "PRMMN", "b retail inc": "PRTLNK", "": "", "smith": "SM0", "schmidt": "XMT", "knight": "NT", "thomas": "TMS", "caesar": "SSR", "church": "XRX", "xavier": "SF", "phone": "FN", "laugh": "LF", "wright": "RT"}.items():
        assert double_metaphone(word) == code, word
    register(spark)
    assert spark.sql("SELECT double_metaphone('prime money') AS x").first().x == "PRMMN"


def test_other_scripts_become_ascii():
    words = {
        "Москва": "Moskva", "Щукин": "Shchukin", "Ялта": "Ialta", "Київ": "Kiiv", "Αθήνα": "Athena", "Ψυχή": "Psukhe", "שלום": "shlvm", "محمد": "mhmd", "شركة": "shrkh", "서울": "seoul", "삼성전자": "samseongjeonja",
        "राम": "rama", "हिन्दी": "hindi", "भारत": "bharata", "トヨタ": "toyota", "東京 Ltd": "u6771 u4eac  Ltd", "日本": "u65e5 u672c ", "İzmir": "Izmir", "cafe\u0301": "cafe", "１２": "12",
    }
    assert {w: to_ascii(w) for w in words} == words
    for text in ("ग्रेट टेक केयर", "Αθήνα", "Москва", "日本", "Straße Café", "தமிழ்", "ไทย", "ქართული", "አማርኛ"):
        assert to_ascii(text).isascii() and to_ascii(text).strip()
    assert to_ascii("Straße Café") == "Strasse Cafe" and to_ascii("१२") == "12" and to_ascii("ग्रेट").strip() != ""


def test_jaro_winkler_known_values():
    for a, b, v in (("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("same", "same", 1.0), ("abc", "xyz", 0.0)):
        assert abs(jaro_winkler_of(a, b) - v) < 1e-5


def test_long_grams(spark):
    df = spark.createDataFrame([("ab",), ("",), ("a",)], "t string")
    assert [r[0] for r in df.select(T.char_grams(F.col("t"), 5)).collect()] == [[" ab "], [], [" a "]]


def test_functions_in_sql(spark):
    from kindred.functions import sql

    assert len(sql.register(spark)) == 7
    row = spark.sql("""SELECT to_ascii('Café') AS a, double_metaphone('smith') AS b, round(jaro_winkler('martha', 'marhta'), 3) AS c, f_beta(2, 1, 1, 0.5) AS d, f_beta(0, 0, 0, 1) AS e, f_beta(1, 1, 0, 1) AS f,
      edit_similarity('abc', 'abd') AS g, edit_similarity('', '') AS h, set_jaccard(array('a', 'b'), array('b', 'b', 'c')) AS i, set_jaccard(array(), array()) AS j, id_list(' S2-1 ,S2-2,,S2-1') AS k""").first()
    assert tuple(row)[:3] == ("Cafe", "SM0", 0.961) and abs(row.d - 0.625 / 0.75) < 1e-12 and (row.e, row.f) == (1.0, 0.0)
    assert abs(row.g - 2 / 3) < 1e-12 and row.h == 1.0 and abs(row.i - 1 / 3) < 1e-12 and row.j == 0.0 and row.k == ["S2-1", "S2-2"]


def test_street_words_and_folding_word_by_word(spark):
    """Equal short words side by side, runs of spaces and texts without letters to fold, against plain Python; no regular expression a word."""
    texts = ["st st rd", "rd", " st  st ", "best street", "", "  ", "1 ave, st", "a  st   rd b", "Straße st", "née", "plain"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    words = lambda t: " ".join(T.STREET_WORDS.get(w, w) for w in t.split(" "))
    assert {r.t: r.x for r in df.select("t", T.expand_street_words(F.col("t")).alias("x")).collect()} == {**{t: words(t) for t in texts}, None: None}
    got = {r.t: r.x for r in df.select("t", T.fold(F.col("t")).alias("x")).collect()}
    assert (got["Straße st"], got["née"], got["plain"], got[""], got[None]) == ("Strasse st", "nee", "plain", "", None)
    plan = df.select(T.expand_street_words(F.col("t")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("regexp_replace") <= 1
