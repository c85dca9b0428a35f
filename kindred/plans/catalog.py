"""The registered queries of the linkage engine, one for each operator, and their SQL twins.

A query runs over the whole driver tables (or the company feeds that sources.demo derives from them). Arrays come
out as joined texts and doubles rounded to six places, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.phonetic import phonetic
from kindred.functions.scripts import fold_all
from kindred.operators import blocking, checks, classes, decide, evaluate, folds, model, pairs, profile
from kindred.operators import link as link_all
from kindred.operators.golden import EITHER, KEYS, golden_join, golden_match
from kindred.operators.normalize import FIELDS, normalize
from kindred.plans import oracles as O
from kindred.sources import demo, tsv
from kindred.sources.scratch import remove, scratch
from kindred.streaming import link

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NATIVE = tuple(f for f in FIELDS if f != "name_phonetic")
GRID = [0.2, 0.4, 0.6, 0.8]
TOP = 3
#: Pairs of classes whose texts are shuffled at a time, about 85 bytes each.
PAIRS_AT_ONCE = 8_000_000


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def records(spark: SparkSession, d: str) -> DataFrame:
    """The feeds. Where the session asks for it (the benchmark does, as its tables are single small files that one task reads), their rows are spread."""
    spread = spark.conf.get("kindred.demo.partitions", None)
    feeds = demo.view(spark, d, demo.RECORDS)
    return feeds.repartition(int(spread)) if spread else feeds


def truth(spark: SparkSession, d: str) -> DataFrame:
    return demo.view(spark, d, demo.TRUTH)


def normal(spark: SparkSession, d: str, only: tuple[str, ...] = NATIVE) -> DataFrame:
    return normalize(records(spark, d), only=only)


def sides(spark: SparkSession, d: str, only: tuple[str, ...] = NATIVE) -> tuple[DataFrame, DataFrame]:
    """Source 1 and the others, normalized once into a table that every later step reads only the columns of that it needs."""
    path = scratch(spark, "normalized")
    made = normal(spark, d, only)
    made.write.parquet(path)
    n = spark.read.schema(made.schema).parquet(path)
    return n.where("source = 'S1'"), n.where("source <> 'S1'")


def golden(spark: SparkSession, d: str) -> DataFrame:
    return golden_join(*sides(spark, d, KEYS + EITHER))


def entities(spark: SparkSession, d: str) -> DataFrame:
    return demo.view(spark, d, demo.SOURCE1).select(F.col("entity_id").alias("s1_id"))


WORDS = ("name_tokens_no_suffix", "address_tokens")
PLACES = ("country", "postal_code_guess")


def token(a: DataFrame, b: DataFrame) -> DataFrame:
    """The token channel over the words of names and addresses."""
    return blocking.token_channel(a, b, blocking.all_words(), keep=lambda df: cut(a.sparkSession, df))


def minhash_grams() -> Column:
    return T.char_grams(F.concat_ws(" ", "normalized_name", "normalized_address"))


def minhash(a: DataFrame, b: DataFrame) -> DataFrame:
    return blocking.minhash_channel(a, b, minhash_grams())


def minhash_by_class(spark: SparkSession, g: classes.Classes) -> DataFrame:
    """The MinHash pairs of the members, each from the first band that it agrees in. Keys are shuffled a band at a time, pairs not at all."""
    made: list[DataFrame] = []

    def hashes(records: DataFrame, of: DataFrame) -> DataFrame:
        made.append(cut(spark, blocking.band_hashes(classes.with_ids(records, of), minhash_grams())))
        return made[-1]

    a, b = hashes(g.left, g.of_left), hashes(g.right, g.of_right)
    rows = [cut(spark, blocking.band_rows(a, b, k, classes.CHUNK)) for k in range(blocking.BANDS)]
    drop(spark, made)
    return reduce(DataFrame.unionByName, [blocking.of_band(r, k) for k, r in enumerate(rows)])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The pairs of the channels that every later step reads."""
    return blocking.union(token(a, b), blocking.place_channel(a, b, "postal_code_guess"))


#: Fields of words, and the texts that they are the words of; a text and its words tell apart the same records.
WORDS_OF = {"name_tokens_no_suffix": "aggressive_normalized_name", "address_tokens": "normalized_address"}


def grouped(spark: SparkSession, d: str, only: tuple[str, ...]) -> classes.Classes:
    """The sides as classes of records that agree in the named fields, in a table. Where ids repeat, each row stays for itself.

    Classes are told apart by texts, and only their representatives are cut into words. Whether ids repeat is read from the table.
    """
    texts = tuple(dict.fromkeys(WORDS_OF.get(f, f) for f in only))
    made = normal(spark, d, texts).select("entity_id", "source", *texts).withColumn("first", F.col("source") == "S1")
    if "postal_code_guess" in only:  # a country alone is no key and no feature
        known = "normalized_address" if "normalized_address" in only else "postal_code_guess"
        made = made.withColumn("country", F.when(F.col(known) != "", F.col("country")).otherwise(""))
    value = lambda f: T.tokens(F.col(WORDS_OF[f])) if f in WORDS_OF else F.col(f)
    # a hash in front, by which nearly all comparisons of a sort are decided
    rows = classes.classed(made.withColumn("key", F.xxhash64("first", *texts)), ("key", "first", *texts))
    n = cut(spark, rows.select("entity_id", "first", "class_id", "place", "size", *[F.when(F.col("place") == 1, value(f)).alias(f) for f in only]))
    unique = n.groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty()
    if not unique:
        drop(spark, [n])
        n = cut(spark, made.select("entity_id", "first", F.col("entity_id").alias("class_id"), F.lit(1).alias("place"), *[value(f).alias(f) for f in only]))
    a, b = n.where("first").drop("first"), n.where("not first").drop("first")
    of = lambda x: classes.members(x) if unique else classes.members(x).distinct()
    return classes.Classes(classes.representatives(a), classes.representatives(b), of(a), of(b))


def in_full(found: DataFrame, g: classes.Classes) -> DataFrame:
    return classes.for_members(found, g.of_left, g.of_right)


def by_class(spark: SparkSession, d: str, only: tuple[str, ...], channel: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The pairs of a channel that reads the named fields."""
    g = grouped(spark, d, only)
    return in_full(channel(g.left, g.right), g)


def found_once(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """s1_id, match_id of union(a, b), each once, in a table. Pairs of all channels are shuffled once, and the tables of the steps before go."""
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(cut(spark, df))
        return made[-1]

    every = blocking.token_channel(a, b, blocking.all_words(), keep=keep, once=False).unionByName(blocking.place_channel(a, b, "postal_code_guess"))
    found = cut(spark, every.select("s1_id", "match_id").distinct())
    drop(spark, made)
    return found


def in_parts(found: DataFrame, long: int = 1) -> tuple[int, Callable[[DataFrame, str, int], DataFrame]]:
    """The number of parts that pairs are dealt to by their match, and the rows of a frame, by its column, that fall to one. long: how many times the usual texts a pair's are."""
    parts = found.count() * long // PAIRS_AT_ONCE + 1
    return parts, lambda df, x, k: df.where(F.pmod(F.xxhash64(x), F.lit(parts)) == k) if parts > 1 else df


def features(spark: SparkSession, d: str, columns: dict[str, Column], *names: str) -> tuple[DataFrame, classes.Classes]:
    """s1_id, match_id and the columns, made of the named features, of each pair of classes; and the classes.

    The texts that features read are many times a pair's ids: pairs are dealt to parts by their match, and no more than
    the texts of a part are on disk at a time.
    """
    g = grouped(spark, d, tuple(dict.fromkeys(WORDS + PLACES + pairs.read_by(names))))
    found = found_once(spark, g.left, g.right)
    parts, of = in_parts(found)
    made = [cut(spark, pairs.features(of(found, "match_id", k), g.left, of(g.right, "entity_id", k), names).select("s1_id", "match_id", *[c.alias(x) for x, c in columns.items()])) for k in range(parts)]
    return reduce(DataFrame.unionByName, made), g


def member_features(spark: SparkSession, d: str, columns: dict[str, Column], *names: str) -> DataFrame:
    """features for each pair of members. A part's pairs leave as packed rows, so that the last step shuffles nothing."""
    g = grouped(spark, d, tuple(dict.fromkeys(WORDS + PLACES + pairs.read_by(names))))
    found = found_once(spark, g.left, g.right)
    parts, of = in_parts(found, 2 if "address_tokens" in pairs.read_by(names) else 1)  # an address's words take about 140 bytes a pair
    left = cut(spark, classes.with_ids(g.left, g.of_left))
    made = []
    for k in range(parts):
        part = pairs.features(of(found, "match_id", k), left, of(g.right, "entity_id", k), names, also=("ids",))
        made.append(cut(spark, classes.packed(part.select("match_id", "ids", *[c.alias(x) for x, c in columns.items()]), of(g.of_right, "class_id", k))))
    return classes.unpacked(reduce(DataFrame.unionByName, made))


def scored(spark: SparkSession, d: str) -> tuple[DataFrame, classes.Classes]:
    """s1_id, match_id, score of each pair of classes, and the classes."""
    score = F.round(0.5 * F.col("gram_jaccard") + 0.3 * F.col("edit") + 0.2 * F.col("address_overlap"), 6)
    return features(spark, d, {"score": score}, "gram_jaccard", "edit", "address_overlap")


def best(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k best candidates of each record: those of the k best classes, as an id of a class is no less than the class's."""
    found, g = scored(spark, d)
    return blocking.prune(classes.for_members(blocking.prune(found, k).drop("place"), g.of_left, g.of_right.where(F.col("place") <= k)), k)


def linkage(spark: SparkSession, d: str) -> link_all.Linked:
    """The whole linkage of the feeds: candidates, features, classifier, calibration, threshold, lists."""
    fields = tuple(dict.fromkeys(WORDS + PLACES + KEYS + EITHER + pairs.read_by(model.NUMERIC)))
    g = grouped(spark, d, fields)
    return link_all.link(g.left, g.right, union(g.left, g.right), truth(spark, d), lambda df: cut(spark, df), of=g)


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. What was shuffled for it goes once the driver has collected its garbage."""
    path = scratch(spark, "linkage")
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Deletes tables of cut that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        remove(spark, folder)


def truth_lists(spark: SparkSession, d: str) -> DataFrame:
    return decide.lists(entities(spark, d), truth(spark, d))


def results(spark: SparkSession, d: str) -> DataFrame:
    return demo.view(spark, d, O.RESULTS)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---- sources and sinks


def feed_file(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "feed")
    rows = records(spark, d).where("source <> 'S1'").select("entity_id", "business_name", "business_address", "country")
    rows.write.options(sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def lists_file(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "results")
    tsv.write_results(truth_lists(spark, d), path)
    return path


FEED = O.over("SELECT entity_id, business_name, business_address, country FROM records WHERE source <> 'S1'")


@query("R1_tsv_scan", FEED)
def _(spark, d):
    return tsv.read_tsv(spark, feed_file(spark, d))


@query("R2_path_layout", "SELECT 'source' || i AS name, 'f/train_source' || i || '.tsv' AS path FROM range(1, 4) t(i) UNION ALL SELECT 'ground_truth', 'f/train_ground_truth.tsv'")
def _(spark, d):
    return spark.createDataFrame(list(tsv.paths("f").items()), "name string, path string")


@query("R3_id_column", O.over("SELECT source1_entity_id AS entity_id FROM lists", O.TRUTH_LISTS))
def _(spark, d):
    return tsv.read_ids(spark, lists_file(spark, d))


@query("R4_result_lines", O.over("SELECT source1_entity_id AS s1_id, matched_entity_ids AS ids, true AS tab, row_number() OVER (ORDER BY source1_entity_id) + 1 AS line FROM lists", O.TRUTH_LISTS))
def _(spark, d):
    path = scratch(spark, "results")
    tsv.write_results(truth_lists(spark, d).orderBy("source1_entity_id"), path)
    return tsv.result_rows(tsv.lines(spark, path))


@query("R5_existence", "SELECT true AS there, false AS elsewhere")
def _(spark, d):
    return spark.createDataFrame([(tsv.exists(spark, f"{d}/orders.parquet"), tsv.exists(spark, f"{d}/no-such-table"))], "there boolean, elsewhere boolean")


@query("R6_valid_utf8", "SELECT true AS valid, false AS damaged")
def _(spark, d):
    damaged = scratch(spark, "latin")  # the accents of the feed in another encoding are bytes that UTF-8 doesn't know
    records(spark, d).select(F.encode(F.coalesce("business_name", F.lit("")), "ISO-8859-1").cast("string").alias("value")).write.text(damaged)
    return spark.createDataFrame([(tsv.is_valid_utf8(spark, feed_file(spark, d)), tsv.is_valid_utf8(spark, damaged))], "valid boolean, damaged boolean")


@query("R7_parquet_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 5000").select("c_custkey", "c_name")


@query("W1_markdown_report")
def _(spark, d):
    rows = records(spark, d)
    lines = profile.markdown(rows, truth_lists(spark, d), normal(spark, d, only=("normalized_name", "postal_code_guess", "city_guess", "country")).drop("source", "business_name", "business_address"))
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return tsv.lines(spark, path).select(F.col("value").alias("line"))


@query("W2_candidate_file", O.over("SELECT source1_entity_id || chr(9) || coalesce(ids, '') AS line FROM lists LEFT JOIN (SELECT s1_id, string_agg(match_id, ',' ORDER BY match_id) AS ids FROM pairs GROUP BY 1) ON s1_id = source1_entity_id UNION ALL SELECT 'source1_entity_id' || chr(9) || 'candidate_entity_ids'", O.TRUTH_LISTS, *O.PAIRS))
def _(spark, d):
    path = scratch(spark, "candidates")
    g = grouped(spark, d, WORDS + PLACES)
    found = classes.for_left(union(g.left, g.right).select("s1_id", "match_id"), g.of_left)
    tsv.write_results(decide.lists(entities(spark, d), found, "candidate_entity_ids", of=g.of_right), path)
    return read_lines(spark, path)


@query("W3_matching_file", O.over("SELECT source1_entity_id || chr(9) || matched_entity_ids AS line FROM lists UNION ALL SELECT 'source1_entity_id' || chr(9) || 'matched_entity_ids'", O.TRUTH_LISTS))
def _(spark, d):
    return read_lines(spark, lists_file(spark, d))


# ---- projections, filters, predicates


@query("P1_projection", O.over("SELECT entity_id, business_name FROM records"))
def _(spark, d):
    return records(spark, d).select("entity_id", "business_name")


@query("P2_filter_first", O.over("SELECT entity_id, business_name FROM records WHERE regexp_matches(business_name, '[^\\x00-\\x7F]') ORDER BY entity_id LIMIT 3"))
def _(spark, d):
    return profile.first_rows(records(spark, d).where(T.is_non_ascii(F.col("business_name"))).select("entity_id", "business_name"))


@query("P3_null_to_empty", O.over("SELECT entity_id, raw_name, raw_address FROM n"))
def _(spark, d):
    return records(spark, d).select("entity_id", T.known(F.col("business_name")).alias("raw_name"), T.known(F.col("business_address")).alias("raw_address"))


@query("P4_blank", O.over("SELECT entity_id, name_missing, address_missing FROM n"))
def _(spark, d):
    return records(spark, d).select("entity_id", T.is_blank(F.col("business_name")).alias("name_missing"), T.is_blank(F.col("business_address")).alias("address_missing"))


@query("P5_non_ascii", O.over("SELECT entity_id, coalesce(regexp_matches(business_name, '[^\\x00-\\x7F]'), false) AS non_ascii FROM records"))
def _(spark, d):
    return records(spark, d).select("entity_id", T.is_non_ascii(F.col("business_name")).alias("non_ascii"))


@query("P6_prefix", O.over("SELECT left(entity_id, 3) AS prefix, count(*) AS n FROM records GROUP BY 1"))
def _(spark, d):
    c = F.col("entity_id")
    return records(spark, d).select(F.when(c.startswith("S1-"), "S1-").when(c.startswith("S2-"), "S2-").when(c.startswith("S3-"), "S3-").alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


@query("P7_head", O.over("SELECT * FROM records ORDER BY entity_id LIMIT 3"))
def _(spark, d):
    return profile.first_rows(records(spark, d))


@query("P8_sample", O.over(f"SELECT entity_id FROM records ORDER BY md5(entity_id), entity_id LIMIT {profile.SAMPLE}"))
def _(spark, d):
    return profile.sample(records(spark, d)).select("entity_id")


# ---- scalar functions


def one_field(name: str, column: str, array: bool = False, oracle: str | None = None) -> None:
    @query(name, oracle or O.field(column, array=array))
    def _(spark, d):
        value = F.array_join(column, "|") if array else F.col(column)
        return normal(spark, d, only=(column,)).select("entity_id", value.alias(column))


@query("N1_fold", f"SELECT doc_id, {O.fold('text')} AS folded FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("N1_fold_every_script", f"SELECT doc_id, {O.fold('text')} AS folded FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fold_all(F.col("text")).alias("folded"))


def on_documents(name: str, make, sql: str) -> None:
    @query(name, f"SELECT doc_id, {sql} AS value FROM documents")
    def _(spark, d):
        return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", make(F.col("text")).alias("value"))


on_documents("N2_lowercase", lambda c: F.lower(T.fold(c)), f"lower({O.fold('text')})")
on_documents("N3_ampersand", T.spell_ampersand, "replace(text, '&', ' and ')")
on_documents("N4_leading_punctuation", lambda c: T.strip_leading(T.fold(c)), rf"regexp_replace({O.fold('text')}, '^[^\w]+', '')")
on_documents("N5_punctuation", T.blank_punctuation, f"translate(text, {O.q(O.PUNCTUATION)}, {O.q(' ' * len(O.PUNCTUATION))})")
on_documents("N6_white_space", lambda c: T.collapse(T.fold(c)), rf"trim(regexp_replace({O.fold('text')}, '\s+', ' ', 'g'))")
one_field("N7_normalized_name", "normalized_name")
one_field("N8_tokens", "name_tokens", True)
one_field("N9_legal_forms", "aggressive_normalized_name")
one_field("N9_tokens_no_suffix", "name_tokens_no_suffix", True)
one_field("N11_char_ngrams", "name_char_ngrams", True)
one_field("A5_street_words", "normalized_address")
one_field("A5_address_tokens", "address_tokens", True)
one_field("A6_postal_code", "postal_code_guess")
one_field("A7_city", "city_guess")
one_field("A8_street_number", "street_number_guess")
one_field("A9_country", "country")


@query("N10_phonetic")
def _(spark, d):
    return normal(spark, d, only=("normalized_name",)).select("entity_id", phonetic(F.col("normalized_name")).alias("name_phonetic"))


@query("A1_4_plain_address", O.over("SELECT entity_id, plain_address FROM n"))
def _(spark, d):
    return records(spark, d).select("entity_id", T.normalized_text(T.fold(T.known(F.col("business_address")))).alias("plain_address"))


@query("A10_missing_flags", O.over("SELECT entity_id, name_missing, address_missing, postal_code_guess = '' AS postal_missing, city_guess = '' AS city_missing FROM n"))
def _(spark, d):
    flags = ("name_missing", "address_missing", "postal_missing", "city_missing")
    return normal(spark, d, only=flags).select("entity_id", *flags)


@query("normalized_record")
def _(spark, d):
    return normalize(records(spark, d))


# ---- joins


@query("J1_golden_predicate", O.over("SELECT t.s1_id, t.match_id, g.s1_id IS NOT NULL AS golden FROM truth t LEFT JOIN golden g USING (s1_id, match_id)", O.GOLDEN))
def _(spark, d):
    a, b = sides(spark, d, KEYS + EITHER)
    side = lambda df, x, y: df.select(F.col("entity_id").alias(x), F.struct("aggressive_normalized_name", "country", "normalized_address", "postal_code_guess").alias(y))
    both = truth(spark, d).join(side(a, "s1_id", "a"), "s1_id").join(side(b, "match_id", "b"), "match_id")
    return both.select("s1_id", "match_id", golden_match(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")).alias("golden"))


@query("J2_golden_join", O.over("SELECT s1_id, match_id FROM golden", O.GOLDEN))
def _(spark, d):
    return golden(spark, d)


@query("J3_missing_and_extra", O.over("SELECT entity_id AS s1_id, 'missing' AS what FROM records WHERE source = 'S1' AND entity_id NOT IN (SELECT s1_id FROM truth) UNION ALL SELECT DISTINCT s1_id, 'extra' FROM truth WHERE s1_id NOT IN (SELECT entity_id FROM records WHERE source = 'S1')"))
def _(spark, d):
    need, seen = entities(spark, d), truth(spark, d).select("s1_id").distinct()
    return need.join(seen, "s1_id", "left_anti").withColumn("what", F.lit("missing")).unionByName(seen.join(need, "s1_id", "left_anti").withColumn("what", F.lit("extra")))


@query("J4_unknown_ids", O.over("SELECT match_id FROM truth WHERE match_id NOT IN (SELECT entity_id FROM records WHERE source = 'S2')"))
def _(spark, d):
    known = records(spark, d).where("source = 'S2'").select(F.col("entity_id").alias("match_id"))
    return truth(spark, d).select("match_id").join(known, "match_id", "left_anti")


@query("J5_not_among_candidates", O.over(f"SELECT DISTINCT s1_id FROM (SELECT * FROM golden EXCEPT SELECT * FROM ({O.place_pairs('street_number_guess')}))", O.GOLDEN))
def _(spark, d):
    numbers = blocking.place_channel(*sides(spark, d, ("country", "street_number_guess")), "street_number_guess")  # no house number: no candidate
    return golden(spark, d).join(numbers, ["s1_id", "match_id"], "left_anti").select("s1_id").distinct()


SIZES = O.over("SELECT s1_id, truths, guesses FROM sizes", O.GOLDEN, O.SCORES)


@query("J6_outer_alignment", SIZES)
def _(spark, d):
    size = lambda df, c: df.groupBy("s1_id").agg(F.count(F.lit(1)).alias(c))
    both = size(truth(spark, d), "truths").join(size(golden(spark, d), "guesses"), "s1_id", "full_outer")
    return both.select("s1_id", F.coalesce("truths", F.lit(0)).alias("truths"), F.coalesce("guesses", F.lit(0)).alias("guesses"))


@query("J7_intersection_size", O.over("SELECT s1_id, hits FROM every", O.GOLDEN, O.SCORES))
def _(spark, d):
    return evaluate.entity_scores(truth(spark, d), golden(spark, d), entities(spark, d)).select("s1_id", "hits")


def fold_of(x: str, n: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % {n})::INTEGER"


@query("J8_group_leakage", O.over(f"SELECT s1_id FROM truth GROUP BY s1_id HAVING bool_or({fold_of('match_id', 5)} = 0) AND bool_or({fold_of('match_id', 5)} <> 0)"))
def _(spark, d):
    rows = folds.hash_folds(truth(spark, d), "match_id", 5)  # folds that ignore the groups, so that some leak
    return folds.leaked_groups(rows.where("fold <> 0"), rows.where("fold = 0"), "s1_id")


def channel(name: str, table: str) -> str:
    return f"SELECT s1_id, match_id, '{name}' AS channel FROM {table}"


@query("J9_token_channel", O.over(channel("token", "token"), O.TOKEN))
def _(spark, d):
    return by_class(spark, d, WORDS, token)


@query("J10_minhash_channel", O.over(channel("minhash", "minhash"), O.MINHASH))
def _(spark, d):
    g = grouped(spark, d, ("normalized_name", "normalized_address"))
    if "size" in g.left.columns:
        return minhash_by_class(spark, g)
    return in_full(minhash(g.left, g.right), g)


@query("J11_postal_channel", O.over(channel("postal_code_guess", "place"), O.PLACE))
def _(spark, d):
    return blocking.place_channel(*sides(spark, d, PLACES), "postal_code_guess")


@query("J11_city_channel", O.over(channel("city_guess", "city"), O.CITY))
def _(spark, d):
    return by_class(spark, d, ("country", "city_guess", "name_tokens_no_suffix"), blocking.city_channel)


@query("J11_street_number_channel", O.over(f"SELECT s1_id, match_id, 'street_number_guess' AS channel FROM ({O.place_pairs('street_number_guess')})"))
def _(spark, d):
    return blocking.place_channel(*sides(spark, d, ("country", "street_number_guess")), "street_number_guess")


@query("J12_phonetic_channel")
def _(spark, d):
    return by_class(spark, d, ("country", "name_phonetic", "address_tokens"), blocking.phonetic_channel)


EVERY = f"""every AS (SELECT s1_id, match_id, list(channel) AS channels FROM ({channel("token", "token")} UNION ALL {channel("postal_code_guess", "place")} UNION ALL {channel("minhash", "minhash")} UNION ALL {channel("city_guess", "city")}) GROUP BY ALL)"""


ALL_FIELDS = WORDS + PLACES + ("city_guess", "normalized_name", "normalized_address")
TOWN = ("country", "city_guess", "name_tokens_no_suffix")


def every_channel(a: DataFrame, b: DataFrame) -> DataFrame:
    return blocking.union(token(a, b), blocking.place_channel(a, b, "postal_code_guess"), minhash(a, b), blocking.city_channel(a, b))


class Every(NamedTuple):
    """near: s1_id, match_id, channels of the pairs of classes that any channel but the city's finds, with the homes of both, and `town`
    where the city channel finds them, too; city: a_home, b_home of its pairs. A home is a class of what the city channel reads."""

    near: DataFrame
    city: DataFrame
    left: DataFrame
    right: DataFrame


def homes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """entity_id, size, home, home_size of each class."""
    same = Window.partitionBy(*TOWN)
    return cut(spark, rows.select("entity_id", "size", *TOWN, F.min("entity_id").over(same).alias("home"), F.sum("size").over(same).alias("home_size")))


def channels_by_class(spark: SparkSession, g: classes.Classes) -> Every:
    a, b = homes(spark, g.left), homes(spark, g.right)
    whole = lambda df: df.where("entity_id = home").select("entity_id", F.col("home_size").alias("size"), *TOWN)
    city = cut(spark, blocking.city_channel(whole(a), whole(b)).select(F.col("s1_id").alias("a_home"), F.col("match_id").alias("b_home")))
    found = cut(spark, blocking.union(*[cut(spark, x) for x in (token(g.left, g.right), blocking.place_channel(g.left, g.right, "postal_code_guess"), minhash(g.left, g.right))]))
    near = found.join(a.select(F.col("entity_id").alias("s1_id"), F.col("home").alias("a_home")), "s1_id").join(b.select(F.col("entity_id").alias("match_id"), F.col("home").alias("b_home")), "match_id")
    near = near.join(city.withColumn("town", F.lit(True)), ["a_home", "b_home"], "left").withColumn("town", F.coalesce("town", F.lit(False)))
    return Every(cut(spark, near.withColumn("channels", F.when(F.col("town"), F.array_sort(F.array_append("channels", F.lit("city_guess")))).otherwise(F.col("channels")))), city, a, b)


def recall_by_class(spark: SparkSession, g: classes.Classes, truth: DataFrame) -> DataFrame:
    """channel_recall of the members' pairs: sums over pairs of classes. What the city channel alone finds is counted by homes."""
    x = channels_by_class(spark, g)
    size = lambda df, ident, n, key="entity_id": df.select(F.col(key).alias(ident), F.col(n).alias(f"{ident}_n"))
    known = truth.select("s1_id", "match_id").distinct()
    member = lambda of, ident: of.select(F.col("entity_id").alias(ident), F.col("class_id").alias(f"{ident}_class"))
    of_classes = known.join(member(g.of_left, "s1_id"), "s1_id").join(member(g.of_right, "match_id"), "match_id").groupBy(F.col("s1_id_class").alias("s1_id"), F.col("match_id_class").alias("match_id")).agg(F.count(F.lit(1)).alias("covered"))
    true = cut(spark, of_classes)
    near = x.near.join(size(x.left, "s1_id", "size"), "s1_id").join(size(x.right, "match_id", "size"), "match_id").withColumn("pairs", F.col("s1_id_n") * F.col("match_id_n"))
    near = near.join(true, ["s1_id", "match_id"], "left").select("channels", "town", "pairs", F.coalesce("covered", F.lit(0)).alias("covered"))
    each = near.select(F.explode(F.array_append("channels", F.lit("union"))).alias("channel"), "pairs", "covered")
    home = lambda df: df.where("entity_id = home")
    city = x.city.join(size(home(x.left), "a_home", "home_size", "home"), "a_home").join(size(home(x.right), "b_home", "home_size", "home"), "b_home")
    city = city.select((F.col("a_home_n") * F.col("b_home_n")).alias("pairs"), F.lit(0).cast("long").alias("covered"))
    again = near.where("town").select((-F.col("pairs")).alias("pairs"), F.lit(0).cast("long").alias("covered"))
    at = lambda df, x, y: df.select(F.col("entity_id").alias(x), F.col("home").alias(y))
    far = true.join(x.near.select("s1_id", "match_id"), ["s1_id", "match_id"], "left_anti").join(at(x.left, "s1_id", "a_home"), "s1_id").join(at(x.right, "match_id", "b_home"), "match_id")
    far = far.join(x.city, ["a_home", "b_home"], "left_semi").select(F.lit(0).cast("long").alias("pairs"), "covered")
    alone = reduce(DataFrame.unionByName, (city, again, far)).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    alone = alone.select(F.explode(F.array(F.lit("city_guess"), F.lit("union"))).alias("channel"), "pairs", "covered")
    rows = each.unionByName(alone).groupBy("channel").agg(F.sum("pairs").alias("pairs"), F.sum("covered").alias("covered")).where("pairs > 0")
    total = F.broadcast(known.agg(F.count(F.lit(1)).alias("true_pairs")))  # one row
    return rows.join(total).select("channel", "pairs", "true_pairs", "covered", F.coalesce(F.try_divide("covered", "true_pairs"), F.lit(0.0)).alias("recall"))


def union_by_class(spark: SparkSession, g: classes.Classes) -> DataFrame:
    """s1_id, match_id, channels of the members' pairs. Those that the city channel alone finds are a home's members by another's, without the pairs of classes that another channel has found."""
    x = channels_by_class(spark, g)
    near = in_full(x.near.select("s1_id", "match_id", F.array_join("channels", "|").alias("channels")), g)
    # a class's ids in chunks, and a home's chunks in rows of about as many ids
    chunks = lambda of, df: of.groupBy(F.col("class_id").alias("c"), F.floor((F.col("place") - 1) / classes.CHUNK).alias("part")).agg(F.collect_list("entity_id").alias("ids")).join(df.select(F.col("entity_id").alias("c"), "home"), "c")

    def packed(of: DataFrame, df: DataFrame, ident: str, name: str) -> DataFrame:
        before = F.sum(F.size("ids")).over(Window.partitionBy("home").orderBy("c", "part").rowsBetween(Window.unboundedPreceding, -1))
        rows = chunks(of, df).withColumn("row", F.floor(F.coalesce(before, F.lit(0)) / classes.CHUNK))
        return rows.groupBy(F.col("home").alias(ident), "row").agg(F.collect_list(F.struct("c", "ids")).alias(name)).drop("row")

    met = x.near.where("town").groupBy("a_home", "b_home").agg(F.collect_list(F.struct("s1_id", "match_id")).alias("met"))
    rows = x.city.join(met, ["a_home", "b_home"], "left").join(packed(g.of_left, x.left, "a_home", "lefts"), "a_home")
    rows = rows.join(packed(g.of_right, x.right, "b_home", "rights"), "b_home").select(F.coalesce("met", F.array().cast("array<struct<s1_id:string,match_id:string>>")).alias("met"), F.explode("lefts").alias("a"), "rights")
    rows = rows.select("a.ids", "rights", F.transform(F.filter("met", lambda m: m.s1_id == F.col("a.c")), lambda m: m.match_id).alias("met"))
    others = F.flatten(F.transform(F.filter("rights", lambda r: ~F.array_contains("met", r.c)), lambda r: r.ids))
    rows = rows.select("ids", others.alias("others")).select(F.explode("ids").alias("s1_id"), "others").select("s1_id", F.explode("others").alias("match_id"))
    return near.unionByName(rows.select("s1_id", "match_id", F.lit("city_guess").alias("channels")))


@query("J13_channel_union", O.over("SELECT s1_id, match_id, array_to_string(list_sort(channels), '|') AS channels FROM every", O.TOKEN, O.PLACE, O.MINHASH, O.CITY, EVERY))
def _(spark, d):
    g = grouped(spark, d, ALL_FIELDS)
    if "size" in g.left.columns:
        return union_by_class(spark, g)
    return every_channel(g.left, g.right).select("s1_id", "match_id", F.array_join("channels", "|").alias("channels"))


# ---- aggregates


@query("G1_row_counts", O.over("SELECT source, count(*) AS rows FROM records GROUP BY 1"))
def _(spark, d):
    return profile.counts(records(spark, d)).select("source", "rows")


@query("G2_missing", O.over("SELECT source, rows, column_name AS \"column\", missing, round(100 * missing / rows, 6) AS percent FROM (SELECT source, count(*) AS rows, count(*) FILTER (name_missing) AS business_name, count(*) FILTER (address_missing) AS business_address, count(*) FILTER (country = '') AS country FROM n GROUP BY 1) UNPIVOT (missing FOR column_name IN (business_name, business_address, country))"))
def _(spark, d):
    return profile.missing(records(spark, d)).select("source", "rows", "column", "missing", *r6("percent"))


@query("G3_distinct_ids", O.over("SELECT source, count(DISTINCT entity_id) AS ids FROM records GROUP BY 1"))
def _(spark, d):
    return profile.counts(records(spark, d)).select("source", "ids")


HISTOGRAM = O.over("SELECT CASE WHEN matched_entity_ids = '' THEN 0 ELSE len(string_split(matched_entity_ids, ',')) END AS matches, count(*) AS entities FROM lists GROUP BY 1 ORDER BY 1", O.TRUTH_LISTS)
SHARES = "shares AS (SELECT count(*) AS entities, count(*) FILTER (matched_entity_ids = '') AS none, count(*) FILTER (matched_entity_ids <> '' AND NOT contains(matched_entity_ids, ',')) AS one, count(*) FILTER (contains(matched_entity_ids, ',')) AS many FROM lists)"


@query("G4_match_histogram", HISTOGRAM)
def _(spark, d):
    return profile.match_histogram(truth_lists(spark, d))


@query("S1_sorted_histogram", HISTOGRAM)
def _(spark, d):
    return profile.match_histogram(truth_lists(spark, d))


@query("G5_match_shares", O.over("SELECT entities, none, one, many, round(100 * none / entities, 6) AS none_percent, round(100 * one / entities, 6) AS one_percent, round(100 * many / entities, 6) AS many_percent FROM shares", O.TRUTH_LISTS, SHARES))
def _(spark, d):
    return profile.match_shares(truth_lists(spark, d)).select("entities", "none", "one", "many", *r6("none_percent", "one_percent", "many_percent"))


@query("G6_one_to_many", O.over("SELECT round(one / greatest(many, 1), 6) AS one_to_many FROM shares", O.TRUTH_LISTS, SHARES))
def _(spark, d):
    return profile.match_shares(truth_lists(spark, d)).select(*r6("one_to_many"))


NON = "count(*) FILTER (regexp_matches({0}, '[^\\x00-\\x7F]'))"


@query("G7_encoding", O.over(f"SELECT source, count(*) AS rows, {NON.format('business_name')} AS names, {NON.format('business_address')} AS addresses, round(100 * {NON.format('business_name')} / count(*), 6) AS names_percent FROM records GROUP BY 1"))
def _(spark, d):
    return profile.encoding(records(spark, d)).select("source", "rows", "names", "addresses", *r6("names_percent"))


@query("G8_countries", O.over("SELECT source, string_agg(DISTINCT coalesce(country, 'NULL'), ',' ORDER BY coalesce(country, 'NULL')) AS countries FROM records GROUP BY 1"))
def _(spark, d):
    return profile.encoding(records(spark, d)).select("source", "countries")


@query("G9_macro_f_beta", O.over(f"SELECT count(*) AS entities, round(coalesce(avg({O.F_BETA}), 0), 6) AS macro_f_beta FROM every", O.GOLDEN, O.SCORES))
def _(spark, d):
    return evaluate.macro_f_beta(truth(spark, d), golden(spark, d), entities(spark, d)).select("entities", *r6("macro_f_beta"))


@query("G9_entity_scores", O.over(f"SELECT s1_id, truths, guesses, hits, round({O.F_BETA}, 6) AS f_beta FROM every", O.GOLDEN, O.SCORES))
def _(spark, d):
    return evaluate.entity_scores(truth(spark, d), golden(spark, d), entities(spark, d)).select("s1_id", "truths", "guesses", "hits", *r6("f_beta"))


@query("G10_result_summary", rf"WITH {O.ROWS} SELECT count(*) AS rows, count(*) FILTER (NOT regexp_matches(ids, '[^\s]')) AS empty, count(*) FILTER (regexp_matches(ids, '[^\s]')) AS filled FROM rows WHERE tab")
def _(spark, d):
    return checks.summary(results(spark, d))


@query("G11_repeated_keys", f"WITH {O.ROWS} SELECT s1_id, count(*) AS rows FROM rows WHERE tab GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return results(spark, d).where("tab").groupBy("s1_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


@query("G12_repeats_in_lists", f"WITH {O.ROWS} SELECT line, s1_id FROM rows WHERE tab AND len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))")
def _(spark, d):
    return results(spark, d).where("tab").where(F.size(F.split("ids", ",")) != F.size(F.array_distinct(F.split("ids", ",")))).select("line", "s1_id")


@query("G13_last_row_wins", f"WITH {O.ROWS}, {O.LAST} SELECT s1_id, id FROM last")
def _(spark, d):
    return checks.last_lists(results(spark, d))


@query("G14_examples", O.finding("C5", "error", "SELECT s1_id AS x FROM rows WHERE tab GROUP BY 1 HAVING count(*) > 1", O.ROWS))
def _(spark, d):
    return checks.row_rules(results(spark, d)).where("rule = 'C5'")


@query("S2_sorted_offenders", f"WITH {O.ROWS}, {O.LISTED} SELECT DISTINCT id FROM listed WHERE id LIKE 'S1-%' OR NOT (id LIKE 'S2-%' OR id LIKE 'S3-%') ORDER BY id LIMIT 5")
def _(spark, d):
    ids = checks.listed_ids(results(spark, d)).select("id").distinct()
    return ids.where(checks.kind(F.col("id")).isNotNull()).orderBy("id").limit(checks.EXAMPLES)


@query("S3_set_operations", O.over("SELECT 'union' AS what, count(*) AS n FROM (SELECT * FROM truth UNION SELECT * FROM golden) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM truth EXCEPT SELECT * FROM golden) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM truth INTERSECT SELECT * FROM golden)", O.GOLDEN))
def _(spark, d):
    a, b = truth(spark, d), golden(spark, d)
    sets = {"union": a.union(b).distinct(), "difference": a.subtract(b), "intersection": a.intersect(b)}
    return reduce(DataFrame.unionByName, [s.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n") for w, s in sets.items()])


@query("G15_candidate_recall", O.over("""SELECT channel, pairs, (SELECT count(*) FROM truth) AS true_pairs, covered, round(covered / (SELECT count(*) FROM truth), 6) AS recall FROM (
  SELECT channel, count(*) AS pairs, count(t.s1_id) AS covered FROM (SELECT s1_id, match_id, unnest(list_append(channels, 'union')) AS channel FROM every) e
  LEFT JOIN truth t ON t.s1_id = e.s1_id AND t.match_id = e.match_id GROUP BY 1)""", O.TOKEN, O.PLACE, O.MINHASH, O.CITY, EVERY))
def _(spark, d):
    g = grouped(spark, d, ALL_FIELDS)
    found = recall_by_class(spark, g, truth(spark, d)) if "size" in g.left.columns else blocking.channel_recall(every_channel(g.left, g.right), truth(spark, d))
    return found.select("channel", "pairs", "true_pairs", "covered", *r6("recall"))


WEIGHTS = """spread AS (SELECT entity_id AS id, unnest(list_distinct(name_tokens_no_suffix)) AS word FROM n),
weights AS (SELECT id, s.word, ln(((SELECT count(*) FROM n) + 1) / (df + 1)) + 1 AS weight FROM spread s JOIN (SELECT word, count(*) AS df FROM spread GROUP BY 1) USING (word))"""


@query("G16_tf_idf", O.over("SELECT id, word, round(weight, 6) AS weight FROM weights", WEIGHTS))
def _(spark, d):
    return pairs.weights(normal(spark, d, only=("name_tokens_no_suffix",))).select("id", "word", *r6("weight"))


# ---- windows, features, decisions


@query("S4_top_candidates", O.over(f"SELECT s1_id, match_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, match_id)::INTEGER AS place FROM scored) WHERE place <= {TOP}", *O.PAIRS, O.SCORED))
def _(spark, d):
    return best(spark, d, TOP)


@query("S5_margins", O.over("SELECT s1_id, match_id, best, round(best - coalesce(next, 0), 6) AS margin FROM (SELECT s1_id, match_id, score AS best, row_number() OVER w AS place, lead(score) OVER w AS next FROM scored WINDOW w AS (PARTITION BY s1_id ORDER BY score DESC, match_id)) WHERE place = 1", *O.PAIRS, O.SCORED))
def _(spark, d):
    return decide.margins(best(spark, d, 2).drop("place")).select("s1_id", "match_id", "best", *r6("margin"))


def feature(name: str, column: str, sql: str) -> None:
    @query(name, O.over(f"SELECT s1_id, match_id, {sql} AS {column} {O.SIDES}", *O.PAIRS))
    def _(spark, d):
        value = F.round(column, 6) if column in ("token_jaccard", "gram_jaccard", "edit", "address_overlap") else F.col(column)
        return member_features(spark, d, {column: value}, column)


SHORT = "array_to_string(list_transform({0}, lambda w: left(w, 1)), '')"
feature("F1_token_jaccard", "token_jaccard", f"round({O.JACCARD.format('a.name_tokens_no_suffix', 'b.name_tokens_no_suffix')}, 6)")
feature("F1_gram_jaccard", "gram_jaccard", f"round({O.JACCARD.format('a.name_char_ngrams', 'b.name_char_ngrams')}, 6)")
feature("F2_levenshtein", "edit", f"round({O.EDIT.format('a.normalized_name', 'b.normalized_name')}, 6)")
feature("F5_acronym", "acronym", " OR ".join(f"(len({x}) > 1 AND {SHORT.format(x)} = array_to_string({y}, ''))" for x, y in (("a.name_tokens_no_suffix", "b.name_tokens_no_suffix"), ("b.name_tokens_no_suffix", "a.name_tokens_no_suffix"))))
feature("F6_address_overlap", "address_overlap", f"round({O.OVERLAP.format('a.address_tokens', 'b.address_tokens')}, 6)")
feature("F6_same_city", "same_city", "a.city_guess = b.city_guess AND a.city_guess <> ''")
feature("F7_missing", "missing", " || ".join(f"CAST(({x}.{c})::INTEGER AS STRING)" for x in "ab" for c in ("name_missing", "address_missing", "postal_code_guess = ''", "city_guess = ''")).replace("(a.postal_code_guess = '')", "(a.postal_code_guess = '')"))


@query("F3_jaro_winkler", O.over(f"SELECT s1_id, match_id, round(jaro_winkler_similarity(a.normalized_name, b.normalized_name), 6) AS jaro_winkler {O.SIDES}", *O.PAIRS))
def _(spark, d):
    return member_features(spark, d, {"jaro_winkler": F.round("jaro_winkler", 6)}, "jaro_winkler")


@query("F4_cosine", O.over("""SELECT s1_id, match_id, round(coalesce(dot / (x.norm * y.norm), 0), 6) AS cosine FROM pairs
  LEFT JOIN (SELECT s1_id, match_id, sum(a.weight * b.weight) AS dot FROM pairs JOIN weights a ON a.id = s1_id JOIN weights b ON b.id = match_id AND b.word = a.word GROUP BY ALL) USING (s1_id, match_id)
  LEFT JOIN norms x ON x.id = s1_id LEFT JOIN norms y ON y.id = match_id""", *O.PAIRS, WEIGHTS, "norms AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY 1)"))
def _(spark, d):
    g = grouped(spark, d, WORDS + PLACES)
    every = g.left.unionByName(g.right)
    if "size" not in every.columns:  # a repeated id has the words of all its rows
        w = pairs.weights(every)
        return pairs.cosine(union(g.left, g.right).select("s1_id", "match_id"), w, w).select("s1_id", "match_id", *r6("cosine"))
    names = cut(spark, every.select("entity_id", F.min("entity_id").over(Window.partitionBy("name_tokens_no_suffix")).alias("name")))
    w = cut(spark, pairs.weights(every).join(names.select(F.col("name").alias("id")).distinct(), "id", "left_semi"))
    name = lambda x, y: names.select(F.col("entity_id").alias(x), F.col("name").alias(y))
    found = cut(spark, union(g.left, g.right).select("s1_id", "match_id"))
    found = cut(spark, found.join(name("s1_id", "a_name"), "s1_id").join(name("match_id", "b_name"), "match_id"))
    # names are far fewer than records, and a pair's cosine is that of their pair
    alike = pairs.cosine(found.select(F.col("a_name").alias("s1_id"), F.col("b_name").alias("match_id")).distinct(), w, w)
    alike = cut(spark, alike.select(F.col("s1_id").alias("a_name"), F.col("match_id").alias("b_name"), *r6("cosine")))
    return in_full(found.join(alike, ["a_name", "b_name"]).select("s1_id", "match_id", "cosine"), g)


@query("V1_hash_folds", O.over(f"SELECT s1_id, match_id, {fold_of('s1_id', 5)} AS fold FROM truth"))
def _(spark, d):
    return folds.hash_folds(truth(spark, d), "s1_id")


GREEDY = f"""WITH RECURSIVE t AS ({demo.plain(demo.TRUTH)}), g AS (SELECT row_number() OVER (ORDER BY size DESC) AS k, size FROM (SELECT count(*) AS size FROM t GROUP BY s1_id)),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load UNION ALL
  SELECT g.k, list_transform(load, lambda x, i: CASE WHEN i = list_position(load, list_min(load)) THEN x + size ELSE x END) FROM r JOIN g ON g.k = r.k + 1)
SELECT unnest(range(5))::INTEGER AS fold, unnest(load)::BIGINT AS rows FROM r WHERE k = (SELECT count(*) FROM g)"""


@query("V1_balanced_folds", GREEDY)
def _(spark, d):
    return folds.balanced_folds(truth(spark, d), "s1_id").groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))


@query("V2_leakage_check", O.over(f"SELECT true AS by_group, NOT EXISTS (SELECT 1 FROM truth GROUP BY s1_id HAVING bool_or({fold_of('match_id', 5)} = 0) AND bool_or({fold_of('match_id', 5)} <> 0)) AS by_row"))
def _(spark, d):
    clean = lambda column: (rows := folds.hash_folds(truth(spark, d), column)) and folds.has_no_leakage(rows.where("fold <> 0"), rows.where("fold = 0"), "s1_id")
    return spark.createDataFrame([(clean("s1_id"), clean("match_id"))], "by_group boolean, by_row boolean")


@query("V3_pair_classifier")
def _(spark, d):
    return linkage(spark, d).scored.select("s1_id", "match_id", "fold", "label", *r6("score"))


@query("V4_calibration")
def _(spark, d):
    return linkage(spark, d).calibrated.select("s1_id", "match_id", "fold", *r6("score", "calibrated"))


HELD = f"{fold_of('{0}', folds.N_SPLITS)} = {link_all.VALIDATION}"


@query("V5_thresholds", O.over(f"""SELECT threshold, round(avg({O.F_BETA}), 6) AS macro_f_beta FROM (
  SELECT threshold, entity_id, coalesce(truths, 0) AS truths, coalesce(guesses, 0) AS guesses, coalesce(hits, 0) AS hits
  FROM (SELECT unnest({GRID}::DOUBLE[]) AS threshold) CROSS JOIN (SELECT entity_id FROM records WHERE source = 'S1' AND {HELD.format('entity_id')})
  LEFT JOIN (SELECT s1_id AS entity_id, count(*) AS truths FROM truth GROUP BY 1) USING (entity_id)
  LEFT JOIN (SELECT threshold, s.s1_id AS entity_id, count(*) AS guesses, count(t.s1_id) AS hits FROM scored s JOIN (SELECT unnest({GRID}::DOUBLE[]) AS threshold) ON score >= threshold
    LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.match_id = s.match_id GROUP BY ALL) USING (threshold, entity_id)) GROUP BY 1""", *O.PAIRS, O.SCORED))
def _(spark, d):
    held = lambda df: folds.hash_folds(df, "s1_id").where(f"fold = {link_all.VALIDATION}").drop("fold")  # noqa: E731  the fold that no model is trained on
    found, g = scored(spark, d)
    return decide.thresholds(held(classes.for_left(found, g.of_left)), held(truth(spark, d)), held(entities(spark, d)), GRID, of=g.of_right).select("threshold", *r6("macro_f_beta"))


@query("V6_entity_lists", O.over("SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(s.match_id, ',' ORDER BY s.match_id), '') AS matched_entity_ids FROM (SELECT entity_id FROM records WHERE source = 'S1') e LEFT JOIN (SELECT * FROM scored WHERE score >= 0.6) s ON s.s1_id = e.entity_id GROUP BY 1", *O.PAIRS, O.SCORED))
def _(spark, d):
    found, g = scored(spark, d)
    return decide.lists(entities(spark, d), classes.for_left(decide.decide(found, 0.6), g.of_left), of=g.of_right)


@query("linkage_lists")
def _(spark, d):
    return linkage(spark, d).lists


@query("linkage_report")
def _(spark, d):
    return linkage(spark, d).report.select("threshold", "chosen", "fold", "entities", *r6("macro_f_beta"))


# ---- rules for result files


def rule(name: str, code: str, severity: str, offenders: str, make, *before: str) -> None:
    @query(name, O.finding(code, severity, offenders, *before))
    def _(spark, d):
        return make(spark, d).where(F.col("rule") == code)


rule("C4_row_without_tab", "C4", "error", "SELECT line AS x FROM rows WHERE NOT tab", lambda s, d: checks.row_rules(results(s, d)), O.ROWS)
rule("C5_repeated_row", "C5", "error", "SELECT s1_id AS x FROM rows WHERE tab GROUP BY 1 HAVING count(*) > 1", lambda s, d: checks.row_rules(results(s, d)), O.ROWS)
rule("C6_repeated_id", "C6", "error", "SELECT s1_id AS x FROM rows WHERE tab AND len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))", lambda s, d: checks.row_rules(results(s, d)), O.ROWS)
rule("C7_own_source", "C7", "error", "SELECT id AS x FROM listed WHERE id LIKE 'S1-%'", lambda s, d: checks.id_rules(results(s, d)), O.ROWS, O.LISTED)
rule("C8_no_source", "C8", "error", "SELECT id AS x FROM listed WHERE NOT (id LIKE 'S1-%' OR id LIKE 'S2-%' OR id LIKE 'S3-%')", lambda s, d: checks.id_rules(results(s, d)), O.ROWS, O.LISTED)
rule("C9_unknown_id", "C9", "error", "SELECT id AS x FROM listed WHERE (id LIKE 'S2-%' OR id LIKE 'S3-%') AND id NOT IN (SELECT entity_id FROM records)", lambda s, d: checks.id_rules(results(s, d), records(s, d).where("source <> 'S1'")), O.NORMAL, O.ROWS, O.LISTED)
rule("C10_missing_entity", "C10", "error", "SELECT entity_id AS x FROM records WHERE source = 'S1' AND entity_id NOT IN (SELECT s1_id FROM rows WHERE tab)", lambda s, d: checks.entity_rules(results(s, d), records(s, d).where("source = 'S1'")), O.NORMAL, O.ROWS)
rule("C11_extra_entity", "C11", "error", "SELECT s1_id AS x FROM rows WHERE tab AND s1_id NOT IN (SELECT entity_id FROM records WHERE source = 'S2')", lambda s, d: checks.entity_rules(results(s, d), records(s, d).where("source = 'S2'")), O.NORMAL, O.ROWS)
rule("C12_not_candidate", "C12", "warning", "SELECT s1_id AS x FROM (SELECT * FROM last EXCEPT SELECT * FROM truth)", lambda s, d: checks.subset_rule(results(s, d), truth(s, d).select(F.xxhash64("match_id").alias("line"), F.lit(True).alias("tab"), "s1_id", F.col("match_id").alias("ids")).transform(lambda t: t.groupBy("s1_id").agg(F.max("line").alias("line"), F.lit(True).alias("tab"), F.concat_ws(",", F.collect_set("ids")).alias("ids")))), O.NORMAL, O.ROWS, O.LAST)


@query("C1_3_header", "SELECT 'C1' AS rule UNION ALL SELECT 'C2' UNION ALL SELECT 'C3'")
def _(spark, d):
    found = checks.header_findings(spark, f"{d}/no-such-file", checks.MATCHING)
    for header in ("source1_entity_id,matched_entity_ids", "source1_entity_id\tsomething_else", "Source1_Entity_Id \tmatched_entity_ids"):
        path = scratch(spark, "header")
        spark.createDataFrame([(header,)], "value string").write.text(path)
        found += checks.header_findings(spark, path, checks.MATCHING)
    return spark.createDataFrame([(f[0],) for f in found], "rule string")


@query("C13_15_whole_check", "SELECT * FROM (VALUES ('no candidates', 'C13', 'warning', true), ('an entity left out', 'C10', 'error', false), ('an entity left out', 'C14', 'warning', false)) t(run, rule, severity, pass)")
def _(spark, d):
    folder, whole, part, listed = (scratch(spark, x) for x in ("test", "matching", "matching", "candidates"))
    for k in (1, 2, 3):
        records(spark, d).where(f"source = 'S{k}'").select("entity_id", "business_name", "business_address", "country").write.options(sep="\t", header=True).csv(f"{folder}/test_source{k}.tsv")
    lists = truth_lists(spark, d)
    tsv.write_results(lists, whole)
    tsv.write_results(lists.where("source1_entity_id <> 'S1-C1'"), part)
    tsv.write_results(lists.withColumnRenamed("matched_entity_ids", "candidate_entity_ids"), listed)
    out = []
    for run, matching, candidates_, ids in (("no candidates", whole, f"{whole}-none", True), ("an entity left out", part, listed, False)):
        found = checks.validate(spark, matching, candidates_, folder, ids).collect()
        passed = all(r.severity != "error" for r in found)
        out += [(run, r.rule, r.severity, passed) for r in found]
    return spark.createDataFrame(out, "run string, rule string, severity string, pass boolean")


@query("stream_golden_join", O.over("SELECT s1_id, match_id FROM golden", O.GOLDEN))
def _(spark, d):
    source, sink, marks = (scratch(spark, x) for x in ("arrivals", "links", "marks"))
    rows = records(spark, d)
    rows.where("source <> 'S1'").write.parquet(source)
    linked = link.golden_stream(link.record_stream(spark, source, rows.schema), sides(spark, d)[0])
    linked.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(linked.schema).parquet(sink)
