"""Candidate generation: channels that are equi-joins on a key, their union, recall and pruning."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word, or pair of words, that more records of the right side have is refined: pairs grow with the square of a key's size.
MOST_RECORDS = 50
#: Pairs of words that are shuffled at a time, about 21 bytes each.
COUPLES = 40_000_000
#: MinHash bands and rows: pairs of similarity 0.8 are found with probability 0.95, of 0.6 with 0.38, of 0.4 with 0.04.
BANDS, ROWS = 10, 6
#: Words that say nothing in a name.
EMPTY_WORDS = ("and",)


def weight(df: DataFrame) -> Column:
    """How many records a row stands for: its `size`, if it is the one record of a class (operators.classes)."""
    return F.col("size") if "size" in df.columns else F.lit(1)


def keyed(df: DataFrame, key: Column, ident: str = "entity_id") -> DataFrame:
    return df.select(F.col(ident).alias("id"), weight(df).alias("size"), key.alias("key")).where(F.col("key").isNotNull() & (F.col("key") != ""))


def on_key(left: DataFrame, right: DataFrame, channel: str, once: bool = False) -> DataFrame:
    """s1_id, match_id, channel of the records that share a key. once: no id has two rows, so that no pair comes twice."""
    a, b = left.select(F.col("id").alias("s1_id"), "key"), right.select(F.col("id").alias("match_id"), "key")
    found = a.join(b, "key").select("s1_id", "match_id", F.lit(channel).alias("channel"))
    return found if once else found.distinct()


def rare_keys(keys: DataFrame, most: int) -> DataFrame:
    """The keys of at most `most` records. A key's size is counted with a map-side combine; with a second key made of the first, both sides of the join get an exchange, and a hot key can be split."""
    again = F.xxhash64("key").alias("again")
    rare = keys.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") <= most).select("key", again)
    return keys.select("*", again).join(rare, ["key", "again"], "left_semi").drop("again")


def name_words(words: Column) -> Column:
    """The distinct words of a name that tell names apart, in order."""
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*EMPTY_WORDS))))


def all_words(name: str = "name_tokens_no_suffix", address: str = "address_tokens") -> Column:
    """The words of name and address, told apart by a prefix."""
    return F.array_union(F.transform(name_words(F.col(name)), lambda w: F.concat(F.lit("n:"), w)), F.transform(F.col(address), lambda w: F.concat(F.lit("a:"), w)))


def couples(words: Column, part: int = 0, parts: int = 1) -> Column:
    """All pairs of the distinct words, each in order; with parts, those whose first word falls to one of them by its hash."""
    mine = lambda x: F.lit(True) if parts == 1 else F.pmod(F.xxhash64(x), F.lit(parts)) == part
    later = lambda o, x, k: F.transform(F.slice(o, k + 2, F.greatest(F.size(o) - k - 1, F.lit(0))), lambda y: F.concat_ws(" ", x, y))
    one = lambda o: F.flatten(F.transform(o, lambda x, k: F.when(mine(x), later(o, x, k)).otherwise(F.array().cast("array<string>"))))
    return F.element_at(F.transform(F.array(F.sort_array(F.array_distinct(words))), one), 1)  # bound to a variable, so that words are sorted once


def paired(df: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """entity_id, size, key for each of the couples of a record's distinct words; rows are made natively, where couples makes an array."""
    first = df.select("entity_id", "size", "words", F.explode("words").alias("x"))
    mine = first if parts == 1 else first.where(F.pmod(F.xxhash64("x"), F.lit(parts)) == part)
    each = mine.select("entity_id", "size", "x", F.explode("words").alias("y")).where(F.col("x") < F.col("y"))
    return each.select("entity_id", "size", F.concat_ws(" ", "x", "y").alias("key"))


def token_channel(
    left: DataFrame, right: DataFrame, words: Column | None = None, whole: Column | None = None, most: int = MOST_RECORDS, keep: Callable[[DataFrame], DataFrame] | None = None, at_once: int = COUPLES, once: bool = True
) -> DataFrame:
    """Records that share a word that few records have, however large the table is.

    Each record of the right side has the finest keys that it needs: its words of at most `most` records; if it has none,
    its pairs of words that as many such records have; if it has none of those either, all words of its name. A record of
    the left side meets it under any of its own words, pairs, or all words of its name.

    Pairs of words are many times the records. With keep(df), which returns df as a table, they are made and shuffled in
    parts of about `at_once` by their first word, and no more than a part of them is on disk at a time. Without once, a
    pair may come several times, and the caller's own distinct is the only shuffle of all pairs.
    """
    words = F.col("name_tokens_no_suffix") if words is None else words
    whole = name_words(F.col("name_tokens_no_suffix")) if whole is None else whole
    table = keep or (lambda df: df)
    bags = lambda df: df.select("entity_id", weight(df).alias("size"), F.array_distinct(words).alias("words"), F.concat_ws(" ", whole).alias("whole"))
    each = lambda df, key: keyed(df.select("entity_id", "size", F.explode(key).alias("key")), F.col("key"))
    every = lambda df: keyed(df, F.col("whole"))
    ids = lambda df: df.select(F.col("id").alias("entity_id")).distinct()
    a, b = bags(left), bags(right)
    rare = table(rare_keys(each(b, F.col("words")), most))
    second = table(b.join(ids(rare), "entity_id", "left_anti"))
    n = F.size("words").cast("long")
    both = sum(df.agg(F.sum(n * (n - 1) / 2).alias("n")).first().n or 0 for df in (a, second)) if keep else 0
    parts = int(both // at_once) + 1
    fine, found = [], [on_key(each(a, F.col("words")), rare, "token", not once)]
    for k in range(parts):
        pair = lambda df: keyed(paired(df, k, parts), F.col("key"))  # noqa: E731, B023  used within the round
        fine.append(table(rare_keys(pair(second), most)))
        found.append(table(on_key(pair(a), fine[-1], "token")))
    third = second.join(ids(reduce(DataFrame.unionByName, fine)), "entity_id", "left_anti")
    # the right records of the three kinds of keys differ, so that a pair comes twice in several parts alone
    found.append(on_key(every(a), every(third), "token", not once))
    every_pair = reduce(DataFrame.unionByName, found)
    return every_pair.distinct() if parts > 1 and once else every_pair


def place_channel(left: DataFrame, right: DataFrame, field: str) -> DataFrame:
    """Records of one country that share a postal code."""
    key = F.when(F.col(field) != "", F.concat_ws("|", "country", field))
    return on_key(keyed(left, key), keyed(right, key), field, once="size" in left.columns and "size" in right.columns)


def refined(left: DataFrame, right: DataFrame, key: Column, words: Column, channel: str, most: int = MOST_RECORDS) -> DataFrame:
    """Records that share a key; under a key of more than `most` records of the right side, those that also share one of their words, or of which one has no word."""
    side = lambda df, x: df.select(F.col("entity_id").alias(x), weight(df).alias("size"), key.alias("coarse"), words.alias("words")).where(F.col("coarse").isNotNull() & (F.col("coarse") != ""))
    a, b = side(left, "s1_id"), side(right, "match_id")
    large = b.groupBy("coarse").agg((F.sum("size") > most).alias("large"))
    many = b.join(large, "coarse").select("coarse", "match_id", "large", F.col("words").alias("others"))
    meets = ~F.col("large") | (F.size("words") == 0) | (F.size("others") == 0) | F.arrays_overlap("words", "others")
    found = a.join(many, "coarse").where(meets).select("s1_id", "match_id", F.lit(channel).alias("channel"))
    return found if "size" in left.columns and "size" in right.columns else found.distinct()  # an id of a class has one row, so no pair comes twice


def city_channel(left: DataFrame, right: DataFrame, field: str = "city_guess", most: int = MOST_RECORDS) -> DataFrame:
    """Records of one country and city; in a large city, those that share a word of the name, too."""
    return refined(left, right, F.when(F.col(field) != "", F.concat_ws("|", "country", field)), name_words(F.col("name_tokens_no_suffix")), field, most)


def phonetic_channel(left: DataFrame, right: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Records whose names sound alike in one country; of a frequent sound, those that share a word of the address, too."""
    return refined(left, right, F.when(F.col("name_phonetic") != "", F.concat_ws("|", "country", "name_phonetic")), F.array_distinct("address_tokens"), "phonetic", most)


#: Hashes of grams are 32 bits of an md5; row r's is (hash * (2 * r * r + 7919 * r + 104729) + 15485863 * r) modulo this prime.
PRIME = 2_147_483_647


def row_factors(row: int) -> tuple[int, int]:
    return (2 * row * row + 7919 * row + 104_729) % PRIME, 15_485_863 * row % PRIME


def signature(grams: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """MinHash band keys of an array of n-grams: one md5 a gram, from which each row's hash comes by a product and a sum."""

    def least(hashes: Column, row: int) -> Column:
        factor, more = row_factors(row)
        return F.array_min(F.transform(hashes, lambda h: (h * F.lit(factor).cast("long") + F.lit(more).cast("long")) % F.lit(PRIME).cast("long"))).cast("string")

    hashes = F.transform(F.array_distinct(grams), lambda g: F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"))
    keys = lambda hs: F.array(*[F.concat_ws(":", F.lit(str(b)), *[least(hs, b * rows + r) for r in range(rows)]) for b in range(bands)])
    return F.element_at(F.transform(F.array(hashes), keys), 1)  # bound to a variable, so that each md5 is computed once


def minhash_channel(left: DataFrame, right: DataFrame, grams: Column | None = None, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Records whose n-grams (of the name, or as given) agree in a MinHash band."""
    grams = F.col("name_char_ngrams") if grams is None else grams
    keys = lambda df: keyed(df.where(F.size(grams) > 0).select("entity_id", F.explode(signature(grams, bands, rows)).alias("band")), F.col("band"))
    return on_key(keys(left), keys(right), "minhash")


def band_hashes(records: DataFrame, grams: Column, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """ids (those that a record stands for) and `keys`, 64 bits of each of its MinHash band keys."""
    return records.where(F.size(grams) > 0).select("ids", F.transform(signature(grams, bands, rows), lambda k: F.xxhash64(k)).alias("keys"))


def band_rows(left: DataFrame, right: DataFrame, band: int, most: int = 1000) -> DataFrame:
    """Of two frames of band_hashes, rows of `lefts` and `rights` that agree in a band, of about `most` ids each, with their keys of the bands before."""

    def side(df: DataFrame, name: str) -> DataFrame:
        entry = F.struct("ids", *[F.col("keys")[k].alias(f"key{k}") for k in range(band)])
        before = F.sum(F.size("entry.ids")).over(Window.partitionBy("key").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        rows = df.select(F.col("keys")[band].alias("key"), entry.alias("entry")).withColumn("row", F.floor(F.coalesce(before, F.lit(0)) / most))
        return rows.groupBy("key", "row").agg(F.collect_list("entry").alias(name)).drop("row")

    return side(left, "lefts").join(side(right, "rights"), "key").drop("key")


def of_band(rows: DataFrame, band: int) -> DataFrame:
    """s1_id, match_id, channel of the pairs in band_rows that agree in no band before, so that a pair comes from its first band alone. Nothing is shuffled."""
    met = rows.select(F.explode("lefts").alias("a"), "rights").select("a", F.explode("rights").alias("b"))
    for k in range(band):
        met = met.where(F.col(f"a.key{k}") != F.col(f"b.key{k}"))
    return met.select(F.explode("a.ids").alias("s1_id"), F.col("b.ids").alias("others")).select("s1_id", F.explode("others").alias("match_id"), F.lit("minhash").alias("channel"))


def union(*channels: DataFrame) -> DataFrame:
    """Each pair once, with the channels that found it."""
    every = reduce(DataFrame.unionByName, channels)
    return every.groupBy("s1_id", "match_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))


def recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true_pairs, covered, recall of the candidates."""
    found = truth.select("s1_id", "match_id").distinct().join(pairs.select("s1_id", "match_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "match_id"], "left")
    return found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("covered")).withColumn("recall", F.coalesce(F.try_divide("covered", "true_pairs"), F.lit(0.0)))


def channel_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """channel, pairs, true_pairs, covered, recall of each channel in a union, and of all of them ("union")."""
    each = found.select("s1_id", "match_id", F.explode(F.array_append("channels", F.lit("union"))).alias("channel"))
    true = truth.select("s1_id", "match_id").distinct().withColumn("hit", F.lit(1))
    rows = each.join(true, ["s1_id", "match_id"], "left").groupBy("channel").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("covered"))
    total = F.broadcast(true.agg(F.count(F.lit(1)).alias("true_pairs")))  # one row
    return rows.join(total).select("channel", "pairs", "true_pairs", "covered", F.coalesce(F.try_divide("covered", "true_pairs"), F.lit(0.0)).alias("recall"))


def prune(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best candidates of each record, ties to smaller ids (S4). Spark limits each map task's groups before the shuffle."""
    order = Window.partitionBy("s1_id").orderBy(F.col(score).desc(), "match_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
