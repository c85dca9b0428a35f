"""Sure links, candidates, scores, folds and decisions."""

import random

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, classes, decide, evaluate, folds, model, pairs
from kindred.operators import link as link_all
from kindred.operators.golden import golden_join, golden_match
from kindred.operators.normalize import normalize
from kindred.plans import catalog
from kindred.streaming import link

NATIVE = ("normalized_name", "aggressive_normalized_name", "name_tokens_no_suffix", "name_char_ngrams", "normalized_address", "address_tokens", "postal_code_guess", "city_guess", "street_number_guess", "name_missing", "address_missing", "postal_missing", "city_missing", "country")
# name, address, country of either side, and whether they match
CASES = [
    ("Bluefin Ltd", "7 Quay Rd", "PT", "Bluefin Inc", "7 Quay Road", "PT", True),
    ("Bluefin Ltd", "7 Quay Rd, 40210", "PT", "Bluefin SARL", "12 Harbour Sq, 40210", "PT", True),
    ("Bluefin Ltd", "7 Quay Rd", "PT", "Bluefin Inc", "12 Harbour Sq", "Peru", False),
    ("Bluefin Ltd", "7 Quay Road", "PT", "Bluefin Inc", "7 Quay Road", "Peru", False),
    ("Bluefin Ltd", "Quay Road", "PT", "Bluefin Inc", "Harbour Square", "PT", False),
    ("Bluefin Ltd", "7 Quay Rd, 40210", "PT", "Redfin Ltd", "7 Quay Rd, 40210", "PT", False),
    ("Bluefin Ltd", "7 Quay Rd, 40210", "PT", "Bluefin Inc", "12 Harbour Sq, 40210", "Peru", False),
    ("Limited Co", "3 Mill Ln", "PT", "Private", "3 Mill Ln", "PT", False),
    ("Bluefin", "", "PT", "Bluefin", None, "PT", False),
    ("Bluefin", "3 Mill Ln", "", "Bluefin", "3 Mill Ln", None, False),
]


def records(spark, rows):
    return normalize(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string"), every_script=False, only=NATIVE)


@pytest.mark.parametrize("case", CASES)
def test_golden_cases(spark, case):
    a, b, want = [("S1-1", *case[:3])], [("S2-1", *case[3:6])], case[6]
    left, right = records(spark, a), records(spark, b)
    assert golden_join(left, right).count() == golden_join(right, left).count() == int(want)
    both = left.select(F.struct("*").alias("a")).join(right.select(F.struct("*").alias("b")))
    assert both.select(golden_match(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))).first()[0] == want


def pair_table(spark, sets):
    return spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], "s1_id string, match_id string")


@pytest.mark.parametrize(
    "truth,guess,score",
    [
        ({"a": ["S2-100"], "b": ["S3-200"]}, {"a": ["S2-100"], "b": ["S3-200"]}, 1.0),
        ({"a": []}, {"a": []}, 1.0),
        ({"a": []}, {"a": ["S2-100"]}, 0.0),
        ({"a": ["S2-1", "S2-2"]}, {"a": ["S2-1"]}, 0.625 / 0.75),
        ({"a": ["S2-100"]}, {"a": ["S3-999"]}, 0.0),
        ({"a": [], "b": [], "c": ["S2-100"]}, {"a": [], "b": ["S2-50"], "c": ["S2-100"]}, 2 / 3),
        ({}, {}, 0.0),
    ],
)
def test_macro_f_beta(spark, truth, guess, score):
    every = spark.createDataFrame([(k,) for k in {*truth, *guess}], "s1_id string")
    assert abs(evaluate.macro_f_beta(pair_table(spark, truth), pair_table(spark, guess), every).first().macro_f_beta - score) < 1e-12


def test_f_beta_for_other_weights_and_lists(spark):
    cells = spark.createDataFrame([("a", " S2-1 ,S2-2,,S2-1"), ("b", None)], "id string, cell string")
    every, truth = evaluate.from_lists(cells, "id", "cell")
    assert sorted(map(tuple, truth.collect())) == [("a", "S2-1"), ("a", "S2-2")] and every.count() == 2
    assert cells.select(F.size(evaluate.id_list(F.col("cell"), distinct=False))).collect()[0][0] == 3
    one = pair_table(spark, {"a": ["S2-1"]})
    for beta in (1.0, 2.0):
        p, r = 1.0, 0.5
        want = ((1 + beta**2) * p * r / (beta**2 * p + r) + 1) / 2
        assert abs(evaluate.macro_f_beta(truth, one, every, beta).first().macro_f_beta - want) < 1e-12
    assert evaluate.macro_f_beta(truth, truth, every).first().macro_f_beta == 1.0


def test_balanced_folds_follow_the_greedy_rule(spark):
    rng = random.Random(7)
    for sizes, n in (([2, 2, 2, 1, 1], 3), ([rng.choice([1, 1, 2, 3, 9, 40]) for _ in range(200)], 5), ([1] * 30, 4), ([50, 1, 1, 1, 1, 1], 3)):
        df = spark.createDataFrame([(f"g{k}", v) for k, s in enumerate(sizes) for v in range(s)], "source1_entity_id string, val int")
        got = folds.balanced_folds(df, n_splits=n)
        per_group = got.groupBy("source1_entity_id").agg(F.countDistinct("fold").alias("f")).agg(F.max("f")).first()[0]
        load = [0] * n
        for s in sorted(sizes, reverse=True):
            load[load.index(min(load))] += s
        assert per_group == 1 and got.count() == sum(sizes)
        assert sorted(r["count"] for r in got.groupBy("fold").count().collect()) == sorted(x for x in load if x)
        for k in range(n):
            assert folds.has_no_leakage(got.where(F.col("fold") != k), got.where(F.col("fold") == k))
    with pytest.raises(ValueError):
        folds.balanced_folds(df.limit(1), n_splits=3)


def test_shares_of_folds_equal_the_greedy_rule():
    rng = random.Random(2)
    for _ in range(300):
        load, size, groups = [rng.randrange(40) for _ in range(rng.randrange(1, 6))], rng.randrange(1, 9), rng.randrange(60)
        want, weights = [0] * len(load), list(load)
        for _ in range(groups):
            k = weights.index(min(weights))
            weights[k] += size
            want[k] += 1
        assert folds.shares(load, size, groups) == want
    assert sum(folds.shares([10**9, 0, 0, 0, 0], 1, 4 * 10**9 + 7)) == 4 * 10**9 + 7  # no step for each group


def test_hash_folds_and_leakage(spark):
    df = spark.range(500).select(F.concat(F.lit("g"), (F.col("id") % 60).cast("string")).alias("source1_entity_id"), "id")
    got = folds.hash_folds(df)
    assert got.groupBy("source1_entity_id").agg(F.countDistinct("fold").alias("f")).where("f > 1").isEmpty()
    assert not folds.has_no_leakage(df.where("id < 250"), df.where("id >= 250"))
    with pytest.raises(ValueError):
        folds.hash_folds(df, n_splits=1)


def test_channels_recall_and_pruning(spark):
    left = records(spark, [("S1-1", "Alpha Beta Ltd", "1 Main St, Rome 10001", "IT"), ("S1-2", "Gamma", "2 Oak Ave, Pisa 20002", "IT"), ("S1-3", "", "", "IT")])
    right = records(spark, [("S2-1", "Alpha Bexa", "9 Hill Rd, Rome 10001", "IT"), ("S2-2", "Gamma Inc", None, "IT"), ("S3-1", "Other", "2 Oak Ave, Pisa 20002", "US"), ("S3-2", None, None, None)])
    ids = lambda df: sorted((r.s1_id, r.match_id) for r in df.collect())
    assert ids(blocking.token_channel(left, right)) == [("S1-1", "S2-1"), ("S1-2", "S2-2")]
    assert ids(blocking.token_channel(left, right, most=0)) == [("S1-2", "S2-2")]  # then whole names alone
    assert ids(blocking.place_channel(left, right, "postal_code_guess")) == [("S1-1", "S2-1")]
    assert ("S1-2", "S2-2") in ids(blocking.minhash_channel(left, right, bands=8, rows=1))
    found = blocking.union(blocking.token_channel(left, right), blocking.place_channel(left, right, "postal_code_guess"))
    assert {r.s1_id: r.channels for r in found.collect()} == {"S1-1": ["postal_code_guess", "token"], "S1-2": ["token"]}
    truth = pair_table(spark, {"S1-1": ["S2-1"], "S1-2": ["S2-2", "S3-9"]})
    assert tuple(blocking.recall(found, truth).first()) == (3, 2, 2 / 3)
    each = {r.channel: (r.pairs, r.true_pairs, r.covered) for r in blocking.channel_recall(found, truth).collect()}
    assert each == {"postal_code_guess": (1, 3, 1), "token": (2, 3, 2), "union": (2, 3, 2)}
    f = pairs.features(found, left, right).collect()
    assert {r.s1_id: r.token_jaccard for r in f} == {"S1-1": 1 / 3, "S1-2": 1.0} and all(0 <= r.jaro_winkler <= 1 for r in f)
    w = pairs.weights(left.unionByName(right))
    assert {r.s1_id: round(r.cosine, 6) for r in pairs.cosine(found, w, w).collect()}["S1-2"] == 1.0


def test_frequent_tokens_keep_finer_keys(spark):
    left = records(spark, [("S1-1", "Alpha Beta", "", "IT"), ("S1-2", "Alpha Gamma", "", "IT"), ("S1-3", "Alpha", "", "IT")])
    right = records(spark, [*[(f"S2-{k}", "Alpha Beta", "", "IT") for k in range(3)], *[(f"S3-{k}", "Alpha Gamma", "", "IT") for k in range(2)], ("S3-9", "Alpha", "", "IT")])
    ids = lambda df: sorted((r.s1_id, r.match_id) for r in df.collect())
    want = sorted([*[("S1-1", f"S2-{k}") for k in range(3)], *[("S1-2", f"S3-{k}") for k in range(2)], ("S1-3", "S3-9")])
    for most in (0, 1, 2):
        assert ids(blocking.token_channel(left, right, most=most)) == want
    bags = lambda df: df.withColumn("address_tokens", F.array())
    assert ids(blocking.token_channel(bags(left), bags(right), blocking.all_words(), most=2)) == want


def test_pairs_of_words_and_cities(spark):
    row = spark.createDataFrame([(["c", "a", "b", "a"],), (["z"],), ([],)], "w array<string>").select(blocking.couples(F.col("w")).alias("x")).collect()
    assert [r.x for r in row] == [["a b", "a c", "b c"], [], []]
    left = records(spark, [("S1-1", "Alpha and Beta", "1 Main St, Rome, 10001", "IT"), ("S1-2", "Gamma", "2 Oak Ave, Rome, 20002", "IT"), ("S1-3", "Gamma", "2 Oak Ave, Rome, 20002", "US")])
    right = records(spark, [("S2-1", "Zeta Beta", "9 Hill Rd, Rome, 30003", "IT"), ("S2-2", "Other and Name", "9 Hill Rd, Rome, 30003", "IT"), ("S2-3", None, "9 Hill Rd, Rome, 30003", "IT")])
    ids = lambda df: sorted((r.s1_id, r.match_id) for r in df.collect())
    assert ids(blocking.city_channel(left, right)) == [(a, b) for a in ("S1-1", "S1-2") for b in ("S2-1", "S2-2", "S2-3")]
    assert ids(blocking.city_channel(left, right, most=2)) == [("S1-1", "S2-1"), ("S1-1", "S2-3"), ("S1-2", "S2-3")]  # a nameless record meets the whole city
    sounds = [df.withColumn("name_phonetic", F.lit("X")) for df in (left, right)]
    assert len(ids(blocking.phonetic_channel(*sounds))) == 6
    assert ids(blocking.phonetic_channel(*sounds, most=2)) == ids(blocking.phonetic_channel(*sounds))  # all have the word "rome"
    apart = [sounds[0].withColumn("address_tokens", F.array("entity_id")), sounds[1].withColumn("address_tokens", F.when(F.col("entity_id") == "S2-1", F.array()).when(F.col("entity_id") == "S2-2", F.array(F.lit("S1-2"))).otherwise(F.array(F.lit("z"))))]
    assert ids(blocking.phonetic_channel(*apart, most=2)) == [("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-2", "S2-2")]


def test_whole_linkage(spark):
    """Lists, threshold and report against a plain computation on the calibrated scores; recall of the candidates."""
    data = "/root/testdata/sf0.001"
    got = catalog.linkage(spark, data)
    assert {r.channel: r.recall for r in catalog.QUERIES["G15_candidate_recall"](spark, data).collect()}["union"] >= 0.99
    truth = {}
    for r in catalog.truth(spark, data).collect():
        truth.setdefault(r.s1_id, set()).add(r.match_id)
    rows = got.calibrated.collect()
    sure = {(r.s1_id, r.match_id) for r in catalog.golden(spark, data).collect()}
    assert {(r.s1_id, r.match_id) for r in rows if r.calibrated == 1} >= sure and all(0 <= r.calibrated <= 1 for r in rows)
    assert {r.fold for r in rows} == set(range(5)) and len({(r.s1_id, r.fold) for r in rows}) == len({r.s1_id for r in rows})
    entities = {r.s1_id for r in folds.hash_folds(catalog.entities(spark, data), "s1_id").where("fold = 4").collect()}

    def macro(threshold):
        total = 0.0
        for e in entities:
            guess, true = {r.match_id for r in rows if r.s1_id == e and r.calibrated >= threshold}, truth.get(e, set())
            hits = len(guess & true)
            total += 1.0 if not guess and not true else 1.25 * hits / (0.25 * len(true) + len(guess)) if hits else 0.0
        return total / len(entities)

    report = got.report.collect()
    assert all(abs(r.macro_f_beta - macro(r.threshold)) < 1e-9 and r.entities == len(entities) for r in report)
    (chosen,) = [r for r in report if r.chosen]
    assert chosen.threshold == got.threshold and chosen.macro_f_beta == max(r.macro_f_beta for r in report) > 0.7
    lists = {r.source1_entity_id: r.matched_entity_ids for r in got.lists.collect()}
    want = {}
    for r in rows:
        if r.calibrated >= got.threshold:
            want.setdefault(r.s1_id, []).append(r.match_id)
    assert lists == {r.s1_id: ",".join(sorted(want.get(r.s1_id, []))) for r in catalog.entities(spark, data).collect()}


def test_linkage_without_examples(spark):
    left = records(spark, [("S1-1", "Alpha", "1 Main St, Rome 10001", "IT"), ("S1-2", "Beta", None, "IT")])
    right = records(spark, [("S2-1", "Alpha Inc", "1 Main St, Rome 10001", "IT"), ("S2-2", "Beta", None, "IT")])
    fields = ("entity_id", *NATIVE)
    found = link_all.link(left.select(*fields), right.select(*fields), blocking.token_channel(left, right), pair_table(spark, {}).where("false"), lambda df: df)
    assert sorted(map(tuple, found.lists.collect())) == [("S1-1", "S2-1"), ("S1-2", "")]


def test_city_channel_needs_no_house_number(spark):
    data = "/root/testdata/sf0.001"
    names = catalog.normal(spark, data, ("raw_address", "street_number_guess")).withColumnRenamed("entity_id", "match_id")
    found = catalog.QUERIES["J11_city_channel"](spark, data).where("channel = 'city_guess'").join(names, "match_id")
    assert not found.where("raw_address LIKE 'Unit 4, %' AND street_number_guess = ''").isEmpty()


def test_stream_links_names_of_other_scripts(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string"
    known = spark.createDataFrame([("S1-1", "राम Ltd", "1 Main St", "IN"), ("S1-2", "Traders", "1 Main St", "IN"), ("S1-3", "Москва Inc", "2 Oak Ave", "RU")], schema)
    spark.createDataFrame([("S2-1", "राम", "1 Main Street", "IN"), ("S2-2", "राम Traders", "1 Main St", "IN"), ("S2-3", "МОСКВА", "2 Oak Avenue", "RU")], schema).write.parquet(f"{tmp_path}/in")
    linked = link.golden_stream(link.record_stream(spark, f"{tmp_path}/in", known.schema), normalize(known))
    linked.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("S1-1", "S2-1"), ("S1-3", "S2-3")]


def test_decisions(spark):
    rows = [("a", "x", 0.9), ("a", "y", 0.85), ("b", "z", 0.7), ("c", "w", 0.1)]
    scored = spark.createDataFrame(rows, "s1_id string, match_id string, score double")
    every = spark.createDataFrame([(x,) for x in "abcd"], "s1_id string")
    assert sorted((r.s1_id, round(r.margin, 6)) for r in decide.margins(scored).collect()) == [("a", 0.05), ("b", 0.7), ("c", 0.1)]
    assert sorted(map(tuple, decide.decide(scored, 0.5, margin=0.1).collect())) == [("b", "z")]
    lists = {r.source1_entity_id: r.matched_entity_ids for r in decide.lists(every, decide.decide(scored, 0.5)).collect()}
    assert lists == {"a": "x,y", "b": "z", "c": "", "d": ""}
    assert [r.place for r in blocking.prune(scored, 1).orderBy("s1_id").collect()] == [1, 1, 1]
    truth = pair_table(spark, {"a": ["x"], "b": ["z"]})
    table = {r.threshold: r.macro_f_beta for r in decide.thresholds(scored, truth, every, [0.05, 0.5, 0.95]).collect()}
    for t, f in table.items():
        assert abs(f - evaluate.macro_f_beta(truth, decide.decide(scored, t), every).first().macro_f_beta) < 1e-12


def test_classifier_and_calibration(spark):
    rng = random.Random(1)
    rows = []
    for k in range(400):
        good = k % 4 == 0
        base = 0.7 if good else 0.3
        rows.append((f"a{k}", f"b{k}", *[min(1.0, max(0.0, rng.gauss(base, 0.2))) for _ in range(3)], False, rng.gauss(base, 0.3), rng.random() < base, rng.random() < base, False, "0"))
    f = spark.createDataFrame(rows, "s1_id string, match_id string, token_jaccard double, gram_jaccard double, edit double, acronym boolean, address_overlap double, same_postal boolean, same_city boolean, same_number boolean, missing string")
    truth = pair_table(spark, {f"a{k}": [f"b{k}"] for k in range(0, 400, 4)})
    data = model.labelled(f, truth)
    scored = model.score(model.train_rounds(data, trees=3), data)
    assert scored.where("(score > 0.5) = (label = 1)").count() > 340
    hard = model.hard_negatives(scored, 1.0)
    assert hard.where("label = 1").count() == 100 and hard.count() < 400
    levels = [r.calibrated for r in model.calibrated(model.calibrator(scored), scored).orderBy("score").collect()]
    assert levels == sorted(levels) and 0 <= levels[0] and levels[-1] <= 1


def test_calibration_equals_pooled_neighbours(spark):
    """The isotonic fit against pool-adjacent-violators in plain Python."""
    rng = random.Random(3)
    points = [(k / 60, float(rng.random() < k / 60)) for k in range(60)]
    pools = []
    for x, y in points:
        pools.append([y, 1, [x]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (m, n, xs), (k, w, more) = pools[-2:]
            pools[-2:] = [[(m * n + k * w) / (n + w), n + w, xs + more]]
    want = {x: m for m, _, xs in pools for x in xs}
    df = spark.createDataFrame(points, "score double, label double")
    got = {r.score: r.calibrated for r in model.calibrated(model.calibrator(df), df).collect()}
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_phonetic_channel(spark):
    left = normalize(spark.createDataFrame([("S1-1", "Smith Phone", "", "IT"), ("S1-2", "Other", "", "IT"), ("S1-3", "", "", "IT")], "entity_id string, business_name string, business_address string, country string"))
    right = normalize(spark.createDataFrame([("S2-1", "Smyth Fone", "", "IT"), ("S2-2", "Smith Phone", "", "US"), ("S2-3", None, "", "IT")], "entity_id string, business_name string, business_address string, country string"))
    assert [(r.s1_id, r.match_id) for r in blocking.phonetic_channel(left, right).collect()] == [("S1-1", "S2-1")]


def test_pairs_of_classes(spark):
    """Large groups of copies are few pairs of classes; their members have the pairs, thresholds and lists of the records themselves."""
    left = records(spark, [*[(f"S1-{k:02}", "Alpha Beta", "", "IT") for k in range(30)], ("S1-90", "Gamma Delta", "", "IT"), ("S1-91", "Gamma Delta", "2 Oak Ave, Pisa 20002", "IT")])
    right = records(spark, [*[(f"S2-{k:02}", "Alpha Beta", "", "IT") for k in range(60)], *[(f"S3-{k}", "Gamma Delta", "", "IT") for k in range(3)], ("S3-9", "Gamma Beta", "2 Oak Ave, Pisa 20002", "IT")])
    fields = ("name_tokens_no_suffix", "normalized_name", "address_tokens")
    a, b = (classes.classed(df, fields) for df in (left, right))
    g = classes.Classes(classes.representatives(a), classes.representatives(b), classes.members(a), classes.members(b))
    assert sorted(map(tuple, g.right.select("entity_id", "size").collect())) == [("S2-00", 60), ("S3-0", 3), ("S3-9", 1)]
    got = lambda df: sorted(map(tuple, df.collect()))
    found, plain = (blocking.token_channel(x, y, blocking.all_words(), most=3).localCheckpoint() for x, y in ((g.left, g.right), (left, right)))
    assert found.count() <= 9 and got(classes.for_members(found, g.of_left, g.of_right)) == got(plain)
    one = pairs.features(found, g.left, g.right, ("gram_jaccard", "address_overlap"))
    each = pairs.features(plain, left, right, ("gram_jaccard", "address_overlap"))
    assert got(classes.for_members(one, g.of_left, g.of_right)) == got(each)
    score = F.col("gram_jaccard").alias("score")
    one, each = classes.for_left(one.select("s1_id", "match_id", score), g.of_left), each.select("s1_id", "match_id", score)
    every, truth = left.select(F.col("entity_id").alias("s1_id")), pair_table(spark, {"S1-01": ["S2-01", "S2-07"], "S1-90": ["S3-1", "S3-9"]})
    assert got(decide.lists(every, one, of=g.of_right)) == got(decide.lists(every, each))
    assert got(decide.thresholds(one, truth, every, [0.1, 0.5, 0.9], of=g.of_right)) == got(decide.thresholds(each, truth, every, [0.1, 0.5, 0.9]))
    plain = {tuple(r) for r in pairs.weights(left).collect()}
    assert {tuple(r) for r in pairs.weights(g.left).collect()} <= plain


def test_token_channel_in_parts(spark):
    """Pairs of words in many parts, one on disk at a time, find what they find at once."""
    row = spark.createDataFrame([(["c", "a", "b", "d"],)], "w array<string>")
    each = [row.select(F.explode(blocking.couples(F.col("w"), k, 3)).alias("x")).collect() for k in range(3)]
    assert sorted(r.x for rows in each for r in rows) == ["a b", "a c", "a d", "b c", "b d", "c d"]
    left = records(spark, [("S1-1", "Alpha Beta Gamma", "", "IT"), ("S1-2", "Alpha Beta Delta", "", "IT"), ("S1-3", "Gamma Delta", "", "IT")])
    right = records(spark, [*[(f"S2-{k}", "Alpha Beta Gamma", "", "IT") for k in range(3)], *[(f"S3-{k}", "Beta Delta", "", "IT") for k in range(2)], ("S3-9", "Gamma Delta", "", "IT")])
    kept = []
    plain = blocking.token_channel(left, right, most=2)
    parts = blocking.token_channel(left, right, most=2, keep=lambda df: kept.append(df) or df, at_once=3)
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(parts) == got(plain) != [] and len(kept) > 4


def test_recall_and_union_by_class(spark):
    """Sums over pairs of classes, and their members' pairs, are those of the records."""
    data = "/root/testdata/sf0.001"
    g = catalog.grouped(spark, data, catalog.ALL_FIELDS)
    plain = catalog.every_channel(*catalog.sides(spark, data, catalog.ALL_FIELDS)).localCheckpoint()
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(catalog.recall_by_class(spark, g, catalog.truth(spark, data))) == got(blocking.channel_recall(plain, catalog.truth(spark, data)))
    assert got(catalog.union_by_class(spark, g)) == got(plain.withColumn("channels", F.array_join("channels", "|")))


def test_cosine_of_few_names(spark, monkeypatch):
    """Only pairs of different names are weighed, however many records have them."""
    data, seen, real = "/root/testdata/sf0.001", [], pairs.cosine
    monkeypatch.setattr(pairs, "cosine", lambda p, a, b: seen.append(p.count()) or real(p, a, b))
    n = catalog.QUERIES["F4_cosine"](spark, data).count()
    assert sum(seen) < n / 4


@pytest.mark.parametrize("name", ["F2_levenshtein", "F3_jaro_winkler", "F5_acronym", "F6_address_overlap", "F6_same_city"])
def test_members_leave_without_a_shuffle(spark, monkeypatch, name):
    """The last step only writes out packed rows, a part of the pairs each; its rows are those of the SQL (test_entry)."""
    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalog, "PAIRS_AT_ONCE", 2000)
    out = catalog.QUERIES[name](spark, data)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    whole = catalog.union(*catalog.sides(spark, data, catalog.WORDS + catalog.PLACES))
    assert out.count() == whole.count() > 2000 and out.select("s1_id", "match_id").exceptAll(whole.select("s1_id", "match_id")).isEmpty()


def test_long_texts_go_in_more_parts(spark, monkeypatch):
    """Pairs that carry the words of addresses are dealt to twice as many parts, so that as many bytes are on disk at a time."""
    data, seen, real = "/root/testdata/sf0.001", {"F5_acronym": 0, "F6_address_overlap": 0}, classes.packed
    monkeypatch.setattr(catalog, "PAIRS_AT_ONCE", 2000)
    for name in seen:
        monkeypatch.setattr(classes, "packed", lambda *a, name=name: seen.update({name: seen[name] + 1}) or real(*a))
        catalog.QUERIES[name](spark, data)
    assert seen["F6_address_overlap"] - 1 >= 2 * (seen["F5_acronym"] - 1) > 0


def test_packed_rows(spark, monkeypatch):
    """Large classes on both sides, in rows of few ids, give each pair of members once."""
    monkeypatch.setattr(classes, "CHUNK", 2)
    of = lambda ids: spark.createDataFrame([(c, f"{c}{k}", k) for c, n in ids.items() for k in range(1, n + 1)], "class_id string, entity_id string, place int")
    of_left, of_right = of({"a": 5, "b": 1, "c": 3}), of({"x": 4, "y": 1})
    found = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.1), ("c", "y", 0.2)], "s1_id string, match_id string, score double")
    ids = classes.with_ids(spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string"), of_left)
    rows = classes.packed(found.join(ids.withColumnRenamed("entity_id", "s1_id"), "s1_id").select("match_id", "ids", "score"), of_right)
    assert all(len(r.lefts) <= 2 and len(r.others) <= 2 for r in rows.collect())
    got = lambda df: sorted(map(tuple, df.select("s1_id", "match_id", "score").collect()))
    assert got(classes.unpacked(rows)) == got(classes.for_members(found, of_left, of_right)) and classes.unpacked(rows).count() == 27


def test_minhash_by_class(spark, monkeypatch):
    """Each pair leaves once, from the first band that it agrees in, and the last step shuffles nothing, in rows of few ids, too."""
    data, fields = "/root/testdata/sf0.001", ("normalized_name", "normalized_address")
    monkeypatch.setattr(classes, "CHUNK", 3)
    out = catalog.QUERIES["J10_minhash_channel"](spark, data)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    plain = catalog.minhash(*catalog.sides(spark, data, fields))
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(out) == got(plain) != []


def test_minhash_where_ids_repeat(spark, monkeypatch):
    """A repeated id has the pairs of all its rows, each once."""
    rows = [("S1-1", "S1", "Alpha Beta Gamma", "2 Oak Ave, Pisa 20002", "IT"), ("S1-1", "S1", "Alpha Beta Gamma", "2 Oak Ave., Pisa 20002", "IT"), ("S2-1", "S2", "Alpha Beta Gamma", "2 Oak Ave, Pisa 20002", "IT")]
    feeds = spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string")
    monkeypatch.setattr(catalog, "records", lambda spark, d: feeds)
    assert [tuple(r) for r in catalog.QUERIES["J10_minhash_channel"](spark, "").collect()] == [("S1-1", "S2-1", "minhash")]


def test_classes_by_texts(spark, monkeypatch):
    """Classes are told apart by texts, and words are cut for their representatives alone; the tables are read for repeated ids, not the feeds once more."""
    data, reads, real = "/root/testdata/sf0.001", [], catalog.records
    monkeypatch.setattr(catalog, "records", lambda s, d: reads.append(d) or real(s, d))
    fields = catalog.WORDS + catalog.PLACES
    g = catalog.grouped(spark, data, fields)
    assert len(reads) == 1 and set(fields) <= set(g.left.columns)
    plain = catalog.normal(spark, data).withColumn("country", F.when(F.col("postal_code_guess") != "", F.col("country")).otherwise(""))
    for side, want in ((g.left, plain.where("source = 'S1'")), (g.right, plain.where("source <> 'S1'"))):
        alike = want.groupBy(*fields).agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("size"))
        got = lambda df: sorted(map(repr, df.select("entity_id", "size", *fields).collect()))
        assert got(side) == got(alike)


def test_couples_made_natively(spark):
    """Rows of pairs of words are those of the array of couples, in parts, too."""
    df = spark.createDataFrame([("r1", 2, ["c", "a", "b", "d"]), ("r2", 1, ["z"]), ("r3", 1, []), ("r4", 1, ["é", "e"])], "entity_id string, size int, words array<string>")
    for parts in (1, 3):
        for k in range(parts):
            want = df.select("entity_id", "size", F.explode(blocking.couples(F.col("words"), k, parts)).alias("key"))
            got = blocking.paired(df, k, parts)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "lambda" not in plan


def test_fits_on_alike_pairs(spark, monkeypatch):
    """Trees and calibration see each set of values once, with the weight of all pairs that have it."""
    left = records(spark, [(f"S1-{k:02}", f"Alpha {'Beta' if k % 2 else 'Gamma'}", "", "IT") for k in range(30)])
    right = records(spark, [(f"S2-{k:02}", f"Alpha {'Beta' if k % 3 else 'Gama'}", "", "IT") for k in range(20)])
    seen, train, fit = {}, model.train_rounds, model.calibrator
    note = lambda what, df: seen.update({what: df.toPandas()})
    monkeypatch.setattr(model, "train_rounds", lambda df, **o: note("trees", df) or train(df, trees=2, **o))
    monkeypatch.setattr(model, "calibrator", lambda df, **o: note("scores", df) or fit(df, **o))
    pairs_of = left.select(F.col("entity_id").alias("s1_id")).join(right.select(F.col("entity_id").alias("match_id")))
    link_all.link(left, right, pairs_of, pair_table(spark, {f"S1-{k:02}": [f"S2-{k % 20:02}"] for k in range(30)}), lambda df: df.localCheckpoint())
    fold = {r.s1_id: r.fold for r in folds.hash_folds(left.select(F.col("entity_id").alias("s1_id")), "s1_id").collect()}
    trained, middle = sum(f < link_all.CALIBRATION for f in fold.values()), sum(f == link_all.CALIBRATION for f in fold.values())
    for what, columns, entities in (("trees", [*model.NUMERIC, "label"], trained), ("scores", ["score", "label"], middle)):
        assert not seen[what].duplicated(columns).any() and seen[what].weight.sum() == 20 * entities > len(seen[what])
