"""Sources, sinks, the profile, rules for result files and the stream."""

import pytest
from pyspark.sql import functions as F

from kindred.operators import checks, profile
from kindred.plans import catalog
from kindred.sources import tsv

HEAD = "source1_entity_id\tmatched_entity_ids\n"


def test_tsv_cells_and_missing_values(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"two\nlines ""x"""\tNA\t null \nS2-2\tNaN\t\tUS\n', encoding="utf-8")
    assert sorted(map(tuple, tsv.read_tsv(spark, str(tmp_path / "a.tsv")).collect())) == [("S2-1", 'two\nlines "x"', None, " null "), ("S2-2", None, None, "US")]
    assert tsv.read_tsv(spark, str(tmp_path / "a.tsv"), missing=False).where("business_name = 'NaN'").count() == 1
    assert tsv.paths("d", "test") == {f"source{k}": f"d/test_source{k}.tsv" for k in (1, 2, 3)} and "ground_truth" in tsv.paths("d")


def test_ids_lines_and_encoding(spark, tmp_path):
    (tmp_path / "ids.tsv").write_text("entity_id\tx\n S1-1 \ta\n\n \t\nS1-2\nS1-1\tb\n")
    assert sorted(r[0] for r in tsv.read_ids(spark, str(tmp_path / "ids.tsv")).collect() if r[0]) == ["S1-1", "S1-2"]
    (tmp_path / "m.tsv").write_bytes((HEAD + "S1-1\tS2-1\tS2-2\n\nbroken\nS1-2 \t\r\n").encode())
    rows = {r.line: (r.tab, r.s1_id, r.ids) for r in tsv.result_rows(tsv.lines(spark, str(tmp_path / "m.tsv"))).collect()}
    assert rows == {2: (True, "S1-1", "S2-1\tS2-2"), 3: (False, "", None), 4: (False, "broken", None), 5: (True, "S1-2 ", "")}
    assert tsv.is_valid_utf8(spark, str(tmp_path / "m.tsv"))
    (tmp_path / "bad.tsv").write_bytes(b"a\tb\n\xff\xfe\t\n")
    assert not tsv.is_valid_utf8(spark, str(tmp_path / "bad.tsv"))
    assert tsv.exists(spark, str(tmp_path / "bad.tsv")) and not tsv.exists(spark, str(tmp_path / "none"))


def test_written_results_have_truly_empty_cells(spark, tmp_path):
    tsv.write_results(spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1,S2-2")], "source1_entity_id string, matched_entity_ids string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == HEAD + "S1-1\t\nS1-2\tS2-1,S2-2\n"


def test_many_files_are_read_as_one(spark, tmp_path):
    rows = [(f"S1-{k:04}", "" if k % 3 else f"S2-{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string").repartitionByRange(7, "source1_entity_id").sortWithinPartitions("source1_entity_id")
    tsv.write_results(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 7
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # files in several pieces each
    try:
        got = sorted(map(tuple, tsv.lines(spark, str(tmp_path / "out")).collect()))
        ids = sorted(r[0] for r in tsv.read_ids(spark, str(tmp_path / "out")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate([HEAD.strip("\n"), *[f"{a}\t{b}" for a, b in rows]], 1))
    assert ids == [a for a, _ in rows]
    assert tsv.lines(spark, str(tmp_path / "out")).where("line = 1").first().value == HEAD.strip("\n")


def test_sample_is_the_start_of_the_hashes(spark):
    import hashlib

    df = spark.range(3000).select(F.col("id").cast("string").alias("entity_id"))
    order = sorted(map(str, range(3000)), key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))
    for n in (0, 1, 700, 2999, 5000):
        assert sorted(r[0] for r in profile.sample(df, n).collect()) == sorted(order[:n])
    assert profile.sample(df.where("false"), 5).count() == 0


@pytest.fixture
def folder(tmp_path):
    for k, ids in ((1, ["S1-1", "S1-2", "S1-3"]), (2, ["S2-1", "S2-2"]), (3, ["S3-1"])):
        (tmp_path / f"test_source{k}.tsv").write_text("entity_id\tbusiness_name\n" + "".join(f"{i}\tn\n" for i in ids))
    return tmp_path


def found(spark, folder, text, candidates=None, check_ids=True):
    (folder / "m.tsv").write_text(text)
    if candidates is not None:
        (folder / "c.tsv").write_text(candidates)
    rows = checks.validate(spark, str(folder / "m.tsv"), str(folder / "c.tsv"), str(folder), check_ids).collect()
    return {r.rule: (r.severity, r.n, r.examples) for r in rows}


GOOD = HEAD + "S1-1\tS2-1,S3-1\nS1-2\t\nS1-3\tS2-2\n"


def test_rules_one_by_one(spark, folder):
    assert set(found(spark, folder, GOOD)) == {"C13"}
    assert set(found(spark, folder, GOOD, GOOD.replace("matched", "candidate"))) == set()
    assert set(found(spark, folder, GOOD, check_ids=False)) == {"C14"}
    (folder / "c.tsv").unlink()
    assert found(spark, folder, "")["C1"][0] == "error"
    assert "C2" in found(spark, folder, GOOD.replace("\t", ",")) and "C3" in found(spark, folder, GOOD.replace("matched", "other"))
    for row, rule, n, examples in (
        ("S1-3 S2-2\n", "C4", 1, "5"),
        ("S1-1\tS2-2\n", "C5", 1, "S1-1"),
        ("S1-9\tS2-1,S2-1\n", "C6", 1, "S1-9"),
        ("S1-9\tS1-1,S2-1\n", "C7", 1, "S1-1"),
        ("S1-9\tX9-1,S2-1,\n", "C8", 2, ",X9-1"),
        ("S1-9\tS2-77,S3-88\n", "C9", 2, "S2-77,S3-88"),
        ("S1-9\tS2-1\n", "C11", 1, "S1-9"),
    ):
        got = found(spark, folder, GOOD + row)
        assert got[rule] == ("error", n, examples), rule
    assert found(spark, folder, GOOD + " \n\n") == found(spark, folder, GOOD)
    assert found(spark, folder, HEAD + "S1-1\tS2-1\n")["C10"] == ("error", 2, "S1-2,S1-3")
    assert found(spark, folder, GOOD, GOOD.replace("matched", "candidate").replace("S2-1,S3-1", "S2-1"))["C12"] == ("warning", 1, "S1-1")
    many = HEAD + "".join(f"S1-{k}\tY{k}\n" for k in range(1, 10))
    assert found(spark, folder, many)["C8"] == ("error", 9, "Y1,Y2,Y3,Y4,Y5")


def test_command_line(spark, folder, capsys):
    (folder / "m.tsv").write_text(GOOD)
    stop, type(spark).stop = type(spark).stop, lambda self: None
    try:
        assert checks.main(["-m", str(folder / "m.tsv"), "-t", str(folder), "--check-ids"]) == 0
        (folder / "m.tsv").write_text(GOOD + "S1-1\t\n")
        assert checks.main(["-m", str(folder / "m.tsv"), "-t", str(folder)]) == 1
    finally:
        type(spark).stop = stop
    out = capsys.readouterr().out
    assert "PASS" in out and "FAIL" in out and "C5" in out


def test_profile(spark, tmp_path):
    rows = [("S1-1", "S1", "Café", " ", "US"), ("S1-2", "S1", None, "x", None), ("S2-1", "S2", "a", "é", "IN"), ("S2-1", "S2", "a", "", "US")]
    df = spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string")
    truth = spark.createDataFrame([("S1-1", "S2-1, ,S2-1"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")
    assert {(r.source, r["rows"], r.ids) for r in profile.counts(df).collect()} == {("S1", 2, 2), ("S2", 2, 1)}
    assert {(r.source, r["column"]): r.missing for r in profile.missing(df).collect()} == {("S1", "business_name"): 1, ("S1", "business_address"): 1, ("S1", "country"): 1, ("S2", "business_name"): 0, ("S2", "business_address"): 1, ("S2", "country"): 0}
    assert [tuple(r) for r in profile.match_histogram(truth).collect()] == [(0, 1), (2, 1)]
    s = profile.match_shares(truth).first()
    assert (s.none, s.one, s.many, s.one_to_many, s.none_percent) == (1, 0, 1, 0.0, 50.0)
    e = {r.source: r for r in profile.encoding(df).collect()}
    assert (e["S1"]["names"], e["S2"].addresses, e["S1"].countries, e["S2"].countries) == (1, 1, "NULL,US", "IN,US")
    assert profile.sample(df, 2).count() == 2 and profile.sample(df).count() == 4
    lines = profile.markdown(df, truth, df.select("entity_id", "country"))
    for _ in range(2):
        profile.write_markdown(spark, lines, str(tmp_path / "new" / "report.md"))
    assert "- none: 1 (50.00%)" in (tmp_path / "new" / "report.md").read_text().split("\n")
    assert profile.match_shares(truth.limit(0)).first().none_percent == 0.0


def test_stream_links_as_the_batch_does(spark):
    d = "/root/testdata/sf0.001"
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(catalog.QUERIES["stream_golden_join"](spark, d)) == key(catalog.QUERIES["J2_golden_join"](spark, d)) != []
