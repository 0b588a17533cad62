"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from crowdcover.catalogue import CATALOGUE, CELL_LEVELS, RENAMED, Qid
from crowdcover.operators import detect
from crowdcover.operators.assess import assess
from crowdcover.operators.enrich import with_aliases, without_copies
from crowdcover.operators.link import link_key
from crowdcover.operators.population import Population
from crowdcover.sources import datasets, registers, series, sinks


def test_csv_is_text_with_sniffed_separator(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿id;jaar;naam\n1;007;\n2;NA;\"a;b\"\n", encoding="utf-8")
    rows = datasets.read_dataset(spark, str(tmp_path / "d.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "007", None), ("2", "NA", "a;b")]


def test_population_names_aliases_supplement(spark, tmp_path):
    old = spark.createDataFrame([("1", 1970, 1970, "C"), ("2", 1980, 1980, "D")],
                                "vbo_id string, bouwjaar int, kopie int, energielabel string")
    small, aliases = without_copies(old, {"kopie": "bouwjaar"})
    small.write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        without_copies(old, {"energielabel": "vbo_id"})
    renamed_alias = aliases.withColumn("gelijk_aan", F.lit("bouwjaar__yr"))
    extra = spark.createDataFrame([("2", True, "A", 9.0)],
                                  "vbo_id__str string, aangevuld__bool boolean, energielabel__cat string, x double")
    p = datasets.read_population(spark, str(tmp_path / "p"), aliases=renamed_alias, supplement=extra)
    got = {r.vbo_id__str: (r.bouwjaar__yr, r.energielabel__cat, r.x, r.kopie) for r in p.df.collect()}
    assert got == {"1": (1970, "C", None, 1970), "2": (1980, "A", 9.0, 1980)}
    assert with_aliases(small, aliases).columns == ["vbo_id", "bouwjaar", "energielabel", "kopie"]
    assert RENAMED["sig_mwa_H"] == "sig_mwa_H__W_K_1" and RENAMED["h3_r5"] == "h3_r5__str"
    assert len(CATALOGUE) == 23 + 26 and CELL_LEVELS == (4, 5, 6, 7, 8)


def test_scope_texts(spark):
    cols = ["gemeente__cat", "bouwjaar__yr", "eengezins__bool", "woningtype__cat"]
    s = datasets.parse_scope(spark, datasets.scope_items(
        ["gemeente=Zwolle,Deventer", "bouwjaar=1900-1989", "eengezins=true",
         "woningtype!=appartement"]), cols)
    assert s.criteria == {"gemeente__cat": {"Zwolle", "Deventer"}, "bouwjaar__yr": (1900.0, 1989.0),
                          "eengezins__bool": {"true"}}
    assert s.exclude == {"woningtype__cat": {"appartement"}}
    assert datasets.region_items(["Overijssel"], "Zwolle, ") == {
        "provincie": ["Overijssel"], "gemeente": ["Zwolle"]}
    with pytest.raises(ValueError):
        datasets.parse_scope(spark, {"bouwjaar": "oud"}, cols)


def test_label_register(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "PublicatieDatum;20240101\nVersie;3\n"
        "Pand_registratiedatum;Pand_energieklasse;Pand_bagverblijfsobjectid;Pand_gebouwklasse;"
        "Pand_gebouwtype;Pand_gebouwsubtype;Pand_compactheid;Pand_berekeningstype\n"
        "20230405;A++;123;W;Twee-onder-een-kap / rijwoning hoek;Rijwoning;1,85;NTA 8800:2023\n"
        "2022-01-02;c;124;W;Appartement;;;ISSO\n20230101;B;125;U;kantoor;;;x\n20230101;B;;W;;;;x\n")
    rows = {r.vbo_id: r for r in registers.read_labels(spark, str(tmp_path / "l.csv")).collect()}
    assert set(rows) == {"0" * 13 + "123", "0" * 13 + "124"}
    a, b = rows["0" * 13 + "123"], rows["0" * 13 + "124"]
    assert (a.energielabel, a.woningtype, a.compactheid, a.nta8800) == ("A++", "hoekwoning", 1.85, True)
    assert (b.energielabel, b.woningtype, str(b.registratiedatum), b.nta8800) == (
        "C", "appartement", "2022-01-02", False)


def test_hourly_json_and_stations(spark, tmp_path):
    one = [{"station_code": 260, "date": "2024-01-01T00:00:00.000Z", "hour": 1, "T": 35, "Q": 36}]
    for name in ("a", "b"):     # the same hour in two files
        (tmp_path / f"{name}.json").write_text(json.dumps(one))
    r = registers.read_hourly(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).collect()
    assert len(r) == 1 and (r[0].station, str(r[0].time), r[0].T, r[0].Q) == (
        "260", "2024-01-01 00:00:00", 3.5, 100.0)
    (tmp_path / "s.txt").write_text(
        "# STN LON LAT ALT NAME\n# 260 5.180 52.100 1.90 De Bilt\n# 270 5.752 53.223 1.20 Leeuwarden\n"
        "260,20240101, 1, 35\n270,20240101, 1, \n")
    s = registers.read_stations(spark, str(tmp_path / "s.txt")).collect()
    assert [(x.station, x.lat, x.lon, x.naam) for x in s] == [("260", 52.1, 5.18, "De Bilt")]


def test_feature_pages(spark, tmp_path):
    def feature(water, kind, coords):
        return {"properties": {"code": "GM1", "naam": "X", "ligt_in_provincie_naam": "Y", "water": water},
                "geometry": {"type": kind, "coordinates": coords}}

    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    page = {"features": [feature("NEE", "Polygon", [ring]), feature("NEE", "MultiPolygon", [[ring], [ring]]),
                         feature("JA", "Polygon", [ring])]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    assert registers.read_regions(spark, str(tmp_path / "p.json")).first() == ("GM1", "X", "Y")
    v = registers.read_land_rings(spark, str(tmp_path / "p.json"))
    assert v.count() == 12 and v.select("vlak").distinct().count() == 3


def test_series_from_files_and_folders(spark, tmp_path):
    for home in ("woning_7", "woning_8"):
        (tmp_path / home).mkdir()
        (tmp_path / home / "IM_customer_a1.csv").write_text(
            "tijd,T_buiten,andere\n2024-01-01 00:00,3.5,x\n2024-01-01 01:00,niets,x\n")
    by_folder = series.read_series(spark, str(tmp_path), id_from="map")
    assert sorted((r.id, r.waarde) for r in by_folder.collect()) == [("7", 3.5), ("8", 3.5)]
    by_file = series.read_series(spark, str(tmp_path), id_from="bestand", id_regex=r"customer_(\w+)\.")
    assert {r.id for r in by_file.collect()} == {"a1"}
    s = spark.createDataFrame([(str(i % 9), i) for i in range(90)], "id string, waarde int")
    some = series.sample_entities(s, 4)
    assert some.count() == 40 and some.select("id").distinct().count() == 4


def test_assessment_is_written_apart(spark, tmp_path):
    pop = Population(spark.createDataFrame([(1970,)] * 12 + [(1980,)], "bouwjaar__yr int"))
    d = spark.createDataFrame([(1, "1970", "straat 1"), (2, "1980", "straat 2")],
                              "record_id int, bouwjaar string, adres string")
    q = [Qid("bouwjaar", CATALOGUE["bouwjaar"])]
    sinks.write_assessment(assess(d, q, pop), q, str(tmp_path / "o"), drop=["adres"])
    out = spark.read.option("header", True).csv(str(tmp_path / "o/publiceerbaar"))
    assert out.columns == ["record_id", "bouwjaar"] and out.count() == 1
    assert spark.read.parquet(str(tmp_path / "o/per_record")).count() == 2
    assert spark.read.json(str(tmp_path / "o/samenvatting")).first().ok == 1


def test_detected_link_key(spark):
    names = ["home_nr", "home_nr_add_on", "postcode", "bouwjaar", "BAG_id", "T_out__degC",
             "adres_Ainf__cm2", "knmi_station", "e_consumed"]
    empty = spark.createDataFrame([], ", ".join(f"`{n}` string" for n in ["record_id", *names]))
    found = {d.column: d for d in detect.detect(empty, "record_id")}
    assert [found[n].role for n in names] == ["direct", "direct", "qid", "qid", "direct",
                                              "implicit_location", "qid", "implicit_location", "direct"]
    assert link_key("auto", names, list(found.values())) == {"vbo_id": "BAG_id"}
    rest = [d for n, d in found.items() if n != "BAG_id"]
    assert link_key("auto", names, rest) == {"postcode": "postcode", "huisnummer": "home_nr",
                                             "toevoeging": "home_nr_add_on"}
    assert link_key("postcode,home_nr,,home_nr_add_on", names) == {
        "postcode": "postcode", "huisnummer": "home_nr", "toevoeging": "home_nr_add_on"}
    with pytest.raises(ValueError):
        link_key("postcode=weg", names)
    q, direct = detect.qids_from(list(found.values()), names, {"bouwjaar": "geen", "home_nr": "direct"})
    assert [x.column for x in q] == ["postcode", "adres_Ainf__cm2", "knmi_station"]
    assert "home_nr" in direct


def test_times_do_not_depend_on_the_session(spark):
    from crowdcover.functions import cleaning
    texts = ["2024-07-01 12:00:00", "2024-07-01T14:10:00+02:00", "2024-07-01T12:59:59Z", "202407011200",
             "01-07-2024 12:30", "2024-07-01", "20240701", "01-07-2024", "", "later", None]
    noon, midnight = 1719835200, 1719792000
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Amsterdam", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = dict(df.select("i", F.unix_seconds(cleaning.utc_hour(F.col("t")))).collect())
            assert [got[i] for i in range(len(texts))] == [noon] * 5 + [midnight] * 3 + [None] * 3, z
            instant = spark.range(1).select(F.timestamp_seconds(F.lit(noon + 99)).alias("t"))
            assert instant.select(F.unix_seconds(cleaning.utc_hour(F.col("t")))).first()[0] == noon
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_profile_reads_every_value(spark):
    rows = [(i, "x" if i < 600 else "1234") for i in range(6000)]
    p = detect.profile(spark.createDataFrame(rows, "record_id int, a string"), "record_id").first()
    assert p.share_pc4 == 0.9


def test_blocks_without_a_zone_stay(spark):
    from crowdcover.operators import report
    pop = Population(spark.createDataFrame([(1970, "a")] * 3 + [(1980, "b")], "bouwjaar__yr int, z string"))
    d = spark.createDataFrame([(1, "1970", 2), (2, "1999", 1)], "record_id int, bouwjaar string, size int")
    q = [Qid("bouwjaar", CATALOGUE["bouwjaar"])]
    areas = report.candidate_areas(d, q, pop, "z", group=["record_id"], size="size")
    assert sorted(map(tuple, areas.collect())) == [(1, 2, 1, 1, 1, 3), (2, 1, 0, 0, 0, 0)]
    risk = report.chance_too_small(report.zone_counts(d, q, pop, "z"), 11, record="record_id")
    assert sorted(map(tuple, risk.collect())) == [(1, 1.0), (2, None)]


def test_series_files_with_other_columns(spark, tmp_path):
    """Every file is read by its own first line; notes beside the data are left out."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "home_1.csv").write_text("time;T_out;x\n2024-01-01 00:00;1.5;9\n2024-01-01 01:00;2.5;9\n")
    (tmp_path / "a" / "home_2.csv").write_text('x,"outdoor_temp",more,moment\n9,3.5,"a,b",2024-01-01 00:00\n\n9,,c,2024-01-01 01:00\n')
    (tmp_path / "a" / "metadata.csv").write_text("name,unit\nT_out,C\n")
    (tmp_path / "a" / "empty.csv").write_text("")
    out = series.read_series(spark, str(tmp_path), id_from="bestand").collect()
    assert sorted(map(tuple, out)) == [("1", "2024-01-01 00:00", 1.5), ("1", "2024-01-01 01:00", 2.5),
                                       ("2", "2024-01-01 00:00", 3.5)]
    named = series.read_series(spark, str(tmp_path), id_from="bestand", time_col="time", value_col="x").collect()
    assert sorted(map(tuple, named)) == [("1", "2024-01-01 00:00", 9.0), ("1", "2024-01-01 01:00", 9.0)]
    with pytest.raises(ValueError):
        series.read_series(spark, str(tmp_path), id_from="bestand", time_col="nowhere")
