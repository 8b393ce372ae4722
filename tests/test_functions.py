import math

import pytest
from pyspark.sql import functions as F

from navspark.functions import geo, nmea
from navspark.functions.clock import absolute_utc, split_log_lines
from navspark.schema import drop_families, family_of, feature_names
from tests.makers import DOP, IN_VIEW, SNRS, Sighting


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_geodesy(spark):
    lat, lon = 40.0, 29.0
    lat2, lon2 = lat + 100 / 111320, lon + 100 / (111320 * math.cos(math.radians(lat)))
    p = [F.lit(v) for v in (lat, lon, lat2, lon2)]
    bearing, distance, gap, still, missing = one(
        spark, geo.bearing_deg(*p), geo.haversine_m(*p), geo.angular_diff_deg(F.lit(359.0), F.lit(1.0)),
        geo.bearing_deg(p[0], p[1], p[0], p[1]), geo.haversine_m(p[0], p[1], p[2], F.lit(None).cast("double")),
    )
    assert bearing == pytest.approx(44.99943, abs=1e-4)
    assert distance == pytest.approx(141.26200, abs=1e-3)
    assert gap == 2.0 and still == 0.0 and missing is None


def parse(spark, *sentences, **options):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "i int, payload string")
    return {r["i"]: r for r in nmea.parse_sentences(df, **options).collect()}


def test_sentences(spark):
    here = Sighting(7000.5, lat=-33.86, lon=-151.2, course=12.5)
    fix, motion = here.gga(), here.vtg()
    wrong = fix[:-1] + ("1" if fix[-1] == "0" else "0")
    odd = ["$PSAT,GBS,1", "no dollar,GGA", "!BSVDM,2,1", "$GPGSV,3", "$GPGGA,shor"]
    rows = parse(spark, fix, wrong, here.rmc().split("*")[0], DOP, *IN_VIEW, motion, *odd)
    assert set(rows) == {0, 2, 3, 4, 5, 6, 10, 11}
    assert (rows[0]["utc_of_day"], rows[0]["num_satellites"]) == (7000.5, 6)
    for i in (0, 2):
        assert (rows[i]["lat_deg"], rows[i]["lon_deg"]) == pytest.approx((-33.86, -151.2), abs=1e-7)
    assert (rows[3]["fix_mode"], rows[3]["pdop"], rows[3]["vdop"]) == (3, 2.6, 2.2)
    assert rows[4]["snrs"] + rows[5]["snrs"] == SNRS
    assert rows[6]["cog_true"] == 12.5 and rows[6]["cog_magnetic"] is None
    assert rows[10]["source"] is None and rows[11]["source"] is None


def test_rejected_rows_can_stay(spark):
    rows = parse(spark, "note", DOP, DOP[:-2] + "QQ", keep_rejected=True)
    assert [rows[i]["fmt"] for i in range(3)] == [None, "GSA", None]


@pytest.mark.parametrize(
    "text,value",
    [("1.5", 1.5), (" 2 ", 2.0), ("-.5", -0.5), ("1e3", 1000.0), ("", None), ("nan", None), ("inf", None),
     ("1.0d", None), ("x", None), ("0x1p3", None)],
)
def test_number(spark, text, value):
    assert one(spark, nmea.number(F.lit(text)))[0] == value


def test_clock_is_not_validated(spark):
    assert one(spark, nmea.clock_seconds(F.lit("999999.50")))[0] == 99 * 3600 + 99 * 60 + 99.5


def test_log_prefixes(spark):
    lines = [
        "05/28/2018,12:00:00.100,$GPGGA,x", "2018-05-28T12:00:00.100Z $GPGGA,x", "2018-05-28 12:00:00, !AIVDM,1",
        "$GPGGA,x", "garbage line", "13/45/2018,12:00:00,$GPGGA,x", "",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    rows = {r["i"]: r for r in split_log_lines(df).collect()}
    assert set(rows) == {0, 1, 2, 3}
    assert rows[0]["ext_clock"] == pytest.approx(1527508800.1, abs=1e-6) == rows[1]["ext_clock"]
    assert rows[2]["payload"] == "!AIVDM,1" and rows[3]["ext_clock"] is None


def test_day_resolution(spark):
    day = 1527465600.0
    cases = [(86399.5, day + 0.2, day - 0.5), (0.1, day + 86399.9, day + 86400.1), (100.0, day + 120, day + 100),
             (43200.0, day, day - 43200.0), (10.0, None, 10.0)]
    for of_day, clock, expected in cases:
        got = one(spark, absolute_utc(F.lit(of_day), F.lit(clock).cast("double")))[0]
        assert got == pytest.approx(expected, abs=1e-6)


def test_feature_names():
    assert len(feature_names("full")) == 138 == len(set(feature_names("full")))
    deployable = feature_names("deployable")
    assert len(deployable) == 93
    assert not [n for n in deployable if family_of(n)]
    assert len(drop_families(feature_names("full"))) == 93
    with pytest.raises(ValueError):
        feature_names_of_unknown()


def feature_names_of_unknown():
    from navspark.schema import raw_keys

    raw_keys("other")
