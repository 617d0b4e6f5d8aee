"""Single functions on hand-made rows; the values are those of the venues' and the forecast's rules."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from skyledger.functions import book, price, text, time, weather
from skyledger.operators.ordered import asof_backward, change_points, changes, gaps, islands, latest, missing, stratified
from skyledger.plans import forecast, market, structure
from skyledger.sources import bronze

DAY = 19723 + 186  # 2024-07-05


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v) if not isinstance(v, tuple) else F.lit(v[0]).cast(v[1]))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bid,ask,want", [(0.01, 0.99, True), (0.0, 0.5, False), (0.5, 1.0, False), (None, 0.5, False)])
def test_two_sided(spark, bid, ask, want):
    assert one(spark, price.two_sided(F.lit(bid).cast("double"), F.lit(ask).cast("double"))) is want


@pytest.mark.parametrize("age,want", [(900, False), (901, True)])
def test_stale_is_strict(spark, age, want):
    assert one(spark, price.stale(F.lit(age))) is want


@pytest.mark.parametrize("hours,want", [(0.5, "0-1h"), (1.0, "0-1h"), (3.0, "1-3h"), (48.0, "24-48h"), (48.1, "48h+"), (None, None)])
def test_hours_bucket(spark, hours, want):
    assert one(spark, price.hours_bucket(F.lit(hours).cast("double"))) == want


@pytest.mark.parametrize("raw,want", [("455 PM", 16 * 60 + 55), ("1140 PM", 23 * 60 + 40), ("12 AM", 0), ("4:05 am", 245), ("MM", None), ("", None)])
def test_printed_clock(spark, raw, want):
    assert one(spark, time.clock_minutes(F.lit(raw))) == want


def test_ticker_date(spark):
    assert str(one(spark, time.ticker_date(F.lit("KXHIGHNY-24JUL05-B85.5")))) == "2024-07-05"
    assert one(spark, time.ticker_date(F.lit("KXHIGHNY-24XXX05-B85.5"))) is None


@pytest.mark.parametrize("date,want", [("2024-07-05", "edt"), ("2024-01-05", "est"), ("2024-03-10", "transition"), ("2024-11-03", "transition")])
def test_dst_status(spark, date, want):
    day = F.unix_date(F.lit(date).cast("date")).cast("long")
    assert one(spark, time.dst_status(day)) == want


def test_clock_readings_differ_by_an_hour_in_summer(spark):
    lst = one(spark, time.clock_instant(F.lit(DAY).cast("long"), F.lit(60), "lst"))
    ldt = one(spark, time.clock_instant(F.lit(DAY).cast("long"), F.lit(60), "ldt"))
    assert lst - ldt == 3600


def test_issuance_header(spark):
    got = one(spark, time.issuance_epoch(F.lit("220 AM EDT SUN JUL 05 2026")))
    assert got == 1783232400  # 06:20 UTC


def test_http_date(spark):
    assert one(spark, time.http_date_epoch(F.lit("Tue, 05 Mar 2024 10:20:30 GMT"))) == 1709634030


@pytest.mark.parametrize("f,want", [(75, "tail_below"), (76, "between_76-77"), (77, "between_76-77"), (93, "between_92-93"), (94, "tail_above")])
def test_even_bracket(spark, f, want):
    assert one(spark, weather.even_bracket(F.lit(f))) == want


def test_whole_degrees_are_half_even(spark):
    assert [one(spark, weather.whole(F.lit(x))) for x in (70.5, 71.5)] == [70, 72]


def test_forecast_hours(spark):
    day = F.lit(DAY).cast("long")
    assert one(spark, weather.max_hour(F.lit(DAY * 86400).cast("long"), day)) == 30
    assert one(spark, weather.max_hour(F.lit(DAY * 86400 + 43200).cast("long"), day)) == 18
    assert one(spark, weather.max_hour(F.lit(DAY * 86400 + 3600).cast("long"), day)) is None


def test_inventory_line(spark):
    got = one(spark, text.inventory(F.lit("7:120:d=2024010100:TMP:2 m above ground:12-30 hour max fcst:P50% level")))
    assert (got["msg"], got["byte_offset"], got["start_h"], got["end_h"], got["level"]) == (7, 120, 12, 30, 50)
    assert one(spark, text.inventory(F.lit("7:120:d=2024010100:RH:2 m above ground:x:y"))) is None


@pytest.mark.parametrize("title,want", [("84°F or higher", ("tail_above", 84, None)), ("70°F or below", ("tail_below", None, 70)), ("80-81°F", ("between", 80, 81)), ("none", None)])
def test_venue_bracket(spark, title, want):
    got = one(spark, text.venue_bracket(F.lit(title), F.lit("x")))
    assert (None if got is None else (got["kind"], got["low"], got["high"])) == want


def test_book(spark):
    rows = spark.createDataFrame([(1, "t", 0, 0, [["0.55", "10"], ["x", "1"], ["0.50", "5"]], [["0.42", "7"]])], "event_id long, ticker string, day long, end_ts long, yes array<array<string>>, no array<array<string>>")
    got = market.depth_metrics(rows).first()
    assert (float(got["bid"]), float(got["ask"])) == (0.55, 0.58)
    assert (float(got["yes_size_2"]), float(got["depth_2c"]), round(got["imbalance"], 6)) == (15.0, 17.0, round(3 / 17, 6))
    empty = rows.withColumn("no", F.lit(None).cast("array<array<string>>"))
    assert market.depth_metrics(empty).count() == 0 and one(spark, F.size(book.levels(F.lit(None).cast("array<array<string>>")))) == 0


def test_asof_against_brute_force(spark):
    left = spark.createDataFrame([(k, t) for k in "ab" for t in range(0, 30, 3)], "k string, t long")
    right = spark.createDataFrame([("a", 4, 1), ("a", 9, 2), ("b", 9, 3), ("a", 9, 0)], "k string, ts long, v long")
    for strict in (False, True):
        got = {(r["k"], r["t"]): (r["found"]["ts"] if r["found"] else None) for r in asof_backward(left, right, ["k"], "t", "ts", strict).collect()}
        for (k, t), found in got.items():
            times = [x for key, x in (("a", 4), ("a", 9), ("b", 9)) if key == k and (x < t if strict else x <= t)]
            assert found == (max(times) if times else None)
    assert {r["found"]["v"] for r in asof_backward(left.where("k = 'a' and t = 9"), right, ["k"], "t", "ts").collect()} == {2}


def test_spans_change_nothing(spark):
    """Cutting a hot key's sequence into spans of seconds gives what the whole sequence gives."""
    import random

    rng = random.Random(3)
    make = lambda n: [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(400), rng.choice([1, 2, None])) for _ in range(n)]
    left, right = (spark.createDataFrame(list({(k, t): (k, t, v) for k, t, v in make(n)}.values()), "k string, t long, v long") for n in (120, 80))
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    for every in (7, 60, 1000):
        for strict in (False, True):
            assert same(asof_backward(left, right, ["k"], "t", "t", strict), asof_backward(left, right, ["k"], "t", "t", strict, every=every))
        assert same(gaps(left, ["k"], "t"), gaps(left, ["k"], "t", every))
        assert same(changes(left, ["k"], ["t"], ["v"]), changes(left, ["k"], ["t"], ["v"], every))


def test_sequences(spark):
    daily = spark.createDataFrame([(i, v) for i, v in enumerate("aabba")], "d long, v string")
    got = [tuple(r) for r in change_points(daily, "d", "v").orderBy("first_date_after").collect()]
    assert got == [(1, 2, "a", "b", 2, 2), (3, 4, "b", "a", 2, 1)]
    assert [r["island"] for r in islands(daily, "d", "v").orderBy("d").collect()] == [0, 0, 1, 1, 2]
    rows = spark.createDataFrame([("x", 1, 1.0), ("x", 2, None), ("x", 3, None), ("x", 4, 2.0)], "k string, t long, v double")
    assert [r["t"] for r in changes(rows, ["k"], ["t"], ["v"]).orderBy("t").collect()] == [2, 4]
    assert latest(rows, ["k"], ["t"]).first()["v"] == 2.0
    assert missing(daily, daily.where("d < 4"), ["d"]).first()["d"] == 4
    picked = stratified(daily, ["v"], "d", 3, 1).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in picked} == {"a": 2, "b": 1}


def test_deduplication_keeps_the_last(spark):
    rows = spark.createDataFrame([("t", 60, 1.0, 1), ("t", 60, 2.0, 2), ("t", 120, 3.0, 1)], "ticker string, end_ts long, bid double, pos long")
    assert [r["bid"] for r in market.deduplicated(rows).orderBy("end_ts").collect()] == [2.0, 3.0]


def test_byte_ranges_come_before_the_filter(spark):
    lines = ["1:0:d=2024010100:TMP:2 m above ground:12-30 hour max fcst:10% level", "2:100:d=2024010100:TMP:2 m above ground:12-30 hour max fcst:ens std dev", "3:250:d=2024010100:TMP:2 m above ground:12-30 hour max fcst:20% level"]
    rows = forecast.inventory(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id long, pos long, line string"))
    got = forecast.max_percentiles(forecast.byte_ranges(rows)).orderBy("pos").select("first_byte", "last_byte").collect()
    assert [tuple(r) for r in got] == [(0, 99), (250, 250)]


def test_vintage_is_strict(spark):
    snap = DAY * 86400 + 18000
    days = spark.createDataFrame([(DAY, snap), (DAY + 1, (DAY + 1) * 86400 + 3600)], "day long, snapshot_ts long")
    got = {r["day"]: r["vintage_ts"] for r in forecast.vintages(days, 60).collect()}
    assert got[DAY] == DAY * 86400
    assert got[DAY + 1] == DAY * 86400 + 43200  # 00Z is published at the snapshot, not before it


def test_watch_states(spark):
    rows = [("aws", 0, 30, 0, 100, 404, None), ("aws", 0, 30, 1, 160, 200, 300), ("aws", 0, 18, 2, 100, 200, 50), ("nomads", 1000, 30, 3, 500, 200, None), ("nomads", 0, 30, 4, 60, 404, None)]
    probes = spark.createDataFrame(rows, "source string, nominal_ts long, fhour long, probe_id long, probe_ts long, http_status long, modified_ts long")
    got = {(r["source"], r["nominal_ts"], r["fhour"]): r["status"] for r in forecast.availability(probes).collect()}
    assert got == {("aws", 0, 30): "complete", ("aws", 0, 18): "pre_existing", ("nomads", 1000, 30): "pending", ("nomads", 0, 30): "waiting"}


def test_contiguous_bins(spark):
    rows = spark.createDataFrame([("K-24JUL05-B1.5", 1, "between", 70, 71, ""), ("K-24JUL05-B2.5", 1, "between", 72, 73, ""), ("K-24JUL05-B4.5", 2, "between", 74, 75, ""), ("K-24JUL05-B5.5", 2, "between", 78, 79, "")], "ticker string, day long, strike_type string, floor_strike int, cap_strike int, subtitle string")
    got = {r["day"]: (r["contiguous_interior"], r["interior_width_f"]) for r in structure.event_structure(rows).collect()}
    assert got == {1: (True, 2), 2: (False, 2)}


def test_plain_tree_with_torn_tail(spark, tmp_path):
    folder = tmp_path / "2024-07-05" / "asos_obs"
    folder.mkdir(parents=True)
    line = json.dumps({"ts_utc": "2024-07-05T00:00:00Z", "endpoint": "x", "http_status": 200, "latency_ms": 1, "payload": {"text": "station,valid,tmpf\nLGA,2024-07-05 00:51,80.0\nLGA,2024-07-05 01:51,M"}}) + "\n"
    whole = gzip.compress(line.encode()) + gzip.compress(line.encode())
    (folder / "LGA_2024-07.jsonl.gz").write_bytes(whole + gzip.compress(line.encode() * 50)[:-20])
    rows = bronze.observations(bronze.read_envelopes(spark, str(tmp_path), "asos_obs", layout="plain"))
    got = {(r["station"], r["valid_ts"], r["tmpf"]) for r in rows.collect()}
    assert got == {("LGA", 1720140660, 80.0)}


def test_gzip_members_and_torn_tails(spark):
    line = lambda i: json.dumps({"i": i}) + "\n"
    member = lambda a, b, level=6: gzip.compress("".join(map(line, range(a, b))).encode(), level)
    files = [
        ("whole", member(0, 3) + member(3, 5)),
        ("torn", member(0, 3) + member(3, 6, 0)[:-12]),
        ("junk", member(0, 2) + b"\x00\x01"),
        ("none", b""),
        ("header", member(0, 1)[:5]),
    ]
    rows = bronze.gzip_lines(spark.createDataFrame(files, "path string, content binary")).collect()
    got = {}
    for r in rows:
        got.setdefault((r["path"], r["members"], r["torn"]), []).append(r["line"] and json.loads(r["line"])["i"])
    assert got == {("whole", 2, False): [0, 1, 2, 3, 4], ("torn", 1, True): [0, 1, 2, 3, 4], ("junk", 1, True): [0, 1], ("none", 0, False): [None], ("header", 0, True): [None]}


def test_products_and_limits(spark):
    text = "CDUS41 KOKX 1\nCLIMATE REPORT\nCDUS41 KOKX 2\nx"
    pages = spark.createDataFrame([(("%s" % text, "2024-01"),), (("a\x01b\x03\x01 \x03c", "2024-02"),), ((None, "2024-03"),)], "payload struct<text:string,month:string>")
    assert {(r["source_month"], r["n"], r["maybe_cut"]) for r in bronze.possibly_cut(pages, 3).collect()} == {("2024-01", 2, False), ("2024-02", 3, True)}


def test_nearest_cell_anywhere(spark):
    import math
    import random

    rng = random.Random(5)
    place = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 540))
    cells = [(i, *place()) for i in range(40)] + [(40, 90.0, 0.0), (41, -90.0, 77.0), (42, 10.0, 179.99), (43, 10.0, 179.99)]
    points = [(f"p{i}", *place()) for i in range(30)] + [("pole", 89.9, 100.0), ("line", 10.0, -179.99), ("far", 0.0, 0.0)]

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * weather.EARTH_KM * math.asin(min(1, math.sqrt(x)))

    p, c = spark.createDataFrame(points, "name string, lat double, lon double"), spark.createDataFrame(cells, "cell long, cell_lat double, cell_lon double")
    got = {r["name"]: (r["cell"], round(r["km"], 3)) for r in forecast.nearest(p, c).collect()}
    want = {n: min((round(km(a, b, x, y), 9), i) for i, x, y in cells) for n, a, b in points}
    assert got == {n: (i, round(d, 3)) for n, (d, i) in want.items()}
    far = forecast.nearest(p.where("name = 'far'"), c.where("cell in (40, 41)")).first()
    assert far["cell"] in (40, 41) and round(far["km"]) == 10008
    assert forecast.nearest(p, c.limit(0)).count() == 0 and forecast.nearest(p.limit(0), c).count() == 0


def test_spines(spark):
    span = spark.createDataFrame([(19722, 19724)], "a long, b long")  # 2023-12-31 to 2024-01-02
    at = lambda df: [r["at"] for r in df.orderBy("at").collect()]
    assert at(forecast.day_spine(span)) == [19722, 19723, 19724]
    assert at(forecast.month_spine(span)) == [2023 * 12 + 11, 2024 * 12]
    assert at(forecast.minute_spine(spark.createDataFrame([(59, 121)], "a long, b long"))) == [0, 60, 120]
    assert at(forecast.cycle_spine(span, 2)) == [19723 * 86400, 19723 * 86400 + 43200, 19724 * 86400, 19724 * 86400 + 43200]
    assert at(forecast.sample_days(span, 3, first=19723, end=19724)) == [19723] and at(forecast.sample_days(span, 3, first=19725)) == []


def test_current_and_next(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 7), ("a", 9), ("b", 1), ("b", 2), ("b", 3), ("c", 1), ("d", 8)], "k string, t long")
    got = {(r["k"], r["t"], r["rn"]) for r in forecast.current_and_next(rows, "k", F.col("t") >= 5, ["t"]).collect()}
    assert got == {("a", 5, 1), ("a", 7, 2), ("b", 2, 1), ("b", 3, 2), ("c", 1, 1), ("d", 8, 1)}
