import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from landgrid.streaming import additions
from landgrid.streaming import usage as streams

SCHEMA = "event_id long, ts timestamp, org_id long, user_id long, metric string, amount long"
START = datetime(2024, 3, 1)


def batches():
    """Four batches; the third and fourth hold events of days that earlier batches closed."""
    rng = random.Random(8)
    spans = [(0, 60), (50, 130), (0, 150), (20, 200)]
    out, k = [], 0
    for first, last in spans:
        rows = []
        for _ in range(120):
            k += 1
            at = START + timedelta(minutes=rng.randrange(first * 60, last * 60))
            rows.append((k, at, rng.choice([1, 2, None]), rng.randrange(12), rng.choice(["view", "purchase"]), rng.randrange(9)))
        out.append(rows)
    out[1].append((9999, None, 1, 1, "view", 5))
    return out


def expected(groups, delay=1):
    """Sums per day, and the news of every batch, by going through the events one by one."""
    days, news, clock = defaultdict(lambda: [0, 0, 0, 0]), [], None
    for number, rows in enumerate(groups):
        before, touched = clock, set()
        closes = lambda d: datetime.combine(d, datetime.min.time()) + timedelta(days=1 + delay)
        for _, ts, org, _, metric, amount in rows:
            if ts is None:
                continue
            key, late = (org, metric, ts.date()), before is not None and closes(ts.date()) <= before
            sums = days[key]
            sums[0], sums[1] = sums[0] + amount, sums[1] + 1
            if late:
                sums[2], sums[3] = sums[2] + amount, sums[3] + 1
                touched.add(key)
        clock = max([r[1] for r in rows if r[1]] + ([clock] if clock else []))
        news += [(number, "corrected", *k, days[k][0]) for k in touched]
        news += [(number, "closed", *k, v[0]) for k, v in days.items() if closes(k[2]) <= clock and (before is None or closes(k[2]) > before)]
    return days, news, clock


def test_days_stay_exact(spark, tmp_path):
    groups = batches()
    path, log = str(tmp_path / "days"), str(tmp_path / "log")
    for number, rows in enumerate(groups):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        additions.add_days(stream, path, log).awaitTermination()
        if number in (1, 2):
            additions.compact(spark, path, additions.DAY)
    days, news, clock = expected(groups)
    found = additions.read_days(spark, path).collect()
    assert {(r.org_id, r.metric, r.period): [r.used, r.events, r.late_used, r.late_events] for r in found} == dict(days)
    assert len(found) == len(days) and sum(v[3] for v in days.values()) > 20
    assert {r.period for r in found if not r.closed} == {d for d in {k[2] for k in days} if datetime.combine(d, datetime.min.time()) + timedelta(days=2) > clock}
    told = [(r.batch, r.kind, r.org_id, r.metric, r.period, r.used) for r in additions.read_news(spark, path).collect()]
    assert sorted(told, key=str) == sorted(news, key=str)
    assert {t[1] for t in told} == {"closed", "corrected"}
    # The second merge dropped what the first had replaced, and kept what a running reader may still read.
    assert sorted(p.name for p in (tmp_path / "days" / "parts").iterdir()) == ["batch=2", "batch=3"]
    # A merge without new batches changes nothing; an old batch that comes again lies under the base.
    additions.compact(spark, path, additions.DAY)
    additions.compact(spark, path, additions.DAY)
    spark.read.parquet(f"{path}/parts/batch=3").write.mode("overwrite").parquet(f"{path}/parts/batch=1")
    again = additions.read_days(spark, path).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_actives_are_exact(spark, tmp_path):
    groups = batches()
    spark.createDataFrame([r for g in groups for r in g], SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "users")
    additions.add_actives(stream, path, str(tmp_path / "log")).awaitTermination()
    before = additions.read_actives(spark, path, days=4).collect()
    additions.compact(spark, path, additions.USER_DAY)
    users, calls = defaultdict(set), defaultdict(int)
    for rows in groups:
        for _, ts, _, user, _, _ in rows:
            if ts:
                first = date(1970, 1, 1) + timedelta(days=(ts.date() - date(1970, 1, 1)).days // 4 * 4)
                users[first].add(user)
                calls[first] += 1
    want = sorted((d, len(u), calls[d]) for d, u in users.items())
    assert sorted(map(tuple, before)) == want
    assert sorted(map(tuple, additions.read_actives(spark, path, days=4).collect())) == want


def test_closed_days_of_the_watermarked_stream(spark, tmp_path):
    rows = batches()[0]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    streams.run_to_table(streams.daily_usage(stream), str(tmp_path / "out"), str(tmp_path / "log"))
    want = defaultdict(int)
    for _, ts, org, _, metric, amount in rows:
        want[org, metric, ts.date()] += amount
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    last = max(r[1] for r in rows)
    assert {(r.org_id, r.metric, r.period): r.used for r in found} == {k: v for k, v in want.items() if datetime.combine(k[2], datetime.min.time()) + timedelta(days=2) <= last}
