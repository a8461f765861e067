import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.llm import validtime

START = datetime(2024, 1, 1)
FACTS = "id long, k long, at timestamp_ntz, b int, batch string, rec int, key string, payload int"
VERSIONS = "vid long, k long, valid timestamp_ntz, seq long, b int, value long, note string, id string, n_held int"


def plain(facts, versions, batches, delay):
    """One batch after the other, one key after the other."""
    number = lambda b: batches - 1 if b is None else min(max(b, 0), batches - 1)
    order = lambda v: (v[2], v[3] is not None, v[3] or 0, v[0] is not None, v[0] or 0)
    held, waiting, out, tops = {}, [], [], [None, None]

    def emit(facts, batch):
        for i, k, at, *_ in facts:
            mine = held.get(k, []) if k is not None else []
            fit = max((v for v in mine if at is not None and v[2] <= at), key=order, default=None)
            out.append(("fact", i, batch, len(mine), *((fit[0], fit[5], fit[6]) if fit else (None, None, None))))

    for b in range(batches):
        below = [None if t is None else t - delay for t in tops]
        until = None if None in below else min(below)
        for v in versions:
            if v[2] is not None and number(v[4]) == b:
                if below[1] is not None and v[2] < below[1]:
                    out.append(("late", v[0], b, None, None, None, None))
                elif v[1] is not None:
                    held.setdefault(v[1], []).append(v)
        come = waiting + [f for f in facts if number(f[3]) == b]
        due = [f for f in come if f[2] is None or (until is not None and f[2] < until)]
        waiting = [f for f in come if f not in due]
        emit(due, b)
        for k, mine in held.items():
            done = sorted((v for v in mine if until is not None and v[2] <= until), key=order)
            for v in done[:-1]:
                mine.remove(v)
        for n, rows, at, nr in ((0, facts, 2, 3), (1, versions, 2, 4)):
            tops[n] = max([t for t in (tops[n], *(r[at] for r in rows if number(r[nr]) == b)) if t is not None], default=None)
    emit(waiting, batches)
    return sorted(out, key=str)


def run(spark, facts, versions, batches, delay, **more):
    f = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in facts], FACTS)
    v = spark.createDataFrame([(*r, "z", 3) for r in versions], VERSIONS)
    got = validtime.enrich(
        f, v, id_col="id", key_col="k", at_col="at", version_id="vid", version_key="k", valid_col="valid", seq_col="seq", payload={"value": F.col("value"), "note": F.col("note")},
        fact_batch=F.col("b"), version_batch=F.col("b"), batches=batches, delay_s=int(delay.total_seconds()), **more,
    )
    return sorted(map(tuple, got.collect()), key=str)


def rows_of(seed, batches):
    rng, day = random.Random(seed), timedelta(days=1)
    some = lambda x, p=0.05: None if rng.random() < p else x
    when = lambda b: START + day * b + timedelta(seconds=rng.choice([rng.randrange(3 * 86_400), rng.randrange(40) * 3600]))
    keys = [7] * 10 + list(range(12))
    facts = [(some(i), some(rng.choice(keys)), some(when(b := rng.randrange(batches))), some(b, 0.02)) for i in range(260)]
    versions = [(some(1000 + i), some(rng.choice(keys)), some(when(b := rng.randrange(batches))), some(rng.randrange(3)), rng.choice([b, b, b, None, -2, 99]), some(rng.randrange(100)), rng.choice([None, "", "a\"b", "é😀"])) for i in range(260)]
    # repeated facts and times, and one version at the very time of a fact
    return facts + facts[:5], versions + [(5000, 7, facts[0][2], None, 0, 1, "tie"), (5000, 7, facts[0][2], 2, 0, 2, "tie")]


@pytest.mark.parametrize("most", [25, 100_000])
def test_as_one_batch_after_the_other(spark, most):
    """With 25 rows a slice the large key has many slices, some without versions."""
    facts, versions = rows_of(3, 4)
    delay = timedelta(hours=12)
    got, want = run(spark, facts, versions, 4, delay, most=most), plain(facts, versions, 4, delay)
    assert got == want
    assert {r[0] for r in got} == {"fact", "late"} and {r[2] for r in got if r[0] == "fact"} >= {1, 2, 3, 4}


def test_empty_tables(spark):
    facts, versions = rows_of(1, 2)
    for f, v in (([], versions[:30]), (facts[:30], [])):
        assert run(spark, f, v, 2, timedelta(0)) == plain(f, v, 2, timedelta(0))


def test_clock_times_have_no_zone(spark):
    rows = spark.sql("select timestamp_ntz'2024-03-31 02:30:00.000001' as t union all select null")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        got = {r[0] for r in rows.select(validtime.micros(F.col("t"))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {None, int((datetime(2024, 3, 31, 2, 30) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + 1}
