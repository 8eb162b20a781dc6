"""The Spark cleaning, rollup and spells against plain Python loops on random small records."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest

from klimawerk.operators import cleaning
from klimawerk.operators.deviation import deviations
from klimawerk.operators.yearly import yearly_with_spells
from klimawerk.schema import MEASURES

COLUMNS = ["SDK", "RSK", "TMK", "SHK_TAG"]


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for station in ("0001", "0002"):
        day = date(2001, 1, 1)
        while day < date(2005, 1, 1):
            short_year = station == "0002" and day.year == 2003 and day.month > 10
            if not short_year and rng.random() > 0.05:
                share = 0.2 if (station, day.year) == ("0001", 2002) else 0.05
                values = {}
                for c in COLUMNS:
                    draw = rng.random()
                    values[c] = -999 if draw < share else None if draw < share + 0.02 else rng.choice([0, 0, rng.randrange(-50, 300) / 10])
                rows.append((station, day, values))
            day += timedelta(days=1)
    rng.shuffle(rows)
    return rows


def by_hand(rows):
    months = defaultdict(set)
    for s, d, _ in rows:
        months[s, d.year].add(d.month)
    rows = [r for r in rows if len(months[r[0], r[1].year]) >= 11]
    result = {(s, d): {} for s, d, _ in rows}
    for c in COLUMNS:
        missing, donors = defaultdict(int), defaultdict(list)
        for s, d, v in rows:
            if v[c] == -999:
                missing[s, d.year] += 1
            elif v[c] is not None:
                donors[s, d.month, d.day].append(v[c])
        for s, d, v in rows:
            value = v[c]
            if value == -999:
                values = donors[s, d.month, d.day]
                value = sum(values) / len(values) if values else None
            result[s, d][c] = None if missing[s, d.year] >= 60 else value
    return result


def longest(flags, wanted):
    best = run = 0
    for f in flags:
        run = run + 1 if f == wanted else 0
        best = max(best, run)
    return best or None


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_loops(raw_days, seed):
    rows = random_rows(seed)
    expected = by_hand(rows)
    clean = cleaning.clean(raw_days(rows)).cache()
    got = {(r.station_id, r.Date): r for r in clean.select("station_id", "Date", *COLUMNS).collect()}
    assert set(got) == set(expected)
    assert all(same(got[k][c], expected[k][c]) for k in expected for c in COLUMNS)
    nulled = [k for k in expected if k[0] == "0001" and k[1].year == 2002 and expected[k]["SDK"] is not None]
    assert not nulled

    years = defaultdict(list)
    for key in sorted(expected):
        years[key[0], key[1].year].append(expected[key])
    for r in yearly_with_spells(clean).collect():
        days = years[r.station_id, r.Jahr]
        flags = [int(d["RSK"] is not None and d["RSK"] >= 0.1) for d in days]
        temperatures = [d["TMK"] for d in days if d["TMK"] is not None]
        assert same(r.RSK, sum(d["RSK"] or 0 for d in days))
        assert same(r.TMK, sum(temperatures) / len(temperatures) if temperatures else None)
        assert (r.Regentage, r.Maximale_Trockenperiode, r.Maximale_Regenperiode) == (sum(flags), longest(flags, 0), longest(flags, 1))

    for r in deviations(clean, 2004, (2001, 2003), metrics=["TMK", "SDK", "Schneetag"]).collect():
        means, sums, snow = [], [], []
        for (station, year), days in years.items():
            if station == r.station_id and year <= 2003:
                t = [d["TMK"] for d in days if d["TMK"] is not None]
                means += [sum(t) / len(t)] if t else []
                sums.append(sum(d["SDK"] or 0 for d in days))
                snow.append(sum(d["SHK_TAG"] is not None and d["SHK_TAG"] > 1 for d in days))
        assert same(r.TMK_normal, sum(means) / len(means))
        assert same(r.SDK_normal, sum(sums) / len(sums))
        assert same(r.Schneetag_normal, sum(snow) / len(snow))


def test_other_measures_stay_null(raw_days):
    clean = cleaning.clean(raw_days(random_rows(4)))
    assert clean.filter(" or ".join(f"{m} is not null" for m in MEASURES if m not in COLUMNS)).count() == 0
