"""Fixed values, written down once more from the rules, so that a slip in one place does not pass on both sides."""

from klimawerk import schema


def test_thresholds_and_counts():
    assert (schema.SENTINEL, schema.MIN_MONTHS, schema.MAX_MISSING, schema.NORMAL_DIVISOR) == (-999.0, 11, 60, 30)
    assert {(name, column, op, limit) for name, column, op, limit in schema.THRESHOLD_DAYS} == {
        ("Regentag", "RSK", ">=", 0.1), ("Sommertag", "TXK", ">=", 25.0), ("Hitzetag", "TXK", ">=", 30.0),
        ("Tropennacht", "TNK", ">=", 20.0), ("Frosttag", "TNK", "<", 0.0), ("Eistag", "TXK", "<", 0.0),
        ("Schneetag", "SHK_TAG", ">", 1.0), ("Heiterertag", "NM", "<", 1.6), ("Truebertag", "NM", ">", 6.4),
    }
    assert set(schema.DAY_COUNTS) == {name for name, *_ in schema.THRESHOLD_DAYS}


def test_scales():
    assert schema.PRECIP_BREAKS == [0, 0.1, 0.5, 1, 2, 5, 10, 20, 50]
    assert len(schema.COMPASS) == 17 and schema.COMPASS[0] == schema.COMPASS[16] == "N"
    assert [schema.COMPASS[i] for i in (4, 8, 12)] == ["E", "S", "W"]
    assert schema.BAND_RANGES == {"temp": (-20, 40), "pressure": (950, 1050), "humidity": (0, 100)}


def test_months_periods_and_layers():
    assert [m[:3] for m in schema.MONTHS] == schema.MONTHS_SHORT
    assert schema.MONTHS_SHORT == ["Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"]
    assert schema.PERIODS == ["1991-2020", "1981-2010", "1971-2000", "1961-1990"]
    assert len(schema.MAP_LAYERS) == 8 and [in_tenths for *_, in_tenths in schema.MAP_LAYERS] == [True] * 3 + [False] * 5
