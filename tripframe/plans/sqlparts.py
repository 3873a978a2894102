"""Reusable DuckDB SQL fragments for oracle queries."""

CLOCK = ("coalesce(try_strptime({c}, '%H:%M'), try_strptime({c}, '%H:%M:%S'), "
         "try_strptime({c}, '%Y-%m-%d %H:%M:%S'))")


def clock(c: str) -> str:
    return CLOCK.format(c=c)


def hour(c: str) -> str:
    return f"CAST(hour({clock(c)}) AS INTEGER)"


def minute(c: str) -> str:
    return f"CAST(minute({clock(c)}) AS INTEGER)"


def slots(c: str = "DEP_TIME") -> str:
    return (f"({c} BETWEEN '07:00' AND '09:00' OR {c} BETWEEN '13:00' AND '15:00' "
            f"OR {c} BETWEEN '18:00' AND '20:00')")


def tod_class(h: str, default: int = 2) -> str:
    return (f"CASE WHEN {h} >= 0 AND {h} < 6 THEN 0 WHEN {h} >= 6 AND {h} < 12 THEN 1 "
            f"WHEN {h} >= 12 AND {h} < 18 THEN 2 WHEN {h} >= 18 AND {h} < 24 THEN 3 "
            f"ELSE {default} END")


TRAVEL_PAYLOAD = ("DAY_TYPE, BUSROUTE_ID, PEEK_ALLOC, NPEEK_ALLOC, ROUTE_LEN, BUSSTOP_CNT, "
                  "INFOUNIT_SEQ, BUSINFOUNIT_ID, LEN, GPS_COORDX, GPS_COORDY, COLLECT_DATE, "
                  "DEP_TIME, TIME_GAP, SPEED, DATA_TYPE")
TRAVEL_COLS = "obs_id, " + TRAVEL_PAYLOAD

TRAVEL_ROW_RULES = ("TIME_GAP > 5 AND TIME_GAP <= 300 AND SPEED > 5 AND SPEED <= 55 "
                    "AND coalesce(GPS_COORDX <> 0, true) AND coalesce(GPS_COORDY <> 0, true) "
                    "AND " + slots())


def travel_quality(src: str, name: str = "tq") -> str:
    """CTEs ``{name}_1..{name}`` applying the travel rules to ``src``."""
    return f"""
{name}_1 AS (SELECT {TRAVEL_PAYLOAD}, min(obs_id) AS obs_id FROM {src}
             WHERE LEN > 0 GROUP BY ALL),
{name}_2 AS (SELECT * FROM {name}_1 WHERE {TRAVEL_ROW_RULES}),
{name} AS (SELECT {TRAVEL_COLS} FROM (
    SELECT *, row_number() OVER (PARTITION BY BUSROUTE_ID, BUSINFOUNIT_ID, DEP_TIME
                                 ORDER BY obs_id) AS _rn FROM {name}_2) WHERE _rn = 1)"""


def md5_mod(expr: str, n: int) -> str:
    """int(md5 hex,16) mod n via four 8-digit chunks (same fold as Spark)."""
    step = (2 ** 32) % n
    h = f"md5(coalesce(CAST({expr} AS VARCHAR), 'nan'))"
    r = "CAST(0 AS BIGINT)"
    for i in range(4):
        chunk = f"CAST(('0x' || substr({h}, {8 * i + 1}, 8)) AS BIGINT)"
        r = f"(({r}) * {step} + {chunk}) % {n}"
    return r


def seeded_hash(expr: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || CAST({expr} AS VARCHAR))"
