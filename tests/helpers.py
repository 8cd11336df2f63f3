"""Small fleets and report archives used by the tests."""

import datetime as dt
import io
import zipfile

from heliofleet import schemas
from heliofleet.operators.fleet import Fleet

UTC = dt.timezone.utc
AT = dt.datetime(2026, 3, 12, 2, 0)
STAMP = "2026/03/12 12:00:00"  # market time of AT

# farm: (name, region, latitude, longitude, capacities of its units)
FARMS = {
    "HAZLSF": ("Hazel Solar Farm", "VIC1", -36.25, 142.5, (80.0, 40.0)),
    "BRKNSF": ("Bracken Solar Farm", "SA1", -34.5, 139.25, (250.0,)),
}
UNITS = [(f"{code}{i}", code, *place, capacity, None)
         for code, (*place, capacities) in FARMS.items() for i, capacity in enumerate(capacities, 1)]
FULL_SUN = [(code, AT, 1000.0, 25.0, 0.0) for code in FARMS]
LOW = [(unit[0], AT, unit[6] / 5) for unit in UNITS]  # a quarter of what full sun lets expect


def fleet(spark, readings=(), weather=(), prices=(), dispatch=(), ledger=()):
    def frame(rows, schema):
        return spark.createDataFrame(list(rows), schema)
    return Fleet(
        units=frame(UNITS, schemas.UNITS), readings=frame(readings, schemas.READINGS),
        weather=frame(weather, schemas.WEATHER), prices=frame(prices, schemas.PRICES),
        dispatch=frame(dispatch, schemas.DISPATCH), ledger=frame(ledger, schemas.LEDGER))


def archive(lines, member="REPORT.CSV"):
    """A zipped report beside a text file whose lines look like a report's and must not be read."""
    beside = scada_lines([(STAMP, "BESIDE1", 7.0)])
    packed = io.BytesIO()
    out = zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED)
    for name, content in (("about/index.txt", beside), (member, lines)):
        out.writestr(name, "\n".join(content) + "\n")
    out.close()
    return packed.getvalue()


def section(table, columns, *records):
    """One section of a report: its header line and a data line per record; values with a slash are quoted."""
    def cell(value):
        text = "" if value is None else str(value)
        return f'"{text}"' if "/" in text else text
    kind = f"DISPATCH,{table}"
    return [f"I,{kind},{','.join(columns.split())}", *(f"D,{kind},{','.join(map(cell, r))}" for r in records)]


def scada_lines(rows, extra=()):
    """A whole report of readings (stamp, unit, megawatts) between comment lines."""
    own = section("UNIT_SCADA,1", "SETTLEMENTDATE DUID SCADAVALUE LASTCHANGED", *((*r, r[0]) for r in rows))
    return ["C,readings of the fleet", *own, *extra, f"C,lines,{len(own)}"]


def files(spark, named):
    return spark.createDataFrame([(f"/in/{n}", bytearray(c)) for n, c in named.items()], "path string, content binary")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
