"""Small quote panels with closed-form answers."""
from datetime import date, timedelta

D1 = date(2026, 5, 1)
COLS = ("collected_date date, departure_date date, route string, carrier string, apw_days int, flight_number string, "
        "fare_family string, cabin string, stops int, price double, disposition string")


def quote(day=0, route="DEL-BOM", carrier="6E", apw=7, flight="1", family="SAVER", price=5000.0, dep=None, disposition="ACCEPTED"):
    collected = D1 + timedelta(days=day)
    return (collected, dep or collected + timedelta(days=apw), route, carrier, apw, str(flight), family, "economy", 0, float(price), disposition)


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


def weights(spark, routes, carriers=(), omega=None, preset="uniform"):
    from pricemill.params import OMEGA_PRESETS
    from pricemill.plans.index import Weights
    omega = omega or OMEGA_PRESETS["uniform"]
    return Weights(
        spark.createDataFrame(list(routes.items()), "route string, w double"),
        spark.createDataFrame(list(carriers) or [("-", "-", 1.0)], "route string, carrier string, phi double"),
        spark.createDataFrame([(preset, a, v) for a, v in omega.items()], "omega_preset string, apw_days int, omega double"))


def values(df, *cols):
    return {r["period"]: (r["value"] if not cols else tuple(r[c] for c in cols)) for r in df.collect()}
