"""Learned hour-of-day profiles of a host's signals, their maturity, and shifts of level.

A signal is learned hour by hour: a mean for each hour of weekdays and of weekend
days. While it is learning, all hours weigh the same; once learned, a new day
weighs a tenth, and hours far from the profile don't move it. A shift that lasts a
day and is no incident sends the signal back to learning from the new level.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold, fold_stream

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
# Hours of the day that must be known, hours that make a day count, the change of a profile from day to day
# that is stable, the swing that calls for a weekend, the difference that proves a weekly cycle, and a rate that is quiet.
COVERAGE, DAY_HOURS, STABLE, SWING, WEEKLY, QUIET = 22, 12, 0.15, 0.5, 0.25, 0.05
# Weight of a new day, relative distance of a shifted hour, hours of a shift that is judged, normal hours that
# end one, and hours that are kept for learning anew.
DECAY, FAR, SHIFT_HOURS, NORMAL_HOURS, RECENT = 0.1, 0.5, 24, 3, 48
#: Smallest level that a change is measured against; other signals are percentages.
FLOORS, OTHER_FLOOR = {"rate": 1.0, "errors": 0.5}, 5.0

OUT = "host string, signal string, us long, value double, status string, event string, reasons array<string>, progress double, shift_since_us long, shift_hours int, direction int, expected double"
PROFILE = "host string, signal string, status string, hours int, weekday array<double>, weekend array<double>, change double"


def _series(us: int) -> dict:
    return {
        "status": "learning", "started": us, "mean": {"wd": [None] * 24, "we": [None] * 24}, "n": {"wd": [0] * 24, "we": [0] * 24}, "before": {"wd": None, "we": None},
        "known": [0] * 24, "day": None, "day_hours": 0, "days": {"wd": 0, "we": 0}, "change": None, "hours": 0, "sum": 0.0, "last": us, "recent": [], "shift": None,
    }


def _kind(us: int) -> str:
    return "we" if datetime.fromtimestamp(us / 1e6, UTC).weekday() >= 5 else "wd"


def _end_day(s: dict, floor: float) -> None:
    """What the day that is over did to the profile of its kind."""
    kind = _kind(s["day"] * DAY_US)
    now, old = s["mean"][kind], s["before"][kind]
    if s["day_hours"] >= DAY_HOURS:
        s["days"][kind] += 1
        both = [(a, b) for a, b in zip(now, old or []) if a is not None and b is not None]
        if len(both) >= DAY_HOURS:
            s["change"] = round(sum(abs(a - b) for a, b in both) / sum(max(abs(b), floor) for _, b in both), 4)
    s["before"][kind] = list(now)


def expected(s: dict, us: int) -> float | None:
    """The profile's value for an hour: of its kind of day, else of the other."""
    h, kind = us // HOUR_US % 24, _kind(us)
    own = s["mean"][kind][h]
    return own if own is not None else s["mean"]["we" if kind == "wd" else "wd"][h]


def _shifted(s: dict, us: int, value: float, floor: float) -> bool:
    """Whether a learned signal's hour is far from its profile; far hours on one side run on as a shift until three are normal."""
    want = expected(s, us)
    if want is None or s["hours"] < 24:
        return False
    far, shift = (value - want) / max(abs(want), floor), s["shift"]
    if abs(far) < FAR:
        if shift:
            shift["normal"] += 1
            if shift["normal"] >= NORMAL_HOURS:
                s["shift"] = None
        return False
    side = 1 if far > 0 else -1
    if not shift or shift["side"] != side:
        shift = s["shift"] = {"side": side, "since": us, "hours": 0, "value": 0.0, "want": 0.0, "incident": ""}
    shift.update(hours=shift["hours"] + 1, normal=0, value=round(shift["value"] + value, 4), want=round(shift["want"] + want, 4))
    return True


def observe(s: dict, us: int, value: float, floor: float) -> None:
    """One more hour of a signal."""
    h, kind, day, learned = us // HOUR_US % 24, _kind(us), us // DAY_US, s["status"] == "learned"
    if s["day"] != day:
        if s["day"] is not None:
            _end_day(s, floor)
        s.update(day=day, day_hours=0)
    if not (learned and _shifted(s, us, value, floor)):
        s["n"][kind][h] += 1
        weight = 1.0 / s["n"][kind][h]
        old = s["mean"][kind][h]
        s["mean"][kind][h] = round(value if old is None else old + (max(DECAY, weight) if learned else weight) * (value - old), 4)
    s["known"][h] += 1
    s.update(day_hours=s["day_hours"] + 1, hours=s["hours"] + 1, sum=round(s["sum"] + value, 4), last=us, recent=[*s["recent"], [us, round(value, 4)]][-RECENT:])


def _swing(s: dict, floor: float) -> float:
    """Peak less trough of the daily profile, relative to its mean; 0 while under 18 hours are known."""
    for kind in ("wd", "we"):
        own = [v for v in s["mean"][kind] if v is not None]
        if len(own) >= 18:
            return (max(own) - min(own)) / max(sum(own) / len(own), floor)
    return 0.0


def missing(s: dict, signal: str, age: float, least_days: float) -> list[str]:
    """What a signal still lacks to be learned."""
    floor, out = FLOORS.get(signal, OTHER_FLOOR), []
    if signal == "rate" and s["hours"] >= 6 and s["sum"] / s["hours"] < QUIET:
        out.append("quiet")
    if not (s["days"]["wd"] and s["days"]["we"]) and _swing(s, floor) >= SWING:
        out.append("weekly")
    if sum(map(bool, s["known"])) < COVERAGE:
        out.append("coverage")
    if s["change"] is None:
        out.append("stability_wait")
    elif s["change"] > STABLE:
        out.append("unstable")
    if age < least_days:
        out.append("min")
    return out


def _progress(s: dict, reasons: list, age: float, least_days: float, most_days: float) -> float:
    change = s["change"]
    parts = [min(1.0, age / least_days) if least_days > 0 else 1.0, min(1.0, sum(map(bool, s["known"])) / COVERAGE), 0.0 if change is None else 1.0 if change <= STABLE else 0.9 * STABLE / change]
    parts += [0.5 if any(s["days"].values()) else 0.0] * ("weekly" in reasons) + [0.0] * ("quiet" in reasons)
    done = 100 * sum(parts) / len(parts)
    return round(min(99.0, max(done, 100 * age / most_days if most_days > 0 else 0.0)), 1)


def _incident(host: dict, signal: str, shift: dict) -> str:
    """Why a shift is not a new normal; empty if it is."""
    errors = (host["signals"].get("errors") or {}).get("shift")
    if (signal == "errors" and shift["side"] > 0) or (signal != "errors" and errors and errors["side"] > 0):
        return "errors"
    if shift["side"] < 0 and shift["value"] <= 0.1 * shift["want"]:
        return "silence"
    return "alert" if host["alert"] is not None and host["alert"] >= shift["since"] else ""


def _settle(host: dict, signal: str, now: int, least_days: float, most_days: float) -> tuple[str, list, float]:
    """What the hour changes: (event, what is missing, progress)."""
    s = host["signals"][signal]
    if s["status"] == "learned":
        shift = s["shift"]
        if shift and not shift["incident"]:
            span = (s["last"] - shift["since"]) / HOUR_US + 1
            if span >= SHIFT_HOURS and shift["hours"] >= 0.75 * span:
                shift["incident"] = _incident(host, signal, shift)
                if shift["incident"]:
                    return f"incident:{shift['incident']}", [], 100.0
                fresh = _series(shift["since"])
                for us, value in s["recent"]:
                    if us >= shift["since"]:
                        observe(fresh, us, value, FLOORS.get(signal, OTHER_FLOOR))
                host["signals"][signal] = fresh
                return "relearn", [], 0.0
        return "", [], 100.0
    age = (now - s["started"]) / DAY_US
    lacks = missing(s, signal, age, least_days)
    if not lacks or age >= most_days:
        s["status"] = "learned"
        return ("cap" if lacks else "learned"), lacks, 100.0
    return "", lacks, _progress(s, lacks, age, least_days, most_days)


def _steps(least_days: float, most_days: float):
    def start() -> dict:
        return {"signals": {}, "alert": None}

    def step(host: dict, row: dict) -> list:
        us, out = row["us"], []
        if row["alerts"]:
            host["alert"] = us
        values = {r["signal"]: r["value"] for r in row["values"]}
        for signal in sorted(values):
            s = host["signals"].setdefault(signal, _series(us))
            observe(s, us, values[signal], FLOORS.get(signal, OTHER_FLOOR))
        for signal in sorted(values):
            event, lacks, progress = _settle(host, signal, us + HOUR_US, least_days, most_days)
            s = host["signals"][signal]
            shift = s["shift"] or {}
            out.append({"signal": signal, "us": us, "value": values[signal], "status": s["status"], "event": event, "reasons": lacks, "progress": progress, "shift_since_us": shift.get("since"), "shift_hours": shift.get("hours", 0), "direction": shift.get("side", 0), "expected": expected(s, us)})
        return out

    return start, step


def hours_of(values: DataFrame) -> DataFrame:
    """(host, us, values, alerts) for each hour, from host, signal, us, value and alert: means of each signal, and whether an alert fell into it."""
    hour = (F.floor(F.col("us") / HOUR_US) * HOUR_US).alias("us")
    per = values.groupBy("host", hour, "signal").agg(F.avg("value").alias("value"), F.coalesce(F.bool_or("alert"), F.lit(False)).alias("alert"))
    return per.groupBy("host", "us").agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("signal", "value"))).alias("values"), F.bool_or("alert").alias("alerts"))


def learning_states(hours: DataFrame, least_days: float = 1.0, most_days: float = 7.0) -> DataFrame:
    """Each hour of each signal with its state after it: status (learning, learned), event (learned, cap, relearn or
    incident:why), what is missing, progress, the shift that runs, and what the profile expects.

    `hours` has host, us (the hour's beginning), values (signal and value) and
    alerts, as `hours_of` gives them. `most_days` learns a signal whatever it lacks.
    An hour without a value of a signal is not observed.
    """
    return fold(hours, ["host"], ["us"], *_steps(least_days, most_days), OUT)


def learning_stream(hours: DataFrame, least_days: float = 1.0, most_days: float = 7.0) -> DataFrame:
    """`learning_states` over a stream of closed hours."""
    return fold_stream(hours, ["host"], ["us"], *_steps(least_days, most_days), OUT)


def learned_profiles(hours: DataFrame, least_days: float = 1.0, most_days: float = 7.0) -> DataFrame:
    """The profile that each signal has in the end."""
    start, step = _steps(least_days, most_days)

    def quiet(state: dict, row: dict) -> list:
        step(state, row)
        return []

    def finish(state: dict, key: dict) -> list:
        return [{"signal": k, "status": s["status"], "hours": s["hours"], "weekday": s["mean"]["wd"], "weekend": s["mean"]["we"], "change": s["change"]} for k, s in sorted(state["signals"].items())]

    return fold(hours, ["host"], ["us"], start, quiet, PROFILE, finish)


def shifts(states: DataFrame) -> DataFrame:
    """One row for each shift of level that has run: where it began, its far hours, side and how it ended (relearn, incident, or it passed)."""
    runs = states.where("shift_since_us IS NOT NULL OR event = 'relearn'")
    per = runs.where("shift_since_us IS NOT NULL").groupBy("host", "signal", F.col("shift_since_us").alias("since_us")).agg(F.max("shift_hours").alias("hours"), F.max("us").alias("last_us"), F.max_by("direction", "us").alias("direction"), F.max(F.when(F.col("event").startswith("incident:"), F.col("event"))).alias("incident"))
    anew = states.where("event = 'relearn'").select("host", "signal", F.col("us").alias("relearn_us"))
    # The hour that sends a signal back to learning is the one after the last of its shift.
    out = per.join(anew, (per["host"] == anew["host"]) & (per["signal"] == anew["signal"]) & (F.col("relearn_us") > per["last_us"]) & (F.col("relearn_us") - per["last_us"] <= HOUR_US), "left")
    return out.select(per["host"], per["signal"], "since_us", "hours", "last_us", "direction", F.coalesce("incident", F.when(F.col("relearn_us").isNotNull(), "relearn"), F.lit("passed")).alias("end"))
