"""Dates, trigger times and the game clock."""

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierpick.config import HOME_ZONE, PERIOD_SECONDS


def home_date(now_utc: dt.datetime, days: int = 0) -> dt.date:
    """Date in the home zone at a given instant; jobs take it as ``as_of``."""
    if now_utc.tzinfo is None:
        now_utc = now_utc.replace(tzinfo=dt.timezone.utc)
    return (now_utc.astimezone(ZoneInfo(HOME_ZONE)) + dt.timedelta(days=days)).date()


def home_time(utc: Column, days: int = 0) -> Column:
    """UTC timestamp (no zone) -> ``yyyy-MM-ddTHH:mm:ss`` in the home zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(HOME_ZONE), utc.cast("timestamp_ntz"))
    return F.date_format(local + F.make_dt_interval(days=F.lit(days)), "yyyy-MM-dd'T'HH:mm:ss")


def home_day(utc: Column, days: int = 0) -> Column:
    """UTC timestamp (no zone) -> date in the home zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(HOME_ZONE), utc.cast("timestamp_ntz"))
    return F.date_add(local.cast("date"), days)


def trigger_time(start: Column, minutes: int = 5) -> Column:
    """Start time (ISO-UTC text or timestamp) plus some minutes, as UTC without zone."""
    return start.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes))


def cron_text(time: Column) -> Column:
    parts = (F.minute(time), F.hour(time), F.dayofmonth(time), F.month(time), F.year(time))
    return F.format_string("cron(%d %d %d %d ? %d)", *parts)


def rule_name(time: Column, env: str) -> Column:
    stamp = F.date_format(time, "yyyyMMddHHmm")
    return F.concat(F.lit("TriggerStateMachineAt_"), stamp, F.lit(f"-{env}"))


def date_number(date: Column) -> Column:
    """Date as the integer yyyymmdd."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def goal_clock(period: Column, time_in_period: Column) -> Column:
    """Seconds of play at a goal, from the period and ``mm:ss``."""
    parts = F.split(F.coalesce(time_in_period, F.lit("00:00")), ":")
    return (
        (period - 1) * PERIOD_SECONDS
        + parts.getItem(0).cast("int") * 60
        + parts.getItem(1).cast("int")
    )


def elapsed(period: Column, seconds_remaining: Column) -> Column:
    left = F.coalesce(seconds_remaining, F.lit(0))
    return (period - 1) * PERIOD_SECONDS + (PERIOD_SECONDS - left)


def goal_period(clock: Column) -> Column:
    return F.floor(clock / PERIOD_SECONDS).cast("int") + 1
