"""Requests: parameters as they come in text, their defaults, labels, and who is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import EVENT_TABS, EVENT_TYPES, STATUSES


def values_of(text: Column, allowed: list[str] | None = None) -> Column:
    """The values of a comma-separated list in its order, blanks around them and empty ones gone; with a closed list, only its values."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    return parts if allowed is None else F.filter(parts, lambda v: v.isin(*allowed))


def month_of(text: Column, now: str) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}$"), text).otherwise(F.lit(now))


def parsed(raw: DataFrame, now: str, default_tab: str = EVENT_TABS[0]) -> DataFrame:
    """raw with text columns tab, month, types, statuses, installs and search as values."""
    out = {
        "tab": F.when(F.col("tab").isin(*EVENT_TABS), F.col("tab")).otherwise(default_tab), "month": month_of(F.col("month"), now), "types": values_of(F.col("types"), EVENT_TYPES), "statuses": values_of(F.col("statuses"), STATUSES),
        "installs": values_of(F.col("installs")), "search": F.coalesce(F.trim("search"), F.lit("")),
    }
    return raw.withColumns(out)


def with_defaults(rows: DataFrame, subscribed: str) -> DataFrame:
    """A request without types, statuses, installs and search gets all types but promos, and the subscribed installs."""
    bare = (F.size("types") + F.size("statuses") + F.size("installs") == 0) & (F.col("search") == "")
    usual = F.array(*[F.lit(t) for t in EVENT_TYPES if t != "PROMO"])
    return rows.withColumns({"types": F.when(bare, usual).otherwise(F.col("types")), "installs": F.when(bare, F.col(subscribed)).otherwise(F.col("installs"))})


def label(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value)


def origin_label(origin: Column, host: Column, url: Column) -> Column:
    """`some-origin` as `Some Origin`, else the host, else the address."""
    words = F.transform(F.split(origin, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.coalesce(F.array_join(words, " "), host.cast("string"), url)


def is_listed(address: Column, addresses: Column) -> Column:
    """Whether an address is in a comma-separated list, without regard to case."""
    return F.array_contains(F.transform(F.split(addresses, ","), lambda a: F.lower(F.trim(a))), F.lower(address))


def first_statuses(rows: DataFrame, n: int) -> DataFrame:
    """day, statuses (the first n of a day, in order of event_id), more."""
    each = rows.groupBy("day", "status").agg(F.min("event_id").alias("first"))
    found = each.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("first", "status"))).alias("s"))
    return found.select("day", F.array_join(F.transform(F.slice("s", 1, n), lambda x: x["status"]), ",").alias("statuses"), (F.size("s") > n).alias("more"))


def recipients(subscriptions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Premium subscribers who want alerts and whose account is neither to be removed nor banned."""
    return subscriptions.where("premium AND alerts").join(accounts.where("NOT removed AND NOT banned").select("user_id"), "user_id", "left_semi")
