"""Not-modified revisits of web archives: each resolved to the full response that it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import asof_join

#: Header fields of a revisit that never replace those of the response: they describe a body or one connection.
NOT_MERGED = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization", "set-cookie")
#: Query parameters that don't change what a URL means.
TRACKING = r"utm_\w+|ref|fbclid|gclid|sessionid|phpsessid"


def canonical_url(url: Column) -> Column:
    """One form of URLs that mean the same page.

    Scheme, ``www.`` and ``m.``, the default port, the fragment, tracking parameters and a final slash go, the host is
    lower-cased, and parameters are sorted. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    address, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.substring(bare, F.instr(bare, "?") + 1, F.length(bare))).otherwise("")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(address, "/", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.substring(address, F.length(F.substring_index(address, "/", 1)) + 1, F.length(address)), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """Headers by lower-case name; of names that are then the same the first counts. Null is none."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers, with those of the revisit that may replace or join them."""
    newer = F.map_filter(revisit, lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(newer), k)), newer)


def resolve_revisits(records: DataFrame, id: str = "record_id", url: str = "url", time: str = "time", status: str = "status", headers: str = "headers") -> DataFrame:
    """Every revisit (``status`` 304) of ``records`` with the latest full response (200) before it of the same canonical URL.

    ``id``, ``canonical_url``, ``time``, ``response_id``, ``response_time``, ``outcome`` and ``headers``:

    * ``resolved``: the entity tags agree (weak ones count as strong), or, where one side has none, the dates of last
      modification; ``headers`` are the response's, updated by the permitted ones of the revisit;
    * ``mismatch``: they are there and differ; ``unchecked``: no validator is on both sides; ``no response``: nothing
      full came before. ``headers`` are the revisit's own then.

    Of responses at the same time the one with the largest id counts; one at the time of the revisit is not before it.
    A null URL matches a null URL only, and a record without a time is neither met nor resolved. Repeated revisits each
    have a row. Records of other kinds are passed over; other columns are not read.
    """
    rows = records.select(F.col(id).alias("id"), canonical_url(F.col(url)).alias("canonical_url"), F.col(time).alias("at"), F.col(status).alias("status"), lower_names(F.col(headers)).alias("headers"))
    revisits = rows.where("status = 304").drop("status")
    responses = rows.where("status = 200").select("canonical_url", "at", "id", F.col("id").alias("response_id"), F.col("at").alias("response_time"), F.col("headers").alias("response_headers"))
    met = asof_join(revisits, responses, ["canonical_url"], "at", ["response_id", "response_time", "response_headers"], order=["id"], exact=False, how="left")
    tag = lambda c: F.regexp_replace(F.col(c)["etag"], "^W/", "")
    date = lambda c: F.col(c)["last-modified"]
    same = F.coalesce(tag("headers") == tag("response_headers"), date("headers") == date("response_headers"))
    outcome = F.when(F.col("response_id").isNull(), "no response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    return met.select(
        F.col("id").alias(id),
        "canonical_url",
        F.col("at").alias(time),
        "response_id",
        "response_time",
        outcome.alias("outcome"),
        F.when(same, merged(F.col("response_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
