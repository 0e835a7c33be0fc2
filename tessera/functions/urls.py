"""URL functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions.text import let, strings


def host(url: Column) -> Column:
    """Lower-case host, or null."""
    return F.lower(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """What stands between ? and #, or an empty string."""
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def dedupe_key(url: Column) -> Column:
    """The same for addresses that differ by fragment, tracking parameters, closing slashes, www. or http."""
    kept = F.array_join(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*L.TRACKING_PARAMETERS)), "&")
    scheme = F.regexp_replace(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1), "^http$", "https")
    trimmed = F.when(F.length(path(url)) > 1, F.regexp_replace(path(url), "(?<=.)/+$", "")).otherwise(path(url))
    port = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1)
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(host(url), "^www\\.", ""), port, trimmed, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.coalesce(whole, F.lower(F.trim(url)))


def navigation_penalty(url: Column) -> Column:
    """0 for a page, 2 for thin listings and fronts, 3 with a query, 1 for what is no address."""
    thin = let(F.lower(path(url)), lambda p: F.exists(strings(L.THIN_PATHS), lambda t: F.contains(p, t)) | p.isin("", "/"))
    return F.when(host(url).isNull(), 1).when(query(url) != "", 3).when(thin, 2).otherwise(0)


def is_private(url: Column) -> Column:
    """Whether the host is this machine or on a private network."""

    def judged(h: Column) -> Column:
        part = lambda i: F.regexp_extract(h, "^([0-9]{1,3})\\.([0-9]{1,3})\\.([0-9]{1,3})\\.([0-9]{1,3})$", i).try_cast("int")
        a, b = part(1), part(2)
        valid = F.coalesce((a <= 255) & (b <= 255) & (part(3) <= 255) & (part(4) <= 255), F.lit(False))
        named = h.isin("localhost", "127.0.0.1", "::1", "0.0.0.0") | h.endswith(".local") | h.endswith(".internal")
        ranged = (a == 10) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254))
        return F.coalesce(named, F.lit(False)) | (valid & F.coalesce(ranged, F.lit(False)))

    return let(host(url), judged)


def unwrap_redirect(href: Column) -> Column:
    """The target of a redirecting search link, else the address with a scheme."""
    whole = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    target = F.regexp_extract(whole, "[?&]uddg=([^&#]*)", 1)
    return F.when(href.contains("uddg=") & (target != ""), F.try_url_decode(target)).otherwise(whole)
