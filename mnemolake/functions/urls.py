"""URL identity, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track. (Fixed values.)
TRACKERS = "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid gclsrc dclid msclkid yclid igshid mc_cid mc_eid _ga _gl ref_src spm".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host_of(url: Column | str) -> Column:
    """Lower case without www.; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(_col(url))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def normalize(url: Column | str) -> Column:
    """Lower-case scheme and host, no fragment, no slash after a bare host."""
    u = F.regexp_replace(F.trim(_col(url)), "#.*$", "")
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    tail = F.substring(u, F.length(head) + 1, F.length(u))
    return F.when(head == "", u).otherwise(F.concat(F.lower(head), F.when(tail == "/", F.lit("")).otherwise(tail)))


def canonical(url: Column | str) -> Column:
    """https, no www., no trackers, parameters sorted, no slash at the end, no fragment. What has no host is only trimmed
    and lower case; null for null."""
    pattern = "^(" + "|".join(TRACKERS) + ")(=|$)"
    params = F.array_sort(F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.lower(p).rlike(pattern)))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    path = F.regexp_replace(path_of(url), "/+$", "")
    port = F.regexp_extract(F.lower(F.trim(_col(url))), r"^[a-z][a-z0-9+.-]*://[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    return F.when(host_of(url) != "", F.concat(F.lit("https://"), host_of(url), port, path, query)).otherwise(F.lower(F.trim(_col(url))))


def hash8(url: Column | str) -> Column:
    return F.substring(F.sha2(normalize(url), 256), 1, 8)


def extension(url: Column | str) -> Column:
    """What follows the last dot of the last path segment, up to five characters; else empty."""
    return F.lower(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,5})$", 1))


def redirect_target(url: Column | str) -> Column:
    """The address in a redirect's uddg parameter, else the address itself."""
    inner = F.regexp_extract(_col(url), r"[?&]uddg=([^&]+)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(_col(url))


def in_scope(url: Column | str, rules: list[str]) -> Column:
    """Whether a rule allows the address: a host (and what is below it), or host and path prefix."""
    out = F.lit(False)
    for rule in rules:
        host, _, path = rule.lower().removeprefix("https://").removeprefix("http://").removeprefix("www.").partition("/")
        below = (host_of(url) == host) | host_of(url).endswith("." + host)
        out = out | (below if not path else (host_of(url) == host) & path_of(url).startswith("/" + path))
    return out
