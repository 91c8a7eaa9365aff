"""URLs, referrers, devices and ids of web events as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UTM = ("source", "medium", "campaign", "term", "content")

#: Referrer hosts and the names they are shown under, in the order in which they are tried.
REFERRERS = [
    ("google.", "Google"),
    ("bing.com", "Bing"),
    ("duckduckgo.com", "DuckDuckGo"),
    ("yahoo.", "Yahoo"),
    ("yandex.", "Yandex"),
    ("baidu.com", "Baidu"),
    ("facebook.com", "Facebook"),
    ("fb.com", "Facebook"),
    ("instagram.com", "Instagram"),
    ("twitter.com", "Twitter"),
    ("x.com", "Twitter"),
    ("t.co", "Twitter"),
    ("linkedin.com", "LinkedIn"),
    ("reddit.com", "Reddit"),
    ("youtube.com", "YouTube"),
    ("pinterest.com", "Pinterest"),
    ("tiktok.com", "TikTok"),
    ("github.com", "GitHub"),
    ("news.ycombinator.com", "Hacker News"),
]


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def path(url: Column) -> Column:
    """The path, `/` where a host has none; text that is no URL is its own path."""
    h = F.try_parse_url(url, F.lit("HOST"))
    p = F.try_parse_url(url, F.lit("PATH"))
    return F.when(h.isNull(), F.coalesce(url, F.lit(""))).otherwise(F.when(F.coalesce(p, F.lit("")) == "", F.lit("/")).otherwise(p))


def clean_url(url: Column) -> Column:
    """Scheme, host and path, without port, query and fragment."""
    h = F.try_parse_url(url, F.lit("HOST"))
    return F.when(h.isNull(), F.coalesce(url, F.lit(""))).otherwise(F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), h, path(url)))


def utm(url: Column, name: str) -> Column:
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(f"utm_{name}"))
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def referrer_source(referrer: Column, own_host: Column) -> Column:
    """Direct for none or the own host, else the first known name, else the referrer's host.

    A name with a dot at its end matches a label of the host, other names the host or a parent
    domain of it; so `netflix.com` is not taken for `x.com`.
    """
    h = host(referrer)
    out = F.when((F.coalesce(referrer, F.lit("")) == "") | (h == own_host), F.lit("Direct"))
    for pattern, name in REFERRERS:
        if pattern.endswith("."):
            fits = F.startswith(h, F.lit(pattern)) | F.contains(h, F.lit("." + pattern))
        else:
            fits = (h == pattern) | F.endswith(h, F.lit("." + pattern))
        out = out.when(fits, F.lit(name))
    return out.otherwise(F.when(h == "", referrer).otherwise(h))


def device(os: Column, width: Column) -> Column:
    mobile = os.isin("Android", "iOS", "Windows Phone")
    return F.when(width <= 575, "Mobile").when(mobile & width.isNull(), "Mobile").when(mobile, "Tablet").otherwise("Desktop")


def screen(width: Column) -> Column:
    return F.when(width.isNull(), "").when(width <= 575, "Small").when(width <= 991, "Medium").otherwise("Large")


#: Families in the order in which they are tried, with the pattern that gives major and minor version.
_BROWSERS = [
    ("Edge", r"Edg(?:e|A|iOS)?/(\d+)(?:\.(\d+))?"),
    ("Opera", r"(?:OPR|Opera)/(\d+)(?:\.(\d+))?"),
    ("Samsung Internet", r"SamsungBrowser/(\d+)(?:\.(\d+))?"),
    ("Firefox iOS", r"FxiOS/(\d+)(?:\.(\d+))?"),
    ("Firefox", r"Firefox/(\d+)(?:\.(\d+))?"),
    ("Chrome Mobile iOS", r"CriOS/(\d+)(?:\.(\d+))?"),
    ("Chrome", r"Chrome/(\d+)(?:\.(\d+))?"),
    ("Mobile Safari", r"Version/(\d+)(?:\.(\d+))?.* Mobile/.*Safari"),
    ("Safari", r"Version/(\d+)(?:\.(\d+))?.*Safari"),
]
_SYSTEMS = [
    ("Windows Phone", r"Windows Phone(?: OS)? (\d+)(?:\.(\d+))?"),
    ("Windows", r"Windows NT (\d+)(?:\.(\d+))?"),
    ("Android", r"Android (\d+)(?:\.(\d+))?"),
    ("iOS", r"(?:iPhone|CPU) OS (\d+)(?:[_.](\d+))?"),
    ("Mac OS X", r"Mac OS X (\d+)(?:[_.](\d+))?"),
    ("Linux", r"Linux()()"),
]


def _family(agent: Column, known: list[tuple[str, str]]) -> tuple[Column, Column]:
    def version(pattern: str) -> Column:
        major, minor = F.regexp_extract(agent, pattern, 1), F.regexp_extract(agent, pattern, 2)
        return F.when(minor != "", F.concat(major, F.lit("."), minor)).otherwise(major)

    def pick(value) -> Column:
        return reduce(lambda out, k: out.when(agent.rlike(k[1]), value(k)), known[1:], F.when(agent.rlike(known[0][1]), value(known[0])))

    return pick(lambda k: F.lit(k[0])).otherwise("Other"), pick(lambda k: version(k[1])).otherwise("")


def browser(agent: Column) -> tuple[Column, Column]:
    """Family and major.minor version of a user agent's browser, by a short list."""
    return _family(agent, _BROWSERS)


def system(agent: Column) -> tuple[Column, Column]:
    return _family(agent, _SYSTEMS)


def visitor_id(salt: Column, source: Column, ip: Column, agent: Column) -> Column:
    """16 hex characters that stay the same for a salt's day."""
    return F.substring(F.sha2(F.concat_ws("|", salt, source, ip, agent), 256), 1, 16)


def input_hash(pairs: dict[str, Column]) -> Column:
    """A digest of names and values that no shift of a border between them leaves the same."""
    parts = []
    for name, value in sorted(pairs.items()):
        v = F.coalesce(value.cast("string"), F.lit(""))
        parts += [F.lit(f"{len(name.encode())}:{name}"), F.octet_length(v).cast("string"), F.lit(":"), v]
    return F.sha2(F.concat(*parts), 256)


def language_tag(tag: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(tag), "[-_]"), 1))


def filled(template: str, columns: dict[str, Column]) -> Column:
    """A text with {column} placeholders; unknown ones stay."""
    import re

    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        name = piece[1:-1] if piece.startswith("{") else None
        parts.append(F.coalesce(columns[name].cast("string"), F.lit("")) if name in columns else F.lit(piece))
    return F.concat(*parts)


def blank(segment: Column) -> Column:
    return F.when(segment == "", "(blank)").otherwise(segment)
