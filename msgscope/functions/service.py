"""Per-row service rules as Column expressions: confidence, risk tier,
percentages, request text statistics, URL predicates, model-id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgscope.functions import patterns as P
from msgscope.functions.text import _c, count_literal, strip_ws, words

# IPv4 ranges that count as private / loopback / link-local / reserved /
# multicast (fixed values, CIDR notation)
UNSAFE_IPV4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4",
    "240.0.0.0/4", "255.255.255.255/32",
]
URL_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
IPV4 = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"


def cidr_bounds(cidr: str) -> tuple[int, int]:
    ip, bits = cidr.split("/")
    a, b, c, d = (int(x) for x in ip.split("."))
    base = (a << 24) | (b << 16) | (c << 8) | d
    size = 1 << (32 - int(bits))
    return base, base + size - 1


def confidence(p) -> Column:
    """PRJ-08: |p - 0.5| * 2."""
    return F.abs(_c(p) - F.lit(0.5)) * 2


def risk_tier(p) -> tuple[Column, Column]:
    """PRJ-09: (type, level) by the first threshold strictly exceeded."""
    t = F.lit(P.RISK_DEFAULT[0])
    lv = F.lit(P.RISK_DEFAULT[1])
    for thr, typ, level in reversed(P.RISK_TIERS):
        t = F.when(_c(p) > thr, F.lit(typ)).otherwise(t)
        lv = F.when(_c(p) > thr, F.lit(level)).otherwise(lv)
    return t, lv


def spam_percent(p) -> Column:
    """PRJ-10: round-half-up integer percent."""
    return F.floor(_c(p) * 100 + 0.5).cast("int")


def request_text_stats(text) -> list[tuple[str, Column]]:
    """PRJ-06: characters, words, sentences = max(1, #. + #! + #?), mean word
    length (unrounded)."""
    t = F.coalesce(_c(text), F.lit(""))
    ws = words(t)
    wc = F.size(ws)
    letters = F.length(F.regexp_replace(t, f"[{P.SPACE}]+", ""))
    sentences = F.greatest(F.lit(1), count_literal(t, ".") + count_literal(t, "!") + count_literal(t, "?"))
    return [
        ("char_count", F.length(t).cast("int")),
        ("word_count", wc.cast("int")),
        ("sentence_count", sentences.cast("int")),
        ("avg_word_length", F.when(wc > 0, letters / wc).otherwise(F.lit(0.0))),
    ]


def text_rejection(text) -> Column:
    """FLT-04: reason a request text is rejected, null when accepted."""
    t = _c(text)
    return (
        F.when(t.isNull() | (strip_ws(t) == F.lit("")), F.lit("empty"))
        .when(F.length(t) > P.MAX_TEXT_CHARS, F.lit("too_long"))
        .otherwise(F.lit(None).cast("string"))
    )


def url_host(url) -> Column:
    netloc = F.regexp_extract(_c(url), URL_NETLOC, 1)
    return F.split(netloc, ":", -1).getItem(0)


def is_url(url) -> Column:
    """FLT-09: stripped text starts with http:// or https:// and has a host."""
    u = strip_ws(_c(url))
    return (F.lower(u).startswith("http://") | F.lower(u).startswith("https://")) & (
        F.regexp_extract(u, URL_NETLOC, 1) != F.lit("")
    )


def ipv4_value(host) -> Column:
    parts = [F.regexp_extract(_c(host), IPV4, i).cast("long") for i in range(1, 5)]
    ok = _c(host).rlike(IPV4) & parts[0].between(0, 255) & parts[1].between(0, 255) & parts[2].between(0, 255) & parts[3].between(0, 255)
    val = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(ok, val)


def unsafe_url_reason(url) -> Column:
    """FLT-10: scheme, missing host, blocked host name, or a private /
    loopback / link-local / reserved / multicast IPv4 literal; null = safe."""
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, URL_SCHEME, 1))
    netloc = F.regexp_extract(u, URL_NETLOC, 1)
    host = F.lower(F.split(netloc, ":", -1).getItem(0))
    ip = ipv4_value(host)
    in_ranges = F.lit(False)
    for cidr in UNSAFE_IPV4:
        lo, hi = cidr_bounds(cidr)
        in_ranges = in_ranges | ip.between(lo, hi)
    return (
        F.when(~scheme.isin("http", "https"), F.lit("scheme"))
        .when(netloc == F.lit(""), F.lit("no_host"))
        .when(host.isin(*P.BLOCKED_HOSTS), F.lit("blocked_host"))
        .when(ip.isNotNull() & in_ranges, F.lit("private_ip"))
        .otherwise(F.lit(None).cast("string"))
    )


def validate_model_ids(requested, valid: list[str]) -> tuple[Column, Column]:
    """PRJ-07 / SET-03 / SET-04: order-preserving distinct ids and the
    requested ids that are not valid."""
    req = _c(requested)
    vl = F.array(*[F.lit(v) for v in valid])
    return F.array_distinct(F.filter(req, lambda x: F.array_contains(vl, x))), F.array_except(req, vl)
