"""Browser, operating system, device and region families by ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (keywords, family) in matching order; the first hit wins.
BROWSER_FAMILIES = [
    (["chrome"], "Chrome"),
    (["firefox", "mozilla"], "Firefox"),
    (["safari"], "Safari"),
    (["edge"], "Edge"),
    (["whale"], "Whale"),
    (["samsung"], "Samsung Internet"),
]
OS_FAMILIES = [
    (["windows"], "Windows"),
    (["mac", "darwin"], "Mac OS X"),
    (["linux"], "Linux"),
    (["chrome os"], "Chrome OS"),
    (["android"], "Android"),
]
DEVICE_TYPES = [
    (["mac", "darwin", "os x"], "mac"),
    (["windows", "linux", "chrome os"], "desktop"),
    (["ipad", "tablet"], "tablet"),
]
# The families used while loading raw client files.
LOAD_BROWSERS = [
    (["chrome"], "chrome"),
    (["firefox", "mozilla"], "firefox"),
    (["safari"], "safari"),
    (["edge"], "edge"),
    (["whale"], "whale"),
]
LOAD_DEVICES = [
    (["mac os x", "darwin"], "mac"),
    (["windows", "linux", "chrome os"], "desktop"),
    (["ios", "iphone", "ipad"], "ios"),
    (["android"], "android"),
]
# Country codes per region.
REGIONS = {
    "Asia": ["KR", "JP", "CN", "TW", "SG", "TH", "VN", "IN", "ID", "MY", "PH"],
    "Europe": ["GB", "DE", "FR", "IT", "ES", "NL", "SE", "NO", "FI", "DK", "PL"],
    "Americas": ["US", "CA", "BR", "MX", "AR", "CL", "CO", "PE"],
    "Oceania": ["AU", "NZ"],
}
CAPITAL_AREAS = ["Seoul", "Gangnam", "Seocho", "Gangdong", "Yongsan"]


def keyword_family(text: Column, rules: list[tuple[list[str], str]], other: str, missing: str | None = None) -> Column:
    """First family with a keyword inside the lower-cased text; empty text gives `missing`."""
    low = F.lower(text)
    out = F.when(text.isNull() | (text == ""), F.lit(missing))
    for words, family in rules:
        hit = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(low, F.lit(word))
        out = out.when(hit, family)
    return out.otherwise(other)


def browser_family(browser: Column) -> Column:
    return keyword_family(browser, BROWSER_FAMILIES, "Other")


def os_family(os: Column) -> Column:
    return keyword_family(os, OS_FAMILIES, "Other")


def device_type(os: Column) -> Column:
    return keyword_family(os, DEVICE_TYPES, "desktop", missing="unknown")


def load_browser_family(browser: Column) -> Column:
    return keyword_family(browser, LOAD_BROWSERS, "other")


def load_device_category(os: Column) -> Column:
    return keyword_family(os, LOAD_DEVICES, "other")


def region(country_code: Column) -> Column:
    code = F.upper(country_code)
    out = F.when(country_code.isNull() | (country_code == ""), F.lit(None).cast("string"))
    for name, codes in REGIONS.items():
        out = out.when(code.isin(codes), name)
    return out.otherwise("Other")


def is_korea(country_code: Column) -> Column:
    return F.coalesce(F.upper(country_code) == "KR", F.lit(False))


def is_capital_area(country_code: Column, city: Column) -> Column:
    return is_korea(country_code) & F.coalesce(city.rlike("|".join(CAPITAL_AREAS)), F.lit(False))
