"""Scalar functions of the record store as Column expressions. IDs in comments name the inventory entries they cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for true and false.
TRUE_WORDS = ("true", "1", "yes", "y", "active", "enabled", "approved")
FALSE_WORDS = ("false", "0", "no", "n", "inactive", "disabled", "blocked")
# Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")
# Names by which sections and lanes are known.
SECTIONS = {"discovery": "discovery", "lead": "lead", "the_lead": "lead", "deal": "deal_tape", "deals": "deal_tape", "deal_tape": "deal_tape", "competitive": "competitive_field", "competitive_field": "competitive_field", "ai": "ai_radar", "ai_radar": "ai_radar", "runway": "runway_watch", "runway_watch": "runway_watch", "deposit": "deposit_watch", "deposit_watch": "deposit_watch"}
LANES = {"rss": "rss_atom", "atom": "rss_atom", "feed": "rss_atom", "rss_atom": "rss_atom", "api": "api", "json": "api", "json_api": "api", "html": "html", "web_page": "html", "sitemap": "sitemap_html", "sitemap_html": "sitemap_html", "markdown": "markdown", "md": "markdown", "html_email": "html_email", "email": "html_email"}
# Currencies by sign or code, and amounts by unit word.
CURRENCIES = {"$": "USD", "US$": "USD", "USD": "USD", "£": "GBP", "GBP": "GBP", "€": "EUR", "EUR": "EUR", "C$": "CAD", "CAD": "CAD", "A$": "AUD", "AUD": "AUD"}
UNITS = {"": 1, "k": 10**3, "thousand": 10**3, "m": 10**6, "mm": 10**6, "million": 10**6, "b": 10**9, "bn": 10**9, "billion": 10**9, "tn": 10**12, "trillion": 10**12}
# Expressions for dates in prose, calls to action and instructions to a model.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE_HINT = rf"(?i)\b(?:(?:19|20)\d{{2}}[-/]\d{{1,2}}[-/]\d{{1,2}}|{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}}|\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\.?,?\s+(?:19|20)\d{{2}})\b"
CALL_TO_ACTION = r"(?i)\b(?:learn more|read more|read (?:the )?(?:blog )?post|view (?:the )?article)\b.*$"
INJECTION = r"(?i)(?:ignore\s+(?:all|any|the|your)?\s*(?:previous|prior|above)\s+instructions|system\s+prompt|developer\s+message|call\s+(?:a\s+)?tool|do\s+not\s+follow\s+your\s+instructions)"


def mapping(entries: dict) -> Column:
    """A literal map."""
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_key(c: Column) -> Column:  # S1
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))


def parse_bool(c: Column, default: bool | None = None, strict: bool = False) -> Column:  # S2
    """True, false, the default for blanks; anything else is null, or an error if strict."""
    word = F.lower(F.trim(c))
    other = F.raise_error(F.concat(F.lit("invalid boolean value: "), c)).cast("boolean") if strict else F.lit(None).cast("boolean")
    blank = F.lit(default).cast("boolean")
    return F.when(c.isNull() | (word == ""), blank).when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False)).otherwise(other)


def parse_aware_time(c: Column) -> Column:  # S3, S41
    """Instants with an explicit offset; everything else is null."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp"))


def parse_cell_time(c: Column) -> Column:  # S4
    """An aware instant, or a bare date as midnight UTC, or null."""
    text = F.trim(c)
    bare = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp"))
    return F.coalesce(parse_aware_time(c), bare)


def let(value: Column, body) -> Column:
    """body(value), where the value is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Zones by the minutes that they are ahead of UTC.
ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "CET": 60, "CEST": 120}
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([ap]m))?"
_NAMES = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def parse_lenient_time(c: Column) -> Column:  # S5
    """Dates as feeds and pages write them: in numbers, month before day where both fit, or with a month's name, in either order; then a
    time of day, an offset or zone, if any. Weekdays, commas, ordinals and dots after months say nothing. Without a zone it is UTC."""
    text = F.lower(F.trim(c))
    for pattern, by in ((r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+", ""), (r"(?<=\d)(?:st|nd|rd|th)\b", ""), (r"\b([a-z]{3,9})\.(?=\s)", "$1"), (r"(?<=\d)t(?=\d)", " "), (r"\s+at\s+|,\s*|\s+", " "), (r"(?<=:\d{2})\.\d+", ""), (r"\s*\b([ap])\.?m\.?(?=\s|$)", " $1m")):
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(text, rf"(?i)\b{_MONTH}\b", "<$0>")  # a month's name, whole

    def of(x: Column) -> Column:
        g = lambda k: F.get(x, F.lit(k))
        day, month, name = g(1), g(2), F.substring(g(2), 2, 3)
        month_no = F.element_at(mapping({m: k + 1 for k, m in enumerate(_NAMES.split("|"))}), name)
        date = F.coalesce(
            *(F.when(day.rlike(p), F.try_to_timestamp(day, F.lit(f))) for p, f in ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{8}$", "yyyyMMdd"))),
            F.when(day.rlike(r"^(?:<[a-z]+> \d{1,2} \d{4}|\d{1,2}[ -]<[a-z]+>[ -]\d{4}|\d{4} <[a-z]+> \d{1,2})$") & (month != ""), F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(day, r"\d{4}", 0), month_no.cast("string"), F.regexp_extract(day, r"(?<!\d)(\d{1,2})(?!\d)", 1)), F.lit("yyyy-M-d"))),
        )
        whole = lambda k: F.when(g(k) != "", g(k).try_cast("int"))  # noqa: E731  a cast that fails is dear
        hour, minute, second = (F.coalesce(whole(k), F.lit(0)) for k in (3, 4, 5))
        half = g(6)
        sound = (hour < 24) & (minute < 60) & (second < 60) & ((half == "") | hour.between(1, 12))
        clock = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0)) * 3600 + minute * 60 + second
        ahead = F.coalesce(F.element_at(mapping(ZONES), F.upper(g(7))), F.when(g(8) == "-", -1).otherwise(1) * (whole(9) * 60 + whole(10)), F.lit(0))
        return F.when(sound, F.timestamp_seconds(F.unix_seconds(date) + clock - F.when(g(3) != "", ahead).otherwise(0) * 60))

    whole = rf"^(.*?)(?: {_CLOCK}(?: ?(?:({'|'.join(ZONES).lower()})|([+-])(\d{{2}}):?(\d{{2}})))?)?$"
    groups = lambda t: F.array(F.lit(""), F.regexp_extract(t, whole, 1), F.regexp_extract(t, r"<[a-z]+>", 0), *(F.regexp_extract(t, whole, k) for k in range(2, 10)))
    return F.coalesce(parse_aware_time(c), let(text, lambda t: let(groups(t), of)))


def parse_list(c: Column, lowercase: bool = False) -> Column:  # S6
    """A JSON array, or a text split at , ; or |: trimmed, without blanks, each value once in order of appearance."""
    text = F.trim(F.coalesce(c, F.lit("")))
    as_json = F.when(text.startswith("["), F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}))
    items = F.transform(F.coalesce(as_json, F.split(text, "[,;|]")), lambda x: F.lower(F.trim(x)) if lowercase else F.trim(x))
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def cadence_minutes(c: Column) -> Column:  # S7
    """First number times unit, half-even, 15 at least; a bare number is minutes, a blank a day."""
    text = F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("daily"))
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double"), F.lit(1.0))
    unit = F.when(text.rlike(r"^\d+(?:\.\d+)?$") | text.contains("min"), 1).when(text.contains("hour") | text.rlike(r"\bhr"), 60).when(text.contains("week"), 7 * 1440).when(text.contains("month"), 30 * 1440).otherwise(1440)
    return F.greatest(F.lit(15), F.bround(number * unit, 0).cast("int"))


def section_of(c: Column) -> Column:  # S8
    return F.element_at(mapping(SECTIONS), normalize_key(c))


def parser_lane(method: Column, parser: Column | None = None) -> Column:  # S8, SC15
    own = F.element_at(mapping(LANES), normalize_key(method))
    return own if parser is None else F.coalesce(F.element_at(mapping(LANES), normalize_key(parser)), own)


def source_tier(c: Column, primary: Column | None = None, discovery: Column | None = None) -> Column:  # S8
    """Letters A to D, where a primary source is A unless D; labels by what they name."""
    upper, key = F.upper(F.trim(F.coalesce(c, F.lit("")))), normalize_key(c)
    is_primary = F.coalesce(primary, F.lit(False)) if primary is not None else F.lit(False)
    is_discovery = F.coalesce(discovery, F.lit(False)) if discovery is not None else F.lit(False)
    return (
        F.when(upper == "D", "D")
        .when(upper.isin("A", "B", "C"), F.when(is_primary, "A").otherwise(upper))
        .when(is_primary | key.contains("primary") | key.contains("regulatory"), "A")
        .when(key.contains("official") | key.contains("corporate") | key.contains("product"), "B")
        .when(is_discovery | key.contains("discovery"), "C")
        .when(key.rlike("social|unattributed|ambiguous|malformed"), "D")
    )


def first_filled(*columns: Column) -> Column:  # S9
    return F.coalesce(*(blank_to_null(c) for c in columns))


def canonical_url(c: Column) -> Column:  # S10, absolute URLs
    """Scheme and host lowered, default port, fragment and tracking parameters gone, query sorted, slashes single. Null
    without scheme or host, or with credentials."""
    url = F.trim(c)
    scheme, authority = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))))
    query = F.array_join(pairs, "&")
    made = F.concat(scheme, F.lit("://"), host, F.when((port != "") & ~((scheme == "https") & (port == "443")), F.concat(F.lit(":"), port)).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when((scheme != "") & (host != "") & ~authority.contains("@"), made)


def url_host(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def url_key(c: Column) -> Column:  # S11
    """Host, path without a slash at its end, query."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(c), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    return F.struct(F.coalesce(url_host(c), F.lit("")).alias("host"), F.when(path == "", "/").otherwise(path).alias("path"), F.regexp_extract(rest, r"\?(.*)$", 1).alias("query"))


def revision_hash(title: Column, body: Column) -> Column:  # S12
    """SHA-256 of what a reader sees: the collapsed title, then the trimmed lines that are not blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.sha2(F.concat(collapse(F.coalesce(title, F.lit(""))), F.lit("\n"), F.array_join(lines, "\n")), 256)


def candidate_key(source: Column, item: Column, content: Column) -> Column:  # S13
    return F.sha2(F.concat_ws("|", source, item, content), 256)


def short_id(c: Column, prefix: str = "WEB-") -> Column:  # S14
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(c, 256), 1, 16)))


def scrub_entities(c: Column) -> Column:  # S16
    """The five XML entities stay, nbsp becomes numeric, other named ones a blank."""
    return F.regexp_replace(F.regexp_replace(c, "(?i)&nbsp;", "&#160;"), r"&(?!(?:amp|apos|gt|lt|quot);)[A-Za-z][A-Za-z0-9]+;", " ")


def date_hint(c: Column) -> Column:  # S17
    """The first date in a text. Each form of a date holds a year, so a text without one is not searched."""
    return F.nullif(let(c, lambda x: F.when(F.contains(x, F.lit("20")) | F.contains(x, F.lit("19")), F.regexp_extract(x, DATE_HINT, 0))), F.lit(""))


def card_title(c: Column) -> Column:  # S18
    """Without dates, calls to action and labels; 300 characters at most."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, DATE_HINT, " "), CALL_TO_ACTION, " "), r"(?i)\b(?:press release|featured)\b", " ")
    return F.substring(F.trim(collapse(text), F.lit(" -|:")), 1, 300)


def padded_words(c: Column) -> Column:  # S19
    """ASCII words in lower case between single blanks, a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def has_term(padded: Column, term: Column, least: int = 3) -> Column:  # S19
    words = F.trim(padded_words(term))
    return (F.length(words) >= least) & F.contains(padded, F.concat(F.lit(" "), words, F.lit(" ")))


def grounded(c: Column) -> Column:  # S20 for text that NFKC and case folding leave alone
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w$€£%]+", " "))


# What an amount of money and a number with its unit look like.
_SIGN, _NUMBER, _UNIT = r"US\$|C\$|A\$|USD|GBP|EUR|CAD|AUD|\$|£|€", r"\d[\d,]*(?:\.\d+)?", "trillion|billion|million|thousand|tn|bn|mm|b|m|k"
AMOUNT_BEFORE = rf"(?i)({_SIGN})\s*({_NUMBER})\s*({_UNIT})?\b"
AMOUNT_AFTER = rf"(?i)({_NUMBER})\s*({_UNIT})?\s*(USD|GBP|EUR|CAD|AUD)\b"


def _parts(c: Column, pattern: str, groups: dict[str, int]) -> Column:
    """The groups of each match. A text is searched once, and not at all without a digit."""
    found = F.when(c.rlike("[0-9]"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda x: F.struct(*(F.regexp_extract(x, pattern, k).alias(n) for n, k in groups.items())))


def scaled(number: Column, unit: Column) -> Column:
    """A number as digits, commas taken out, its unit worked in and zeros that say nothing left off: units are powers of ten, so the point
    moves and no arithmetic bounds the digits."""
    digits = F.regexp_replace(number, ",", "")
    places = F.element_at(mapping({u: len(str(n)) - 1 for u, n in UNITS.items()}), F.lower(F.coalesce(unit, F.lit(""))))

    def moved(x: Column) -> Column:
        whole = F.regexp_replace(F.concat(x["whole"], F.rpad(F.substring(x["part"], F.lit(1), places), places, F.lit("0"))), "^0+(?=.)", "")
        rest = F.regexp_replace(F.substring(x["part"], places + 1, F.lit(2**31 - 1)), "0+$", "")
        return F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))

    return let(F.struct(F.substring_index(digits, ".", 1).alias("whole"), F.when(digits.contains("."), F.substring_index(digits, ".", -1)).otherwise("").alias("part")), moved)


def amounts(c: Column) -> Column:  # S21
    """array<struct<amount decimal(38,6), currency>>: each different amount of money, sign before or code after it. What has more digits
    than the type holds is no amount."""

    def found(pattern: str, sign: int, number: int, unit: int) -> Column:
        parts = _parts(c, pattern, {"sign": sign, "number": number, "unit": unit})
        return F.transform(parts, lambda x: F.struct(scaled(x["number"], x["unit"]).try_cast("decimal(38,6)").alias("amount"), F.element_at(mapping(CURRENCIES), F.upper(x["sign"])).alias("currency")))

    held = F.filter(F.concat(found(AMOUNT_BEFORE, 1, 2, 3), found(AMOUNT_AFTER, 3, 1, 2)), lambda x: x["amount"].isNotNull())
    return F.array_sort(F.array_distinct(held))


NUMBER = r"(?i)(?<!\w)(\d[\d,]*(?:\.\d+)?)\s*(trillion|billion|million|thousand|tn|bn|mm|b|m|k)?\s*(%|percent|per\s+cent)?"


def numbers(c: Column) -> Column:  # S22
    """array<string>: each different number, of any length, with its unit worked in; percentages end in %."""
    parts = _parts(c, NUMBER, {"number": 1, "unit": 2, "share": 3})
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.concat(scaled(x["number"], x["unit"]), F.when(x["share"] != "", "%").otherwise("")))))


def word_runs(words: Column, size: int) -> Column:
    """Every run of `size` words of an array, joined by a blank."""
    runs = words
    for k in range(1, size):
        left = F.greatest(F.size(words) - k, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(words, F.lit(k + 1), left), lambda a, b: F.concat(a, F.lit(" "), b))
    return runs


# What counts as a name (capitals only, capitals inside, or a capital and two small letters or more), what as a
# token that may support one, and behind which characters a sentence or a field begins.
NAME = r"(?U)\b(?:[A-Z]{2,}|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]{2,})\b"
NAME_TOKEN = r"[A-Za-z][A-Za-z0-9&.'-]*"
BEGINNING = "[.!?\n\u2014:]"


def unknown_names(copy: Column, entities: Column, facts: Column, allowed: tuple[str, ...] = ()) -> Column:  # S24
    """Names in the copy that are no token of entities, facts or `allowed`, in order. The copy is cut where sentences and fields begin;
    a plainly capitalised word that opens a piece is taken off it, as any sentence may begin with one."""
    pieces = F.split(F.coalesce(copy, F.lit("")), BEGINNING)
    opened = F.transform(pieces, lambda x: F.regexp_replace(x, r"(?U)^[ \t\r]*[A-Z][a-z]{2,}\b", " "))
    names = F.flatten(F.transform(opened, lambda x: F.regexp_extract_all(x, F.lit(NAME), F.lit(0))))
    support = F.concat(F.coalesce(entities, F.array().cast("array<string>")), F.array(F.coalesce(facts, F.lit(""))))
    known = F.flatten(F.transform(support, lambda x: F.regexp_extract_all(x, F.lit(NAME_TOKEN), F.lit(0))))
    return F.array_sort(F.array_except(F.array_except(names, known), F.array(*map(F.lit, allowed)).cast("array<string>")))


def column_label(n: Column) -> Column:  # S34
    """A, B, ... Z, AA, ... of a number from 1 on; null below."""
    step = lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).alias("n"), F.concat(F.char(F.lit(65) + (s["n"] - 1) % 26), s["label"]).alias("label"))).otherwise(s)
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("label"))
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["label"]))


def plain_decimal(c: Column) -> Column:  # S23
    """Digits without zeros at the end of a fraction."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


TOKEN_STOPS = ("and", "for", "from", "the", "with")


def token_set(c: Column) -> Column:  # S25
    """Words of more than two characters, but for five stop words, each once."""
    return F.array_distinct(F.filter(F.split(F.trim(padded_words(c)), " "), lambda x: (F.length(x) > 2) & ~x.isin(*TOKEN_STOPS)))


def token_overlap(a: Column, b: Column) -> Column:  # S25
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def reason_code(c: Column) -> Column:  # S26
    code = F.substring(F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "_"), F.lit("_")), 1, 80)
    return F.when(code == "", "UNKNOWN").otherwise(code)


def brand_key(c: Column) -> Column:  # S27
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def normalize_domain(c: Column) -> Column:  # S27, S40
    """Host of a URL, or the text before a slash, without www. and dots at the ends."""
    text = F.lower(F.trim(c))
    host = F.when(text.contains("://"), F.coalesce(url_host(text), F.lit(""))).otherwise(F.substring_index(text, "/", 1))
    return F.trim(F.regexp_replace(host, r"^www\.", ""), F.lit("."))


def initials(c: Column) -> Column:  # S28
    return F.upper(F.array_join(F.slice(F.transform(F.filter(F.split(collapse(c), " "), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), 1, 2), ""))


def slug(c: Column) -> Column:  # S28
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def send_id(date: Column, audience: Column, prefix: str) -> Column:  # S29
    return F.substring(F.concat_ws("-", F.lit(prefix), F.date_format(date, "yyyy-MM-dd"), audience), 1, 200)


def run_id(ts: Column, namespace: Column, engine: str) -> Column:  # S29
    return F.concat_ws("-", namespace, F.lit(engine), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))


def operating_lane(section: Column) -> Column:  # S30
    return F.when(section == "ai_radar", "ai").when(section.isin("competitive_field", "deposit_watch"), "competitor_deposit").otherwise("venture_debt")


def padded_number(c: Column, width: int = 10) -> Column:  # S31
    return F.right(F.lpad(F.regexp_replace(c, r"\D", ""), F.lit(width), F.lit("0")), F.lit(width))


def truncated(c: Column, size: int) -> Column:  # S32
    return F.substring(c, 1, size)


def json_list(c: Column, item: str = "string") -> Column:  # S33
    return F.coalesce(F.from_json(c, f"array<{item}>"), F.array().cast(f"array<{item}>"))


def boosted(score: Column, deposit_hits: Column, company_hits: Column) -> Column:  # S36
    return F.least(F.lit(100), score + F.when(deposit_hits > 0, 15).otherwise(0) + F.when(company_hits > 0, 5).otherwise(0))


def amount_label(currency: Column, commitment: Column, funding: Column) -> Column:  # S37
    return F.concat_ws(" ", currency, plain_decimal(F.coalesce(commitment, funding)))


def normalize_email(c: Column) -> Column:  # S38
    """Lowered and trimmed; null unless it has the form of an address."""
    text = F.lower(F.trim(c))
    return F.when(text.rlike(r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$"), text)


def search_url(base: Column, query: Column, lookback: str) -> Column:  # S39
    return F.concat(base, F.url_encode(F.concat(F.lit("("), query, F.lit(f") when:{lookback}"))))


def json_safe(c: Column) -> Column:  # S42
    return F.to_json(c, {"ignoreNullFields": "false"})


def optional_int(c: Column) -> Column:  # S43
    return F.trim(c).try_cast("int")


def error_codes(c: Column, most: int = 20) -> Column:  # S43
    return F.slice(F.array_distinct(F.transform(c, reason_code)), 1, most)


def has_template(url: Column, patterns: tuple[str, ...]) -> Column:  # S44
    return url.rlike("|".join(patterns))


def filled_template(url: Column, patterns: tuple[str, ...], value: Column) -> Column:  # S44
    return F.regexp_replace(url, F.lit("|".join(patterns)), value)


def codes(*checks: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, each once, sorted: an empty array means valid."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in checks)))))
