"""Scalar expressions, all built of Spark's own functions. Nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters (fixed values): soft hyphen, zero-width and direction marks, word joiner and the like, byte order mark.
INVISIBLE = "\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}"

#: Writing systems (fixed values): name and the character classes counted for it.
SCRIPTS = {"latin": "\\p{IsLatin}", "cjk": "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}", "cyrillic": "\\p{IsCyrillic}", "arabic": "\\p{IsArabic}"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often `use` names it: lambdas don't share common parts, a lambda's variable does."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def if_holds(text: Column, marks: list[str], use: Column, otherwise: Column) -> Column:
    """use where one of the marks stands in the text: a plain search spares most texts a pattern that can't match without it."""
    held = F.lit(False)
    for m in marks:
        held = held | F.contains(text, F.lit(m))
    return F.when(held, use).otherwise(otherwise)


def sat(x: Column, top: float) -> Column:
    """Saturating logarithm: 0 at or below 0, 1 at or above top."""
    if top <= 0:
        raise ValueError("top must be over 0")
    return F.when(x.isNull(), None).when(x <= 0, 0.0).otherwise(F.log1p(x) / F.log1p(F.greatest(x.cast("double"), F.lit(float(top)))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(z: Column) -> Column:
    """Stable at both ends."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(p: Column) -> Column:
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(F.ln(p / (1 - p)))


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves towards plus infinity, and never gives a negative zero."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def tidy(x: Column) -> Column:
    return half_up(x, 9)


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86400e6)


def normalise_space(text: Column) -> Column:
    """Unicode white space (byte order marks with it) as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x{FEFF}]+", " "))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-8, as a long."""
    digits = F.hex(text.cast("binary"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(h: Column, at: Column) -> Column:
        byte = F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("long")
        return (h.bitwiseXOR(byte) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.when(text.isNotNull(), F.aggregate(places, F.lit(2166136261).cast("long"), step))


def draw(seed: str, *keys: Column) -> Column:
    """A seeded order of rows that any engine can repeat: the MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]).cast("binary"))


def mulberry32(seed: Column, n: Column) -> Column:
    """The n-th number (from 1) of the Mulberry32 generator with a 32-bit seed, in [0, 1), bit by bit as published. Any n costs the same, as the state is a multiple."""
    mask = F.lit(0xFFFFFFFF)
    # Products of 32 by 16 bits stay within 64.
    times = lambda x, y: (x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((x * F.shiftrightunsigned(y, 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)
    folded = lambda t, bits: t.bitwiseXOR(F.shiftrightunsigned(t, bits))
    state = (seed.cast("long").bitwiseAND(mask) + times(n.cast("long").bitwiseAND(mask), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(mask)
    first = lambda a: times(folded(a, 15), a.bitwiseOR(F.lit(1)))
    second = lambda t: t.bitwiseXOR((t + times(folded(t, 7), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return F.when(seed.isNotNull() & n.isNotNull(), bound(bound(bound(state, first), second), lambda t: folded(t, 14) / F.lit(4294967296.0)))


def cut_utf8(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within so many bytes."""
    raw = F.substring(text.cast("binary"), 1, most)
    shorter = [F.substring(text.cast("binary"), 1, max(most - k, 0)) for k in range(1, 4)]
    valid = [F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")) for x in (raw, *shorter)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*valid))


def fence_lines(text: Column) -> Column:
    """Lines that open or close a fenced code block."""
    lines = F.split(text, "\\r\\n|\\r|\\n")
    return if_holds(text, ["```", "~~~"], F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("```") | F.ltrim(x).startswith("~~~"))), F.when(text.isNotNull(), 0))


def without_comments(text: Column) -> Column:
    """Without HTML comments; one that isn't ended runs to the end."""
    return F.regexp_replace(text, "(?s)<!--.*?(-->|$)", "")


def comments(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<!--"))


def invisible_run(text: Column) -> Column:
    """The length of the longest run of invisible characters."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"[{INVISIBLE}]+"), F.lit(0)), lambda x: F.char_length(x))
    return F.when(text.isNotNull(), F.when(F.char_length(text) == F.octet_length(text), 0).otherwise(F.coalesce(F.array_max(runs), F.lit(0))))  # plain ASCII has none


def marks_of(text: Column, kind: str) -> Column:
    """How many characters of a class stand in the text, taken out in runs: one match a word instead of one a letter."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{kind}]+", ""))


def script_letters(text: Column) -> dict[str, Column]:
    """Letters of each writing system."""
    return {k: marks_of(text, v) for k, v in SCRIPTS.items()}


def script_of(text: Column) -> Column:
    """The writing system other than Latin with over 30 percent of the letters; latin with under ten letters."""
    counts, letters = script_letters(text), marks_of(text, "\\p{L}")
    found = F.when(letters < 10, F.lit("latin"))
    for name in ("cjk", "cyrillic", "arabic"):
        found = found.when(counts[name] > 0.3 * letters, F.lit(name))
    return F.when(text.isNotNull(), found.otherwise("latin"))


def distinct_words(text: Column, words: list[str]) -> Column:
    """How many of the words stand in the text as whole words, in either case, with or without a plural s."""
    own = F.array_distinct(F.transform(F.split(F.lower(text), "[^a-z]+"), lambda w: F.when(F.array_contains(F.array(*map(F.lit, words)), w), w).otherwise(F.regexp_replace(w, "s$", ""))))
    return F.size(F.array_intersect(own, F.array(*map(F.lit, words))))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def clone_targets(text: Column) -> Column:
    """owner/name of each `git clone` address."""
    return F.transform(F.regexp_extract_all(text, F.lit("git clone \\S*?://[^/\\s]+/([^/\\s]+/[^/\\s]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "\\.git$", ""))


def safe_link(url: Column) -> Column:
    """http and https addresses without credentials or control characters; null for all others."""
    host = F.try_parse_url(url, F.lit("HOST"))
    fine = url.rlike("^https?://") & host.isNotNull() & ~url.rlike("[\\x00-\\x20]") & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.when(fine, url)


def detected_script(text: Column) -> Column:
    """The writing system that prevails in a README's prose: over 30 percent of its letters, the largest of those; other for the rest beyond Latin; latin under ten letters."""
    from lodestone.functions.readers import BARE_URL, URL_SIGNS, prose

    classes = {"cjk": SCRIPTS["cjk"], "cyrillic": SCRIPTS["cyrillic"], "arabic": SCRIPTS["arabic"], "devanagari": "\\p{IsDevanagari}", "latin": "\\p{IsLatin}"}

    def letters(x: Column) -> Column:
        plain = bound(prose(without_comments(x)), lambda p: if_holds(p, ["<"], F.regexp_replace(p, "<[^>]*>", " "), p))
        plain = bound(plain, lambda p: if_holds(p, ["]("], F.regexp_replace(p, r"\]\([^)]*\)", "]"), p))
        return bound(plain, lambda p: if_holds(p, URL_SIGNS, F.regexp_replace(p, f"{BARE_URL}|\\P{{L}}+", ""), F.regexp_replace(p, "\\P{L}+", "")))

    def counts(x: Column) -> Column:
        n, ascii_only = F.char_length(x), F.char_length(x) == F.octet_length(x)
        return F.struct(n.alias("all"), *[F.when(ascii_only, n if k == "latin" else F.lit(0)).otherwise(F.char_length(F.regexp_replace(x, f"[^{v}]+", ""))).alias(k) for k, v in classes.items()])

    def name(n: Column) -> Column:
        out, most = F.when(n["all"] < 10, F.lit("latin")), F.greatest(*[n[k] for k in classes if k != "latin"])
        for k in classes:
            if k != "latin":
                out = out.when((n[k] == most) & (n[k] > 0.3 * n["all"]), F.lit(k))
        return out.when(n["all"] - n["latin"] > 0.3 * n["all"], F.lit("other")).otherwise("latin")

    return F.when(text.isNotNull(), bound(bound(letters(text), counts), name))


def softplus(z: Column) -> Column:
    """ln(1 + e^z), stable at both ends."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def log_likelihood(z: Column, positive: Column) -> Column:
    """Of one outcome under sigmoid(z); its sum is the fit's."""
    return -softplus(F.when(positive, -z).otherwise(z))


def cost(tokens_in: Column, tokens_out: Column, read: Column, written: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars of a call at prices a million tokens: what the cache took in costs 1.25 times the input price, what it gave 0.1 times."""
    fresh = F.greatest(F.lit(0), tokens_in - read - written)
    return (fresh * price_in + written * price_in * 1.25 + read * price_in * 0.1 + tokens_out * price_out) / 1e6


def week_start(week: Column) -> Column:
    """The Monday of an ISO week such as 2026-W37; null for a week that its year doesn't have."""
    year, n = F.substring(week, 1, 4).try_cast("int"), F.substring(week, 7, 2).try_cast("int")
    monday = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (n - 1) * 7)
    return F.when(week.rlike(r"^\d{4}-W\d{2}$") & (iso_week(monday) == week), monday)


def shifted_week(week: Column, weeks: int) -> Column:
    return iso_week(F.date_add(week_start(week), 7 * weeks))


def size_text(n: Column) -> Column:
    """Bytes as people read them: one decimal from 1024 on."""
    return F.when(n >= 1_048_576, F.format_string("%.1f MB", n / 1_048_576)).when(n >= 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%d bytes", n))


def clipped(text: Column, most: int) -> Column:
    """Cut to so many characters, the last of them an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", "-")


def package_key(name: Column) -> Column:
    """A Python package's name, as its index compares it."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def crate_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit("-"))


def safe_segment(name: Column) -> Column:
    """A path segment that any file system takes: lower case, odd characters as _, dots at the ends as %2E, device names escaped."""
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9._-]", "_")
    dots = lambda at: F.repeat(F.lit("%2E"), F.length(F.regexp_extract(plain, at, 0)))
    inner = F.regexp_replace(plain, r"^\.+|\.+$", "")
    ended = F.when(inner == "", dots(r"^\.*")).otherwise(F.concat(dots(r"^\.*"), inner, dots(r"\.*$")))
    device = F.substring_index(ended, ".", 1).rlike(r"^(con|prn|aux|nul|com[0-9]|lpt[0-9])$")
    return F.when(device, F.concat(F.lit("%"), F.hex(F.ascii(ended)), F.substring(ended, 2, 1_000_000))).otherwise(ended)


def escaped(text: Column) -> Column:
    """Text for markup: the five marks as entities, control and direction characters dropped."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{202A}-\x{202E}\x{2066}-\x{2069}]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def redacted(text: Column) -> Column:
    """Text without what looks like an access token (fixed values: the shapes of keys)."""
    return F.regexp_replace(F.regexp_replace(text, "sk-[A-Za-z0-9_-]{16,}", "[redacted]"), "gh[pousr]_[A-Za-z0-9]{20,}", "[redacted]")


def stable_json(fields: dict[str, Column]) -> Column:
    """A JSON object with its fields in order of name, nulls among them."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(v.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array(*parts), lambda p: F.regexp_replace(p, ":$", ":null")), ","), F.lit("}"))
