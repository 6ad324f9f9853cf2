"""Scalar column functions of the domain: codes, tokens, hashes, numbers, dates, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_literal(text: Column) -> Column:
    """A Python-style list of code tokens as an array."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")


def token_code(token: Column) -> Column:
    return F.substring_index(token, "_@_", 1)


def token_value(token: Column) -> Column:
    """The value of a code_@_value token; null for a bare code."""
    return F.when(F.instr(token, "_@_") > 0, F.substring_index(token, "_@_", -1))


def age_band(age: Column) -> Column:
    """Decade of age, 0 to 9; negative ages count as 0."""
    return F.greatest(F.least(F.floor(age / 10), F.lit(9)), F.lit(0))


def hash_number(*parts: Column) -> Column:
    """The first 8 hex digits of a SHA-256 over the joined parts, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def full_hash_modulo(text: Column, modulus: int) -> Column:
    """All 256 bits of a SHA-256 modulo a small number, folded digit by digit."""
    digits = F.split(F.sha2(text, 256), "")
    digit = lambda x: F.conv(x, 16, 10).cast("long")
    return F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: (acc * 16 + digit(x)) % modulus)


def plain_id(text: Column) -> Column:
    """An id without a trailing .0 and outer blanks; empty becomes null."""
    return F.nullif(F.regexp_replace(F.trim(text), r"\.0$", ""), F.lit(""))


def plain_code(text: Column) -> Column:
    """A code in capitals without dots and blanks."""
    return F.upper(F.regexp_replace(text, r"[.\s]", ""))


def timestamp_of(text: Column) -> Column:
    """The first 19 characters as a time; blank or malformed is null."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", b, a) / 3.6e9


def finite(text: Column) -> Column:
    """A finite number, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def censored(text: Column) -> Column:
    """struct(kind, bound, rank_value): `<x` ranks below and `>x`, `>=x` above every measured value, in their order."""
    sign = F.regexp_extract(text, r"^\s*(<=?|>=?)?\s*(-?\d+(?:\.\d+)?)\s*$", 1)
    bound = F.regexp_extract(text, r"^\s*(<=?|>=?)?\s*(-?\d+(?:\.\d+)?)\s*$", 2).try_cast("double")
    kind = F.when(bound.isNull(), None).when(F.startswith(sign, F.lit("<")), "BELOW").when(F.startswith(sign, F.lit(">")), "ABOVE").otherwise("EXACT")
    rank = F.when(kind == "BELOW", bound - 1e12).when(kind == "ABOVE", bound + 1e12).otherwise(bound)
    return F.struct(kind.alias("kind"), bound.alias("bound"), rank.alias("rank_value"))


def unit_name(unit: Column) -> Column:
    return F.lower(F.regexp_replace(unit, r"\s+", ""))


def frequency_range(text: Column, named: dict[str, tuple[float, float]]) -> Column:
    """struct(lo, hi) of a named frequency, a share `a/b` or a percentage."""
    names = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("lo"), F.lit(v[1]).alias("hi")))])
    a, b = (F.regexp_extract(text, r"^(\d+)/(\d+)$", k).try_cast("double") for k in (1, 2))
    percent = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)%$", 1).try_cast("double") / 100
    one = F.coalesce(F.try_divide(a, b), percent)
    return F.coalesce(F.try_element_at(names, text), F.when(one.isNotNull(), F.struct(one.alias("lo"), one.alias("hi"))))


def plain_text(text: Column) -> Column:
    """Lower case, without a closing tag in parentheses, other signs as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s*\([^()]*\)$", ""), r"[^a-z0-9]+", " "))


def stems(text: Column, stop: list[str]) -> Column:
    """Words without stop words and a plural or -ing ending, in order, without repeats."""
    words = F.filter(F.split(plain_text(text), " "), lambda w: (w != "") & ~w.isin(stop))
    return F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, r"(ing|es|s)$", "")).otherwise(w)))


def spelling_variants(text: Column) -> Column:
    return F.array_distinct(F.array(text, F.replace(text, F.lit("-"), F.lit(" ")), F.replace(text, F.lit(" "), F.lit("")), F.regexp_replace(text, "ae", "e"), F.regexp_replace(text, "our", "or")))


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text has none."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's elements that b has; 0 for an empty a."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a).cast("double")), F.lit(0.0))


def set_token_match(a: Column, b: Column) -> Column:
    """Two shared tokens, or one set inside the other."""
    shared = F.size(F.array_intersect(a, b))
    return (shared >= 2) | ((shared > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)))


def quoted_in(quote: Column, body: Column) -> Column:
    """Whether every part of a quote, cut at `...`, stands in the body."""
    parts = F.filter(F.transform(F.split(quote, r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda p: F.instr(body, p) > 0)


def severity(text: Column) -> Column:
    """The latest of one or more grades `a/10` as a share."""
    last = F.element_at(F.split(text, "→"), -1)
    return F.regexp_extract(last, r"(\d+(?:\.\d+)?)\s*/\s*10", 1).try_cast("double") / 10


def personal_data_flags(text: Column) -> Column:
    """Names of the kinds of personal data that a text seems to hold."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\b\d{2,3}-\d{3,4}-\d{4}\b", "url": r"https?://", "national_id": r"\b\d{6}-[1-4]\d{6}\b"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]))


def parsed_list(text: Column) -> Column:
    """Parts between commas, semicolons, slashes or line ends, trimmed, without repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,;/\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def withheld_percent(k: Column, n: Column, least: int = 10) -> Column:
    """A percentage with one decimal (ties to even), or WITHHELD for small groups."""
    return F.when(n >= least, F.format_string("%.1f%%", F.bround(100.0 * k / n, 1))).otherwise(F.lit("WITHHELD"))


def month_grid(day: Column) -> Column:
    """The days of the weeks (Sunday first) that a day's month touches."""
    first, last = F.trunc(day, "month"), F.last_day(day)
    start = F.date_sub(first, F.dayofweek(first) - 1)
    return F.sequence(start, F.date_add(last, 7 - F.dayofweek(last)))


# Korean particles that may end a noun, and words that make a sentence strong or permissive.
PARTICLES = ("으로는", "으로", "에서", "에게", "까지", "부터", "이라고", "라고", "이나", "인지", "이며", "이고", "이란", "이라", "하고", "과", "와", "이", "가", "을", "를", "은", "는", "도", "의", "에", "로", "만", "일")
STRONG = (r"\bmust\b", r"\bshould\b", r"\brequire[sd]?\b", r"\brecommend\w*", r"\bindicated\b", r"\bmandatory\b", r"\bnecessary\b", r"\bessential\b", r"\bpreferred\b", r"\bfirst-line\b", r"\bwarrant\w*", r"\bperform\w*")
PERMISSIVE = (r"\bcan\b", r"\bmay\b", r"\bcould\b", r"\bmight\b", r"\badvocated\b", r"\bsuggested\b", r"\bconsider(?:ed)?\b", r"\boption(?:al)?\b")


def without_particles(text: Column, particles: tuple[str, ...] = PARTICLES, times: int = 2) -> Column:
    """A word without blanks and without up to `times` particles at its end; a particle that is the whole word stays."""
    out = F.regexp_replace(text, r"\s+", "")
    for _ in range(times):
        short = F.regexp_replace(out, f"({'|'.join(particles)})$", "")
        out = F.when(F.length(short) >= 1, short).otherwise(out)
    return out


def wording(text: Column, strong: tuple[str, ...] = STRONG, permissive: tuple[str, ...] = PERMISSIVE) -> Column:
    """(strength, markers): MIXED, STRONG, PERMISSIVE or UNMARKED, and the distinct words that tell it, the strong ones first; null text is unmarked."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda patterns: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in patterns]))))
    s, p = found(strong), found(permissive)
    kind = F.when((F.size(s) > 0) & (F.size(p) > 0), "MIXED").when(F.size(s) > 0, "STRONG").when(F.size(p) > 0, "PERMISSIVE").otherwise("UNMARKED")
    return F.struct(kind.alias("strength"), F.concat(s, p).alias("markers"))


def audit_decision(grades: Column, final_class: Column, agreed: tuple[str, ...] = ("G2_SILVER_AGREED", "G3_SILVER_AUDITED")) -> Column:
    """What becomes of a concept: one without an agreed grade is rejected or held, any other goes by its final class A to F."""
    sure = F.arrays_overlap(grades, F.array(*map(F.lit, agreed)))
    out = F.when(~sure & F.array_contains(grades, "REJECTED"), "REJECTED").when(~sure, "HELD")
    return out.when(final_class == "D", "KEEP_NEW_CANDIDATE").when(final_class.isin("A", "B", "C"), "MERGE_AS_EXISTING_RELATION").when(final_class == "E", "REJECTED").otherwise("HELD")
