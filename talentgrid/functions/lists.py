"""Column expressions on arrays of skills. No UDFs: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import fixed_values as V

STRINGS = "array<string>"
#: every character that ``\\s`` matches under ``(?U)``
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a variable.

    Expressions captured by a lambda are otherwise re-evaluated for every array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let(value: Column, schema: str, body) -> Column:
    """As ``bind`` for a result of the type ``schema`` that is passed on as it is; ``bind`` copies its result, which
    makes folds over growing lists quadratic."""
    return F.aggregate(F.array(value), F.lit(None).cast(schema), lambda _, v: body(v))


def strings(values) -> Column:
    """Literal string array."""
    return F.array(*[F.lit(v) for v in values]).cast(STRINGS)


def string_map(mapping: dict[str, str]) -> Column:
    """Literal string map."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def strip(text) -> Column:
    """Text without white space of any kind at its ends."""
    return F.trim(text, F.lit(WHITE))


def parse_list_literal(text: Column) -> Column:
    """A list or tuple literal, ``"['a', 'b']"``, to an array of its strings.

    Items are quoted strings with escapes, None or numbers, with an optional comma at the end; None becomes a
    null item and a number its text. Null, blank and any other text gives an empty array.
    """
    quoted = r"""'(?:[^'\\\\]|\\\\.)*'|"(?:[^"\\\\]|\\\\.)*\"""".replace("\\\\", "\\")
    item = f"(?:{quoted}|None|True|False|[-+]?[0-9.]+)"
    whole = rf"(?s)^\s*[\[(]\s*(?:{item}\s*(?:,\s*{item}\s*)*,?\s*)?[\])]\s*$"
    items = F.regexp_extract_all(text, F.lit(f"(?s){item}"), F.lit(0))

    def plain(s: Column) -> Column:
        body = F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
        body = F.regexp_replace(F.regexp_replace(body, r"\\'", "'"), r'(?<!\\)"', r'\\"')
        unescaped = F.get_json_object(F.concat(F.lit('{"v":"'), body, F.lit('"}')), "$.v")
        return F.when(s.rlike("^['\"]"), F.coalesce(unescaped, body)).when(s != "None", s)

    return F.when(F.coalesce(text.rlike(whole), F.lit(False)), F.transform(items, plain)).otherwise(empty_strings())


def parse_delimited(text: Column, sep: str = ",", lower: bool = False) -> Column:
    """Split on a literal separator, trim, drop blanks; null gives an empty array."""
    parts = F.transform(F.split(text, "\\Q" + sep + "\\E"), lambda s: strip(s))
    if lower:
        parts = F.transform(parts, F.lower)
    return F.coalesce(F.filter(parts, lambda s: s != ""), empty_strings())


def dedup_ignoring_case(arr: Column) -> Column:
    """Keep the first spelling of each case-insensitive value, in order."""
    return bind(arr, lambda a: bind(
        F.transform(a, F.lower),
        lambda keys: F.filter(a, lambda s, i: F.array_position(keys, F.lower(s)) == i + 1),
    ))


def flatten_lower(arr: Column) -> Column:
    """Lowercase, trim, drop blanks and repeated values, keeping order."""
    low = F.filter(F.transform(arr, lambda s: strip(F.lower(s))), lambda s: s != "")
    return F.array_distinct(low)


def clean_skill_list(arr: Column, two_char_rule: bool = True) -> Column:
    """Drop noise words (case-sensitive) and invalid short skills, then de-duplicate ignoring case.

    ``two_char_rule=False`` is the notebook variant that only checks one-character skills.
    """
    short_upper = [v.upper() for v in V.VALID_SHORT_SKILLS]

    def keep(s: Column) -> Column:
        ok = (s != "") & ~s.isin(V.NOISY_SKILLS)
        ok = ok & ((F.length(s) != 1) | s.isin(V.VALID_SHORT_SKILLS))
        if two_char_rule:
            ok = ok & ((F.length(s) != 2) | F.upper(s).isin(short_upper))
        return ok

    trimmed = F.transform(arr, lambda s: strip(s))
    return dedup_ignoring_case(F.filter(trimmed, keep))


def map_then_stop(arr: Column, synonyms: dict[str, str], stops) -> Column:
    """Lowercase and trim, map synonyms, then remove stop skills (vocabulary builder order)."""
    m = string_map(synonyms)
    low = F.transform(arr, lambda s: strip(F.lower(s)))
    mapped = F.transform(low, lambda s: F.coalesce(F.try_element_at(m, s), s))
    return F.filter(mapped, lambda s: ~s.isin(list(stops)))


def stop_then_map(arr: Column, synonyms: dict[str, str], stops) -> Column:
    """Clean tokens, remove stop skills and one-character tokens, then map synonyms."""
    m = string_map(synonyms)
    clean = F.transform(arr, lambda s: F.regexp_replace(F.lower(strip(s)), r"\s+", " "))
    kept = F.filter(clean, lambda s: ~s.isin(list(stops)) & (F.length(s) >= 2))
    return F.transform(kept, lambda s: F.coalesce(F.try_element_at(m, s), s))


def wide_columns_to_list(columns: list[Column]) -> Column:
    """Collect several nullable text columns into one lowercase, trimmed list."""
    low = F.transform(F.array(*columns), lambda s: F.lower(strip(s)))
    return F.filter(low, lambda s: s.isNotNull() & (s != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b|, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def precision(demand: Column, course: Column) -> Column:
    """Share of the course's skills that are demanded, 0 for a course without skills."""
    n = F.size(F.array_distinct(course))
    return F.when(n > 0, F.size(F.array_intersect(demand, course)) / n).otherwise(F.lit(0.0))


def weighted_coverage(demand: Column, course: Column, weight_of) -> Column:
    """Weight of covered demanded skills over the weight of all demanded skills.

    ``weight_of`` maps a skill Column to its weight Column.
    """
    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + weight_of(s))

    den = total(F.array_distinct(demand))
    return F.when(den > 0, total(F.array_intersect(demand, course)) / den).otherwise(F.lit(0.0))


def first_with_more(arr: Column, n: int = 6) -> Column:
    """First ``n`` values joined with ``, `` and a ``+k more`` label for the rest."""
    head = F.array_join(F.slice(arr, 1, n), ", ")
    more = F.concat(head, F.lit(" +"), (F.size(arr) - n).cast("string"), F.lit(" more"))
    return F.when(F.size(arr) > n, more).otherwise(head)


def last_joined(arr: Column, n: int = 3, sep: str = " → ", default: str = "unknown") -> Column:
    """Last ``n`` values in order, joined; ``default`` for an empty list."""
    tail = F.when(F.size(arr) > n, F.slice(arr, -n, n)).otherwise(arr)
    return F.when(F.size(arr) > 0, F.array_join(tail, sep)).otherwise(F.lit(default))


def flat_skill_names(text: Column) -> Column:
    """JSON list of strings or ``{surface | normalized_guess}`` objects to a list of names."""
    items = F.coalesce(F.from_json(text, STRINGS), empty_strings())

    def name(item: Column) -> Column:
        surface = F.get_json_object(item, "$.surface")
        guess = F.get_json_object(item, "$.normalized_guess")
        from_object = F.coalesce(F.nullif(surface, F.lit("")), guess, F.lit(""))
        return F.when(item.startswith("{"), from_object).otherwise(item)

    return F.filter(F.transform(items, name), lambda s: s != "")


def multi_hot(vocab: Column, owned: Column) -> Column:
    """Dense 0/1 vector over an ordered vocabulary array."""
    return F.transform(vocab, lambda s: F.array_contains(owned, s).cast("int"))


def pair_by_position(left: Column, right: Column, left_name: str, right_name: str) -> Column:
    """i-th left value with i-th right value; the shorter side is filled with ''."""
    zipped = F.arrays_zip(left.alias(left_name), right.alias(right_name))
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.coalesce(z[left_name], F.lit("")).alias(left_name),
            F.coalesce(z[right_name], F.lit("")).alias(right_name),
        ),
    )
