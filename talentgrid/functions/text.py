"""Text rules as Column expressions: normalising, validity tests, contact and header fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import fixed_values as V
from talentgrid.functions.lists import bind, dedup_ignoring_case, string_map, strings, strip

# Word boundaries, \w and \s are meant Unicode-aware; (?U) makes Java's so on every JDK.
UNICODE = "(?U)"


def rlike(c: Column, pattern: str) -> Column:
    return c.rlike(UNICODE + pattern)


def led(pattern: str, first: str) -> str:
    """The same pattern, tried only where a character of the class ``first`` stands: all its matches start with one."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return f"{flags}(?=[{first}])(?:{pattern[len(flags):]})"


PHONE = led(V.PHONE, r"+(\d")
DATE_WORD = led(V.DATE_WORD, "12jfmasond")
DURATION = led(V.DURATION, "12pnctasbym")
MONTH_RANGE = led(V.MONTH_RANGE, "jfmasond")
YEAR_RANGE = led(V.YEAR_RANGE, r"\d")
YEAR_ANY = led(V.YEAR_ANY, "12")
YEAR_2000S = led(V.YEAR_2000S, "2")
EXPLICIT_YEARS = led(V.EXPLICIT_YEARS, r"\d")
JOB_TITLE_LINE = led(V.JOB_TITLE_LINE, "iedptcma")
GRADE_WORD = led(V.GRADE_WORD, "gcpsm")
WORK_WORDS = (led(r"\b(work|professional|employment|career)\b", "wpec"), led(r"\b(experience|experiences|history)\b", "eh"))
EDUCATION_WORDS = led(r"\b(education|academic|qualification|degree|training|school|university)\b", "eaqdtsu")
MISC_WORDS = led(r"\b(projects?|achievements?|awards?|honors?|certifications?)\b", "pahc")
_ENDS = ("\n", "\r", "\x85", "\u2028", "\u2029")  # ``$`` matches before the last of these, too


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern`` ('' when none)."""
    return F.regexp_extract(c, UNICODE + pattern, group)


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(UNICODE + pattern), F.lit(group))


def contains_any(c: Column, words) -> Column:
    """True when the text contains one of a short fixed list of substrings."""
    return bind(c, lambda v: F.exists(strings(words), lambda w: F.contains(v, w)))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


# --- normalising ----------------------------------------------------------------

def norm_text(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def clean_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\s+", " ")


def squeeze(c: Column) -> Column:
    """Collapse any whitespace, including no-break spaces, to single blanks and trim."""
    return strip(F.regexp_replace(c, "[\\s\xa0]{2,}|[\\s\xa0&&[^ ]]", " "))


def strip_any(c: Column, chars_class: str) -> Column:
    """Strip characters of a regex class from both ends."""
    if chars_class == r"\s":
        chars = "\t\n\x0b\f\r "
    else:
        chars = chars_class.replace("\\", "")
    ends = [e for e in _ENDS if e not in chars]

    def cut(v: Column) -> Column:
        ended = F.lit(False)
        for e in ends:
            ended = ended | F.endswith(v, F.lit(e))
        return F.when(ended, F.regexp_replace(v, f"^[{chars_class}]+|[{chars_class}]+$", "")).otherwise(F.trim(v, F.lit(chars)))

    return bind(c, cut)


def edge_trim(c: Column, chars: str) -> Column:
    """As ``strip_any`` for text that ends with no line terminator, by the characters themselves."""
    return F.trim(c, F.lit(chars))


def clean_document(c: Column) -> Column:
    """CRLF to LF, runs of blanks to one, three or more newlines to two, blanks before newline cut."""
    t = F.regexp_replace(c, "\r\n", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[^\S\n]+\n", "\n")
    return strip_any(t, r"\s")


def null_sentinels(c: Column) -> Column:
    """``undefined``, ``nan``, ``none`` and blank attribute text become null."""
    return F.when(~F.lower(strip(c)).isin(V.NULL_WORDS), c)


def role_is_usable(c: Column) -> Column:
    t = F.lower(strip(c))
    return c.isNotNull() & (t != "undefined") & (t != "")


def role_file_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[\\/]", "_")


def label_title(c: Column) -> Column:
    """``ONE_TO_THREE`` to ``One To Three``."""
    return F.initcap(F.lower(F.translate(c, "_", " ")))


def employment_bucket(c: Column) -> Column:
    up = F.upper(c)
    return (
        F.when(F.contains(up, F.lit("FULL")), "full_time")
        .when(F.contains(up, F.lit("CONTRACT")), "contract").otherwise("other")
    )


# --- validity predicates ----------------------------------------------------------

def is_garbage(c: Column) -> Column:
    return c.isNull() | (c == "") | F.lower(strip(c)).isin(V.GARBAGE_WORDS)


def is_valid_skill(c: Column) -> Column:
    """Letter required, 2..30 characters, short allow-list, no dangling bracket, ≥ 60 % plain
    characters, not block-listed, not an e-mail or URL."""
    s = strip(c)
    n = F.length(s)
    plain = F.length(F.regexp_replace(s, r"[^\p{L}\p{N}\-+#./_ ]", ""))
    return (
        s.rlike("[a-zA-Z]") & (n > 1) & (n <= 30)
        & ((n != 2) | F.lower(s).isin(V.SHORT_SKILLS_2))
        & ~s.rlike(r"[({\[<\"'/)\]>}]$")
        & (plain / n >= 0.6)
        & ~F.lower(s).isin(V.SKILL_BLOCKLIST)
        & ~rlike(s, r"(?i)^[\w.+-]+@|^https?://|^www\.")
    )


def is_valid_company(c: Column) -> Column:
    """At least 3 characters with a letter, capital first; single words need 5 characters or be a
    capital abbreviation, and must not be block-listed."""
    s = strip(c)
    single = ~s.rlike(r"\s")
    capitals = (F.upper(s) == s) & (F.lower(s) != s)
    listed = F.lower(s).isin(V.COMPANY_BLOCKLIST)
    single_ok = (capitals | (F.length(s) >= 5)) & ~listed
    return (
        (F.length(s) >= 3) & s.rlike("[a-zA-Z]") & s.rlike(r"^\p{Lu}") & (~single | single_ok)
    )


def is_valid_duration(c: Column) -> Column:
    return rlike(c, DURATION)


def is_valid_designation(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) >= 3) & ~F.lower(s).isin(V.DESIGNATION_BLOCKLIST)


def is_valid_name(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) >= 3) & ~s.rlike("^(http|www)") & ~F.lower(s).isin(V.NAME_BLOCKLIST)


def is_valid_location(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) >= 3) & ~F.lower(s).isin(V.LOCATION_BLOCKLIST)


def is_valid_degree(c: Column) -> Column:
    s = strip(c)
    coded = (F.length(s) >= 3) & F.upper(F.substring(s, 1, 2)).isin("S1", "S2", "S3", "D3", "D4")
    return s.rlike(r"\S\s+\S") | coded


# --- contact and header fields ------------------------------------------------------

def email(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), first_match(c, V.EMAIL)).otherwise(F.when(c.isNotNull(), ""))


def phone(c: Column, min_digits: int = 7) -> Column:
    """First phone-like text if it holds enough digits, else ''."""
    p = strip(first_match(c, PHONE))
    digits = F.length(F.regexp_replace(p, r"\D", ""))
    return F.when(digits >= min_digits, p).otherwise(F.lit(""))


def header_name(text: Column, first_lines: int = 10, min_words: int = 2,
                block: bool = True) -> Column:
    """First of the leading lines that looks like a person name ('' when none)."""
    def ok(line: Column) -> Column:
        good = line.rlike(V.PERSON_NAME) & (F.size(F.split(line, r"\s+")) >= min_words)
        return good & ~F.lower(line).isin(V.NAME_BLOCKLIST) if block else good

    head = F.transform(F.slice(lines(text), 1, first_lines), lambda s: strip_any(s, r"\s"))
    return F.coalesce(F.get(F.filter(head, ok), F.lit(0)), F.lit(""))


def header_location(text: Column, first_lines: int = 5) -> Column:
    """First leading line holding ``City, Region``; the whole line is the location."""
    head = F.transform(F.slice(lines(text), 1, first_lines), lambda s: strip_any(s, r"\s"))
    hits = F.filter(
        head,
        lambda s: rlike(s, V.CITY_REGION)
        & ~F.lower(first_match(s, V.CITY_REGION, 1)).isin(V.NAME_BLOCKLIST),
    )
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(""))


def name_from_file(c: Column) -> Column:
    """Person name from a file name: prefix words, years, digits and symbols removed; 2–4 words."""
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    s = F.regexp_replace(stem, r"(?i)^(?:cv|resume|resum[eé]|curriculum(?:[\s_-]*vitae)?)[:\s_-]*", "")
    s = F.translate(s, "_-", "  ")
    s = F.regexp_replace(s, UNICODE + r"(?i)\b(?:final|draft|updated|latest|candidate|profile)\b", " ")
    s = F.regexp_replace(s, UNICODE + r"\b(?:19|20)\d{2}\b", " ")
    s = F.regexp_replace(s, UNICODE + r"\b\d+(?:[.,]\d+)?(?:/\d+(?:[.,]\d+)?)?\b", " ")
    s = F.regexp_replace(s, r"[^A-Za-z\s'.]", " ")
    words = F.filter(
        F.split(s, r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(V.FILE_PREFIXES)
    )
    picked = F.slice(F.filter(words, lambda w: F.length(w) > 1), 1, 4)
    named = F.transform(
        picked, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    )
    return F.when((F.size(words) >= 2) & (F.size(picked) >= 2), F.array_join(named, " "))


def experience_years(text: Column, reference_year: int) -> Column:
    """Largest explicit "N years/tahun" under 50, else 0.8 × span since the first 20xx year."""
    explicit = F.filter(
        F.transform(all_matches(text, EXPLICIT_YEARS, 1), lambda v: v.cast("double")),
        lambda v: v < 50,
    )

    def spanned(years: Column) -> Column:
        delta = F.lit(reference_year) - F.array_min(years)
        good = (F.size(years) >= 2) & (delta > 0) & (delta <= 40)
        return F.when(good, F.bround(delta * 0.8, 1)).otherwise(F.lit(0.0))

    years = F.transform(all_matches(text, YEAR_2000S, 1), lambda v: v.cast("int"))
    return F.coalesce(F.array_max(explicit), bind(years, spanned))


# --- skill text ------------------------------------------------------------------------

def known_skills_in(text: Column, skills=None) -> Column:
    """Fixed skills that occur as substrings of the lowercased text, in list order."""
    known = strings(skills or V.KNOWN_SKILLS)
    return bind(F.lower(text), lambda low: F.filter(known, lambda s: F.contains(low, s)))


def normalize_surface(c: Column, rules: dict[str, str] | None = None) -> Column:
    """Strip edge punctuation (keeping ``#+.-/``), lower; headers, degrees and numbers give ''."""
    s = F.regexp_replace(strip(c), r"^[^a-zA-Z0-9#+.\-]+", "")
    s = F.regexp_replace(s, r"[^a-zA-Z0-9#+.\-/]+$", "")
    s = strip(F.regexp_replace(F.lower(s), r"\s+", " "))
    m = string_map(V.SYNONYMS if rules is None else rules)

    def finish(s: Column) -> Column:
        degree = s.rlike(r"(?i)^[bmd][a-z.]?\.(sc|s|eng|tech|a|com|ed|arch|pharm)\.?$")
        dropped = (F.length(s) < 2) | s.rlike(r"^\d+$") | s.isin(V.SURFACE_BLOCKLIST) | degree
        return F.when(dropped, "").otherwise(F.coalesce(F.try_element_at(m, s), s))

    return bind(s, finish)


def split_surface(c: Column) -> Column:
    """A multi-skill span split at delimiters into structs (surface, normalized)."""
    parts = F.filter(
        F.transform(F.split(c, V.SURFACE_DELIMITERS), lambda s: strip_any(s, r"\s")),
        lambda s: s != "",
    )
    pairs = F.transform(
        parts, lambda s: F.struct(s.alias("surface"), normalize_surface(s).alias("normalized"))
    )
    return F.filter(pairs, lambda p: F.length(p["normalized"]) >= 2)


def skill_candidates(text: Column, among: Column | None = None) -> Column:
    """Known skills found anywhere (longest first), then delimiter-cut tokens that are known or
    look like a capital abbreviation.

    ``among``: the known skills of a longer text that holds this one, so that no others are sought."""
    tokens = F.transform(
        F.split(text, r"[\n,;|/•*\-]+"), lambda s: edge_trim(squeeze(s), " .,:;()[]{}")
    )
    good = F.filter(
        tokens,
        lambda s: (s != "")
        & (F.lower(s).isin(V.BLOCK_KNOWN_SKILLS)
           | (s.rlike(r"^[A-Z0-9+#.-]{2,12}$") & ~F.lower(s).isin(V.FILE_PREFIXES))),
    )
    known = block_skills_in(text) if among is None else bind(
        F.lower(text), lambda low: F.filter(among, lambda s: F.contains(low, s)))
    return F.concat(known, F.transform(good, F.lower))


def block_skills_in(text: Column) -> Column:
    """Known skills of the block parser that occur in the lowercased text, longest first."""
    return known_skills_in(text, sorted(V.BLOCK_KNOWN_SKILLS, key=lambda s: (-len(s), s)))


def sanitize_skills(arr: Column) -> Column:
    """Drop stop tokens, numbers, dates and grade words; de-duplicate ignoring case."""
    cand = F.transform(arr, lambda s: edge_trim(squeeze(s), " .,:;()[]{}"))
    kept = F.filter(
        cand,
        lambda s: (s != "") & ~F.lower(s).isin(V.STOP_SKILL_TOKENS)
        & ~s.rlike(V.NUMERIC_ONLY) & ~s.rlike(V.DATE_TOKEN)
        & ~rlike(s, GRADE_WORD) & ~rlike(s, DATE_WORD)
        & ~F.lower(s).isin(V.GRADE_WORDS),
    )
    return dedup_ignoring_case(kept)


def expand_fragment(fragment: Column, text: Column, max_extra: int = 15) -> Column:
    """Grow the first occurrence of a fragment to whole words, unless it grows too much."""
    def grow(frag: Column, pos: Column) -> Column:
        before = F.regexp_extract(F.substring(text, F.lit(1), pos - 1), r"([\p{L}\p{N}]*)$", 1)
        after = F.regexp_extract(
            F.substring(text, pos + F.length(frag), F.length(text)), r"^([\p{L}\p{N}]*)", 1
        )
        grown = strip(F.concat(before, F.substring(text, pos, F.length(frag)), after))
        return bind(grown, lambda g: F.when(
            (frag == "") | (pos == 0) | (F.length(g) > F.length(frag) + max_extra), frag
        ).otherwise(g))

    def locate(frag: Column) -> Column:
        exact = F.position(frag, text)
        return F.when(exact > 0, exact).otherwise(F.position(F.lower(frag), F.lower(text)))

    return bind(strip(fragment), lambda f: bind(locate(f), lambda pos: grow(f, pos)))


# --- header lines -------------------------------------------------------------------------

_NAME_PART = "[A-Za-z][A-Za-z.'-]*[\x85\u2028\u2029]?"
NAME_WORDS = f"^{_NAME_PART}(?: {_NAME_PART}){{1,4}}$"


def is_name_candidate(line: Column) -> Column:
    """2–5 alphabetic words, nearly all capitalised, no contact data, dates or section words."""
    def check(s: Column) -> Column:
        words = F.split(s, " ")
        caps = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
        # letters only: neither an e-mail address nor a phone number
        return (
            s.rlike(NAME_WORDS) & (caps >= F.greatest(F.lit(2), F.size(words) - 1))
            & ~contains_any(F.lower(s), V.NAME_STOP_WORDS) & ~rlike(s, DATE_WORD)
        )

    return bind(edge_trim(squeeze(line), " :,-"), check)


def header_line_class(line: Column, generic: Column | bool = True) -> Column:
    """Section a header line opens: personal, skills, work, education, misc; null for body lines."""
    return bind(squeeze(line), lambda s: header_class(s, generic))


def header_class(line: Column, generic: Column | bool = True) -> Column:
    """As ``header_line_class`` for a squeezed line."""
    generic = F.lit(generic) if isinstance(generic, bool) else generic

    def classify(s: Column) -> Column:
        def by_words(n: Column) -> Column:
            work_words = rlike(s, WORK_WORDS[0]) & rlike(s, WORK_WORDS[1])
            # the last test costs most and few lines reach it
            capital = line.rlike(V.CAPITAL_HEADER) & (n <= 6) & generic
            return (
                F.when(s.isin(V.PERSONAL_HEADERS), "personal")
                .when(s.isin(V.SKILLS_HEADERS), "skills")
                .when(s.isin(V.WORK_HEADERS) | ((n <= 5) & work_words), "work")
                .when(s.isin(V.EDUCATION_HEADERS) | ((n <= 5) & rlike(s, EDUCATION_WORDS)), "education")
                .when(s.isin(V.NEUTRAL_HEADERS) | rlike(s, MISC_WORDS) | capital, "misc"))

        return F.when(s != "", bind(F.size(F.split(s, " ")), by_words))

    return bind(edge_trim(F.lower(line), " :.-"), classify)


def is_contact(line: Column) -> Column:
    """An e-mail address or a phone number stands in the line."""
    return (F.contains(line, F.lit("@")) & rlike(line, V.EMAIL)) | line.rlike(PHONE)


def looks_like_work(line: Column) -> Column:
    return contains_any(F.lower(line), V.WORK_MARKERS)


def looks_like_education(line: Column) -> Column:
    return contains_any(F.lower(line), V.EDUCATION_MARKERS)


def looks_like_summary(line: Column) -> Column:
    s = squeeze(line)
    return (
        (F.size(F.split(s, " ")) >= 8) & ~is_contact(s) & ~rlike(s, DATE_WORD) & header_line_class(s, False).isNull()
    )


def language_scores(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """Per language: how many distinct stop words occur; struct array sorted best first."""
    toks = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    return bind(toks, lambda words_of_text: F.array(*[
        F.struct(
            F.size(F.array_intersect(words_of_text, strings(words))).alias("score"),
            F.lit(code).alias("lang"),
        )
        for code, words in stop_words.items()
    ]))


def detect_language(text: Column, stop_words: dict[str, list[str]]) -> Column:
    """Language with the most distinct stop words (ties: later code); blank text is ``unknown``."""
    best = bind(
        F.array_max(language_scores(text, stop_words)),
        lambda b: F.when(b["score"] > 0, b["lang"]).otherwise("unknown"),
    )
    return F.when(text.isNull() | (strip(text) == ""), "unknown").otherwise(best)


