"""Text functions as Columns; each has a DuckDB counterpart in *_sql for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and code patterns, stop words, field labels, directives and topics from outside. RE2 and Java read
# those without possessive quantifiers alike.
TOKEN = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.\p{L}{2,}|[0-9]{1,4}(?:[-/][0-9]{1,2}){1,2}|[0-9]+(?:\.[0-9]+)?%?|[\x{0980}-\x{09ff}]+|\p{L}+"
CODE = r"(?:^|[^\p{L}\p{N}_])([a-z]{2,12})\s*-?\s*([0-9]{2,4})(?:\s*\(\s*([a-z0-9]+)\s*\))?"
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to was what when where which who why with".split()
COURSE_CODE = r"(?:^|[^A-Za-z0-9])([A-Za-z]{2,12}(?:\s*\(\s*[A-Za-z]{2,12}\s*\))?\s*[- ]?\s*[0-9]{2,4}(?:\s*\([A-Za-z0-9]{1,4}\))?)(?:$|[^A-Za-z0-9])"
FIELD_PATTERNS = {
    "attendance": r"\battendance\b",
    "course_code": r"\bcourse\s+(?:code|no\.?)(?:$|[^a-z0-9_])|" + COURSE_CODE,
    "course_title": r"\bcourse\s+title\b",
    "credits": r"\bcredits?\b|\bcredit\s+value\b",
    "date": r"\b(?:19|20)[0-9]{2}\b|\b[0-9]{1,2}[/-][0-9]{1,2}[/-](?:[0-9]{2}|[0-9]{4})\b",
    "email": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
    "percentage": r"[0-9]+(?:\.[0-9]+)?\s*%|\bpercentage\b",
    "policy": r"\bpolic(?:y|ies)\b|\brules?\b|\bregulations?\b",
    "prerequisite": r"\bpre\s*[- ]?\s*requisites?\b",
    "requirement": r"\brequired\b|\brequirements?\b|\bmust\b",
    "topics": r"\bcourse\s+content\b|\btopics?\b",
}
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
DASHES = "‐‑‒–—―−"
SPACES = "\u00a0\u2007\u202f"
INJECTION = (
    r"\bignore\s+(?:all\s+)?(?:the\s+)?(?:previous\s+instructions|university\s+documents?|pdf|provided\s+documents?)\b",
    r"\bdo\s+not\s+use\s+(?:the\s+)?(?:pdf|documents?|sources?)\b",
    r"\banswer\s+from\s+(?:your\s+)?own\s+knowledge\b",
)
OUT_OF_DOMAIN = (
    r"\bweather\b|\bforecast\s+(?:today|tomorrow)\b|\btemperature\s+(?:today|tomorrow)\b|\bwill\s+it\s+rain\b",
    r"\b(?:world\s+cup|football\s+match|cricket\s+match)\b.*\b(?:won|winner|score)\b|\bwho\s+won\s+(?:the\s+)?(?:world\s+cup|football\s+match|cricket\s+match|match)\b",
    r"\b(?:give|provide|need|want)\s+(?:me\s+)?(?:medical|health)\s+advice\b|\b(?:diagnose|prescribe)\s+(?:my|me)\b",
    r"\b(?:write|generate|show)\s+(?:me\s+)?(?:a\s+)?(?:python|javascript|java)\s+(?:sorting\s+)?(?:code|program|function|script)\b",
    r"\b(?:who\s+is\s+(?:the\s+)?(?:current\s+)?president|latest\s+(?:political\s+)?news|election\s+result)\b",
    r"\b(?:capital\s+of\s+france|who\s+wrote\s+hamlet|largest\s+planet)\b",
    r"\b(?:should\s+i\s+(?:break\s+up|marry|invest)|relationship\s+advice)\b",
    r"আজকের\s+আবহাওয়া|বিশ্বকাপ\s+কে\s+জিতেছে|চিকিৎসা\s+পরামর্শ",
)
IN_DOMAIN = r"\b(?:university|campus|course|syllabus|curriculum|department|semester|faculty|admission|tuition|prospectus)\b|বিশ্ববিদ্যালয়|কোর্স|সিলেবাস|বিভাগ|ভর্তি"

#: The patterns for Java: possessive where giving back can never help, which spares the scanner most of its work.
_TOKEN_JAVA = TOKEN.replace("_.+-]+@", "_.+-]++@")
#: For texts without an "@": no addresses, and words first, which are most of what there is; at one place only one of them fits.
_TOKEN_PLAIN = r"[\p{L}&&[^\x{0980}-\x{09ff}]]\p{L}*+|" + TOKEN.split("|", 1)[1].removesuffix(r"|\p{L}+")
_CODE_JAVA = CODE.replace(r"([a-z]{2,12})\s*-?\s*", r"([a-z]{2,12}+)\s*+-?\s*+")
_NOT_ASCII = r"[^\x00-\x7f]"


def folded(text: Column) -> Column:
    """Lower case with the one Latin letter whose case folding is longer; null as empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ß", "ss")


def folded_sql(text: str) -> str:
    return f"replace(lower(coalesce({text}, '')), 'ß', 'ss')"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value evaluated, and planned, once however often `of` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _icu(class_: str, method: str, text: Column) -> Column:
    """A call of the Unicode library that Spark brings; texts of ASCII alone, which it would not change, are passed by."""
    changed = lambda t: F.reflect(F.lit(f"com.ibm.icu.{class_}"), F.lit(method), F.coalesce(t, F.lit("")), F.lit(True))
    return let(text, lambda t: F.when(t.rlike(_NOT_ASCII), changed(t)).otherwise(t))


def nfkc(text: Column) -> Column:
    return _icu("text.Normalizer", "compose", text)


def casefold(text: Column) -> Column:
    """Full case folding; null stays null. Letters up to U+00FF fold as they are lowered, but for two."""
    folded_ = lambda t: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.coalesce(t, F.lit("")), F.lit(True))
    narrow = lambda t: F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))
    return F.lower(let(text, lambda t: F.when(t.rlike(r"[^\x00-\xff]"), folded_(t)).otherwise(narrow(t))))


def _plain_marks(text: Column) -> Column:
    """Bengali digits to ASCII, dashes to '-', fixed-width spaces to blanks."""
    marks = BENGALI_DIGITS + DASHES + SPACES
    changed = lambda t: F.translate(t, marks, "0123456789" + "-" * len(DASHES) + " " * len(SPACES))
    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x9f\xa1-\xff]"), changed(t)).otherwise(t))


def one_blank(text: Column) -> Column:
    """Each run of white space as one blank; those that are one blank already are passed by."""
    return F.regexp_replace(text, r"(?U)(?=[^!-~])(?: (?=\s)|(?! )\s)\s*", " ")


def normalize_unicode(text: Column) -> Column:
    """NFKC, Bengali digits to ASCII, dashes and spaces folded, white space collapsed; null as empty."""
    return F.trim(one_blank(_plain_marks(nfkc(F.coalesce(text, F.lit(""))))))


def normalize_unicode_sql(text: str) -> str:
    """For texts that NFKC does not change."""
    marks = f"translate(coalesce({text}, ''), '{BENGALI_DIGITS}{DASHES}{SPACES}', '0123456789{'-' * len(DASHES)}{' ' * len(SPACES)}')"
    return rf"trim(regexp_replace({marks}, '\s+', ' ', 'g'))"


def clean_page(text: Column) -> Column:
    """Replacement characters to '-', one kind of line end, lower-case words joined over a line end with a hyphen, blanks
    collapsed, and of blank lines between others one kept."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "�", "-")
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, r"(?U)(?<=[a-z])\s*-\s*\n\s*(?=[a-z])", "")
    out = F.regexp_replace(out, "[\t \u00a0]+", " ")
    out = F.regexp_replace(out, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def clean_page_sql(text: str) -> str:
    """For texts whose white space is ASCII."""
    out = f"regexp_replace(replace(coalesce({text}, ''), '�', '-'), '\\r\\n?', chr(10), 'g')"
    for _ in range(2):  # RE2 has no look-around: a letter that ends one join may begin the next
        out = rf"regexp_replace({out}, '([a-z])\s*-\s*\n\s*([a-z])', '\1\2', 'g')"
    out = rf"regexp_replace(regexp_replace({out}, '[\t ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _token_text(text: Column) -> Column:
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(_NOT_ASCII), casefold(_plain_marks(nfkc(t)))).otherwise(F.lower(t)))


def tokens(text: Column) -> Column:
    """Sparse tokens: addresses, dates, numbers, Bengali runs and words, then the aliases of codes such as 'abc 123 (x)'."""
    low = _token_text(text)

    def aliases_of(m: Column) -> Column:
        p, n, x = (F.regexp_extract(m, CODE, i) for i in (1, 2, 3))
        both = F.concat(p, n)
        return F.when(x != "", F.array(p, n, both, x, F.concat(both, x))).otherwise(F.array(p, n, both))

    def of(t: Column) -> Column:
        codes = F.when(t.rlike("[0-9]{2}"), F.regexp_extract_all(t, F.lit(_CODE_JAVA), F.lit(0))).otherwise(F.array().cast("array<string>"))
        found = F.when(F.contains(t, F.lit("@")), F.regexp_extract_all(t, F.lit(_TOKEN_JAVA), F.lit(0))).otherwise(F.regexp_extract_all(t, F.lit(_TOKEN_PLAIN), F.lit(0)))
        return F.concat(found, F.flatten(F.transform(codes, aliases_of)))

    return let(low, of)


def tokens_sql(text: str) -> str:
    t = folded_sql(text)
    g = lambda i: f"regexp_extract_all({t}, '{CODE}', {i})"
    return (
        f"list_concat(regexp_extract_all({t}, '{TOKEN}'), flatten(list_transform(range(1, len({g(1)}) + 1), lambda i: "
        f"CASE WHEN {g(3)}[i] <> '' THEN [{g(1)}[i], {g(2)}[i], {g(1)}[i] || {g(2)}[i], {g(3)}[i], {g(1)}[i] || {g(2)}[i] || {g(3)}[i]] "
        f"ELSE [{g(1)}[i], {g(2)}[i], {g(1)}[i] || {g(2)}[i]] END)))"
    )


def compact(text: Column) -> Column:
    """Entity key: only ASCII letters and digits, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '\\s+'), lambda w: w <> '')"


def content_tokens(text: Column) -> Column:
    """Distinct tokens of more than one character that are no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)))


def content_tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_distinct(list_filter(regexp_extract_all({folded_sql(text)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 1 AND t NOT IN ({stop})))"


def field_types(text: Column) -> Column:
    """Labels of the fields whose pattern the text has, in alphabetical order."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(k)) for k, p in sorted(FIELD_PATTERNS.items())]))


def field_types_sql(text: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(coalesce({text}, ''), '(?i){p}') THEN '{k}' END" for k, p in sorted(FIELD_PATTERNS.items()))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def script_profile(text: Column) -> Column:
    """Language by script: under 20 letters unknown, both scripts at 20 and a fifth mixed, else the larger one."""
    t = F.coalesce(text, F.lit(""))
    bengali = F.length(F.regexp_replace(t, r"[^\x{0980}-\x{09ff}]", ""))
    latin = F.length(F.regexp_replace(t, r"[^A-Za-z]", ""))
    return (
        F.when(bengali + latin < 20, "unknown")
        .when((F.least(bengali, latin) >= 20) & (F.least(bengali, latin) / F.greatest(bengali, latin) >= 0.2), "mixed")
        .when(bengali > latin, "bengali").otherwise("latin")
    )


def script_profile_sql(text: str) -> str:
    b, c = (f"length(regexp_replace(coalesce({text}, ''), '{p}', '', 'g'))" for p in (r"[^\x{0980}-\x{09ff}]", "[^A-Za-z]"))
    return (
        f"CASE WHEN {b} + {c} < 20 THEN 'unknown' WHEN least({b}, {c}) >= 20 AND least({b}, {c}) / CAST(greatest({b}, {c}) AS DOUBLE) >= 0.2e0 THEN 'mixed' "
        f"WHEN {b} > {c} THEN 'bengali' ELSE 'latin' END"
    )


def strip_directives(text: Column) -> Column:
    """The text without overt commands to pass the documents by, and without what is left at its start and end."""
    out = F.coalesce(text, F.lit(""))
    for p in INJECTION:
        out = F.regexp_replace(out, "(?i)" + p, " ")
    out = F.regexp_replace(out, r"(?i)^[\s,;:.!?-]*(?:and\s+)?", "")
    return F.regexp_replace(out, r"^[ ,;:.-]+|[ ,;:.-]+$", "")


def strip_directives_sql(text: str) -> str:
    out = f"coalesce({text}, '')"
    for p in INJECTION:
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)^[\s,;:.!?-]*(?:and\s+)?', '')"
    return f"regexp_replace({out}, '^[ ,;:.-]+|[ ,;:.-]+$', '', 'g')"


def out_of_domain(text: Column) -> Column:
    """Blank, or about a topic from outside without a word that ties it to the institution."""
    clean = strip_directives(text)
    return (clean == "") | (clean.rlike("(?i)" + "|".join(OUT_OF_DOMAIN)) & ~clean.rlike("(?i)" + IN_DOMAIN))


def out_of_domain_sql(text: str) -> str:
    clean = strip_directives_sql(text)
    return f"({clean} = '' OR regexp_matches({clean}, '(?i){'|'.join(OUT_OF_DOMAIN)}') AND NOT regexp_matches({clean}, '(?i){IN_DOMAIN}'))"


def found(text: Column, pattern: Column) -> Column:
    """Whether a pattern that is a Column itself is in the text."""
    return F.call_function("rlike", text, pattern)


def group(text: Column, pattern: Column, i: int) -> Column:
    """Group i of the first match of a pattern that is a Column itself; empty without a match."""
    return F.call_function("regexp_extract", text, pattern, F.lit(i))


def coalesce_blank(*columns: Column) -> Column:
    """The first of the columns that is not blank, trimmed."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])
