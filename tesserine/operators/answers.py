"""Answers: strategy, exact facts, extracted sections, answer-bank matches, language checks, safe responses and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import understanding as U
from . import evidence as V
from . import retrieval as R

LANGUAGES = ("english", "bangla", "banglish")

# Fixed values.
EXACT_FIELDS = "credits prerequisite percentage course_code course_title course_type email date duration semester grade attendance".split()
EXACT_INTENTS = "course_credit prerequisite course_code course_title course_type final_exam_marks".split()
LIST_FIELDS = "topic weekly_content learning_outcome".split()
LIST_INTENTS = "topics weekly_content mark_distribution clo".split()
EXPLAIN = r"\b(?:explain|describe|why|how\s+is|how\s+does|kivabe)\b|কীভাবে|কিভাবে|ব্যাখ্যা"
COUNT_OF_COURSES = (r"\b(?:how\s+many|maximum|koyta|কয়টি|কত)\b", r"\b(?:repeat(?:ed|ing)?|re[- ]?examination)\b|পুনরায়|পুনঃপরীক্ষা", r"\bcourses?\b|কোর্স")
HOW_LONG = r"\b(?:how long|duration|koto)\b|সময়কাল|কতদিন"
#: English, Bangla and Banglish; {e} the entity, {v} the value.
FACTS = {
    "credits": ("{e} carries {v} credits.", "{e} কোর্সটির ক্রেডিট {v}।", "{e} course-er credit {v}."),
    "prerequisite": ("The prerequisite for {e} is {v}.", "{e} কোর্সটির prerequisite হলো {v}।", "{e} course-er prerequisite holo {v}."),
    "percentage": ("The requested percentage for {e} is {v}%.", "{e} বিষয়টির প্রাসঙ্গিক percentage {v}%।", "{e} item-er relevant percentage {v}%."),
    "course_code": ("The course code is {v}.", "কোর্সটির code হলো {v}।", "Course-er code holo {v}."),
    "course_title": ("The course title is {v}.", "কোর্সটির title হলো {v}।", "Course-er title holo {v}."),
    "course_type": ("The course type is {v}.", "কোর্সটির type হলো {v}।", "Course-er type holo {v}."),
    "email": ("The email address is {v}.", "প্রাসঙ্গিক email address হলো {v}।", "Relevant email address holo {v}."),
    "date": ("The relevant date is {v}.", "প্রাসঙ্গিক তারিখ হলো {v}।", "Relevant date holo {v}."),
    "duration": ("The duration is {v}.", "সময়কাল হলো {v}।", "Duration holo {v}."),
    "semester": ("The semester is {v}.", "সেমিস্টারটি হলো {v}।", "Semester holo {v}."),
    "grade": ("The grade is {v}.", "প্রাসঙ্গিক grade হলো {v}।", "Relevant grade holo {v}."),
    "attendance": ("The attendance requirement is {v}.", "Attendance-এর শর্ত হলো {v}।", "Attendance-er requirement holo {v}."),
}
OTHER_FACT = ("{e}: {v}.", "{e}: {v}।", "{e} value holo {v}.")
NO_PREREQUISITE = ("{e} has no listed prerequisite.", "{e} কোর্সের কোনো পূর্বশর্ত দেওয়া নেই।", "{e} course-er kono prerequisite deya nei.")
NO_ENTITY = ("The requested item", "অনুরোধ করা বিষয়টির", "Requested item-er")
SAFE = {
    "INSUFFICIENT_EVIDENCE": ("I couldn't find enough information in the university documents to answer reliably.", "বিশ্ববিদ্যালয়ের নথিতে নির্ভরযোগ্যভাবে উত্তর দেওয়ার মতো পর্যাপ্ত তথ্য পাওয়া যায়নি।", "University document-e reliable answer deyar moto porjapto tothyo paoa jayni."),
    "RETRIEVAL_UNCERTAIN": ("I found related information, but couldn't verify that it answers this specific question.", "সম্পর্কিত তথ্য পাওয়া গেছে, কিন্তু তা এই নির্দিষ্ট প্রশ্নের উত্তর কি না নিশ্চিত করা যায়নি।", "Related tothyo paoa geche, kintu eta ei specific proshner uttor kina verify kora jayni."),
    "AMBIGUOUS_QUERY": ("Which course, document, program, or policy do you mean?", "আপনি কোন কোর্স, নথি, প্রোগ্রাম বা নীতির কথা বলছেন?", "Apni kon course, document, program, ba policy-r kotha bolchen?"),
    "CONFLICTING_EVIDENCE": ("The university documents contain conflicting information about this.", "বিশ্ববিদ্যালয়ের নথিতে এই বিষয়ে পরস্পরবিরোধী তথ্য রয়েছে।", "University document-gulote ei bishoye conflicting tothyo ache."),
    "GENERATION_REJECTED": ("Relevant information was found, but I couldn't produce a reliable answer.", "প্রাসঙ্গিক তথ্য পাওয়া গেছে, কিন্তু নির্ভরযোগ্য উত্তর তৈরি করা যায়নি।", "Relevant tothyo paoa geche, kintu reliable uttor toiri kora jayni."),
    "OUT_OF_DOMAIN": ("I can answer questions supported by the provided university documents, but not this one.", "আমি দেওয়া বিশ্ববিদ্যালয়ের নথিভিত্তিক প্রশ্নের উত্তর দিতে পারি, কিন্তু এই প্রশ্নটির নয়।", "Ami deya university document-er tothyo diye proshner uttor dite pari, kintu ei proshner noy."),
    "SYSTEM_ERROR": ("I couldn't check the university documents right now. Please try again later.", "এখন বিশ্ববিদ্যালয়ের নথি যাচাই করা যাচ্ছে না। পরে আবার চেষ্টা করুন।", "Ekhon university document verify kora jacche na. Pore abar cheshta korun."),
}
BANGLISH_STRUCTURE = "holo ache jonno ebong korte kora hoy deya lagbe dara theke pare peyeche peyecchhe chilo niye ki koyta korun dekhun pawa paoa nei".split()
OTHER_SCRIPTS = r"[\x{0400}-\x{052F}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]"
BANGLA_GRAMMAR = r"(?:হলো|হয়|ছিল|করেছে|পেয়েছে|অবস্থিত|প্রকাশ|প্রতিষ্ঠিত|থেকে|জন্য|সালে|ঠিকানাটি|টি|টা)(?:[\s।,.]|$)"
#: Banglish words and what they are in English, in the order in which they are replaced.
ENGLISH_FORMS = (
    (r"\bholo\b", "is"), (r"\bebong\b", "and"), (r"\bsathe\b", "with"), (r"\bo\b", "and"), (r"\bache\b", "are included"), (r"\bpaoa jayni\b", "was not found"), (r"\bporano hoy\b", "is taught"),
    (r"\binclude kora hoyeche\b", "are included"), (r"\buse kore\b", "using"), (r"\buse kora\b", "using"), (r"\bbojha\b", "understanding"), (r"\bbojhano\b", "teaching"), (r"\bdescribe kora\b", "describing"),
    (r"\bdesign kora\b", "designing"), (r"\bdevelop kora\b", "developing"), (r"\bcalculate kora\b", "calculating"), (r"\bdeya\b", "giving"), (r"\bsomporke dharona\b", "an idea about"), (r"\bjonno\b", "for"), (r"\bkorar\b", "for"),
    (r"(\w+)-er\b", "$1"), (r"(\w+)-e\b", "$1"), (r"(\w+)-te\b", "$1"),
)
SEVERAL = (
    "This question matches multiple course answers. Please include the course name/code for one exact answer:\n",
    "প্রশ্নটি একাধিক কোর্সের উত্তরের সাথে মিলে যায়। নির্দিষ্ট উত্তর পেতে course name/code দিন:\n",
    "Question-ta multiple course answer-er sathe match kore. Exact answer pete course name/code din:\n",
)


def _in(language: Column, forms: tuple[str, str, str]) -> Column:
    """The form of the language; English for others."""
    return F.when(language == "bangla", forms[1]).when(language == "banglish", forms[2]).otherwise(forms[0])


def _filled(form: Column, **parts: Column) -> Column:
    for key, value in parts.items():
        form = F.replace(form, F.lit("{" + key + "}"), F.coalesce(value, F.lit("")))
    return form


# --- strategy and facts -------------------------------------------------------------------------------------------


def effective_field(field: Column, question: Column) -> Column:
    """course_count for how often courses may be repeated; duration for how long a semester is; else the field."""
    return F.when(U.matches_all(question, *COUNT_OF_COURSES), "course_count").when((field == "semester") & U.matches(question, HOW_LONG), "duration").otherwise(field)


def strategy(support: Column, field: Column, intent: Column, question: Column) -> Column:
    """structured_exact, structured_list or gguf_generation for what is supported; else unsupported, ambiguous, conflicting."""
    return (
        F.when(support.isin("ambiguous", "conflicting"), support).when(support != "supported", "unsupported")
        .when(effective_field(field, question) == "course_count", "gguf_generation")
        .when(U.matches(question, EXPLAIN) & field.isin("credits", "attendance", "requirement", "policy"), "gguf_generation")
        .when(field.isin(*EXACT_FIELDS) | intent.isin(*EXACT_INTENTS), "structured_exact")
        .when(field.isin(*LIST_FIELDS) | intent.isin(*LIST_INTENTS), "structured_list").otherwise("gguf_generation")
    )


#: The value as it stands in the passage; where it differs from how values are compared.
SHOWN = {
    "attendance": (r"attendance[^.\n]{0,100}?(\d+(?:\.\d+)?\s*%)", r"(\d+(?:\.\d+)?\s*%)[^.\n]{0,100}?attendance"),
    "prerequisite": (rf"pre\s*[- ]?\s*requisites?\s*[:=-]\s*((?:Nil|None|N/A|{V.CODE})(?:\s*,\s*{V.CODE})*)",),
}


def _shown(patterns: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda e: F.array(*[F.regexp_replace(V.one_line(F.regexp_extract(F.coalesce(e, F.lit("")), "(?i)" + p, 1)), r"^[ .;:]+|[ .;:]+$", "") for p in patterns])


def single_value(field: Column, excerpts: Column) -> Column:
    """The one value of the field that the excerpts state, as it stands there; null for none or several."""
    out = F.lit(None).cast("string")
    for name, patterns in {**V.VALUES, **SHOWN}.items():
        found = F.flatten(F.transform(excerpts, _shown(patterns)))
        some = F.filter(found, lambda v: v != "")
        one = F.size(F.array_distinct(F.transform(some, F.lower))) == 1
        out = F.when((field == name) & one, F.get(some, F.lit(0))).otherwise(out)
    return out


def exact_fact(entity: Column, field: Column, value: Column, language: Column) -> Column:
    """A value as a sentence; null for a blank value."""
    v = F.regexp_replace(V.one_line(value), r"[.।]+$", "")
    named = F.trim(F.coalesce(entity, F.lit(""))) != ""
    name = F.when(named, F.when(entity.rlike(f"^{V.CODE}$"), F.upper(V.one_line(entity))).otherwise(V.one_line(entity))).otherwise(_in(language, NO_ENTITY))
    form = _in(language, OTHER_FACT)
    for key, forms in FACTS.items():
        form = F.when(field == key, _in(language, forms)).otherwise(form)
    form = F.when((field == "prerequisite") & F.lower(v).isin("nil", "none", "n/a") & named, _in(language, NO_PREREQUISITE)).otherwise(form)
    return F.when(v != "", _filled(form, e=name, v=F.when(field == "percentage", F.regexp_replace(v, "%+$", "")).otherwise(v)))


def safe_response(status: Column, language: Column) -> Column:
    """What is said instead of an answer; null for SUPPORTED and unknown statuses."""
    out = F.lit(None).cast("string")
    for key, forms in SAFE.items():
        out = F.when(status == key, _in(language, forms)).otherwise(out)
    return out


def cleaned(question: Column, answer: Column) -> Column:
    """A generated answer without its label and without the question repeated before it."""
    a = F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), r"(?i)^(?:Answer|উত্তর|Ei information-ta)\s*:\s*", "")
    q, flat = F.regexp_replace(V.one_line(question), r"^[ ?.।]+|[ ?.।]+$", ""), V.one_line(a)
    again = (q != "") & F.startswith(F.lower(flat), F.lower(q))
    return F.trim(F.when(again, F.regexp_replace(F.substring(flat, F.length(q) + 1, F.length(flat)), r"^[ ?:।-]+", "")).otherwise(a))


# --- language of answers ------------------------------------------------------------------------------------------


def answer_language(answer: Column, expected: Column) -> Column:
    """struct<passed, response_language, reason, bangla_words, latin_words, bangla_share, markers> of an answer that should
    be in the expected language. Names and codes may dominate a Bengali sentence that has Bengali grammar."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    bangla = F.regexp_extract_all(a, F.lit(r"[\x{0980}-\x{09FF}]+"), F.lit(0))
    latin = F.transform(F.regexp_extract_all(a, F.lit("[A-Za-z]+(?:-[A-Za-z]+)?"), F.lit(0)), F.lower)
    marks = F.array_sort(F.array_distinct(F.concat(F.filter(latin, lambda w: w.isin(sorted({*U.MARKERS, *BANGLISH_STRUCTURE}))), F.array_compact(F.array(F.when(F.lower(a).rlike(r"\b[a-z]+-(?:er|e|te|tir|ta|gulo|gulor)\b"), F.lit("suffix")))))))
    letters = lambda ws: F.aggregate(ws, F.lit(0), lambda s, w: s + F.length(w))

    def of(x: Column) -> Column:
        n_bangla, n_latin, marked = F.size(x["b"]), F.size(x["l"]), F.size(x["m"]) > 0
        share = letters(x["b"]) / F.greatest(letters(x["b"]) + letters(x["l"]), F.lit(1))
        made = lambda ok, lang, why: F.struct(F.lit(ok).alias("p"), F.lit(lang).alias("r"), F.lit(why).alias("w"))
        ok_bangla = (n_bangla >= 2) & ((share >= 0.25) | a.rlike(BANGLA_GRAMMAR))
        as_bangla = F.when(ok_bangla, made(True, "bangla", "BANGLA_BODY_MEANINGFUL")).when(n_latin > 0, made(False, "english", "BANGLA_BODY_TOO_ENGLISH")).otherwise(made(False, "unknown", "BANGLA_BODY_TOO_ENGLISH"))
        as_banglish = F.when(n_bangla > 0, made(False, "bangla", "BANGLISH_CONTAINS_BENGALI_SCRIPT")).when(n_latin == 0, made(False, "unknown", "EMPTY_ANSWER")).when(marked, made(True, "banglish", "BANGLISH_MARKERS_PRESENT")).otherwise(made(False, "english", "BANGLISH_BODY_PURE_ENGLISH"))
        as_english = F.when((n_bangla >= 2) | (share >= 0.15), made(False, "bangla", "ENGLISH_CONTAINS_BENGALI_SENTENCE")).when(marked, made(False, "banglish", "ENGLISH_CONTAINS_BANGLISH_FRAMING")).when(n_latin > 0, made(True, "english", "ENGLISH_BODY_VALID")).otherwise(made(False, "unknown", "EMPTY_ANSWER"))
        rule = (
            F.when(a == "", made(False, "unknown", "EMPTY_ANSWER")).when(a.rlike(OTHER_SCRIPTS), made(False, "other", "UNEXPECTED_FOREIGN_SCRIPT"))
            .when(a.rlike(r"[\x{0980}-\x{09FF}][A-Za-z]|[A-Za-z][\x{0980}-\x{09FF}]"), made(False, "mixed", "MIXED_SCRIPT_TOKEN"))
            .when(expected == "bangla", as_bangla).when(expected == "banglish", as_banglish).otherwise(as_english)
        )
        return F.struct(rule["p"].alias("passed"), rule["r"].alias("response_language"), rule["w"].alias("reason"), n_bangla.alias("bangla_words"), n_latin.alias("latin_words"), share.alias("bangla_share"), x["m"].alias("markers"))

    return T.let(F.struct(bangla.alias("b"), latin.alias("l"), marks.alias("m")), of)


def in_english(text: Column) -> Column:
    """Banglish phrases of a reference answer in English, the first letter upper case."""
    out = F.trim(F.coalesce(text, F.lit("")))
    for pattern, form in ENGLISH_FORMS:
        out = F.regexp_replace(out, "(?i)" + pattern, form)
    out = V.one_line(out)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))


# --- sections of passages -----------------------------------------------------------------------------------------


def _section(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_replace(V.one_line(F.regexp_extract(text, "(?i)" + pattern, group)), r"^[ .;:-]+|[ .;:-]+$", "")


def items(text: Column) -> Column:
    """Parts of an enumeration: its bullet or numbered lines, else what commas, semicolons, 'and' and bullets divide."""
    bullets = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+(.*)$"), F.lit(1)), lambda x: F.regexp_replace(x, r"[ .]+$", ""))
    flat = F.regexp_replace(F.regexp_replace(V.one_line(text), r"\.+$", ""), "^[^:]*: *", "")
    flat = F.regexp_replace(flat, r"(?i)^(?:topics?\s+)?(?:include|includes|included)\s+", "")
    parts = F.transform(F.split(flat, r"(?i)\s*[,;]\s*|\s+and\s+|\s+•\s+"), lambda x: F.regexp_replace(F.trim(x), r"(?i)^(?:and|or)\s+|^[ .]+|[ .]+$", ""))
    return F.filter(F.when(F.size(bullets) > 0, bullets).otherwise(parts), lambda x: x != "")


#: Per intent, patterns of the section that answers it; {n} is the asked outcome or week, {s} the subject.
OBJECTIVES = r"Course Objectives and Course Summary:\s*(.*?)(?=\s+This is a core course\b|\s+12\.\s+Course Learning Outcomes\b|$)"
CONTENT = r"14\.\s+Course Content:\s*(.*?)(?=\s+15\.\s+Alignment|\s+16\.\s+Class Schedule|$)"
ALIGNMENT = r"15\.\s+Alignment of topics.*?(?=\s+16\.\s+Class Schedule|\s+Part\s+C|$)"
STRATEGY_SECTION = r"Assessment Strategy\s+(.*?)(?=\s+CIE-|\s+20\.\s+Evaluation Policy|$)"
MARK_NAMES = ("Final Exam", "Term Examination", "Mid-Term Examination", "Mid Term", "Assessment", "Class Tests")
LABELS = {"course_code": r"Course\s+No\.\s*/\s*Course\s+Code:\s*(.*?)(?=\s+2\.\s+Course\s+Title:)", "course_title": r"Course Title:\s*(.*?)(?=\s+\d+\.\s+[A-Z]|$)", "course_type": r"Course Type:\s*(.*?)(?=\s+\d+\.\s+[A-Z]|$)", "course_credit": r"Credit Value:\s*(.*?)(?=\s+\d+\.\s+[A-Z]|$)"}
TITLES = {"course_code": "Course code", "course_title": "Course title", "course_type": "Course type", "course_credit": "Credit value"}


def percentage_of(text: Column, name: str) -> Column:
    """The percentage that a passage gives for an assessment; empty if none."""
    forms = (rf"\b{name}\b\s*\((\d+(?:\.\d+)?)\s*%\)", rf"\b{name}\b[^\d%]{{0,40}}(\d+(?:\.\d+)?)\s*%", rf"\d+\.\s*{name}s?\s+(\d+(?:\.\d+)?)%")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in forms], F.lit(""))


def week_content(text: Column, week: Column) -> Column:
    """What a weekly plan has for a week: the cell before it, else the words after it; exams by their name."""
    t = V.one_line(text)
    pattern = F.concat(F.lit(r"(?i)(.{0,260}?)\bWeek\s+"), week.cast("string"), F.lit(r"(?:-\d+)?\b(.{0,180})"))
    before = F.element_at(F.split(T.group(t, pattern, 1), r"(?i)\b(?:Week\s+\d+(?:-\d+)?|CT\d|MID-TERM EXAMINATION|FINAL EXAMINATION)\b"), -1)
    before = F.regexp_replace(F.regexp_replace(before, r"(?i)^.*\bCLO\d(?:,\s*CLO\d)*\s+", ""), r"(?i)\s+(?:gain|understand|apply|relate|learning|constructing|identifying|demonstrating)\b.*$", "")
    before = F.regexp_replace(V.one_line(before), r"^[ .;:-]+|[ .;:-]+$", "")
    after = F.regexp_replace(V.one_line(F.element_at(F.split(T.group(t, pattern, 2), r"(?i)\s+(?:Class notes|Practice|Assignment|Lecture|Multimedia|CLO\d)\b"), 1)), r"^[ .;:-]+|[ .;:-]+$", "")
    return F.when(F.lower(before).rlike("exam"), F.when(week == 15, "FINAL EXAMINATION").otherwise("MID-TERM EXAMINATION")).when(before != "", before).otherwise(after)


def table_row(text: Column, entity: Column) -> Column:
    """struct<title, credit, prerequisite> of the course's row in a curriculum table; null if there is none."""
    parts = F.array_join(F.regexp_extract_all(F.coalesce(entity, F.lit("")), F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), r"[\s()]*")
    pattern = F.concat(F.lit(r"(?i)\b"), parts, F.lit(rf"\b[\s()]*\s+(.+?)\s+(\d+(?:\.\d+)?)\s+(.+?)(?=\s+{V.CODE}\b|\s+Total\b|\s+(?:First|Second|Third|Fourth)\s+Year\b|$)"))
    t = V.one_line(text)
    cell = lambda i: F.regexp_replace(T.group(t, pattern, i), r"^[ .;:-]+|[ .;:-]+$", "")
    return F.when((parts != "") & T.found(t, pattern), F.struct(cell(1).alias("title"), cell(2).alias("credit"), cell(3).alias("prerequisite")))


def section(intent: Column, question: Column, entity: Column, text: Column) -> Column:
    """The part of a passage that answers a question of the intent; null if the passage has none."""
    t = V.one_line(text)
    clo = U.clo_number(question).cast("string")
    outcome_pattern = F.concat(F.lit(r"(?i)\bCLO\s*"), F.coalesce(clo, F.lit("x")), F.lit(r"\b\s*(.*?)(?=\s+CLO\s*\d+\b|\s+13\.\s+Mapping\b|\s+Part\s+B\b|$)"))
    outcome = F.regexp_replace(T.group(t, outcome_pattern, 1), r"^[ .;:-]+|[ .;:-]+$", "")
    subject = U.topic_subject(question)
    heading = F.concat(F.lit(r"(?i)\b\Q"), subject, F.lit(r"\E\s*:\s*(.+?)(?=\s+[A-Z][A-Za-z /&-]{2,55}\s*:|\s+(?:Week|CT\d|MID-TERM|FINAL|Part\s+C)\b|$)"))
    under = F.when(subject != "", F.array_join(items(F.regexp_replace(T.group(t, heading, 1), r"(?i)\b(?:and\s+)?their\s+conversions\b.*$", "")), ", ")).otherwise("")
    rows = F.split(F.regexp_replace(F.regexp_extract(t, "(?i)" + ALIGNMENT, 0), r"(?i)^.*?Course (?:Learning )?Outcome(?: \(CLO\))?\s*", ""), r"\s+(?=\d+\.?\s+[A-Z])")
    aligned = F.array_join(F.filter(F.transform(rows, lambda r: F.regexp_replace(F.regexp_replace(F.regexp_replace(r, r"^\d+\.?\s+", ""), r"(?i)\s+CLO\d(?:,\s*CLO\d)*.*$", ""), r"^[ .;]+|[ .;]+$", "")), lambda r: (r != "") & ~F.lower(r).startswith("alignment of topics")), ", ")
    week = U.week_number(question)
    mid = F.regexp_extract(t, r"(?i)MID-TERM EXAMINATION\s+Week\s+(\d+)", 1)
    weekly = F.when(week.isNotNull(), F.when(week_content(t, week) != "", F.concat(F.lit("Week "), week.cast("string"), F.lit(": "), week_content(t, week), F.lit(".")))).when(U.matches(question, "mid.?term") & (mid != ""), F.concat(F.lit("Mid-Term Examination is scheduled in Week "), mid, F.lit(".")))
    marks = F.array_compact(F.array(*[F.when(percentage_of(t, n) != "", F.concat(F.lit(f"{n.replace('Mid Term', 'Mid-Term Examination')}: "), percentage_of(t, n), F.lit("%"))) for n in MARK_NAMES]))
    final = F.coalesce(*[F.when(percentage_of(t, n) != "", F.concat(F.lit(f"{n}: "), percentage_of(t, n), F.lit("%."))) for n in MARK_NAMES[:2]])
    sentences = F.split(t, r"(?<=[.!?])\s+")
    attend = F.filter(sentences, lambda s: s.rlike(r"(?i)\battend(?:ance)?\b") & s.rlike(r"(?i)\b(?:required|must|expected)\b|\d+(?:\.\d+)?\s*%"))
    best = F.element_at(F.array_sort(F.transform(attend, lambda s: F.struct((-s.rlike(r"\d+(?:\.\d+)?\s*%").cast("int") * 2 - s.rlike(r"(?i)\brequired\b|\bmust\b").cast("int")).alias("o"), s.alias("s")))), 1)["s"]
    grade = F.when(U.matches(question, r"\bgrade\b|গ্রেড") & t.rlike(r"80%\s+and\s+above\s+A\+\s+4\.00"), "80% and above is awarded grade A+.")
    assessment = F.when(U.matches(question, r"\battendance\b|উপস্থিতি|হাজিরা"), F.when(F.size(attend) > 0, best)).otherwise(F.coalesce(grade, F.when(_section(t, STRATEGY_SECTION) != "", F.concat(_section(t, STRATEGY_SECTION), F.lit(".")))))
    row = table_row(t, entity)
    needs = F.coalesce(F.nullif(_section(t, SHOWN["prerequisite"][0].replace("[:=-]", ":")), F.lit("")), row["prerequisite"])
    named = {k: F.nullif(_section(t, p), F.lit("")) for k, p in LABELS.items()}
    named["course_title"], named["course_credit"] = F.coalesce(named["course_title"], row["title"]), F.coalesce(named["course_credit"], row["credit"])
    out = (
        F.when(intent == "clo", F.when(outcome != "", F.concat(F.lit("CLO "), clo, F.lit(": "), outcome, F.lit("."))))
        .when(intent == "course_objective", F.when(_section(t, OBJECTIVES) != "", F.concat(_section(t, OBJECTIVES), F.lit("."))))
        .when(intent == "topics", F.coalesce(F.when(under != "", F.concat(F.lit("Under "), subject, F.lit(", topics include "), under, F.lit("."))), F.when(_section(t, CONTENT) != "", F.concat(F.lit("Topics include "), _section(t, CONTENT), F.lit("."))), F.when(aligned != "", F.concat(F.lit("Topics include "), aligned, F.lit(".")))))
        .when(intent == "weekly_content", weekly).when(intent == "final_exam_marks", final)
        .when(intent == "mark_distribution", F.when(F.size(marks) > 0, F.concat(F.lit("Mark distribution: - "), F.array_join(F.array_distinct(marks), " - "))))
        .when(intent == "assessment", assessment).when(intent == "prerequisite", F.when(needs.isNotNull(), F.concat(F.lit("Prerequisite: "), needs, F.lit("."))))
    )
    for key, title in TITLES.items():
        out = out.when(intent == key, F.when(named[key].isNotNull(), F.concat(F.lit(f"{title}: "), named[key], F.lit("."))))
    whole = F.concat_ws(" ", *[F.when(named[k].isNotNull(), F.concat(F.lit(f"{TITLES[k]}: "), named[k], F.lit("."))) for k in ("course_code", "course_title")])
    return out.when(intent == "course_metadata", F.when(named["course_title"].isNotNull(), whole))


def extractive(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, chunk_id, answer): what the first candidate (query_id, chunk_id, rank, text) that has an answer to the
    question (query_id, question, a) says; questions of unknown intent get up to three sentences that share a word."""
    rows = candidates.join(questions, "query_id")
    rows = rows.withColumn("said", section(F.col("a.intent"), F.col("question"), F.get("a.canonical", F.lit(0)), F.col("text")))
    stop = "a an and are be can course do does for from how in is it of on or that the this to what when where which who why".split()
    words = lambda t: F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[a-z]+|\d+(?:\.\d+)?|[\x{0980}-\x{09ff}]+"), F.lit(0))), lambda w: (F.length(w) > 1) & ~w.isin(stop))
    shared = F.filter(F.split(V.one_line(F.col("text")), r"(?<=[.!?])\s+"), lambda s: F.arrays_overlap(words(F.col("question")), words(s)))
    rows = rows.withColumn("said", F.coalesce("said", F.when((F.col("a.intent") == "unknown") & (F.size(shared) > 0), F.array_join(F.slice(shared, 1, 3), " "))))
    return rows.where("said is not null").groupBy("query_id").agg(F.min_by(F.struct("chunk_id", F.col("said").alias("answer")), "rank").alias("x")).select("query_id", "x.*")


# --- answer bank --------------------------------------------------------------------------------------------------


def bank_plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{0980}-\x{09ff}]+", " "))


def bank_tokens(plain: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain, " "), lambda t: (F.length(t) > 1) & ~t.isin("what which where when how the and are is in".split())))


def bank_answers(bank: DataFrame, questions: DataFrame, threshold: float = 0.86, margin: float = 0.08) -> DataFrame:
    """(query_id, answer, score, item_id) from a bank (item_id, language, question, reference) for questions (query_id,
    language, text).

    Equal questions win; else the most similar one of the language, at `threshold` or more. Several within the margin, or
    several equal ones, whose references differ are listed; alike references within the margin give no answer.
    """
    b = bank.select("item_id", "language", F.col("question").alias("text"), "reference", bank_plain(F.col("question")).alias("plain"), bank_plain(F.col("reference")).alias("said"))
    q = questions.select("query_id", "language", "text", bank_plain(F.col("text")).alias("plain"))
    near = R.jaccard_pairs(b.select(F.concat_ws("\x01", "language", F.col("item_id").cast("string")).alias("item_id"), "plain"), q.select("query_id", "plain"), threshold - margin, bank_tokens)
    near = near.withColumn("language", F.element_at(F.split("item_id", "\x01"), 1)).withColumn("item", F.element_at(F.split("item_id", "\x01"), 2))
    scored = near.join(q.select("query_id", "language"), ["query_id", "language"]).select("query_id", F.col("item").alias("item_id"), "score")
    same = q.where("plain != ''").join(b, ["language", "plain"]).select("query_id", F.col("item_id").cast("string").alias("item_id"), F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    both = scored.withColumn("exact", F.lit(False)).unionByName(same).groupBy("query_id", "item_id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
    full = both.join(b.select(F.col("item_id").cast("string").alias("item_id"), "reference", "said"), "item_id")
    per = full.groupBy("query_id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "item_id", "exact", "reference", "said"))).alias("all"))
    close = F.filter("all", lambda x: F.when(F.col("exact"), x["exact"]).otherwise(F.col("score") + x["o"] < margin))
    out = per.withColumn("close", close).join(q.select("query_id", "language"), "query_id").where(F.col("exact") | (F.col("score") >= threshold))
    different = F.array_distinct(F.transform("close", lambda x: x["said"]))
    one = F.get("close", F.lit(0))["reference"]
    in_lang = lambda r: F.when(F.col("language") == "english", in_english(r)).when(F.col("language") == "bangla", F.concat(F.lit("উত্তর: "), r)).otherwise(r)
    firsts = F.transform(F.filter(different, lambda s: s != ""), lambda s: F.get(F.filter("close", lambda x: x["said"] == s), F.lit(0))["reference"])
    listed = F.concat(_in(F.col("language"), SEVERAL), F.array_join(F.transform(firsts, lambda r: F.concat(F.lit("- "), F.when(F.col("language") == "english", in_english(r)).otherwise(F.trim(r)))), "\n"))
    single = F.col("exact") | (F.size("close") == 1)
    said = F.when(F.size(different) > 1, listed).when(single, in_lang(one))
    return out.select("query_id", said.alias("answer"), "score", F.get("close", F.lit(0))["item_id"].alias("item_id")).where("answer is not null")


# --- prompts ------------------------------------------------------------------------------------------------------


def evidence_block(position: Column, source: Column, page: Column, heading: Column, entity: Column, text: Column) -> Column:
    """One piece of evidence as a prompt shows it."""
    or_none = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("not specified"))
    return F.concat(F.lit("[EVIDENCE "), position.cast("string"), F.lit("]\nSource: "), source, F.lit("\nPage: "), or_none(page), F.lit("\nHeading: "), or_none(heading), F.lit("\nEntity: "), or_none(entity), F.lit("\nText: "), V.one_line(text))


def distinct_excerpts(evidence: DataFrame) -> DataFrame:
    """Evidence (query_id, rank, excerpt, ...) without blank excerpts and without those that an earlier one equals, any
    case; `position` counts what is left."""
    plain = F.sha2(F.lower(V.one_line(F.col("excerpt"))), 256)
    rows = evidence.where(F.trim(F.coalesce("excerpt", F.lit(""))) != "").withColumn("_plain", plain)
    first = rows.groupBy("query_id", "_plain").agg(F.min("rank").alias("rank"))
    return R.ranked(rows.join(first, ["query_id", "_plain", "rank"], "left_semi").drop("_plain"), ["query_id"], [F.asc("rank")], None, "position")


REPAIRS = {
    "WRONG_POLARITY": "Your previous answer reversed the evidence meaning. Rewrite it without changing affirmative or negative meaning. Do not add facts.",
    "MISSING_REQUIRED_ENTITY": "Your previous answer omitted a required entity or value from the verified fact plan. Include it exactly and add no facts.",
    "LANGUAGE": "Rewrite only in the required language and preserve every verified fact and its polarity.",
    "OTHER": "Repair only the stated formatting or language problem. Preserve every fact and its polarity.",
}


def repair_instruction(reason: Column) -> Column:
    return F.when(reason.isin("WRONG_POLARITY", "MISSING_REQUIRED_ENTITY"), F.when(reason == "WRONG_POLARITY", REPAIRS["WRONG_POLARITY"]).otherwise(REPAIRS["MISSING_REQUIRED_ENTITY"])).when(reason.isin("BANGLISH_BODY_PURE_ENGLISH", "BANGLISH_CONTAINS_BENGALI_SCRIPT", "BANGLA_BODY_TOO_ENGLISH"), REPAIRS["LANGUAGE"]).otherwise(REPAIRS["OTHER"])
