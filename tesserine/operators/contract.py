"""Semantic contracts: what an answer must keep of the evidence's facts, and whether it does.

Facts are found sentence by sentence; a contract is one struct per question.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import understanding as U
from . import answers as A
from . import evidence as V

# Cues and sentence forms of relations, in order; subject, value and a negation are named by their group.
CUES = {
    "published_by": ("publish", "publisher", "প্রকাশ", "prokash"),
    "accredited_by": ("accredit", "স্বীকৃতি", "স্বীকৃত", "shikriti"),
    "established": ("establish", "founded", "প্রতিষ্ঠ", "protishth"),
    "operates_under": ("under which act", "operation", "operates under", "আইনের", "অধীনে", "odhine"),
    "located_at": ("located", "location", "address", "কোথায়", "ঠিকানা", "অবস্থিত", "kothay", "obosthito"),
    "offers": ("offer", "available", "included", "program", "প্রোগ্রাম"),
    "required": ("required", "requirement", "must", "প্রয়োজন", "শর্ত", "lagbe"),
    "allowed": ("allowed", "eligible", "permissible", "দিতে পারে", "যোগ্য", "dite pare", "korte pare"),
    "prerequisite": ("prerequisite", "pre-requisite", "পূর্বশর্ত"),
    "fee": ("fee", "payment", "ফি"),
    "general_claim": ("has", "have", "is", "was", "received", "contains", "includes"),
}
FORMS = (
    ("accredited_by", r"^(.+?)\s+(?:(?:is|was|has\s+been)\s+)?accredited\s+(?:from|by)\s+(.+)$", 1, 2), ("accredited_by", r"^(.+?)\s+received\s+(?:a\s+)?(?:certificate\s+of\s+)?accreditation\s+(?:from|by)\s+(.+)$", 1, 2),
    ("published_by", r"^(?:(.+?)\s+(?:is|was)\s+)?published\s+by\s+(.+)$", 1, 2), ("prerequisite", r"^(.+?)\s+has\s+(?:no\s+)?prerequisite(?:\s*(?:is|:)?\s*(.*))?$", 1, 2),
    ("operates_under", r"^(.+?)\s+(?:started\s+its\s+operation|operates?)\s+under\s+(.+)$", 1, 2), ("operates_under", r"^(.+?),?\s+under\s+(.+?),?\s+started\s+its\s+operation(?:\s+.+)?$", 1, 2),
    ("located_at", r"^(.+?)\s+(?:is\s+)?located\s+(?:at|in)\s+(.+)$", 1, 2), ("established", r"^(.+?)\s+(?:was\s+)?(?:established|founded)\s+(?:in|on)?\s*((?:[A-Z][a-z]+\s+)?\d{4}|\d{1,2}[/-]\d{1,2}[/-](?:\d{2}|\d{4}))", 1, 2),
    ("fee", r"^.+?payment\s+of\s+((?:Taka|Tk\.)\s*\d+(?:\s*/\s*-)?(?:\s*\(Tk\.\s*[^)]+\))?\s+only\s+per\s+script)", 0, 1), ("fee", r"^(?:the\s+)?fee\s+for\s+(.+?)\s+is\s+(.+)$", 1, 2),
    ("offers", r"^(.+?)\s+(?:initially\s+)?offer(?:ed|s)?\s+(.+)$", 1, 2),
)
STRICT = ("published_by", "accredited_by", "operates_under", "located_at", "established", "prerequisite")
GENERIC = "the this that course university department program prospectus published certificate accreditation private act address category".split()
COUNTED = r"\bhow\s+many\b|\b(?:koy|koto|kotojon)\b|কত"
CONDITIONAL = r"\bwhen\b|\bunder\s+what\s+conditions?\b|\b(?:kokhon|kobe)\b|\bki\s+shorte\b|কখন|কোন\s+শর্ত"
MOST_FACTS, LONGEST_PART = 4, 240


def _has_cue(text: Column, name: str) -> Column:
    return text.rlike("|".join(CUES[name]))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?।])\s+|\n+"), lambda s: F.regexp_replace(s, r"^[ \-:;\t]+|[ \-:;\t]+$", ""))
    return F.filter(parts, lambda s: s != "")


def wanted_relation(question: Column, field: Column) -> Column:
    """The relation that a question's words name; null if none."""
    t = F.lower(F.concat_ws(" ", field, question))
    out = F.when(F.lit(False), "")
    for name in CUES:
        if name != "general_claim":
            out = out.when(_has_cue(t, name), name)
    return out


def stated_relation(sentence: Column, wanted: Column | None = None) -> Column:
    """The relation of a sentence: the wanted one if it has a cue of that, else the first by the table."""
    t = F.lower(sentence)
    out = F.when(F.lit(False), "")
    if wanted is not None:
        for name in CUES:
            out = out.when((wanted == name) & _has_cue(t, name), name)
    for name in CUES:
        out = out.when(_has_cue(t, name), name)
    return out


def stated_relations(text: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(sentences(text), lambda s: stated_relation(s))))


def anchors(text: Column) -> Column:
    """Names, acronyms and numbers of a text in their compact form, without generic ones, sorted."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Z]{2,}\b|\b[A-Z][a-z]{2,}\b|\b\d+(?:\.\d+)?%?(?!\w)"), F.lit(0))
    plain = F.transform(F.filter(found, lambda x: ~F.lower(x).isin(GENERIC)), lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9\x{0980}-\x{09ff}]+", ""))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda x: x != "")))


def _part(value: Column) -> Column:
    clean = F.regexp_replace(V.one_line(value), r"^[ ,.;:-]+|[ ,.;:-]+$", "")
    return F.nullif(F.substring(clean, 1, LONGEST_PART), F.lit(""))


def fact(sentence: Column, relation: Column, entity: Column | None = None) -> Column:
    """struct<relation, subject, value, polarity, evidence> of a sentence; the value is null where no form fits, the subject
    is then the entity that was asked for."""
    subject, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, form, s, v in reversed(FORMS):
        fits = (relation == name) & sentence.rlike("(?i)" + form)
        subject = F.when(fits, _part(F.regexp_extract(sentence, "(?i)" + form, s)) if s else F.lit(None).cast("string")).otherwise(subject)
        value = F.when(fits, _part(F.regexp_extract(sentence, "(?i)" + form, v))).otherwise(value)
    negative = (relation == "prerequisite") & sentence.rlike(r"(?i)\bhas\s+no\s+prerequisite")
    subject = F.coalesce(subject, _part(entity)) if entity is not None else subject
    return F.struct(relation.alias("relation"), subject.alias("subject"), value.alias("value"), F.when(negative, "negative").otherwise(U.polarity(sentence)).alias("polarity"), sentence.alias("evidence"))


def _fact_of(wanted: Column, entity: Column | None) -> Callable[[Column], Column]:
    return lambda s: T.let(stated_relation(s, wanted), lambda relation: fact(s, relation, entity))


def fact_plan(question: Column, field: Column, evidence: Column, entity: Column | None = None) -> Column:
    """The first facts, each once, of the excerpts (array) that state the relation asked for (any, if none is)."""
    every = F.flatten(F.transform(F.coalesce(evidence, F.array().cast("array<string>")), sentences))

    def of(wanted: Column) -> Column:
        found = F.transform(F.array_distinct(every), _fact_of(wanted, entity))
        return F.slice(F.filter(found, lambda f: f["relation"].isNotNull() & (wanted.isNull() | (f["relation"] == wanted))), 1, MOST_FACTS)

    return T.let(wanted_relation(question, field), of)


CONTRACT = (
    "struct<question:string,field:string,code:string,code_value:string,language:string,entities:array<string>,relations:array<string>,polarity:string,forbidden:array<string>,"
    "supported:array<string>,counted:boolean,counts:array<string>,required:array<string>,n_facts:int,confidence:string>"
)


def contract(question: Column, field: Column, entity: Column, language: Column, evidence: Column) -> Column:
    """What an answer must keep: the polarity that all facts share, the course's own value, counts, and names that belong to
    the relation (others of the evidence are forbidden for strict relations). Confidence is high where one relation was
    asked for and all its facts were taken apart."""
    whole = F.array_join(F.coalesce(evidence, F.array().cast("array<string>")), "\n")
    code = F.when(field.isin("credits", "prerequisite"), F.nullif(V.code_key(entity), F.lit("")))
    owned = T.let(V.row_values(entity, field, whole), lambda v: F.when(F.size(v) == 1, v[0]))
    repeats = U.matches_all(question, *A.COUNT_OF_COURSES)
    most = F.regexp_extract(whole, r"(?i)\brepeat\s+(?:up\s+to\s+|a\s+maximum\s+of\s+|at\s+most\s+)(\d+|[A-Za-z]+)\s+courses?\b", 1)
    asks = U.matches(question, COUNTED)

    def of(plan: Column) -> Column:
        polarities = F.array_distinct(F.transform(plan, lambda f: f["polarity"]))
        polarity = F.when((field == "prerequisite") & (owned == "NO_PREREQUISITE"), "negative").when(F.size(polarities) == 1, polarities[0]).otherwise("unknown")
        relations = F.array_distinct(F.transform(plan, lambda f: f["relation"]))
        strict = F.arrays_overlap(relations, F.array(*[F.lit(x) for x in STRICT]))
        parsed = ~strict | F.forall(plan, lambda f: f["value"].isNotNull())
        document = F.when(field.isin("publication", "publisher") & U.matches(question, "prospectus|প্রসপেক্টাস"), F.lit("prospectus"))
        entities = F.array_compact(F.array(F.nullif(F.trim(F.coalesce(entity, F.lit(""))), F.lit("")), document))
        own = anchors(F.concat_ws(" ", F.array_join(F.transform(F.filter(plan, lambda f: f["relation"].isin(*STRICT)), lambda f: F.concat_ws(" ", f["subject"], f["value"])), " "), F.array_join(entities, " ")))
        forbidden = F.when(strict & parsed, F.array_except(anchors(whole), own)).otherwise(F.array().cast("array<string>"))
        first = F.get(plan, F.lit(0))
        counts = (
            F.when(code.isNotNull() & (field == "credits") & owned.isNotNull(), F.array(owned)).when(repeats & (most != ""), U.cardinalities(most))
            .when((asks | U.matches(question, CONDITIONAL)) & code.isNull() & (F.size(plan) > 0), U.cardinalities(F.coalesce(first["value"], first["evidence"]))).otherwise(F.array().cast("array<string>"))
        )
        required = anchors(F.array_join(F.transform(plan, lambda f: F.when(f["value"].isNotNull(), F.concat_ws(" ", f["subject"], f["value"])).otherwise(f["evidence"])), " "))
        sure = (F.size(plan) > 0) & wanted_relation(question, field).isNotNull() & (F.size(relations) == 1) & (polarity != "unknown") & parsed
        return F.struct(
            question.alias("question"), F.when(repeats, "course_count").otherwise(field).alias("field"), code.alias("code"), owned.alias("code_value"), language.alias("language"), entities.alias("entities"), relations.alias("relations"),
            polarity.alias("polarity"), forbidden.alias("forbidden"), anchors(whole).alias("supported"), asks.alias("counted"), counts.alias("counts"), required.alias("required"), F.size(plan).alias("n_facts"), F.when(sure, "high").otherwise("limited").alias("confidence"),
        ).cast(CONTRACT)

    return T.let(fact_plan(question, field, evidence, entity), of)


def kept(answer: Column, c: Column) -> Column:
    """struct<passed, reason, details> of an answer under a contract; the first rule that it breaks decides."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    none = F.array().cast("array<string>")
    make = lambda ok, why, what=none: F.struct(F.lit(ok).alias("passed"), F.lit(why).alias("reason"), what.alias("details"))
    own, code = U.polarity(a), c["code"].isNotNull()
    numbers = F.transform(F.regexp_extract_all(a, F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?!\w)"), F.lit(0)), V.plain_number)
    nothing = a.rlike(r"(?i)\b(?:nil|none|no\s+(?:listed\s+)?prerequisite|kono\s+prerequisite\s+deya\s+nei)\b|কোনো\s+পূর্বশর্ত\s+দেওয়া\s+নেই")
    flat = lambda t: F.regexp_replace(F.lower(t), r"[^a-z0-9\x{0980}-\x{09ff}]+", "")
    wrong_value = F.when(c["field"] == "credits", ~F.array_contains(numbers, V.plain_number(c["code_value"]))).when(c["code_value"] == "NO_PREREQUISITE", ~nothing).otherwise(~F.contains(flat(a), flat(c["code_value"])))
    repeat = (F.size(c["counts"]) > 0) & U.matches(a, r"\brepeat\b|পুনরায়|পুনঃপরীক্ষা") & U.matches(a, r"\bcourses?\b|কোর্স")
    focus = F.get(F.filter(F.regexp_extract_all(c["question"], F.lit(r"\b[A-Z]{2,8}\b"), F.lit(0)), lambda x: ~x.isin("PDF", "CGPA", "GPA")), F.lit(0))
    founded = U.matches(c["question"], r"\bestablish(?:ed)?\b|\bfounded\b|প্রতিষ্ঠ|protishth") & focus.isNotNull()
    subjects = F.filter(F.transform(F.filter(sentences(a), lambda s: s.rlike(r"(?i)\b(?:established|founded|establish)\b")), lambda s: F.trim(F.regexp_extract(s, r"(?i)^\s*(?:the\s+)?(.+?)\s+(?:was\s+)?(?:established|founded|establish)\b", 1))), lambda s: s != "")
    expanded = F.lower(F.trim(F.regexp_extract(a, r"([A-Z][A-Za-z ]{4,80}?)\s*\([A-Z]{2,8}\)", 1)))
    other_focus = F.filter(subjects, lambda s: ~F.contains(F.concat(F.lit(" "), F.regexp_replace(s, r"\W+", " "), F.lit(" ")), F.concat(F.lit(" "), focus, F.lit(" "))) & (F.lower(s) != expanded))
    lost = F.array_except(c["counts"], F.transform(U.cardinalities(a), lambda x: x))
    lost = F.filter(lost, lambda n: ~F.array_contains(numbers, V.plain_number(n)))
    unsure = (c["language"] != "english") & (c["confidence"] == "limited") & c["code_value"].isNull() & F.exists(c["relations"], lambda r: r.isin(*STRICT, "general_claim"))
    said = anchors(a)
    return (
        F.when(a == "", make(False, "EMPTY_ANSWER"))
        .when((c["polarity"] != "unknown") & (own != c["polarity"]), make(False, "WRONG_POLARITY", F.array(F.concat(F.lit("expected="), c["polarity"], F.lit(";answer="), own))))
        .when(code & c["code_value"].isNull(), make(False, "UNVERIFIED_COURSE_ROW", F.array(c["code"]))).when(code & ~F.contains(V.code_key(a), c["code"]), make(False, "MISSING_REQUIRED_ENTITY", F.array(c["code"])))
        .when(code & wrong_value, make(False, "WRONG_FIELD_VALUE", F.array(c["code_value"]))).when((c["field"] == "course_count") & ~repeat, make(False, "WRONG_FIELD_VALUE"))
        .when(founded & (F.size(other_focus) > 0), make(False, "ENTITY_FOCUS_MISMATCH", other_focus))
        .when((c["confidence"] == "limited") & F.array_contains(c["entities"], "prospectus") & ~F.contains(flat(a), F.lit("prospectus")), make(False, "MISSING_REQUIRED_ENTITY", F.array(F.lit("missing entity: prospectus"))))
        .when(c["counted"] & (F.size(c["counts"]) == 0), make(False, "SEMANTIC_CONTRACT_UNCERTAIN")).when(F.size(lost) > 0, make(False, "MISSING_REQUIRED_ENTITY", lost))
        .when(unsure, make(False, "SEMANTIC_CONTRACT_UNCERTAIN", c["relations"])).when(F.arrays_overlap(said, c["forbidden"]), make(False, "WRONG_RELATION_VALUE", F.array_intersect(said, c["forbidden"])))
        .when((c["n_facts"] > 0) & (F.size(F.array_except(said, c["supported"])) > 0), make(False, "WRONG_RELATION_VALUE", F.array_except(said, c["supported"])))
        .when((c["confidence"] == "high") & (F.size(c["required"]) > 0) & ~F.arrays_overlap(said, c["required"]), make(False, "MISSING_REQUIRED_ENTITY", c["required"]))
        .otherwise(make(True, "SEMANTIC_CONTRACT_SATISFIED"))
    )


def realised(canonical: Column, said: Column, language: Column, c: Column) -> Column:
    """struct<passed, reason, details>: a wording in the target language says what the canonical answer says."""
    kinds = ("emails", "course_codes", "numbers", "named_identifiers")
    told = A.answer_language(said, language)
    acronyms = lambda t: F.filter(V.facts(t, kinds), lambda f: ~f.startswith("named_identifiers:"))
    caps = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)), lambda x: F.concat(F.lit("acronyms:"), F.lower(x)))
    facts = lambda t: F.array_sort(F.array_distinct(F.concat(acronyms(t), caps(t))))
    missing, added = F.array_except(facts(canonical), facts(said)), F.array_except(facts(said), facts(canonical))
    must = F.filter(stated_relations(canonical), lambda r: r.isin("published_by", "accredited_by", "established", "operates_under", "located_at", "prerequisite"))
    own, other = U.polarity(canonical), U.polarity(said)
    none = F.array().cast("array<string>")
    make = lambda why, what=none: F.struct(F.lit(False).alias("passed"), why.alias("reason"), what.alias("details"))
    return (
        F.when(~told["passed"], make(told["reason"])).when((own != "unknown") & (own != other), make(F.lit("WRONG_POLARITY"))).when(F.size(missing) > 0, make(F.lit("MISSING_CANONICAL_FACTS"), missing))
        .when(F.size(added) > 0, make(F.lit("UNSUPPORTED_REALIZATION_FACTS"), added)).when(F.size(F.array_except(must, stated_relations(said))) > 0, make(F.lit("WRONG_RELATION"), must))
        .otherwise(T.let(kept(said, c.withField("language", F.lit("english"))), lambda k: F.when(k["passed"], F.struct(F.lit(True).alias("passed"), F.lit("CANONICAL_MEANING_PRESERVED").alias("reason"), none.alias("details"))).otherwise(k)))
    )


def prompt_block(c: Column, plan: Column) -> Column:
    """The verified facts as a prompt lists them."""
    line = F.transform(plan, lambda f: F.concat(F.lit("- subject="), F.coalesce(f["subject"], F.lit("subject stated by the question/evidence")), F.lit("; relation="), f["relation"], F.lit("; value="), F.coalesce(f["value"], F.lit("value stated in the supporting evidence")), F.lit("; polarity="), F.upper(f["polarity"])))
    none = F.array(F.lit("- No high-confidence triple was extracted; rephrase the supporting evidence conservatively."))
    counts = F.when(F.size(c["counts"]) > 0, F.array(F.concat(F.lit("- Exact requested counts: "), F.array_join(c["counts"], ", ")))).otherwise(F.array().cast("array<string>"))
    rules = ("Preserve the meaning and polarity of every verified fact. Do not negate an affirmative fact.", "Do not affirm a negated fact. Do not add information.")
    return F.array_join(F.concat(F.array(F.lit("VERIFIED FACT PLAN — DATA ONLY")), F.when(F.size(plan) > 0, line).otherwise(none), counts, F.array(*[F.lit(r) for r in rules])), "\n")
