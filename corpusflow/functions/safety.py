"""Rules that look for danger in a question, map lay words to search terms, and mark answers: expressions over text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import normalize_query

# Patterns, word lists and seeds that results depend on.
EMERGENCY = (
    r"sudden\w*\s+\w*\s*blind",
    r"can'?t\s+see\s+(anything|at all|nothing)",
    r"cannot\s+see\s+(anything|at all|nothing)",
    r"lost\s+\w*\s*vision",
    r"loss\s+of\s+vision",
    r"went\s+blind",
    r"chemical\s*(burn|splash|injury)?",
    r"acid\s+(in|into|splash)",
    r"bleach\s+(in|into|splash)",
    r"metal\s+in\s+(my\s+)?eye",
    r"metal\s+went\s+into\s+(my\s+)?eye",
    r"metal.*\sinto\s+.*eye",
    r"nail\s+in\s+(my\s+)?eye",
    r"penetrating\s+(eye|ocular|injury)",
    r"puncture[ds]?\s+(eye|wound)",
    r"retinal\s+detach",
    r"curtain\s+(falling|over|across)",
    r"flash(es)?\s+(and|with)\s+floater",
    r"(extreme|severe|excruciating|unbearable)\s+pain",
    r"eye\s+burst",
    r"globe\s+rupture",
)
TRIAGE_SPOT = r"white\s+(spot|patch|dot|mark|opacity|ulcer|lesion)"
TRIAGE_PLACE = (
    r"black\s+part\s+of\s+(?:(?:the|my|your)\s+)?eye",
    r"(colored|coloured)\s+part\s+of\s+(?:(?:the|my|your)\s+)?eye",
    r"white\s+part\s+of\s+(?:(?:the|my|your)\s+)?eye",
    r"cornea\w*",
    r"front\s+of\s+(?:(?:the|my|your)\s+)?eye",
    r"pupil\w*",
    r"iris\w*",
    r"sclera\w*",
    r"see\s+(it\s+)?in\s+(the\s+)?mirror|visible\s+in\s+(the\s+)?mirror",
    r"on\s+(?:(?:the|my|your)\s+)?(eye|cornea|iris|conjunctiva)",
)
TRIAGE_INFLAMED = (r"red\w*", r"water\w*", r"tear\w*", r"pain\w*", r"photophobia|light\s+sensitive|sensitivity\s+to\s+light|bright\s+light", r"blur\w*\s+vision|vision\s+blur\w*", r"discharge")
LENS = r"contact\s+lens|lens\s+wearer"
LENS_SIGNS = r"red\w*|pain\w*|water\w*|tear\w*|photophobia|white\s+(spot|patch|dot|ulcer)"
NEGATED_BOTH = r"\bno\s+red\w*\s+or\s+pain\w*\b|\bno\s+pain\w*\s+or\s+red\w*\b"
PUPIL = (r"pupil\w*", r"black\s+part\s+of\s+(?:(?:the|my|your)\s+)?eye", r"black\s+cent(?:er|re)\s+of\s+(?:(?:the|my|your)\s+)?eye")
SURFACE = (
    r"front\s+of\s+(the\s+)?eye|surface\s+of\s+(the\s+)?eye",
    r"on\s+(the\s+)?(eye|cornea|iris|pupil|conjunctiva|sclera)",
    r"visible\s+in\s+(the\s+)?mirror|see\s+it\s+in\s+(the\s+)?mirror",
)
SPOT = (r"white\s+(spot|patch|dot|mark|opacity|ulcer|lesion|infiltrate)", r"spot\s+on\s+(the\s+)?(black\s+part|front)\s+of\s+(the\s+)?eye")
PLACE = (
    r"black\s+part\s+of\s+(the\s+)?eye",
    r"front\s+of\s+(?:(?:the|my|your)\s+)?eye",
    r"on\s+(?:(?:the|my|your)\s+)?(eye|cornea|iris|conjunctiva)",
    r"cornea\w*|iris\w*|conjunctiva\w*",
    r"see\s+(it\s+)?in\s+(the\s+)?mirror|visible\s+in\s+(the\s+)?mirror",
)
INFLAMED = (r"red\w*", r"water\w*|tear\w*", r"pain\w*", r"photophobia|light\s+sensitive|sensitivity\s+to\s+light|bright\s+light", r"blur\w*\s+vision|vision\s+blur\w*", r"discharge")
FUNDUS = (r"fundus|fundoscopy|ophthalmoscopy", r"dilat(e|ed|ion|ing)\s+(exam|eye|pupil)", r"retinal\s+photo|retina\s+photo|fundus\s+photo", r"oct|ffa|fluorescein\s+angiography")
EYE = r"\b(eye|ocular|cornea|iris|pupil|retina|conjunctiva|sclera|lens)\b"
ACRONYMS = "amd iop oct cnv dme erm pvd iol rd cscr faf ffa icga rpe onh pcv npdr pdr".split()
NOISE = (
    "patient question questions query context prior output rewrite rewritten keywords keyword clinical english only standalone search terms term include using what when where which this that "
    "there here from with into also have has had your you for and the to of is are be it differential diagnosis possible probable detected"
).split()
CANONICAL = {"retinal": "retina", "macular": "macula", "conjunctival": "conjunctiva", "corneal": "cornea", "lenticular": "lens", "watering": "tear", "tearing": "tear"}
POSTERIOR = "retina retinal fundus leukocoria roth roths vascular".split()
SEED_RISK = "cornea corneal infiltrate corneal ulcer infectious keratitis microbial keratitis red eye tearing pain photophobia surface lesion urgent ophthalmology"
SEED_SPOT = "leukocoria white pupillary reflex cataract corneal opacity corneal scar anterior segment pupil abnormality"
REFINED_RISK = "cornea corneal infiltrate corneal ulcer infectious keratitis microbial keratitis red eye tearing pain photophobia urgent ophthalmology"


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def triage_level(text: Column) -> Column:
    """emergency, urgent, leukocoria or none, in this order; null texts are none."""
    q = F.lower(F.coalesce(text, F.lit("")))
    inflamed, spot, surface = any_of(q, TRIAGE_INFLAMED), q.rlike(TRIAGE_SPOT), any_of(q, SURFACE)
    negated = q.rlike(NEGATED_BOTH) | (q.rlike(r"\b(no|without)\s+red\w*\b") & q.rlike(r"\b(no|without)\s+pain\w*\b"))
    urgent = (spot & inflamed & (any_of(q, TRIAGE_PLACE) | surface)) | (q.rlike(LENS) & q.rlike(LENS_SIGNS) & ~negated)
    return F.when(any_of(q, EMERGENCY), "emergency").when(urgent, "urgent").when(spot & (any_of(q, PUPIL) | surface) & ~inflamed, "leukocoria").otherwise("none")


def surface_profile(text: Column) -> dict[str, Column]:
    """What a question says about the visible surface; ``high_risk`` and ``surface_spot`` sum it up."""
    q = F.lower(F.coalesce(text, F.lit("")))
    spot, inflamed, place, fundus = any_of(q, SPOT), any_of(q, INFLAMED), any_of(q, (*PLACE, *SURFACE)), any_of(q, FUNDUS)
    eye = q.rlike(EYE)
    return {
        "spot": spot,
        "surface_location": place,
        "inflammation": inflamed,
        "fundus_context": fundus,
        "eye_reference": eye,
        "high_risk": ((spot & inflamed & (place | eye)) | (q.rlike(LENS) & inflamed & spot)) & ~fundus,
        "surface_spot": spot & (place | eye) & ~fundus,
    }


def mapped_query(raw: Column, candidate: Column, cap: int = 18) -> Column:
    """The search terms of a question with its candidate rewriting: seeds for risky surface signs, misleading terms dropped there."""
    own = surface_profile(raw)
    merged = F.concat_ws(" ", candidate, raw)
    clean = lambda c, banned=(): normalize_query(c, CANONICAL, NOISE, banned, ACRONYMS, cap)
    out = F.when(own["high_risk"], clean(F.concat_ws(" ", F.lit(SEED_RISK), merged), POSTERIOR)).when(own["surface_spot"], clean(F.concat_ws(" ", F.lit(SEED_SPOT), merged), POSTERIOR)).otherwise(clean(merged))
    return F.when(out != "", out).otherwise(clean(candidate))


def refined_query(raw: Column, rewrite: Column | None = None) -> Column:
    """Seeds where the surface is at risk or spotted, else ``rewrite`` (a model's; the question itself by default) if it is long enough."""
    own = surface_profile(raw)
    model = normalize_query(raw if rewrite is None else rewrite, CANONICAL, NOISE, (), ACRONYMS, 13)
    base = F.when(F.length(model) >= 5, model).otherwise(raw)
    return F.when(own["high_risk"], mapped_query(raw, F.lit(REFINED_RISK), 15)).when(own["surface_spot"], mapped_query(raw, F.lit(SEED_SPOT), 15)).otherwise(mapped_query(raw, base, 13))


def rewrite_input(question: Column, context: Column, probable: Column, translations: Column, facts: Column, memory: Column, history: Column) -> Column:
    """What a model is given to make a question stand alone: the session's context, probable findings of an image (array), what lay words
    mean and facts of structures (arrays), memory, and questions before (array; the question itself is left out). Nulls and empty parts are left out."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    part = lambda before, a, sep, after="": F.when(F.size(a) > 0, F.concat(F.lit(before), F.array_join(a, sep), F.lit(after))).otherwise("")
    earlier = F.filter(history, lambda q: q != question)
    said = F.when(text(memory) != "", F.concat(F.lit("\nPatient Memory:\n"), text(memory))).otherwise("")
    return F.concat(
        F.lit("Context:"), F.coalesce(context, F.lit("")), part(" [Image: ", probable, ", ", "]"), part("\nAnatomy Translation: ", translations, "; "),
        part("\nAnatomy Facts: ", F.slice(facts, 1, 2), " "), said, part("\nPrior Questions: ", earlier, " → "), F.lit("\nPatient: "), question,
    )


def rewritten_query(question: Column, answer: Column, terms: int = 12) -> Column:
    """A model's rewriting as a query of at most ``terms`` words, with the terms of the question's signs; the question where it is too short or null."""
    model = normalize_query(F.coalesce(answer, F.lit("")), CANONICAL, NOISE, (), ACRONYMS, terms)
    return mapped_query(question, F.when(F.length(model) >= 5, model).otherwise(question), terms)


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)")))


def tokens_fit(c: Column, required: Sequence[str], forbidden: Sequence[str]) -> Column:
    """All required tokens and none of the forbidden ones."""
    t = token_set(c)
    lits = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return (F.size(F.array_except(lits(required), t)) == 0) & ~F.arrays_overlap(lits(forbidden), t)


JUDGED = ("accuracy", "completeness", "safety", "clarity")


def judge_scores(c: Column) -> dict[str, Column]:
    """Scores of 1 to 5 that a judge's text names, and the mean of those present."""
    own = {d: F.regexp_extract(c, rf"(?i){d}:\s*([1-5])", 1).try_cast("int") for d in JUDGED}
    valid = F.filter(F.array(*own.values()), lambda x: x.isNotNull())
    mean = F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(valid), F.lit(0))
    return own | {"overall": F.round(mean, 2)}


def nli_label(entail: Column, contradict: Column) -> Column:
    """contradicted above .55, entailed from .45 where that is the top, else unverified."""
    return F.when(contradict > 0.55, "contradicted").when((entail >= 0.45) & (entail >= contradict), "entailed").otherwise("unverified")


def nli_verdict(entailed: Column, contradicted: Column, unverified: Column) -> Column:
    """A contradiction or more than .66 unverified fails, any unverified is partial."""
    total = F.greatest(entailed + contradicted + unverified, F.lit(1))
    return F.when((contradicted > 0) | (unverified / total > 0.66), "FAIL").when(unverified > 0, "PARTIAL").otherwise("PASS")


def with_disclaimer(answer: Column, verdict: Column, contradicted: Column, notices: Mapping[str, str]) -> Column:
    """The answer behind the notice of ``conflict``, ``unverified`` or ``partial``; passed answers stay."""
    kind = F.when(verdict == "PASS", "").when((verdict == "FAIL") & (contradicted > 0), notices["conflict"]).when(verdict == "FAIL", notices["unverified"]).otherwise(notices["partial"])
    return F.concat(kind, answer)


def split_response(c: Column, mark: str = "---DETAILS---") -> tuple[Column, Column]:
    """What stands before and after the mark, without labels of the parts."""
    label = r"(?i)^\s*\**(?:summary|details|answer)\**\s*:\s*\**\s*"
    part = lambda i: F.regexp_replace(F.regexp_replace(F.split_part(c, F.lit(mark), F.lit(i)), label, ""), r"^\s+|\s+$", "")
    return part(1), part(2)


def without_thoughts(c: Column) -> Column:
    """A model's text without its marked thoughts and check lists."""
    c = F.regexp_replace(c, r"(?is)<(thought|think)>.*?</\1>", "")
    c = F.regexp_replace(c, r"(?is)^.*?</(?:thought|think)>", "")
    return F.trim(F.regexp_replace(c, r"(?im)^\s*(?:constraint checklist|confidence score)\b.*$\n?", ""))


def real_time_factor(seconds: Column, duration: Column) -> Column:
    return F.coalesce(F.try_divide(seconds, duration), F.lit(0.0))


def adjusted_confidence(percent: Column, kind: Column) -> Column:
    """A finding's share plus a bonus for its kind, at most 1; null below .03 (to be dropped)."""
    p = F.least(percent / 100 + F.when(kind == "condition", 0.10).when(kind == "anatomy", -0.02).otherwise(0.0), F.lit(1.0))
    return F.when(p >= 0.03, p)


def first_entity(c: Column, dictionary: Sequence[tuple[str, str]], acronyms: Mapping[str, str]) -> Column:
    """The name of the first key that the text equals or stands in, else of the acronym, else the text in lower case."""
    t = F.lower(F.trim(c))
    out = t
    for short, name in acronyms.items():
        out = F.when(t == short, name).otherwise(out)
    for key, name in reversed(dictionary):
        out = F.when((t != "") & F.contains(F.lit(key), t), name).otherwise(out)
    return out


def lexicon_term(c: Column) -> Column:
    """A line as a term: blanks collapsed, bullets and numbers before it and punctuation around it gone; null unless of 3 to 80 characters."""
    t = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"^[\-*•\d.)\s]+", ""), r"^[ ,;:]+|[ ,;:]+$", "")
    return F.when(F.length(t).between(3, 80), t)


def trimmed_chapter(c: Column, anchors: Sequence[str], within: int = 3000) -> Column:
    """The text from the earliest anchor that begins within its first characters; all of it where none does."""
    places = [F.nullif(F.locate(a, F.substring(c, 1, within)), F.lit(0)) for a in anchors]
    at = F.least(*places) if len(places) > 1 else places[0]
    return F.when(at.isNotNull(), F.substr(c, at)).otherwise(c)


def plausible_page(html: Column, nav: Sequence[str], topic: Sequence[str], chars: int = 1200) -> Column:
    """Long enough, less than two words of navigation, four or more of the topic."""
    low = F.lower(html)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return (F.length(html) >= chars) & (hits(nav) < 2) & (hits(topic) >= 4)


def relevant(title: Column, text: Column, keywords: Sequence[str], chars: int = 2500) -> Column:
    """Any keyword in the title or the beginning of the text."""
    probe = F.lower(F.concat_ws(" ", title, F.substring(text, 1, chars)))
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(probe, k))
