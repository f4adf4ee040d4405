"""What a model is told for an answer: rules that follow from the question, and blocks of what is known, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safety import surface_profile

#: The line between the short and the full part of an answer; ``safety.split_response`` cuts there.
MARK = "---DETAILS---"
OPENING = "You answer questions about eyes, kindly and in plain words.\n\n"
#: Numbered rules that always hold; 6 has a form for evaluations.
RULES: dict[int, str] = {
    1: "Say it in everyday words; explain each medical term you need.",
    2: "Be kind and honest. Name possibilities, not a firm diagnosis.",
    3: "First the answer, then likely causes, then what to do and when to see a doctor; home care only for what seems mild.",
    4: "Name [Source N] where a fact stands in that source, and nowhere else.",
    5: "State nothing that the sources below do not say. If they don't answer the question, say so and send the reader to an eye doctor.",
    6: "Use 150 to 250 words.",
    7: "Use the clinical context where there is one.",
    8: "Go on from what was said before.",
    9: "Findings of an image support the sources; they are no diagnosis by themselves.",
    10: "Say of an image only what its findings and the sources bear out.",
    11: "Take a spot that can be seen from outside or in a mirror for one of the surface (cornea, conjunctiva, iris), unless there is evidence from the back of the eye.",
    12: "Don't bring up Roth spots or vessels of the retina: no examination of the back of the eye is mentioned.",
    13: "Don't explain a visible spot by the retina or its vessels without an examination of them.",
    14: "A white spot with signs of inflammation: put an infected cornea first and ask for an examination in person within 24 hours.",
    15: "Home care is not enough here; precautions may be named, the examination is the advice.",
    16: "The sources are on another part of the eye than the question: say so and suggest a specialist.",
    17: "Write all of it in {}.",
    18: f"Give one or two sentences that answer the main worry, then {MARK} on a line of its own, then the full explanation; no headings, no square brackets around text.",
}
CONCISE = "Use 40 to 90 words; with options, begin with 'Final choice:' and the letter, then one line why; no small talk unless there is danger."
CORRECTION = "\nThe answer before said what the sources do not support:\n{}\nLeave that out. State only what the sources say.\n"


def applied_rules(question: Column, mismatch: Column | None = None, language: Column | None = None) -> Column:
    """The numbers of the rules for a question, ascending: 12 to 15 follow from what it says of the surface, 16 from sources on another
    part, 17 from a language other than English (null is English)."""
    own = surface_profile(question)
    inside = own["fundus_context"]
    when = {12: ~inside, 13: own["spot"] & own["surface_location"] & ~inside, 14: own["high_risk"], 15: own["high_risk"]}
    when[16] = F.coalesce(mismatch, F.lit(False)) if mismatch is not None else F.lit(False)
    when[17] = F.coalesce(language, F.lit("English")) != "English" if language is not None else F.lit(False)
    return F.array_compact(F.array(*[F.when(when[n], F.lit(n)) if n in when else F.lit(n) for n in RULES]))


def mismatched(asked: Column, known: Column) -> Column:
    """Whether the structures of a question and those of its sources (arrays) are both known and have none in common."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(asked, none), F.coalesce(known, none)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def system_prompt(numbers: Column, profile: Column | None = None, facts: Column | None = None, language: Column | None = None, correction: Column | None = None, concise: bool = False, rules: dict[int, str] = RULES) -> Column:
    """Opening, what is known of a person, facts (array) and the numbered rules, and behind these what was wrong with an earlier answer."""
    none = F.lit(None).cast("string")
    own = rules | ({6: CONCISE} if concise else {})
    text = F.create_map(*[F.lit(x) for n, t in own.items() for x in (n, t)])
    lines = F.transform(numbers, lambda n: F.concat(n.cast("string"), F.lit(". "), F.replace(text[n], F.lit("{}"), F.coalesce(language if language is not None else none, F.lit("English")))))
    hints = F.when(F.size(facts) > 0, F.concat(F.lit("FACTS:\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"), F.lit("\n\n"))) if facts is not None else none
    wrong = F.nullif(F.trim(correction), F.lit("")) if correction is not None else none
    return F.concat(
        F.lit(OPENING), F.coalesce(profile if profile is not None else none, F.lit("")), F.coalesce(hints, F.lit("")), F.lit("RULES:\n"), F.array_join(lines, "\n"), F.lit("\n"),
        F.coalesce(F.concat(F.lit(CORRECTION.split("{}")[0]), wrong, F.lit(CORRECTION.split("{}")[1])), F.lit("")),
    )


def user_prompt(question: Column, context: Column, history: Column | None = None, blocks: Sequence[tuple[str, Column]] = (), findings: Column | None = None) -> Column:
    """History as it is, titled blocks, the question, findings of an image and the sources; blocks and findings that are null or blank are left out."""
    titled = [F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"\n{title}\n"), F.trim(c), F.lit("\n\n"))).otherwise("") for title, c in blocks]
    seen = F.when(F.coalesce(F.trim(findings), F.lit("")) != "", F.concat(F.lit("\n[FINDINGS OF THE IMAGE]\n"), findings, F.lit("\n"))).otherwise("") if findings is not None else F.lit("")
    before = F.coalesce(history, F.lit("")) if history is not None else F.lit("")
    return F.concat(before, *titled, F.lit("QUESTION:\n"), F.coalesce(question, F.lit("")), seen, F.lit("\n\nSOURCES:\n\n"), F.coalesce(context, F.lit("")))
