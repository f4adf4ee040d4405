"""Entities of a turn: what its image shows, what its words say and what a model found, merged, filtered, bridged and tagged.

The words are found by one automaton of the whole vocabulary; all that belongs to a turn then meets in its row, where one Arrow
function folds the entities of equal name and type, in the order image, words, model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notes import ENTITY_TYPES
from ..session import small_side
from .automaton import needle, phrase_hits
from .evidence import PRIORITIES, REGIONS

# Names that an image's findings use, their normal form, type and structure.
CONDITIONS = (
    ("drusen", "drusen", "finding", "retina"),
    ("age-related macular degeneration", "age-related macular degeneration", "condition", "macula"),
    ("amd", "age-related macular degeneration", "condition", "macula"),
    ("diabetic retinopathy", "diabetic retinopathy", "condition", "retina"),
    ("macular edema", "macular edema", "finding", "macula"),
    ("retinal hemorrhage", "retinal hemorrhage", "finding", "retina"),
    ("retinal detachment", "retinal detachment", "condition", "retina"),
    ("epiretinal membrane", "epiretinal membrane", "finding", "retina"),
    ("macular hole", "macular hole", "finding", "retina"),
    ("cataract", "cataract", "condition", "lens"),
    ("corneal opacity", "corneal opacity", "finding", "cornea"),
    ("pterygium", "pterygium", "condition", "conjunctiva"),
    ("glaucoma", "glaucoma", "condition", "optic nerve"),
    ("optic disc edema", "optic disc edema", "finding", "optic nerve"),
    ("uveitis", "uveitis", "condition", "uvea"),
    ("conjunctivitis", "conjunctivitis", "condition", "conjunctiva"),
)
# Short and full names of kinds of images.
IMAGING = {
    "OCT": "optical coherence tomography",
    "CFP": "color fundus photography",
    "FFA": "fluorescein angiography",
    "ICGA": "indocyanine green angiography",
    "FAF": "fundus autofluorescence",
    "slit lamp": "slit lamp biomicroscopy",
    "specular": "specular microscopy",
    "RetCam": "widefield retinal imaging",
}
# Words that place a finding.
PLACES = {
    "macula": ("macula", "macular", "fovea", "foveal", "central retina"),
    "peripheral_retina": ("peripheral", "mid-peripheral", "far peripheral", "ora serrata"),
    "optic_disc": ("optic disc", "optic nerve head", "ONH", "cup", "rim"),
    "anterior_chamber": ("anterior chamber", "AC", "angle", "trabecular"),
    "lens": ("lens", "crystalline", "anterior capsule", "posterior capsule"),
    "cornea": ("cornea", "corneal", "epithelium", "endothelium", "stroma"),
}
# Acronyms.
ACRONYMS = {
    "AMD": "age-related macular degeneration",
    "ARMD": "age-related macular degeneration",
    "DR": "diabetic retinopathy",
    "PDR": "proliferative diabetic retinopathy",
    "NPDR": "non-proliferative diabetic retinopathy",
    "RPE": "retinal pigment epithelium",
    "IOP": "intraocular pressure",
    "VEGF": "vascular endothelial growth factor",
    "CSC": "central serous chorioretinopathy",
    "CSR": "central serous retinopathy",
}
# Findings that are also reported as symptoms.
BRIDGES = (
    ("roth spot", "roth spots"),
    ("roth spots", "roth spots"),
    ("roth's spot", "roth spots"),
    ("roth's spots", "roth spots"),
    ("white spot", "white spot"),
    ("white spots", "white spots"),
    ("cotton wool spots", "cotton wool spots"),
)
# What stands before an entity that a text denies.
DENIALS = ("no ", "without ", "absent ", "negative for ", "rules out ", "exclude ", "no evidence of ", "not consistent with ")
#: What the word before a finding adds to its share, and the least share that counts.
SURENESS = {"probable": 0.10, "possible": -0.02}
NOISE = 0.03
FINDING = re.compile(r"[●○\-*]\s*(Probable|Possible|Detected):\s*([^(\n]+?)\s*\(([\d.]+)%\)", re.I)
IMAGE = re.compile(r"Detected Image Type:\s*([^\n\r]+)", re.I)
TYPES = ("anatomy", "condition", "symptom", "procedure", "imaging", "medication", "finding")
ENTITY = "struct<text:string,type:string,confidence:double,source:string,turn:bigint,normalized:string,modality:string,place:string,region:string,priority:string>"
FIELDS = tuple(x.split(":")[0] for x in ENTITY[7:-1].split(","))
KNOWN = {row[0]: row for row in CONDITIONS}
Entity = dict


def entity(text: str, kind: str, confidence: float, source: str, turn: int | None, normalized: str | None = None, modality: str | None = None, place: str | None = None) -> Entity:
    return dict(zip(FIELDS, (text, kind, confidence, source, turn, normalized, modality, place, "unspecified", "routine"), strict=True))


def first_group(text: str, groups: Mapping[str, Sequence[str]]) -> str | None:
    """The first group one of whose words the text holds."""
    return next((g for g, words in groups.items() if any(w in text for w in words)), None)


def normal_form(text: str, kind: str) -> str:
    """The normal form of the first condition's or finding's name that the text is or stands in, else of an acronym, else the text in lower case."""
    low = text.lower()
    known = next((row[1] for row in CONDITIONS if low in row[0]), None) if kind in ("condition", "finding") else None
    return known or ACRONYMS.get(text.upper()) or low.strip()


def shown(findings: str, turn: int | None) -> list[Entity]:
    """Entities of the text of an image's findings: the kind of image, then its findings with their places."""
    out, label, modality = [], IMAGE.search(findings), None
    if label and label[1].strip():
        low = label[1].strip().lower()
        modality = next((full for short, full in IMAGING.items() if short.lower() in low or full in low), low)
        out.append(entity(modality, "imaging", 0.95, "visual", turn))
    for how, name, share in FINDING.findall(findings):
        try:
            confidence = min(float(share) / 100 + SURENESS.get(how.lower(), 0.0), 1.0)
        except ValueError:  # more than one point
            continue
        if confidence < NOISE:
            continue
        known = KNOWN.get(name.strip().lower())
        text, kind, spot = known[1:] if known else (name.strip().lower(), "finding", None)
        out.append(entity(text, kind, confidence, "visual", turn, known and text, modality, first_group(text.lower(), PLACES) or spot))
    return out


def said(answer: str | None, source: str, turn: int | None, least: float) -> list[Entity] | None:
    """Entities of a model's answer, from the first ``[`` to the last ``]``, else of its first object; null where none can be read."""
    held = re.search(r"\[.*\]", answer or "", re.S) or re.search(r"\{.*?\}", answer or "", re.S)
    try:
        rows = json.loads(held[0] if held[0].startswith("[") else f"[{held[0]}]") if held else None
    except ValueError:
        return None
    if rows is None:
        return None
    out = []
    for x in rows:
        text, c = (x.get("text"), x.get("confidence", 0)) if isinstance(x, dict) else (None, None)
        if not isinstance(text, str) or not isinstance(c, int | float) or c < least:
            continue
        kind = str(x.get("entity_type") or "finding").lower()
        kind = ENTITY_TYPES.get(kind, kind if kind in TYPES else "finding")
        out.append(entity(text, kind, float(c), source, turn, normal_form(text, kind)))
    return out


def merged(a: Entity, b: Entity) -> Entity:
    """One of two entities of a name: the surer (``a`` of equals) with a weighted confidence and what only the other knows."""
    base, other = (a, b) if a["confidence"] >= b["confidence"] else (b, a)
    share = 0.7 if base["source"] == "visual" and other["source"] == "answer" else 0.6
    out = base | {f: base[f] or other[f] for f in ("normalized", "modality", "place")}
    out |= {f: base[f] if base[f] != blank else other[f] for f, blank in (("region", "unspecified"), ("priority", "routine"))}
    turns = [x["turn"] for x in (a, b) if x["turn"] is not None]
    return out | {"confidence": min(share * base["confidence"] + (1 - share) * other["confidence"], 1.0), "source": "merged", "turn": max(turns, default=None)}


def name_of(e: Entity) -> str:
    return e["normalized"] or e["text"].lower()


def folded(image: Iterable[Entity], spoken: Iterable[Entity]) -> list[Entity]:
    """One entity for each name and type, in the order in which they come first.

    Of an image's the last counts; a spoken symptom replaces, a sure finding of the image grows by .05, all others are merged.
    """
    held = {(name_of(e), e["type"]): e for e in image}
    for e in spoken:
        key = name_of(e), e["type"]
        old = held.get(key)
        if old is None or e["type"] == "symptom":
            held[key] = e
        elif e["type"] == "finding" and old["confidence"] > 0.7:
            held[key] = old | {"confidence": min(old["confidence"] + 0.05, 1.0)}
        else:
            held[key] = merged(old, e)
    return list(held.values())


def denied(low: str, name: str) -> bool:
    return any(d + name.lower() in low for d in DENIALS)


def bridged(entities: list[Entity], turn: int | None) -> list[Entity]:
    """The entities, and the symptoms that their findings are, unless they are among them."""
    out, held = list(entities), {name_of(e) for e in entities if e["type"] == "symptom"}
    for e in entities:
        alias = next((symptom for finding, symptom in BRIDGES if finding in name_of(e).strip()), None) if e["type"] == "finding" else None
        if alias is not None and alias not in held:
            c = max(0.78, min(0.88, e["confidence"] * 0.95))
            out.append(entity(alias, "symptom", c, f"{e['source']}_bridge", turn, alias) | {f: e[f] for f in ("region", "priority")})
            held.add(alias)
    return out


def with_tags(e: Entity) -> Entity:
    """Region by the text, else by the structure of its condition; priority by the text."""
    low = e["text"].lower()
    known = KNOWN.get(low)
    region = first_group(low, REGIONS) or (known and first_group(known[3], REGIONS)) or e["region"]
    return e | {"region": region, "priority": first_group(low, PRIORITIES) or e["priority"]}


def of_turn(text: str | None, turn: int | None, source: str | None, findings: str | None, answer: str | None, words: list[dict], plain: list[dict], least: float) -> list[Entity]:
    """All entities of one turn; see ``extract``."""
    source = source or ""
    spoken = [entity(w["name"], w["type"], w["confidence"], source, turn, normal_form(w["name"], w["type"])) for w in words]
    model = said(answer, source, turn, least)
    spoken += [entity(w["name"], w["type"], 0.6, "fallback", turn) for w in plain] if model is None else model
    low = (text or "").lower()
    kept = [e for e in folded(shown(findings or "", turn), spoken) if e["confidence"] >= least and not denied(low, e["text"])]
    return [with_tags(e) for e in bridged(kept, turn)]


def extract(turns: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", turn: str = "turn", source: str = "source", findings: str | None = None, answer: str | None = None, least: float = 0.5) -> DataFrame:
    """``key, no`` and the fields of each entity of each row of ``turns`` (whose ``key`` is its own), in order.

    ``vocabulary``: term (words; a final ``*`` leaves the end open), name, type, confidence, template. Terms give rule entities
    with the highest confidence of a name and type. Where ``answer`` (a model's JSON) can't be read, or there is none, names that are
    templates count with .6 wherever they stand. Entities below ``least`` and those that the text denies go; findings are
    bridged to symptoms. Nulls: no text, no findings, no answer.
    """
    v = vocabulary.select(needle("term").alias("needle"), "name", "type", "confidence")
    hits = phrase_hits(turns, [key], text, vocabulary, "term").join(small_side(v), "needle")
    named = hits.groupBy(key, F.lower("name").alias("low"), "type").agg(F.max(F.struct("confidence", "name")).alias("best"))
    words = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("low", "type", F.col("best.name").alias("name"), F.col("best.confidence").alias("confidence")))).alias("_words"))
    templates = vocabulary.where("template").select(F.lower("name").alias("needle"), "name", "type").distinct()
    plain = phrase_hits(turns, [key], text, templates, "needle", words=False).join(small_side(templates), "needle")
    plain = plain.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("type", "name"))).alias("_plain"))
    entities_kind = f"array<{ENTITY}>"
    listed = pa.list_(pa.struct([(f, {"confidence": pa.float64(), "turn": pa.int64()}.get(f, pa.string())) for f in FIELDS]))

    @F.arrow_udf(entities_kind)
    def judge(text: pa.Array, turn: pa.Array, source: pa.Array, findings: pa.Array, answer: pa.Array, words: pa.Array, plain: pa.Array) -> pa.Array:
        columns = [c.to_pylist() for c in (text, turn, source, findings, answer, words, plain)]
        return pa.array([of_turn(t, n, s, f, a, w or [], p or [], least) for t, n, s, f, a, w, p in zip(*columns, strict=True)], listed)

    optional = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    rows = turns.select(key, F.col(text).alias("_text"), F.col(turn).cast("long").alias("_turn"), F.col(source).alias("_source"), optional(findings).alias("_findings"), optional(answer).alias("_answer")).join(words, key, "left").join(plain, key, "left")
    found = rows.select(key, judge("_text", "_turn", "_source", "_findings", "_answer", "_words", "_plain").alias("_found"))
    return found.select(key, F.posexplode("_found").alias("no", "e")).select(key, F.col("no").cast("long").alias("no"), "e.*")


def to_json(e: Column) -> Column:
    """An entity as a JSON object, with its empty fields."""
    return F.to_json(e, {"ignoreNullFields": "false"})


def from_json(c: Column) -> Column:
    """An entity of a JSON object; region and priority have defaults, and one without a text or of no known type is null."""
    e = F.from_json(c, ENTITY)
    default = {"region": "unspecified", "priority": "routine"}
    whole = F.struct(*[(F.coalesce(e[f], F.lit(default[f])) if f in default else e[f]).alias(f) for f in FIELDS])
    return F.when(e["text"].isNotNull() & e["type"].isin(*TYPES), whole)


def templates(structures: DataFrame, symptoms: Sequence[str], medications: Sequence[str], procedures: Sequence[str], anatomy: Sequence[str] = ()) -> DataFrame:
    """``name, type`` of the templates: structures (``structure``, underscores as blanks) and words of anatomy, known conditions and findings,
    kinds of images, and the lists given."""
    fixed = [(n, "anatomy") for n in anatomy] + [(row[1], row[2]) for row in CONDITIONS] + [(n, "imaging") for n in IMAGING.values()]
    fixed += [(n, kind) for kind, names in (("symptom", symptoms), ("medication", medications), ("procedure", procedures)) for n in names]
    named = structures.select(F.replace("structure", F.lit("_"), F.lit(" ")).alias("name"), F.lit("anatomy").alias("type"))
    return named.unionByName(structures.sparkSession.createDataFrame(fixed, "name string, type string")).distinct()
