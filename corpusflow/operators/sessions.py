"""Conversation state: one pure transition of a session's state, folded in turn order.

``transition`` is what the batch fold and the stream share.  State of a slot: value, confidence, evidence, last turn; a new
value must be confirmed by a second sighting or a clear margin; what is not seen decays each turn and is dropped at last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import context_light

#: Fixed values of the state machine.
ADMIT, DROP, FLOOR, RATE = 0.3, 0.15, 0.1, 0.1
IMMEDIATE, HITS, PENDING_TURNS, PENDING_LEAST = 0.75, 2, 2, 0.35
MARGIN, SURE = 0.15, 0.2
KEEP_PENDING = 3
#: Turns without an admitted entity after which a session begins anew; slots that are all below ``FAINT`` end it too.
IDLE_TURNS, FAINT = 15, 0.2
#: Kinds that an image gives, and how many terms of each kind a context names.
FROM_IMAGE = ("finding",)
TERMS = {"condition": 3, "finding": 4, "symptom": 4, "medication": 3, "procedure": 3}
SLOTS = ("anatomy", "condition")
#: The margin by which another condition must exceed the first, how many others are kept, and how sure one seen once must stay.
CONDITION_MARGIN, OTHERS, LONE = 0.2, 5, 0.5
#: What an image says is admitted from here on; a region needs this sum of confidences.
ADMIT_VISUAL, REGION_LEAST = 0.05, 0.5
#: Priorities from the least to the most urgent.
PRIORITY_ORDER = ("routine", "C", "B", "A")


def empty_state() -> dict:
    return {"turn": 0, "active": 0, "slots": {}, "others": [], "shift": {}, "items": {}, "pending": {}, "history": [], "drift": False, "region": None, "priority": "routine"}


def reinforce(s: dict, confidence: float, turn: int) -> None:
    alpha = 0.25 if s["n"] >= 2 else 0.4
    s["c"] = min(1.0, (1 - alpha) * s["c"] + alpha * confidence)
    s["n"], s["last"] = min(s["n"] + 1, 8), turn


def fade(c: float, turns: int) -> float:
    return max(c * (1 - RATE) ** turns, FLOOR) if turns > 0 else c


def sight(pending: dict, key: str, confidence: float, turn: int) -> dict:
    """Stage a sighting; one more than two turns old begins anew."""
    p = pending.get(key)
    if p is None or turn - p["last"] > PENDING_TURNS:
        p = pending[key] = {"c": confidence, "hits": 1, "first": turn, "last": turn}
    else:
        p["c"], p["hits"], p["last"] = 0.7 * p["c"] + 0.3 * confidence, p["hits"] + 1, turn
    return p


def confirmed(state: dict, slot: str, value: str, confidence: float, turn: int, margin: float) -> bool:
    """Whether another value may take a slot: surer by the margin and ``SURE`` at once, or by the margin on its second sighting.

    One value waits for each slot; another one, or one that is more than two turns old, begins anew.
    """
    p = state["shift"].get(slot)
    if p and p["value"] == value and turn - p["last"] <= PENDING_TURNS:
        p["c"], p["hits"], p["last"] = 0.7 * p["c"] + 0.3 * confidence, p["hits"] + 1, turn
    else:
        p = state["shift"][slot] = {"value": value, "c": confidence, "hits": 1, "last": turn}
    cur = state["slots"][slot]
    now = fade(cur["c"], turn - cur["last"])
    if confidence >= now + (margin + SURE) or (p["hits"] >= HITS and p["c"] >= now + margin):
        del state["shift"][slot]
        return True
    return False


def fresh(value: str, confidence: float, turn: int) -> dict:
    return {"value": value, "c": confidence, "n": 2 if confidence >= 0.6 else 1, "last": turn}


def see_anatomy(state: dict, value: str, c: float, turn: int) -> None:
    cur = state["slots"].get("anatomy")
    if cur is None:
        state["slots"]["anatomy"] = fresh(value, c, turn)
    elif cur["value"] == value:
        reinforce(cur, c, turn)
        state["shift"].pop("anatomy", None)
    elif confirmed(state, "anatomy", value, c, turn, MARGIN):
        state["slots"]["anatomy"] = {"value": value, "c": c, "n": 2, "last": turn}
        state["drift"] = True


def see_condition(state: dict, value: str, c: float, turn: int) -> None:
    """The first condition is reinforced; another one waits among the last ``OTHERS`` until it may take the first one's place."""
    cur, others = state["slots"].get("condition"), state["others"]
    if cur and cur["value"] == value:
        reinforce(cur, c, turn)
        state["shift"].pop("condition", None)
        return
    own = next((o for o in others if o["value"] == value), None)
    if own:
        reinforce(own, c, turn)
        if cur and confirmed(state, "condition", value, own["c"], turn, CONDITION_MARGIN):
            state["others"] = [*(o for o in others if o["value"] != value), cur]
            state["slots"]["condition"] = own
        return
    new = fresh(value, c, turn)
    if cur is None or confirmed(state, "condition", value, c, turn, CONDITION_MARGIN):
        state["slots"]["condition"] = new
        others += [cur] if cur else []
    else:
        others.append(new)
    state["others"] = others[-OTHERS:]


def see_imaging(state: dict, value: str, c: float, turn: int) -> None:
    """Another kind of image takes the slot at once; short names are written in capitals."""
    value = value.upper() if len(value) <= 5 else value.lower()
    cur = state["slots"].get("imaging")
    if cur and cur["value"] == value:
        reinforce(cur, c, turn)
    else:
        state["slots"]["imaging"] = {"value": value, "c": c, "n": 1, "last": turn}


SEEN = {"anatomy": see_anatomy, "condition": see_condition, "imaging": see_imaging}


def transition(state: dict, turn: int, entities: list[tuple]) -> dict:
    """The state after the entities of a turn: type, value, confidence, and where known source, region and priority.

    One of type ``image`` is a new image. What an image says (source ``visual``) is admitted from ``ADMIT_VISUAL`` on, all else from ``ADMIT``.
    """
    if should_reset(state, turn):
        state = empty_state()
    state["turn"] = turn
    votes: dict[str, float] = {}
    for kind, value, c, *more in entities:
        source, region, priority = (*more, None, None, None)[:3]
        if region and region != "unspecified":
            votes[region] = votes.get(region, 0.0) + c
        if priority in PRIORITY_ORDER and PRIORITY_ORDER.index(priority) > PRIORITY_ORDER.index(state["priority"]):
            state["priority"] = priority
        if kind == "image":
            reset_for_image(state)
            state["active"] = turn
        if kind == "image" or c < (ADMIT_VISUAL if source == "visual" else ADMIT):
            continue
        state["active"] = turn
        if kind in SEEN:
            SEEN[kind](state, value, c, turn)
        else:
            key = f"{kind}:{value}"
            if key in state["items"]:
                reinforce(state["items"][key], c, turn)
            elif c >= IMMEDIATE:
                state["items"][key] = {"value": value, "c": c, "n": 2, "last": turn}
            else:
                p = sight(state["pending"], key, c, turn)
                if p["hits"] >= HITS and p["c"] >= PENDING_LEAST:
                    state["items"][key] = {"value": value, "c": p["c"], "n": p["hits"], "last": turn}
                    del state["pending"][key]
    # decay is written back each turn while the last turn stays, so idle turns compound
    for box in ("slots", "items"):
        for key, s in list(state[box].items()):
            s["c"] = fade(s["c"], turn - s["last"])
            if s["c"] < DROP or (box == "items" and s["n"] < 2 and s["c"] < 0.55):
                del state[box][key]
    for o in state["others"]:
        o["c"] = fade(o["c"], turn - o["last"])
    state["others"] = [o for o in state["others"] if o["c"] >= DROP and (o["n"] >= 2 or o["c"] >= LONE)]
    for box in ("pending", "shift"):
        state[box] = {k: p for k, p in state[box].items() if turn - p["last"] <= KEEP_PENDING}
    best = max(sorted(votes), key=votes.get, default=None)
    if best is not None and votes[best] > REGION_LEAST:
        state["region"] = best
    topic = state["slots"].get("condition", state["slots"].get("anatomy"))
    if topic:
        if state["history"] and state["history"][-1] != topic["value"]:
            state["drift"] = True
        state["history"] = [*state["history"], topic["value"]][-10:]
    return state


def should_reset(state: dict, turn: int) -> bool:
    """Idle for too long, or all that is known of the slots is faint."""
    if not state["turn"]:
        return False
    slots = [state["slots"][k] for k in SLOTS if k in state["slots"]]
    return turn - state["active"] > IDLE_TURNS or (len(slots) == len(SLOTS) and all(s["c"] < FAINT for s in slots))


def reset_for_image(state: dict) -> None:
    """Forget what an earlier image gave; what the patient reported stays."""
    state["slots"], state["others"], state["shift"], state["drift"] = {}, [], {}, False
    for box in ("items", "pending"):
        state[box] = {k: v for k, v in state[box].items() if k.split(":", 1)[0] not in (*FROM_IMAGE, *SLOTS)}


def stable(s: dict, threshold: float = 0.4) -> bool:
    return s["c"] >= 0.65 or (s["c"] >= threshold and s["n"] >= 2)


def has_context(state: dict, threshold: float = 0.4, provisional: float | None = None) -> bool:
    """Whether anything is stable; with ``provisional`` a pending sighting of that confidence will do."""
    known = [*state["slots"].values(), *state["items"].values()]
    return any(stable(s, threshold) for s in known) or (provisional is not None and any(p["c"] >= provisional for p in state["pending"].values()))


def context_terms(state: dict) -> list[str]:
    """The slots and the surest stable items of each kind, as many as ``TERMS`` allows, for retrieval."""
    out = [state["slots"][k]["value"] for k in SLOTS if k in state["slots"] and stable(state["slots"][k], 0.35)]
    for kind, most in TERMS.items():
        own = [s for k, s in state["items"].items() if k.split(":", 1)[0] == kind and stable(s, 0.35)]
        out += [s["value"] for s in sorted(own, key=lambda s: -s["c"])[:most]]
    return list(dict.fromkeys(out))


def provisional(state: dict, least: float = 0.55, most: int = 3) -> dict[str, list[str]]:
    """What waits and may already be used, surest first: of each kind of item ``most``, and what waits for an empty slot."""
    ready = lambda p: p["c"] >= least
    out: dict[str, list[str]] = {k: [state["shift"][k]["value"]] for k in SLOTS if k not in state["slots"] and k in state["shift"] and ready(state["shift"][k])}
    for kind in ("finding", "symptom", "medication", "procedure"):
        own = sorted(((p["c"], p["hits"], p["last"], k.split(":", 1)[1]) for k, p in state["pending"].items() if k.split(":", 1)[0] == kind and ready(p)), key=lambda p: p[:3], reverse=True)
        if own:
            out[kind] = [p[3] for p in own[:most]]
    return out


def generation_context(state: dict, facts: Mapping[str, str] = {}, least: float | None = 0.45) -> str:
    """The state as lines for a model, surest facts of the slots last; ``least`` is the confidence from which waiting values are told, None for none.

    ``facts``: a sentence for a name in lower case with underscores. Empty where nothing is known.
    """
    slots, sure = state["slots"], lambda s: f"{s['value']} ({s['c']:.2f})"
    slot = lambda k, title: [f"{title}: {slots[k]['value']} (confidence: {slots[k]['c']:.2f})"] if k in slots else []
    line = lambda title, values: [f"{title}: {', '.join(values)}"] if values else []
    items = lambda kind, show: [show(s) for k, s in state["items"].items() if k.split(":", 1)[0] == kind and stable(s, 0.4)]
    own = line("Region of the eye", [state["region"]] if state["region"] else []) + line("Priority", [state["priority"].upper()] if state["priority"] != "routine" else [])
    own += slot("anatomy", "Part of the eye") + slot("condition", "Main condition") + line("Other conditions", [sure(o) for o in state["others"] if o["c"] > 0.4])
    own += line("Symptoms", items("symptom", sure)) + line("Findings", items("finding", sure))
    own += line("Medications", items("medication", lambda s: s["value"])) + line("Procedures", items("procedure", lambda s: s["value"]))
    own += line("Imaging", [slots["imaging"]["value"]] if "imaging" in slots else [])
    if least is not None:
        waiting = provisional(state, least)
        for kind in (*SLOTS, "finding", "symptom", "medication", "procedure"):
            own += line(f"Possible {kind}", waiting.get(kind, []))
    own += ["The topic has changed."] if state["drift"] else []
    known = [facts.get(slots[k]["value"].replace(" ", "_").lower()) for k in SLOTS if k in slots and slots[k]["c"] > 0.6]
    return "\n".join(own + ([f"Facts: {' '.join(list(dict.fromkeys(f for f in known if f))[:2])}"] if any(known) else []))


SNAPSHOT = "conv_id bigint, turn bigint, topic string, confidence double, items bigint, pending bigint, drift boolean, others string, imaging string, region string, priority string"


def snapshot(conv_id: int, state: dict) -> dict:
    s = state["slots"].get("condition", state["slots"].get("anatomy"))
    return {
        "conv_id": conv_id, "turn": state["turn"], "topic": s["value"] if s else None, "confidence": round(s["c"], 6) if s else None,
        "items": len(state["items"]), "pending": len(state["pending"]), "drift": state["drift"], "others": ",".join(o["value"] for o in state["others"]),
        "imaging": state["slots"]["imaging"]["value"] if "imaging" in state["slots"] else None, "region": state["region"], "priority": state["priority"],
    }


def said(e) -> tuple:
    """An entity (type, value, confidence, and where the table has them source, region, priority) as ``transition`` takes it."""
    e = e if isinstance(e, dict) else e.asDict()
    return (e["type"], e["value"], e["confidence"], *(e.get(k) for k in ("source", "region", "priority")))


def fold(turns: DataFrame, shown: Callable[[int, dict], dict] = snapshot, schema: str = SNAPSHOT) -> DataFrame:
    """What ``shown`` makes of the state after each turn of rows (conv_id, turn, entities array<struct<type,value,confidence>>, whose structs may have
    source, region and priority); tasks stream sorted turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, empty_state()
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.conv_id != conv:
                    conv, state = r.conv_id, empty_state()
                state = transition(state, int(r.turn), [said(e) for e in r.entities])
                out.append(shown(conv, state))
            yield pd.DataFrame(out)

    own = turns.select("conv_id", "turn", "entities").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return own.mapInPandas(run, schema)


def contexts(turns: DataFrame, facts: Mapping[str, str] = {}) -> DataFrame:
    """conv_id, turn, context: the state after each turn as lines for a model."""
    show = lambda conv, state: {"conv_id": conv, "turn": state["turn"], "context": generation_context(state, facts)}
    return fold(turns, show, "conv_id bigint, turn bigint, context string")


def history(turns: DataFrame, light: Column) -> DataFrame:
    """Each user turn with the last turn before it that says something, and its last three texts."""
    own = turns.where("role = 'user'").select("conv_id", "turn", "text", light.alias("light"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return own.withColumns(
        {
            "last_substantive": F.last(F.when(~F.col("light"), F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "recent": F.array_join(F.collect_list("text").over(w.rowsBetween(-2, Window.currentRow)), " | "),
        }
    )


def topic_drift(turns: DataFrame, label: Column) -> DataFrame:
    """Label of each turn, carried forward, and whether it differs from the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.select("conv_id", "turn", F.last(label, ignorenulls=True).over(w).alias("topic"))
    return own.withColumn("drift", F.coalesce(F.lag("topic").over(w) != F.col("topic"), F.lit(False)))


def interleave(lists: DataFrame, key: str, cap: int = 28) -> DataFrame:
    """Round robin over token lists (key, list_no, tokens): the first of equals, at most ``cap``."""
    own = lists.select(key, "list_no", F.posexplode("tokens").alias("pos", "token"))
    first = own.groupBy(key, "token").agg(F.min(F.struct("pos", "list_no")).alias("at"))
    w = Window.partitionBy(key).orderBy("at")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= cap).select(key, "place", "token")


def light_turn(text: Column) -> Column:
    return context_light(text, cues=("and", "the"), vague=("it", "that", "this"))
