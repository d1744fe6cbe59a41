"""The master plan as files: one JSON object and one script for editors.

A plan is a page or two whatever the number of comments: its parts are short by their operators (a card, five acts with a few cards each, an arc for each
player, some points and titles) and are gathered to be written.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import phrases as P
from ..operators import package as G
from .sinks import write_file

# How a plan's files name the fields of a card.
CARD_NAMES = {
    "role": "role",
    "comment_id": "comment_id",
    "text": "text",
    "author": "author",
    "likes": "likes",
    "category": "category",
    "emotion": "emotion_strength",
    "priority": "priority_score",
    "players": "detected_players",
    "caption": "suggested_caption",
    "usage": "recommended_usage",
    "segment": "matched_segment_id",
    "low": "matched_start",
    "high": "matched_end",
    "confidence": "matching_confidence",
    "manual": "needs_manual_timestamp_mapping",
}


def card(row: Row | None) -> dict[str, Any] | None:
    return None if row is None else {name: _plain(row[field]) for field, name in CARD_NAMES.items()}


def _plain(value: Any) -> Any:
    """What JSON can hold: decimals as numbers."""
    return float(value) if type(value).__name__ == "Decimal" else value


def document(plan: dict[str, DataFrame], records: DataFrame, players: list[str], video: str = "", title: str = "") -> dict[str, Any]:
    """The parts of package.master_plan in the order of a plan's file; acts without comments are there with none.  records: the plan's."""
    first = lambda name: next(iter(plan[name].select("card").collect()), None)
    meta = plan["meta"].first()
    acts, bridges = plan["acts"].collect(), plan["bridges"].orderBy("act", "rank").collect()
    wanted = [(r.anchor, "anchor") for r in acts] + [(r.comment_id, "bridge") for r in bridges]
    ids = records.sparkSession.createDataFrame(wanted, f"_id {records.schema['comment_id'].dataType.simpleString()}, _role string")  # a few for each act
    found = records.join(F.broadcast(ids), records["comment_id"] == ids["_id"]).select("_role", G.card("anchor").alias("card")).collect()
    cards = {(r["_role"], r.card.comment_id): card(r.card) | {"role": r["_role"]} for r in found}
    shares: dict[str, list[tuple[int, str]]] = {}
    for r in plan["categories"].collect():
        shares.setdefault(r.act, []).append((-r.n, r.category))
    by_act = {r.act: r for r in acts}

    def act(name: str) -> dict[str, Any]:
        own, label = by_act.get(name), P.ACT_LABELS[name]
        return {
            "act_id": name, "act_name": label["name"], "emoji": label["emoji"], "description": label["text"], "comment_count": own.n if own else 0,
            "anchor_comment": cards.get(("anchor", own.anchor)) if own else None, "bridge_comments": [cards["bridge", r.comment_id] for r in bridges if r.act == name],
            "category_distribution": {c: -n for n, c in sorted(shares.get(name, []))},
        }

    def arc(r: Row) -> dict[str, Any]:
        counts = dict(x[:-1].rsplit("(", 1) for x in r.categories)
        return {"player": r.player, "comment_count": r.n, "sentiment_arc": r.arc, "category_distribution": {c: int(n) for c, n in counts.items()}, "top_comments": [card(c) for c in r.top], "peak_moment": card(r.peak)}

    arcs = {r.player: arc(r) for r in plan["player_arcs"].collect()}
    opening, closing = first("opening_hook"), first("closing_note")
    return {
        "meta": {"video_id": video, "video_title": title, "total_comments_used": meta.total_comments_used, "player_names": players, "inferred_from_comments": True, "needs_manual_sequence_review": meta.needs_manual_sequence_review, "note": meta.note},
        "opening_hook": card(opening.card) if opening else None,
        "acts": [act(name) for name in P.ACT_LABELS] if meta.total_comments_used else [],
        "player_arcs": [arcs[p] for p in players if p in arcs],
        "turning_points": [card(r.card) | {"narrative_weight": r.weight} for r in plan["turning_points"].collect()],
        "closing_note": card(closing.card) if closing else None,
        "key_event_keywords": [r.event for r in plan["key_event_keywords"].collect()],
        "title_suggestions": [r.title for r in plan["title_suggestions"].orderBy("place").collect()],
    }


def script(plan: dict[str, Any]) -> str:
    """A plan's document as Markdown for editors."""
    S, meta = P.SCRIPT, plan["meta"]
    mark = lambda c: S["manual"] if c["needs_manual_timestamp_mapping"] else S["sure"]
    said = lambda c, n: f"> {c['text'][:n]}"
    by = lambda c: f"— *{c['author']}* ({c['likes']} likes)"
    listed = lambda c, n: f"- [{c['category']}] {c['text'][:n]}…  _{c['author']}_ ({c['likes']}L) {mark(c)}"
    shares = lambda x: "  |  ".join(f"{c}: {n}" for c, n in x.items())
    rule = ["", "---", ""]

    def framed(c: dict[str, Any], heading: str) -> list[str]:
        return [heading, "", said(c, 150), by(c) + "  ", f"{S['category']}: **{c['category']}**  |  {S['score']}: **{c['priority_score']}**  ", f"{S['caption']}: _{c['suggested_caption']}_  ", f"{S['usage']}: `{c['recommended_usage']}`  ", S["check"] if c["needs_manual_timestamp_mapping"] else S["checked"], *rule]

    out = [S["title"], "", f"**{S['video']}:** {meta['video_title']}  ", f"**Video ID:** `{meta['video_id']}`  ", f"**{S['players']}:** {', '.join(meta['player_names']) or S['no_players']}  ", f"**{S['used']}:** {meta['total_comments_used']}  ", "", *(f"> {x}" for x in S["warning"]), *rule]
    if plan["title_suggestions"]:
        out += [S["titles"], "", *(f"{i}. {t}" for i, t in enumerate(plan["title_suggestions"], 1)), *rule]
    if plan["opening_hook"]:
        out += framed(plan["opening_hook"], S["opening"])
    if plan["acts"]:
        out += [S["acts"], ""]
    for a in plan["acts"]:
        out += [f"### {a['emoji']} {a['act_name']}", "", f"_{a['description']}_  ", f"{S['related']}: **{a['comment_count']}개**", ""]
        if a["category_distribution"]:
            out += [f"{S['shares']}: {shares(a['category_distribution'])}", ""]
        if c := a["anchor_comment"]:
            out += [S["anchor"], "", said(c, 120), f"{by(c)} · {c['category']} · score {c['priority_score']} {mark(c)}", f"{S['caption']}: _{c['suggested_caption']}_", ""]
        if a["bridge_comments"]:
            out += [S["bridges"], "", *(listed(c, 80) for c in a["bridge_comments"]), ""]
        out += rule[1:]
    if plan["turning_points"]:
        cells = lambda c: (c["narrative_weight"], c["category"], c["likes"], c["priority_score"], c["text"][:70].replace("|", "｜") + "…", mark(c))
        out += [S["points"], "", *S["points_head"], *("| " + " | ".join(map(str, cells(c))) + " |" for c in plan["turning_points"]), *rule]
    if plan["player_arcs"]:
        out += [S["arcs"], ""]
    for a in plan["player_arcs"]:
        out += [f"### {a['player']}", "", f"- {S['arc_n']}: **{a['comment_count']}개**", f"- {S['arc']}: **{a['sentiment_arc']}**", f"- {S['shares']}: {shares(a['category_distribution'])}"]
        if c := a["peak_moment"]:
            out += ["", S["peak"], said(c, 120), f"{by(c)} · score {c['priority_score']} {mark(c)}"]
        if a["top_comments"]:
            out += ["", S["top"], "", *(listed(c, 70) for c in a["top_comments"])]
        out += rule
    if plan["closing_note"]:
        out += framed(plan["closing_note"], S["closing"])
    if plan["key_event_keywords"]:
        out += [S["events"], "", ", ".join(f"`{w}`" for w in plan["key_event_keywords"]), *rule]
    return "\n".join([*out, S["notes"], "", *(f"- {x}" for x in S["notes_text"])]) + "\n"


def write_plan(plan: dict[str, DataFrame], records: DataFrame, players: list[str], folder: str, video: str = "", title: str = "") -> dict[str, str]:
    """Both files, also of a plan without comments; gives what was written where."""
    doc = document(plan, records, players, video, title)
    spark = records.sparkSession
    written = {"plan_json": f"{folder}/master_highlight_plan.json", "plan_script": f"{folder}/master_highlight_script.md"}
    write_file(spark, json.dumps(doc, ensure_ascii=False, indent=2, default=str), written["plan_json"])
    write_file(spark, script(doc), written["plan_script"])
    return written
