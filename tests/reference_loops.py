"""Plain row-by-row versions of the merges and a plain trigram similarity, as test truth."""

import re

import numpy as np


def grams(text):
    out = set()
    for word in re.split(r"[^0-9a-z]+", text.lower()):
        if word:
            padded = f"  {word} "
            out |= {padded[i : i + 3] for i in range(len(padded) - 2)}
    return out


def similarity(a, b):
    x, y = grams(a), grams(b)
    return float(np.float32(len(x & y)) / np.float32(len(x | y))) if x and y else 0.0


def merge_notes(current, incoming, threshold=0.8):
    state = [dict(r, at=-1) for r in current]
    for r in incoming:
        same = [x for x in state if x["project_id"] == r["project_id"] and x["category"] == r["category"]]
        scored = [(similarity(x["content"], r["content"]), x["at"], x["created_at"], x) for x in same]
        scored = [s for s in scored if s[0] > threshold]
        if scored:
            max(scored, key=lambda s: s[:3])[3].update(
                content=r["content"], tags=r["tags"] or [], created_at=r["created_at"], at=r["seq"]
            )
        else:
            state.append(dict(r, tags=r["tags"] or [], at=r["seq"]))
    return {(x["id"], x["content"], tuple(x["tags"]), x["created_at"]) for x in state}


def merge_errors(current, incoming, threshold=0.7):
    state = [dict(r) for r in current]
    for r in incoming:
        scored = [(-similarity(x["error_message"], r["error_message"]), x["id"], x) for x in state if x["project_id"] == r["project_id"]]
        scored = [s for s in scored if -s[0] > threshold]
        if scored:
            x = min(scored, key=lambda s: s[:2])[2]
            x["occurrence_count"] += 1
            x["last_seen_at"] = r["seen_at"]
            x["attempted_fixes"] = list(dict.fromkeys((x["attempted_fixes"] or []) + (r["attempted_fixes"] or [])))
            for k in ("root_cause", "resolution"):
                x[k] = r[k] or x[k]
            if r["file_paths"] is not None:
                x["file_paths"] = r["file_paths"]
        else:
            state.append(dict(r, occurrence_count=1, last_seen_at=r["seen_at"],
                              attempted_fixes=r["attempted_fixes"] or [], file_paths=r["file_paths"] or []))
    return {
        (x["id"], x["error_message"], tuple(x["attempted_fixes"]), x["root_cause"], x["resolution"], tuple(x["file_paths"]),
         x["occurrence_count"], x["last_seen_at"])
        for x in state
    }


def new_instructions(current, incoming, threshold=0.8):
    state, new = [r for r in current if r["active"]], set()
    for r in incoming:
        if not any(x["project_id"] == r["project_id"] and similarity(x["content"], r["content"]) > threshold for x in state):
            state.append(r)
            new.add(r["id"])
    return new
