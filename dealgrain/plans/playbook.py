"""The playbook document: assembled from small aggregates on the driver, hashed, checked, digested and rendered.

Everything here handles one document of bounded size; what grows with the corpus is aggregated by ``operators`` first, and counted before it is listed.
"""

from __future__ import annotations

import copy
import datetime
import hashlib
import json
import os
import re
import tempfile
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.integrity import tree_hash

SECTIONS = tuple("evidence posture floor curation".split())
BUDGET = 40_000
LISTED = 100_000
VERSIONS = tuple("0.3 0.2 0.1".split())
QUESTIONS = tuple("rounds leverage risk_appetite sacred_clauses flexible_clauses audience".split())
SOFT = ("may", "flexible", "negotiable", "concede", "waive", "relax", "optional", "can accept", "willing")


def within(doc: Any, path: str, other: Any = None) -> Any:
    """What a dotted path leads to, or ``other`` where it leads nowhere or to null."""
    for step in path.split("."):
        doc = doc.get(step) if isinstance(doc, dict) else None
    return other if doc is None else doc


def canonical(value: Any) -> str:
    """JSON with sorted keys, no blanks and characters as they are; the order of arrays stays."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def address(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def canonical_document(doc: dict) -> str:
    """The form whose hash identifies a playbook: without its identity, pins and the marks of the run that made it."""
    held = {k: v for k, v in doc.items() if k not in ("identity", "curation")}
    if isinstance(held.get("compiler"), dict):
        held["compiler"] = {k: v for k, v in held["compiler"].items() if k not in ("generated_at", "run_id")}
    return canonical(held)


def identity(doc: dict) -> dict:
    return {"content_hash": address(canonical_document(doc)), "section_digests": {s: address(canonical(doc.get(s, {}))) for s in SECTIONS}}


def write_atomic(doc: Any, path: str) -> None:
    """Written beside its place and then renamed, so a reader sees the old document or the new one."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f.name, path)


def strings(node: Any, path: str = "") -> list[tuple[str, str]]:
    """(path, string) of a nested document, keys left out."""
    if isinstance(node, str):
        return [(path, node)]
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in strings(v, ".".join(filter(None, (path, str(k)))))]
    if isinstance(node, list):
        return [x for i, v in enumerate(node) for x in strings(v, f"{path}[{i}]")]
    return []


def map_strings(node: Any, f) -> Any:
    """The document with ``f`` over every string and key; two keys that become one are an error."""
    if isinstance(node, str):
        return f(node)
    if isinstance(node, list):
        return [map_strings(v, f) for v in node]
    if isinstance(node, dict):
        out = {f(k): map_strings(v, f) for k, v in node.items()}
        if len(out) != len(node):
            raise ValueError("redaction makes two keys one")
        return out
    return node


def assemble(agreement: dict, positions: DataFrame, documents: DataFrame, forms: DataFrame | None = None, posture: dict | None = None, floor: dict | None = None, run: dict | None = None, standard: bool = False) -> dict:
    """A playbook from rolled-up positions (a row a taxonomy), documents with version counts, and ranked forms.

    Up to ``LISTED`` documents are listed; of more, counted first, the playbook has the hash. More than ``LISTED`` forms are an error: rank fewer, or keep them as a table.
    """
    listed = [json.loads(x) for x in positions.orderBy("taxonomy_id").toJSON().collect()]
    shown: dict[str, list] = {}
    if forms is not None:
        if forms.count() > LISTED:
            raise ValueError(f"more than {LISTED} forms are no playbook; keep them as a table")
        for x in forms.orderBy("taxonomy_id", "rank").collect():
            shown.setdefault(x["taxonomy_id"], []).append({"text_summary": (x["representative"] or "")[:200], "n": x["n"], "band": x["band"], "material": x["material"]})
    clauses = [{"id": f"clause-{p['taxonomy_id']}", "taxonomy_id": p["taxonomy_id"], "title": re.sub("[_-]+", " ", p["taxonomy_id"]).title(), "observed_positions": shown.get(p["taxonomy_id"], []), "summary": {k: v for k, v in p.items() if k != "taxonomy_id"}} for p in listed]
    docs, stats = [], {"documents": documents.count(), "clauses": len(clauses)}
    if stats["documents"] <= LISTED:
        docs = [json.loads(x) for x in documents.orderBy("document_id").toJSON().collect()]
    else:  # a corpus too large to list is named by its hash; the table itself is the caller's
        columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(documents.columns)]
        stats["manifest_hash"] = tree_hash(documents, F.concat_ws("|", *columns)).first()["digest"]
    doc = {
        "format_version": "0.2", "agreement_type": agreement, "evidence": {"clauses": clauses}, "baseline": {"has_canonical_template": standard},
        "taxonomy": {"entries": [{"status": "active", "id": c["taxonomy_id"], "label": c["title"]} for c in clauses], "source": "custom"}, "posture": posture or {}, "floor": floor or {}, "corpus": {"documents": docs, "stats": stats}, "compiler": {"name": "dealgrain", **(run or {})},
    }
    return {**doc, "identity": identity(doc)}


def variations(clause: dict, top: int) -> list:
    """The preferred variations of a clause: entries grouped by their words, the ``top`` most frequent and every material one, with count and band.

    An entry counts as often as the observation that it refers to was made; entries that are plain strings stay strings.
    """
    ref = lambda r: tuple((r or {}).get(k) for k in ("document_id", "version", "clause_path"))
    seen = {ref(p.get("example_ref")): p for p in clause.get("observed_positions") or []}
    groups: dict[str, dict] = {}
    for e in within(clause, "summary.acceptable_if", []):
        plain = isinstance(e, str)
        key = " ".join(re.findall(r"\w+", (e if plain else f"{e.get('if') or ''} {e.get('to') or ''}").lower()))
        if not key:
            continue
        made = {} if plain else seen.get(ref(e.get("observation_ref")), {})
        n = int(made.get("precedent_count") or made.get("n") or 1)
        g = groups.setdefault(key, {"n": 0, "best": 0, "entry": e, "material": False})
        g["n"] += n
        g["material"] |= bool(made.get("material"))
        if n > g["best"]:
            g["best"], g["entry"] = n, e
    ranked = sorted(groups.values(), key=lambda g: -g["n"])
    band = lambda n: "often" if n >= 10 else "sometimes" if n >= 2 else "rare"
    kept = [g for k, g in enumerate(ranked) if k < top or g["material"]]
    return [g["entry"] if isinstance(g["entry"], str) else {**{k: v for k, v in g["entry"].items() if k in ("if", "to", "observation_ref") and v is not None}, "band": band(g["n"]), "n": g["n"]} for g in kept]


def digest(doc: dict, budget: int = BUDGET) -> dict:
    """Clauses with their leading forms and variations; from five down to three until a quarter of its length in characters fits the budget.

    ``tokens`` has the estimate and ``over_budget`` tells whether even three are too many.
    """
    for top in (5, 4, 3):
        clauses = []
        for c in within(doc, "evidence.clauses", []):
            forms = c.get("observed_positions", [])
            ranked = sorted(range(len(forms)), key=lambda i: (-forms[i].get("n", 1), i))
            keep = [i for k, i in enumerate(ranked) if k < top or forms[i].get("material")]
            clauses.append({"id": c["id"], "stance": within(c, "summary.historical_stance"), "preferred_variations": variations(c, top), "forms": [forms[i] for i in keep]})
        out = {"clauses": clauses, "top": top}
        size = tokens(out)
        if size <= budget:
            break
    return {**out, "tokens": size, "over_budget": size > budget}


def tokens(value: Any) -> int:
    return len(canonical(value)) // 4


def problems(doc: dict, min_evidence: int = 2) -> list[tuple[str, str, bool]]:
    """(message, path, blocking) of what is wrong with a playbook."""
    found: list[tuple[str, str, bool]] = []
    if next((v for k, v in sorted(doc.items()) if k.endswith("_version")), None) not in VERSIONS:
        found.append(("unknown version of the format", "", True))
    for key in "agreement_type baseline compiler corpus evidence floor posture taxonomy".split():
        if not isinstance(doc.get(key), dict):
            found.append(("section missing", key, True))
    clauses = within(doc, "evidence.clauses", [])
    for cid, n in Counter(c.get("id") for c in clauses).items():
        if n > 1:
            found.append((f"id {cid} is there {n} times", "evidence.clauses", True))
    versions = {d.get("document_id"): d.get("versions", 0) for d in within(doc, "corpus.documents", [])}
    for d in within(doc, "corpus.documents", []):
        if d.get("in_scope") is False and not d.get("scope_rationale"):
            found.append(("out of scope without a rationale", f"corpus.documents[{d.get('document_id')}]", True))
    for i, c in enumerate(clauses):
        at, s = f"evidence.clauses[{i}]", c.get("summary") or {}
        stance = s.get("historical_stance")
        if stance in ("consistently_held", "usually_held") and s.get("n_our_paper", 0) < min_evidence:
            found.append(("stance is stronger than its evidence", f"{at}.summary", True))
        if s.get("held", 0) > s.get("of", 0):
            found.append(("held is more than of", f"{at}.summary", True))
        for j, p in enumerate(c.get("observed_positions") or []):
            ref = p.get("example_ref")
            if ref and ref.get("version") != "template":
                if ref.get("document_id") not in versions:
                    found.append(("unknown document", f"{at}.observed_positions[{j}]", True))
                elif not 1 <= int(ref.get("version", 0)) <= versions[ref["document_id"]]:
                    found.append(("unknown version of a document", f"{at}.observed_positions[{j}]", True))
    found += provenance_problems(doc) + dynamics_problems(doc)
    for path, text in strings(doc):
        if re.search("[​-‏‪-‮⁠⁦-⁩﻿]", text):
            found.append(("invisible characters", path, True))
    for m in conflicts(within(doc, "posture.system_prompt", ""), within(doc, "floor.invariants", [])):
        found.append((m, "posture", False))
    if isinstance(doc.get("identity"), dict) and doc["identity"].get("content_hash") != address(canonical_document(doc)):
        found.append(("content hash differs", "identity", True))
    return found


def provenance_problems(doc: dict) -> list[tuple[str, str, bool]]:
    """Standards that come from a counterparty's paper, and settled stances whose every observation does."""
    paper = {d.get("document_id"): d.get("provenance") for d in within(doc, "corpus.documents", [])}
    found = []
    for i, c in enumerate(within(doc, "evidence.clauses", [])):
        if paper.get(within(c, "our_standard.source_ref.document_id")) == "counterparty_paper":
            found.append(("standard from a counterparty's paper", f"evidence.clauses[{i}].our_standard", True))
        made = c.get("observed_positions") or []
        if made and all(p.get("provenance") == "counterparty_paper" for p in made) and within(c, "summary.position") in ("standard", "hold_firm", "acceptable_variants_exist"):
            found.append(("position is settled by counterparties' papers alone", f"evidence.clauses[{i}].summary", True))
    return found


def dynamics_problems(doc: dict) -> list[tuple[str, str, bool]]:
    """Counts that contradict their stance (not blocking), trails that refer to unknown documents or versions, and dates that are none."""
    versions = {d.get("document_id"): d.get("versions", 0) for d in within(doc, "corpus.documents", [])}
    found = []
    for i, c in enumerate(within(doc, "evidence.clauses", [])):
        at, s = f"evidence.clauses[{i}]", c.get("summary") or {}
        held, of, stance = s.get("held"), s.get("of"), s.get("historical_stance")
        if all(isinstance(x, int) for x in (held, of)) and of >= held:
            if stance == "consistently_held" and held < of:
                found.append(("held always, but not by its counts", f"{at}.summary", False))
            if stance == "usually_conceded" and held == of > 0:
                found.append(("conceded, but not by its counts", f"{at}.summary", False))
        for j, move in enumerate(c.get("negotiation_trail") or []):
            ref = move.get("ref") or {}
            if ref.get("document_id") not in versions:
                found.append(("unknown document", f"{at}.negotiation_trail[{j}]", True))
            elif not 1 <= int(ref.get("version") or 0) <= versions[ref["document_id"]]:
                found.append(("unknown version of a document", f"{at}.negotiation_trail[{j}]", True))
        for j, p in enumerate(c.get("observed_positions") or []):
            day = p.get("observed_at")
            if day is not None and not (isinstance(day, str) and (re.fullmatch("[0-9]{4}-Q[1-4]", day) or _is_date(day))):
                found.append(("no date", f"{at}.observed_positions[{j}].observed_at", True))
    return found


def _is_date(day: str) -> bool:
    try:
        datetime.date.fromisoformat(day)
    except ValueError:
        return False
    return True


def conflicts(prompt: str, invariants: list[dict]) -> list[str]:
    """Sentences that soften what an invariant fixes: they share a content word and hold a softening term."""
    out = []
    content = lambda t: {w for w in re.findall(r"[a-z]{5,}", t.lower())}
    for sentence in re.split("(?<=[!?.])[ \n]+", prompt):
        if any(re.search(rf"\b{t}\b", sentence.lower()) for t in SOFT):
            out += [f"{sentence.strip()!r} softens {inv.get('id')}" for inv in invariants if content(sentence) & content(inv.get("statement", ""))]
    return out


def posture(answers: dict[str, str], before: dict | None = None) -> dict:
    """Prose from at least three answers, and the next version number."""
    given = [(q, answers[q].strip()) for q in QUESTIONS if answers.get(q, "").strip()]
    if len(given) < 3:
        raise ValueError("at least three answers are needed")
    lines = [f"{q.replace('_', ' ').capitalize()}: {a if a[-1] in '.!?' else a + '.'}" for q, a in given]
    return {"system_prompt": "\n".join(lines), "version": (before or {}).get("version", 0) + 1, "interview": [{"question": q, "answer": a} for q, a in given]}


def interview_candidates(answers: dict[str, str]) -> list[dict]:
    """Items of the sacred clauses, parted by semicolons; those that the flexible ones also name are rejected."""
    items = lambda q: [x.strip() for x in answers.get(q, "").split(";") if x.strip()]
    key = lambda x: re.sub("[^a-z0-9]+", "_", x.lower()).strip("_")
    soft = {key(x) for x in items("flexible_clauses")}
    return [{"id": f"cand-{n:03d}", "statement": x, "slug": key(x), "sentence": len(x.split()) > 7 or bool(re.search(r"\b(must|never|always|not)\b", x.lower())), "auto_rejected": key(x) in soft} for n, x in enumerate(items("sacred_clauses"), 1)]


def promote(candidates: list[dict], invariants: list[dict]) -> list[dict]:
    """Invariants with the candidates that aren't rejected or there already; doing it twice changes nothing."""
    have = {i["statement"] for i in invariants}
    return invariants + [{"id": f"inv-{c['slug']}", "statement": c["statement"], "source": c["id"]} for c in candidates if not c.get("auto_rejected") and c["statement"] not in have]


def publish(doc: dict, redact, names: list[str] = ()) -> dict:
    """A redacted copy with a new identity; a name that is still there stops it."""
    out = map_strings({k: v for k, v in copy.deepcopy(doc).items() if k not in ("identity", "curation")}, redact)
    left = [(p, n) for p, t in strings(out) for n in names if re.search(rf"\b{re.escape(n.lower())}\b", t.lower())]
    if left:
        raise ValueError(f"names left after redaction: {left[:5]}")
    return {**out, "identity": identity(out)}


def prompt(doc: dict) -> str:
    """The playbook as Markdown in six sections."""
    clauses = within(doc, "evidence.clauses", [])
    bullet = lambda items: "\n".join(f"- {x}" for x in items) or "- none"
    held = [c for c in clauses if within(c, "summary.historical_stance") in ("consistently_held", "usually_held")]
    thin = [c for c in clauses if not within(c, "summary.evidence_sufficient", True)]
    parts = [
        ("Agreement", bullet([within(doc, "agreement_type.name", "")])), ("Posture", within(doc, "posture.system_prompt", "") or "- none"),
        ("Floor", bullet(i["statement"] for i in within(doc, "floor.invariants", []))), ("Positions", bullet(f"{c['title']}: {(c.get('summary') or {}).get('historical_stance')}" for c in clauses)),
        ("Usually held", bullet(c["title"] for c in held)), ("Thin evidence", bullet(c["title"] for c in thin)),
    ]
    return "\n\n".join(f"## {h}\n\n{b}" for h, b in parts) + "\n"


def html(doc: dict) -> str:
    from html import escape

    rows = "".join(f"<tr><td>{escape(c['title'])}</td><td>{escape(str((c.get('summary') or {}).get('historical_stance')))}</td></tr>" for c in within(doc, "evidence.clauses", []))
    return f"<!doctype html><meta charset=utf-8><title>{escape(doc.get('agreement_type', {}).get('name', ''))}</title><table>{rows}</table>"


def curate(commands: str, clauses: list[dict]) -> list[dict]:
    """Lines like "pin REF POSITION" or "unpin REF", REF being a clause's id, taxonomy or title whatever its case."""
    index = {str(c[k]).lower(): c["id"] for c in clauses for k in ("title", "taxonomy_id", "id")}
    out = []
    for line in filter(None, map(str.strip, commands.split("\n"))):
        m = re.match(r"(?i)(pin|unpin)\s+(.*)$", line)
        verb, rest = (m[1].lower(), m[2].strip()) if m else ("", line)
        ref, _, position = rest.rpartition(" ") if verb == "pin" else (rest, "", "")
        target = index.get(ref.lower())
        out.append({"command": verb or "unknown", "clause_id": target, "position": position or None, "error": None if verb and target else "unknown command" if not verb else "unknown clause"})
    return out


def load(path: str, min_evidence: int = 2) -> dict:
    """A playbook from a file; blocking problems raise."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    wrong = [f"{at}: {m}" for m, at, blocking in problems(doc, min_evidence) if blocking]
    if wrong:
        raise ValueError("; ".join(wrong[:10]))
    return doc


def sign(candidates: list[dict], invariants: list[dict], who: str, when: str) -> list[dict]:
    """Invariants with accepted candidates as signed ones: by whom and when; those there already stay as they are."""
    have = {i["statement"] for i in invariants}
    return invariants + [{"id": f"inv-{c['slug']}", "statement": c["statement"], "source": c["id"], "signed_by": who, "signed_at": when} for c in candidates if c.get("decision") == "accepted" and c["statement"] not in have]


def floor_states(candidates: list[dict], invariants: list[dict]) -> list[tuple[dict, str | None]]:
    """Each candidate as signed, rejected or, with None, pending; a rejection by the interview alone is pending, as a person may still accept it."""
    held = {i.get("source") for i in invariants} | {i["statement"] for i in invariants}
    state = lambda c: "signed" if c["id"] in held or c["statement"] in held else "rejected" if c.get("decision") == "rejected" and not c.get("auto_rejected") else None
    return [(c, state(c)) for c in candidates]
