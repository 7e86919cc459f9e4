"""Side files of a corpus: configuration, taxonomy and hints, read strictly; and files that others mustn't read."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

STATUSES = ("active", "inactive", "custom")
TOP = frozenset("agreement_type baseline classification extraction perspective provenance scan_role_words_extra scan_stopwords_extra segmentation taxonomy".split())


class ConfigError(ValueError):
    """A side file says something that isn't understood."""


def load(path: str) -> dict:
    """JSON, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError(f"{path}: no YAML reader is installed; use JSON") from e
    return yaml.safe_load(text) or {}


@dataclass(frozen=True)
class Config:
    agreement: dict
    aliases: tuple[str, ...] = ()
    known_entities: tuple[str, ...] = ()
    min_evidence: int = 2
    ambiguity: float = 0.70
    auto: float = 0.85


def config(raw: dict) -> Config:
    unknown = set(raw) - TOP
    if unknown:
        raise ConfigError(f"unknown keys: {', '.join(sorted(unknown))}")
    if not isinstance(raw.get("agreement_type"), dict) or not raw["agreement_type"].get("id"):
        raise ConfigError("agreement_type.id is missing")
    p, c = raw.get("provenance") or {}, raw.get("classification") or {}
    low, high = float(c.get("ambiguity_threshold", 0.70)), float(c.get("auto_classify_threshold", 0.85))
    if not 0 <= low <= high <= 1:
        raise ConfigError("thresholds must rise within 0 and 1")
    return Config(raw["agreement_type"], tuple(p.get("our_party_aliases") or ()), tuple(p.get("known_entities") or ()), int(p.get("min_evidence_n", 2)), low, high)


def taxonomy(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(id, label, ord, status, structural) of entries whose ids differ and whose status is known."""
    ids = [e.get("id") for e in entries]
    if len(set(ids)) != len(ids) or not all(ids):
        raise ConfigError("ids must be there and differ")
    if wrong := [e["id"] for e in entries if e.get("status", "active") not in STATUSES]:
        raise ConfigError(f"unknown status of {', '.join(wrong)}")
    return spark.createDataFrame([(e["id"], e.get("label", e["id"]), i, e.get("status", "active"), bool(e.get("structural"))) for i, e in enumerate(entries)], "id string, label string, ord int, status string, structural boolean")


def hints(spark: SparkSession, raw: dict[str, dict]) -> DataFrame:
    """(document_id, version_order, timestamps, signed_version, provenance); file endings are dropped from names."""
    stem = lambda s: re.sub(r"\.(docx|pdf|rtf)$", "", s, flags=re.IGNORECASE) if s else s
    rows = []
    for doc, h in raw.items():
        if not isinstance(h.get("order", []), list) or not isinstance(h.get("timestamps", {}), dict):
            raise ConfigError(f"hints of {doc} have the wrong shape")
        rows.append((doc, [stem(x) for x in h.get("order", [])], {stem(k): str(v) for k, v in h.get("timestamps", {}).items()}, stem(h.get("signed_version")), h.get("provenance")))
    return spark.createDataFrame(rows, "document_id string, version_order array<string>, timestamps map<string,string>, signed_version string, provenance string")


def taxonomy_yaml(entries: DataFrame, name: str, most: int = 10_000) -> str:
    """A taxonomy's entries (id, label, status, ...) as YAML, in order of id; strings are quoted as in JSON, which YAML reads."""
    rows = entries.orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ConfigError(f"more than {most} entries are no taxonomy")
    out = [f"taxonomy: {json.dumps(name, ensure_ascii=False)}", "entries:"]
    for r in rows:
        for k, (field, value) in enumerate(r.asDict().items()):
            out.append(f"{'  - ' if k == 0 else '    '}{field}: {json.dumps(value, ensure_ascii=False)}")
    return "\n".join(out) + "\n"


def safe_component(name: str) -> bool:
    """A name that stays in its folder."""
    return bool(name) and name not in (".", "..") and not re.search(r"[/\\\x00]", name)


def write_private(data: dict, path: str) -> None:
    """For alias maps: readable by the owner alone from the beginning."""
    private = os.umask(0o177)
    try:
        with open(path, "w", encoding="utf-8") as out:
            json.dump(data, out, indent=2, sort_keys=True, ensure_ascii=False)
    finally:
        os.umask(private)
    os.chmod(path, 0o600)
