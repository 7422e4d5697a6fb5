"""Small governed inputs: rule, taxonomy, profile, policy and corpus files, read on the driver.

Every loader validates a whole file and fails as a whole; Snapshot keeps the last good one.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Generic, TypeVar

import yaml
from pyspark.sql import DataFrame, SparkSession

from sievewright.functions.text import CleaningPolicy
from sievewright.operators.rules import KeywordRule, RuleSet, SenderRule, StructuralRule, SubjectRule

T = TypeVar("T")
GOLD = "sample_id string, thread_id string, labels string, split string, refs string, adjudicated boolean"
PREDICTIONS = "sample_id string, labels array<string>, needs_human_review boolean, strategy string, versions map<string,string>"


class AssetError(ValueError):
    """A governed file is missing or breaks its contract."""


def _load(path: str | Path) -> Any:
    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        raise AssetError(f"{path}: {e}") from e


def _mappings(path: str | Path) -> list[dict]:
    rows = _load(path) or []
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise AssetError(f"{path}: a list of mappings is needed")
    return rows


def _checked(make: Callable[..., T], rows: Iterable[dict], path) -> tuple[T, ...]:
    out = []
    for row in rows:
        try:
            rule = make(**row)
        except TypeError as e:
            raise AssetError(f"{path}: {e}") from e
        if not str(rule.label).strip() or not 0 <= float(rule.confidence) <= 1:
            raise AssetError(f"{path}: a label and a confidence from 0 to 1 are needed")
        out.append(rule)
    return tuple(out)


def load_rules(folder: str | Path) -> RuleSet:
    """The four rule files of a folder, all or none."""
    at = Path(folder)
    sender = lambda domain, label, confidence=0.95, local_part_pattern=None: SenderRule(domain.strip().lower(), label, confidence, local_part_pattern)
    keyword = lambda keywords, label, confidence=0.80, match_all=False: KeywordRule(tuple(keywords), label, confidence, match_all)
    return RuleSet(
        _checked(sender, _mappings(at / "sender_domains.yaml"), at),
        _checked(SubjectRule, _mappings(at / "subject_patterns.yaml"), at),
        _checked(keyword, _mappings(at / "body_keywords.yaml"), at),
        _checked(StructuralRule, _mappings(at / "structural.yaml"), at),
    )


@dataclass(frozen=True)
class Node:
    code: str
    label: str
    description: str = ""
    keywords: tuple[str, ...] = ()
    selection_guidance: tuple[str, ...] = ()
    exclusive: bool = False


def load_taxonomy(path: str | Path) -> tuple[Node, ...]:
    """Flat nodes of unique codes; children are ignored."""
    raw = _load(path)
    if not isinstance(raw, dict) or not isinstance(raw.get("nodes"), list):
        raise AssetError(f"{path}: nodes are needed")
    nodes = []
    for n in raw["nodes"]:
        guidance = tuple(n.get("selection_guidance", ()))
        if len(guidance) > 20 or len(set(guidance)) < len(guidance) or any(len(g) > 500 for g in guidance):
            raise AssetError(f"{path}: at most 20 unlike lines of guidance of 500 characters")
        nodes.append(Node(n["code"], n.get("label", n["code"]), n.get("description", ""), tuple(n.get("keywords", ())), guidance, bool(n.get("exclusive", False))))
    codes = [n.code for n in nodes]
    if len(set(codes)) < len(codes):
        raise AssetError(f"{path}: codes repeat")
    return tuple(nodes)


def taxonomy_frame(spark: SparkSession, nodes: Iterable[Node]) -> DataFrame:
    return spark.createDataFrame([(n.code, n.label, n.exclusive) for n in nodes], "code string, label string, exclusive boolean")


def taxonomy_prompt(nodes: Iterable[Node]) -> str:
    """The taxonomy as lines for a prompt."""
    lines = []
    for n in nodes:
        lines.append(f"- {n.code}: {n.label}" + (f" ({n.description})" if n.description else "") + (" [exclusive]" if n.exclusive else ""))
        lines += [f"  * {g}" for g in n.selection_guidance]
    return "\n".join(lines)


def load_profiles(path: str | Path, valid: Iterable[str] | None = None) -> dict[str, tuple[str, ...]]:
    """Target profiles: label to the labels that its vector search may see; one bad entry rejects all."""
    rows = _load(path)
    rows = rows.get("profiles", []) if isinstance(rows, dict) else rows or []
    known = set(valid) if valid is not None else None
    out: dict[str, tuple[str, ...]] = {}
    for r in rows:
        scope = tuple(r.get("vector_scope", ())) if isinstance(r, dict) else ()
        if not scope or not r.get("label") or known is not None and not set(scope) <= known:
            raise AssetError(f"{path}: a profile needs a label and a scope of known labels")
        out.setdefault(r["label"], scope)
    return out


def load_policy(path: str | Path) -> CleaningPolicy:
    raw = _load(path)
    fields = {k: tuple(v) if isinstance(v, list) else v for k, v in (raw or {}).items()}
    try:
        return CleaningPolicy(**fields)
    except TypeError as e:
        raise AssetError(f"{path}: {e}") from e


def load_gold(spark: SparkSession, path: str | Path) -> tuple[DataFrame, dict[str, str]]:
    """A gold manifest: its examples as rows (lists joined by commas), and its versions."""
    raw = _load(path)
    rows = [(e["sample_id"], e["thread_id"], ",".join(e["labels"]), e["split"], ",".join(e["annotation_refs"]), e["adjudicated"] is True) for e in raw["examples"]]
    return spark.createDataFrame(rows, GOLD), {k: str(v) for k, v in raw.items() if k.endswith("_version")}


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction snapshot: a JSON list, or an object with predictions and nothing else."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one governed file
    raw = json.loads(text)
    if isinstance(raw, dict):
        if set(raw) != {"predictions"}:
            raise AssetError(f"{path}: an object with predictions only is needed")
        raw = raw["predictions"]
    if not isinstance(raw, list):
        raise AssetError(f"{path}: a list is needed")
    rows = [(r["sample_id"], list(r["labels"]), bool(r["needs_human_review"]), r.get("strategy"), {k: v for k, v in r.get("versions", {}).items() if v is not None}) for r in raw]
    if len({r[0] for r in rows}) < len(rows):
        raise AssetError(f"{path}: sample ids repeat")
    return spark.createDataFrame(rows, PREDICTIONS)


def digest_assets(assets: Iterable[tuple[str, str]]) -> str:
    """A digest of named texts, whatever their order; names must not repeat."""
    pairs = sorted(assets)
    if len({n for n, _ in pairs}) < len(pairs):
        raise AssetError("names repeat")
    h = hashlib.sha256()
    for name, value in pairs:
        h.update(name.encode() + b"\0" + value.encode() + b"\0")
    return "sha256:" + h.hexdigest()


def canonical(value: Any) -> str:
    """JSON that equal values share."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=lambda o: o.__dict__)


class Snapshot(Generic[T]):
    """The last good value of a loader, reloaded when its files change, at most every few seconds."""

    def __init__(self, load: Callable[[], T], paths: Iterable[str | Path], every: float = 5.0):
        self._load, self._paths, self._every = load, [Path(p) for p in paths], every
        self._checked, self._stamp, self.error = 0.0, None, None
        self.value = load()
        self._stamp = self._mtimes()

    def _mtimes(self) -> tuple:
        return tuple(p.stat().st_mtime_ns if p.exists() else None for p in self._paths)

    def get(self, now: float | None = None) -> T:
        now = time.monotonic() if now is None else now
        if now - self._checked >= self._every:
            self._checked, stamp = now, self._mtimes()
            if stamp != self._stamp:
                self._stamp = stamp
                try:
                    self.value, self.error = self._load(), None
                except (AssetError, KeyError, TypeError) as e:
                    self.error = str(e)
        return self.value


def load_vertical(folder: str | Path) -> dict[str, Path]:
    """A vertical's manifest: its asset paths, which must stay within the folder."""
    at = Path(folder).resolve()
    raw = _load(at / "vertical.yaml")
    out = {}
    for name, relative in (raw.get("assets") or {}).items():
        path = (at / relative).resolve()
        if not path.is_relative_to(at) or not path.exists():
            raise AssetError(f"{name}: {relative} is missing or leaves the folder")
        out[name] = path
    return out
