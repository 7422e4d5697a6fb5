"""Reports as JSON and Markdown, rendered on the driver from small aggregates, and proposals read back."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(x: float | None) -> str:
    return "N/A" if x is None else f"{x:.6f}"


def percent(x: float | None) -> str:
    return "N/A" if x is None else f"{100 * x:.1f}%"


def interval(low: float | None, high: float | None) -> str:
    return "N/A" if low is None or high is None else f"[{low:.6f}, {high:.6f}]"


def _table(head: Iterable[str], rows: Iterable[Iterable]) -> list[str]:
    head = list(head)
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows)]


def write_atomic(path: str | Path, content: str) -> None:
    """Replace a file as a whole or not at all."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=at.parent)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(name, at)


def evaluation_report(micro: DataFrame, labels: DataFrame, summary: DataFrame, gate: DataFrame, mismatches: DataFrame, versions: dict[str, str]) -> dict:
    """Everything of an evaluation as one sorted structure; mismatches are listed in full."""
    row = lambda df: df.first().asDict()
    return {
        "versions": versions,
        "micro": row(micro),
        "per_label": {r.label: {k: v for k, v in r.asDict().items() if k != "label"} for r in labels.orderBy("label").collect()},
        "summary": row(summary),
        "gate": row(gate),
        "mismatches": [r.asDict() for r in mismatches.orderBy("sample_id").toLocalIterator()],
    }


def evaluation_markdown(report: dict) -> str:
    m, s, g = report["micro"], report["summary"], report["gate"]
    lines = ["# Evaluation", "", f"Gate: **{g['status']}**" + (f" ({g['reasons']})" if g["reasons"] else ""), ""]
    lines += _table(("total", "automatic", "reviewed", "missing", "coverage", "review rate"), [(s["total_examples"], s["auto_accepted"], s["reviewed"], s["missing"], percent(s["coverage"]), percent(s["review_rate"]))])
    lines += ["", *_table(("label", "tp", "fp", "fn", "precision", "recall", "interval"), [(n, x["tp"], x["fp"], x["fn"], ratio(x["precision"]), ratio(x["recall"]), interval(x["wilson_low"], x["wilson_high"])) for n, x in [("(all)", m), *report["per_label"].items()]])]
    if report["mismatches"]:
        lines += ["", "## Mismatches", "", *_table(("sample", "gold", "predicted", "strategy"), [(x["sample_id"], x["gold_labels"], x["predicted_labels"], x["strategy"]) for x in report["mismatches"]])]
    return "\n".join(lines) + "\n"


def write_evaluation(report: dict, folder: str | Path) -> None:
    at = Path(folder)
    write_atomic(at / "evaluation.json", json.dumps(report, sort_keys=True, indent=2, default=str, ensure_ascii=False))
    write_atomic(at / "evaluation.md", evaluation_markdown(report))


def bootstrap_report(entries: DataFrame) -> dict:
    """Counts by tier and by disposition of an import's entries (tier, disposition)."""
    return {
        "tiers": {r.tier: r["count"] for r in entries.groupBy("tier").count().collect()},
        "quality": {r.disposition: r["count"] for r in entries.groupBy("disposition").count().collect()},
        "total": entries.count(),
    }


def bootstrap_markdown(report: dict) -> str:
    lines = ["# Import", "", f"{report['total']} messages", "", *_table(("tier", "messages"), sorted(report["tiers"].items())), "", *_table(("quality", "messages"), sorted(report["quality"].items()))]
    return "\n".join(lines) + "\n"


def discovery_markdown(clusters: Iterable[dict], stamp: str) -> str:
    """New and drifting intents with their representatives."""
    lines = [f"# Intents {stamp}"]
    for c in clusters:
        if c["drift"] == "known":
            continue
        lines += ["", f"## Cluster {c['cluster']} ({c['drift']}, {c['size']} messages)", "", c.get("description") or "Unknown intent", "", f"Similarity {c['similarity']:.3f}"]
        lines += [f"- {text[:200]}" for text in c.get("representatives", ())]
    return "\n".join(lines) + "\n"


def proposals_markdown(proposals: Iterable[dict]) -> str:
    """One unchecked section with one block of YAML for each proposed rule."""
    lines = ["# Rule proposals"]
    for p in proposals:
        rule = [{"domain": p["sender_domain"], "label": p["label"], "confidence": float(f"{p['confidence']:.2f}")}]
        lines += ["", f"- [ ] {p['sender_domain']} -> {p['label']} ({p['n']} of {p['total']})", "", "```yaml", yaml.safe_dump(rule, sort_keys=False).rstrip(), "```"]
    return "\n".join(lines) + "\n"


def checked_rules(markdown: str) -> list[dict]:
    """Rules of the checked sections of a proposal; each must have exactly one block of at least one rule."""
    out: list[dict] = []
    for section in re.split(r"(?m)^(?=- \[[ xX]\])", markdown):
        if not re.match(r"- \[[xX]\]", section):
            continue
        blocks = re.findall(r"(?ms)^```yaml\s*\n(.*?)^```", section)
        rules = yaml.safe_load(blocks[0]) if len(blocks) == 1 else None
        if not isinstance(rules, list) or not rules:
            raise ValueError("a checked section needs one block of rules")
        out += rules
    return out


def append_rules(path: str | Path, rules: list[dict]) -> int:
    """Add rules whose (domain, label) the file does not have; returns how many."""
    at = Path(path)
    have = yaml.safe_load(at.read_text(encoding="utf-8")) or [] if at.exists() else []
    keys = {(r["domain"].strip().lower(), r["label"]) for r in have}
    added = []
    for r in rules:
        domain, label, confidence = r["domain"].strip().lower(), r["label"].strip(), float(r.get("confidence", 0.95))
        if not domain or not label or not 0 <= confidence <= 1:
            raise ValueError("a rule needs a domain, a label and a confidence from 0 to 1")
        if (domain, label) not in keys:
            keys.add((domain, label))
            added.append({"domain": domain, "label": label, "confidence": confidence})
    if added:
        write_atomic(at, yaml.safe_dump(have + added, sort_keys=False, allow_unicode=True))
    return len(added)


def prompt(mails: DataFrame, taxonomy: str, most: int = 24_000) -> DataFrame:
    """mails with the user's message of a classification prompt."""
    from sievewright.functions.text import truncate_body

    body = truncate_body(F.col("body"), most)
    return mails.withColumn("prompt", F.concat(F.lit(f"Taxonomy:\n{taxonomy}\n\n- subject: "), F.col("subject"), F.lit("\n- body:\n"), body))


def latest_report(folder: str | Path, pattern: str = "*.json") -> Path | None:
    """The last report by file name."""
    return max(Path(folder).glob(pattern), key=lambda p: p.name, default=None)


def read_report(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))
