"""Static checks of a vertical: every asset by itself and against the taxonomy, all findings at once."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sievewright.sources import assets
from sievewright.sources.assets import AssetError


def validate_vertical(folder: str | Path) -> list[tuple[str, bool, str]]:
    """(check, passed, detail) for the manifest, taxonomy, rules, profiles and policy of a folder."""
    out: list[tuple[str, bool, str]] = []
    known: set[str] = set()

    def check(name: str, run) -> None:
        try:
            out.append((name, True, str(run())))
        except (AssetError, KeyError, TypeError, ValueError, OSError) as e:
            out.append((name, False, str(e)))

    paths: dict[str, Path] = {}

    def manifest() -> str:
        paths.update(assets.load_vertical(folder))
        return f"{len(paths)} assets"

    def taxonomy() -> str:
        nodes = assets.load_taxonomy(paths["taxonomy"])
        known.update(n.code for n in nodes)
        return f"{len(nodes)} nodes"

    def rules() -> str:
        found = assets.load_rules(paths["rules"])
        if missing := sorted(found.labels() - known):
            raise AssetError(f"unknown labels: {', '.join(missing)}")
        repeated = [k for k, n in Counter((r.domain, r.label, r.local_part) for r in found.senders).items() if n > 1]
        if repeated:
            raise AssetError(f"rules repeat: {repeated[0]}")
        return f"{sum(map(len, (found.senders, found.subjects, found.keywords, found.structures)))} rules"

    check("manifest", manifest)
    for name, run in (
        ("taxonomy", taxonomy),
        ("rules", rules),
        ("profiles", lambda: f"{len(assets.load_profiles(paths['profiles'], known))} profiles"),
        ("policy", lambda: assets.load_policy(paths["policy"]).version),
    ):
        if name in paths:
            check(name, run)
    return out


def findings(spark: SparkSession, folder: str | Path) -> DataFrame:
    return spark.createDataFrame(validate_vertical(folder), "check string, passed boolean, detail string")
