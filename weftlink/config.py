"""Run settings from YAML: libraries, worksheets and embedding models."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from weftlink.operators.definitions import SheetMap

# Fields that change vectors or texts; host, port and batching do not.
VALUE_FIELDS = ("model", "sep_token", "title_cap_combined", "pilot_n")


@dataclass(frozen=True)
class Settings:
    active: str
    configs: dict[str, dict]
    assessments: dict[str, dict] = field(default_factory=dict)
    sheets: dict[str, SheetMap] = field(default_factory=dict)
    citing: dict[str, str] = field(default_factory=dict)
    default_assessment: str = ""
    workers: int = 8

    @property
    def model(self) -> dict:
        """The active embedding entry."""
        if self.active not in self.configs:
            raise ValueError(f"embeddings.active is {self.active!r}; configs has {', '.join(self.configs) or 'nothing'}")
        return self.configs[self.active]

    def fingerprint(self) -> str:
        """Changes with the values that change results, not with connection or batch settings."""
        kept = {k: self.model.get(k) for k in VALUE_FIELDS}
        return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()[:16]


def load_settings(path: str) -> Settings:
    """Read ``embeddings``, ``zotero.assessments``, ``sheets`` and ``citing`` from a YAML (or JSON) file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    embeddings = raw.get("embeddings") or {}
    citing = dict(raw.get("citing") or {})
    return Settings(
        active=embeddings.get("active", ""),
        configs=embeddings.get("configs") or {},
        assessments=(raw.get("zotero") or {}).get("assessments") or {},
        sheets={name: SheetMap(**spec) for name, spec in (raw.get("sheets") or {}).items()},
        default_assessment=citing.pop("default", ""),
        citing=citing,
        workers=int(raw.get("workers", 8)),
    )
