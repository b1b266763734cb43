"""Settings of a workspace."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

# Globs of what is no content of a project, and of files that are secret.
EXCLUDED = [".git/**", ".provgraph/**", ".venv/**", "venv/**", "node_modules/**", "__pycache__/**", ".pytest_cache/**", ".mypy_cache/**", ".ruff_cache/**", ".tox/**", "dist/**", "build/**", "*.egg-info/**", ".coverage", ".coverage.*", "htmlcov/**", ".codex/**", ".claude/**", ".cursor/**", ".obsidian/**"]
SECRET = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.kdbx", ".npmrc", ".pypirc", "id_rsa*", "credentials*.json", "*secret*", ".aws/**", ".ssh/**"]


@dataclass
class Settings:
    """What a settings file may set; globs of the file are added to the fixed ones."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    redaction_patterns: list[str] = field(default_factory=list)
    hash_max_bytes: int = 50 << 20
    extract_max_bytes: int = 10 << 20
    min_confidence: float = 0.30
    adapters: list[str] = field(default_factory=lambda: ["text", "python-ast", "javascript", "document", "image", "git"])
    visualization_limit: int = 80
    explorer_edge_limit: int = 1500

    def __post_init__(self):
        self.exclude = list(dict.fromkeys([*EXCLUDED, *self.exclude]))
        self.redaction_patterns = list(dict.fromkeys([*SECRET, *self.redaction_patterns]))


def settings(text: str | None = None) -> Settings:
    """From a TOML text, whose table ``lineage``, or else the whole of it, has them; unknown keys are ignored."""
    given = tomllib.loads(text or "")
    given = given.get("lineage", given)
    return Settings(**{f.name: given[f.name] for f in fields(Settings) if f.name in given})
