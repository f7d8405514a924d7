"""Options of a scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .errors import ConfigError

MIB = 1024 * 1024


@dataclass(frozen=True)
class ScanConfig:
    min_entropy: float | None = None
    max_file_size: int = 2 * MIB
    redact: bool = True
    redaction: str = "partial"
    git_mode: str | None = None
    base: str | None = None
    history_all: bool = False
    history_full: bool = True
    history_options: tuple[str, ...] = ()
    history_timeout: float = 0
    include_untracked: bool = False
    fallback_walk: bool = False
    binary: str = "auto"
    max_files: int | None = None
    max_findings: int | None = None
    max_findings_per_file: int | None = None
    honor_allow_markers: bool = True
    capture_context: bool = True
    max_matched_len: int | None = None
    #: Part of fingerprints, of the inline allow marker and of SARIF keys; a baseline is only good for the namespace it was made in.
    namespace: str = "sieveglass"

    def __post_init__(self) -> None:
        if self.redaction not in ("partial", "full"):
            raise ConfigError(f"unknown redaction {self.redaction}")
        if self.binary not in ("auto", "skip", "scan"):
            raise ConfigError(f"unknown binary policy {self.binary}")
        if self.git_mode not in (None, "tracked", "changed", "staged", "history"):
            raise ConfigError(f"unknown git mode {self.git_mode}")
        if self.base is not None and self.git_mode != "changed":
            raise ConfigError("base needs git_mode='changed'")
        if self.history_all and self.git_mode != "history":
            raise ConfigError("history_all needs git_mode='history'")
        if self.include_untracked and self.git_mode not in ("tracked", "changed"):
            raise ConfigError("include_untracked needs git_mode 'tracked' or 'changed'")
        if self.history_options and self.git_mode != "history":
            raise ConfigError("history_options need git_mode='history'")
        for option in self.history_options:
            if not option.startswith("-") or option.startswith(("--output", "--format", "--pretty", "-O")) or "\0" in option:
                raise ConfigError(f"history option {option} is not allowed")
        if self.history_timeout < 0:
            raise ConfigError("history_timeout must not be negative")
        if self.max_file_size <= 0:
            raise ConfigError("max_file_size must be positive")
        for name in ("max_files", "max_findings", "max_findings_per_file", "max_matched_len"):
            if (v := getattr(self, name)) is not None and v < 0:
                raise ConfigError(f"{name} must not be negative")

    @classmethod
    def proxy(cls, **changes) -> ScanConfig:
        """For untrusted text: full redaction, no markers or context, bounded output."""
        return replace(cls(redaction="full", honor_allow_markers=False, capture_context=False, max_findings_per_file=1000, max_matched_len=256), **changes)

    @property
    def hardened(self) -> bool:
        return self.redact and self.redaction == "full" and not self.honor_allow_markers and not self.capture_context and self.max_findings_per_file is not None and self.max_matched_len is not None

    @property
    def markers(self) -> tuple[str, ...]:
        return (f"{self.namespace}:allow", "gitleaks:allow")
