"""Errors of the engine, with codes for API callers."""

from __future__ import annotations


class ScanError(Exception):
    code = "SCAN_FAILED"


class RulesetError(ScanError):
    code = "INVALID_RULES"


class ConfigError(ScanError):
    code = "INVALID_CONFIG"


class NotHardened(ConfigError):
    code = "NOT_HARDENED"


class InputTooLarge(ScanError):
    code = "INPUT_TOO_LARGE"


class GitFailed(ScanError):
    code = "GIT_FAILED"


class IncompleteCoverage(ScanError):
    code = "INCOMPLETE_COVERAGE"
