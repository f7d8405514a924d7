"""Where rules come from: an environment variable, a verified cache, the bundled file; and how the cache is updated from a file."""

from __future__ import annotations

import enum
import hashlib
import os
import sys
import tempfile
from pathlib import Path

from ..errors import RulesetError
from ..rules import merge, model

VARIABLE = "SIEVEGLASS_RULES"
BUNDLED = Path(__file__).resolve().parent.parent / "rules" / "default.toml"
MOST_BYTES = 20 * 1024 * 1024


class UpdateResult(enum.Enum):
    CURRENT = "already current"
    UPDATED = "updated"
    AVAILABLE = "update available"
    CHECKED = "checked, current"

    @property
    def exit_code(self) -> int:
        return int(self is UpdateResult.AVAILABLE)


def data_dir() -> Path:
    home = Path(os.environ.get("HOME") or os.environ.get("USERPROFILE") or ".")
    if sys.platform == "darwin":
        return home / "Library" / "Application Support" / "sieveglass"
    if os.name == "nt":
        return Path(os.environ.get("APPDATA", home)) / "sieveglass"
    return Path(os.environ.get("XDG_DATA_HOME") or home / ".local" / "share") / "sieveglass"


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _sidecar(path: Path, kind: str) -> Path:
    return path.with_name(f"{path.name}.{kind}.sha256")


def cached(folder: Path | None = None) -> str | None:
    """The cached rules if they are whole."""
    path = (folder or data_dir()) / "rules.toml"
    try:
        data, want = path.read_bytes(), _sidecar(path, "content").read_text("ascii").strip()
    except OSError:
        return None
    return data.decode("utf-8") if sha256_hex(data) == want else None


def resolve(folder: Path | None = None) -> str:
    """Rules for a scan; what the environment names must load."""
    named = os.environ.get(VARIABLE)
    if named:
        text = Path(named).read_text("utf-8")
        model.load(text)
        return text
    return cached(folder) or BUNDLED.read_text("utf-8")


def local_rules(folder: Path | None = None) -> str | None:
    """The user's own rules; absent is fine, unreadable or invalid is an error."""
    for p in (Path("local.toml"), Path("assets/local.toml"), (folder or data_dir()) / "local.toml"):
        if p.exists():
            try:
                text = p.read_text("utf-8")
            except OSError as e:
                raise RulesetError(f"{p}: {e}") from e
            if problems := model.validate(model.parse(text)):
                raise RulesetError(f"{p}: " + "; ".join(problems))
            return text
    return None


def _write(path: Path, data: bytes) -> None:
    with tempfile.NamedTemporaryFile(dir=path.parent, delete=False) as f:
        f.write(data)
    os.replace(f.name, path)


def update(source: str, folder: Path | None = None, check_only: bool = False, force: bool = False) -> UpdateResult:
    """Take new rules from a file, merge the user's own over them, and replace the cache and its digests."""
    if "://" in source:
        raise RulesetError("only files can be read here")
    with open(source, "rb") as f:
        body = f.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise RulesetError("the rules are larger than 20 MiB")
    folder = folder or data_dir()
    own = local_rules(folder) or ""
    path = folder / "rules.toml"
    read = lambda kind: _sidecar(path, kind).read_text("ascii").strip() if _sidecar(path, kind).exists() else ""
    same = cached(folder) is not None and (read("source"), read("local")) == (sha256_hex(body), sha256_hex(own.encode()))
    if check_only:
        return UpdateResult.CHECKED if same else UpdateResult.AVAILABLE
    if same and not force:
        return UpdateResult.CURRENT
    parts = [merge.Source("update", merge.BASE, model.parse(body.decode("utf-8")))]
    if own:
        parts.append(merge.Source("local", merge.OVERRIDE, model.parse(own)))
    toml, _ = merge.merge_checked(parts)
    folder.mkdir(parents=True, exist_ok=True)
    _write(path, toml.encode())
    for kind, data in (("content", toml.encode()), ("source", body), ("local", own.encode())):
        _write(_sidecar(path, kind), sha256_hex(data).encode())
    return UpdateResult.UPDATED
