"""Detection in one document: keyword gate, patterns, entropy, allowlists, markers, locations, spans, redaction.

Offsets are UTF-8 bytes, ends exclusive; lines and columns count from 1. Bytes
that aren't UTF-8 are read as one character each.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import struct
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import regex

from ..config import ScanConfig
from ..rules.dialect import UnsupportedPattern, compiled
from ..rules.model import Allowlist, Rule, Ruleset

MARKER = "[REDACTED_SECRET]"
LEAST_ENTROPY_BYTES = 8
CONTEXT = 2


def entropy(data: bytes) -> float:
    """Shannon entropy in bits a byte."""
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) + 0.0 if n else 0.0


def digest(parts: list[bytes], key: bytes | None = None) -> str:
    """SHA-256 (or HMAC) of the parts, each after its length in eight bytes."""
    data = b"".join(struct.pack("<Q", len(p)) + p for p in parts)
    return "hmac-sha256:" + hmac.new(key, data, hashlib.sha256).hexdigest() if key else "sha256:" + hashlib.sha256(data).hexdigest()


def finding_fingerprint(namespace: str, rule: str, file: str, secret: bytes, key: bytes | None = None) -> str:
    return digest([f"{namespace}/finding/v2".encode(), rule.encode(), file.encode(), secret], key)


def location_fingerprint(namespace: str, rule: str, uri: str, start: int, end: int, key: bytes | None = None) -> str:
    return digest([f"{namespace}/location/v2".encode(), rule.encode(), uri.encode(), str(start).encode(), str(end).encode()], key)


def fnv1a(parts: list[bytes]) -> str:
    """64-bit FNV-1a with a zero byte between parts; for old baselines."""
    h = 0xCBF29CE484222325
    for i, p in enumerate(parts):
        for b in (b"\0" if i else b"") + p:
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def redact_partial(s: str) -> str:
    return "*" * len(s) if len(s) <= 12 else s[:4] + "*" * (len(s) - 8) + s[-4:]


def merge_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Islands of overlapping or touching spans; empty and outlying ones are left out."""
    out: list[list[int]] = []
    for a, b in sorted(s for s in spans if 0 <= s[0] < s[1] <= size):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def redact_spans(data: bytes, islands: list[tuple[int, int]]) -> bytes:
    """Each island replaced by one marker; islands are widened to whole characters and then joined if they touch."""
    wide = []
    for a, b in islands:
        while a > 0 and data[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        wide.append((a, b))
    out, at = [], 0
    for a, b in merge_spans(wide, len(data)):
        out += [data[at:a], MARKER.encode()]
        at = b
    return b"".join([*out, data[at:]])


@dataclass
class Document:
    """A text with its byte offsets and lines."""

    path: str
    data: bytes

    @cached_property
    def text(self) -> str:
        try:
            return self.data.decode("utf-8")
        except UnicodeDecodeError:
            return self.data.decode("latin-1")

    @cached_property
    def offsets(self) -> list[int] | None:
        """Byte offset of every 256th character; None where bytes are characters."""
        if len(self.text) == len(self.data):
            return None
        out, total = [], 0
        for i in range(0, len(self.text) + 1, 256):
            out.append(total)
            total += len(self.text[i : i + 256].encode("utf-8"))
        return out

    def byte(self, char: int) -> int:
        if self.offsets is None:
            return char
        k = char >> 8
        return self.offsets[k] + len(self.text[k << 8 : char].encode("utf-8"))

    @cached_property
    def breaks(self) -> list[int]:
        out, at = [], self.data.find(b"\n")
        while at >= 0:
            out.append(at)
            at = self.data.find(b"\n", at + 1)
        return out

    def line_of(self, offset: int) -> tuple[int, int, int]:
        """(line, its start, its end); an offset on a line feed is on the line that it ends."""
        k = bisect_left(self.breaks, offset)
        return k + 1, self.breaks[k - 1] + 1 if k else 0, self.breaks[k] if k < len(self.breaks) else len(self.data)

    def line_text(self, line: int) -> tuple[int, int]:
        k = line - 1
        return self.breaks[k - 1] + 1 if k else 0, self.breaks[k] if k < len(self.breaks) else len(self.data)

    def column16(self, start: int, offset: int) -> int:
        part = self.data[start:offset].decode("utf-8", "replace")
        return len(part.encode("utf-16-le")) // 2 + 1


class Engine:
    """A ruleset ready to scan; one for each Python worker."""

    def __init__(self, rules: Ruleset, config: ScanConfig, key: bytes | None = None):
        self.rules, self.config, self.key = rules, config, key
        self.keyworded, self.unkeyworded, self.path_only = rules.keyworded, rules.unkeyworded, rules.path_only
        self.automaton = None
        index = rules.keyword_index()
        if index:
            self.automaton = ahocorasick.Automaton()
            for k, at in index.items():
                if k:
                    self.automaton.add_word(k, (k, tuple(at)))
            self.automaton.make_automaton()

    @cached_property
    def any_unkeyworded(self) -> regex.Pattern | None:
        """One pattern for all rules without keywords, so that a text without any of them is read once; None where they can't be joined or there is only one."""
        if len(self.unkeyworded) < 2:
            return None
        try:
            return compiled("|".join(f"(?:{r.regex})" for r in self.unkeyworded))
        except UnsupportedPattern:
            return None

    def path_allowed(self, path: str) -> bool:
        """True if a global allowlist takes the whole document out."""
        for a in self.rules.allowlists:
            if a.target_rules or not a.paths or a.all_of and (a.regexes or a.stopwords):
                continue
            if any(compiled(p).search(path) for p in a.paths):
                return True
        return False

    @staticmethod
    def suppressed(a: Allowlist, path: str, line: str, match: str, secret: str) -> bool:
        found = []
        if a.paths:
            found.append(any(compiled(p).search(path) for p in a.paths))
        target = {"secret": secret, "match": match, "line": line}[a.target]
        if a.regexes:
            found.append(any(compiled(p).search(target) for p in a.regexes))
        if a.stopwords:
            low = target.lower()
            found.append(any(w in low for w in a.stopwords))
        return bool(found) and (all(found) if a.all_of else any(found))

    def candidates(self, doc: Document) -> list[int]:
        """Positions of the keyworded rules with a keyword anywhere in the text, ASCII case aside."""
        if self.automaton is None or not len(self.automaton):
            return []
        hit: set[int] = set()
        low = doc.data.lower()  # of bytes: ASCII only
        for _, (_, rules) in self.automaton.iter(low.decode("latin-1" if doc.offsets is None else "utf-8")):
            hit.update(rules)
        return sorted(hit)

    def scan(self, path: str, data: bytes) -> list[dict]:
        """All findings in emission order, uncapped."""
        if self.path_allowed(path):
            return []
        doc = Document(path, data)
        out = [self._path_finding(r, path) for r in self.path_only if compiled(r.path).search(path)]
        for i in self.candidates(doc):
            self._match(self.keyworded[i], doc, out)
        if self.any_unkeyworded is None or self.any_unkeyworded.search(doc.text):
            for r in self.unkeyworded:
                self._match(r, doc, out)
        if self.config.capture_context:
            self._context(doc, out)
        return out

    def _path_finding(self, rule: Rule, path: str) -> dict:
        zero = dict.fromkeys(("start_offset", "end_offset", "secret_start_offset", "secret_end_offset"), 0)
        one = dict.fromkeys(("line", "col", "end_line", "end_col", "col_utf16", "end_col_utf16"), 1)
        return {
            "file": path, **one, "rule_id": rule.id, "description": rule.description, "matched": f"File path matches pattern: {path}", "entropy": 0.0, **zero,
            "fingerprint": finding_fingerprint(self.config.namespace, rule.id, path, path.encode(), self.key), "commit": None, "context_lines": [],
        }

    def _match(self, rule: Rule, doc: Document, out: list[dict]) -> None:
        c, ns = self.config, self.config.namespace
        if rule.path is not None and not compiled(rule.path).search(doc.path):
            return
        for m in compiled(rule.regex).finditer(doc.text):
            if m.start() == m.end():
                continue
            group = rule.secret_group or 0
            if m.start(group) < 0 or m.start(group) == m.end(group):
                group = 0
            a, b, sa, sb = (doc.byte(x) for x in (*m.span(), *m.span(group)))
            secret = doc.data[sa:sb]
            e = entropy(secret)
            if rule.entropy is not None and (len(secret) < LEAST_ENTROPY_BYTES or e < max(rule.entropy, c.min_entropy or 0.0)):
                continue
            line, start, end = doc.line_of(a)
            line_text = doc.data[start:end].decode("utf-8", "replace")
            if c.honor_allow_markers and any(x in line_text for x in c.markers):
                continue
            args = (doc.path, line_text, m[0], m[group])
            if any((not g.target_rules or rule.id in g.target_rules) and self.suppressed(g, *args) for g in self.rules.allowlists) or any(self.suppressed(g, *args) for g in rule.allowlists):
                continue
            end_line, end_start, _ = doc.line_of(b)
            if c.max_matched_len is not None and b - a > c.max_matched_len:
                matched = f"[MATCH OMITTED: {b - a} bytes]"
            else:
                matched = m[0] if not c.redact else "[REDACTED]" if c.redaction == "full" else redact_partial(m[0])
            out.append(
                {
                    "file": doc.path, "line": line, "col": a - start + 1, "end_line": end_line, "end_col": b - end_start + 1, "col_utf16": doc.column16(start, a), "end_col_utf16": doc.column16(end_start, b),
                    "rule_id": rule.id, "description": rule.description, "matched": matched, "entropy": e, "start_offset": a, "end_offset": b, "secret_start_offset": sa, "secret_end_offset": sb,
                    "fingerprint": finding_fingerprint(ns, rule.id, doc.path, secret, self.key), "commit": None, "context_lines": [],
                }
            )

    def islands(self, findings: list[dict], size: int) -> list[tuple[int, int]]:
        return merge_spans([(f["secret_start_offset"], f["secret_end_offset"]) for f in findings], size)

    def _context(self, doc: Document, findings: list[dict]) -> None:
        """Lines around each finding, with every secret of the document replaced."""
        spans = self.islands(findings, len(doc.data))
        ends = [b for _, b in spans]
        shown: dict[int, str] = {}
        last = len(doc.breaks) + 1
        for f in findings:
            if f["end_offset"] == 0:
                continue
            rows = []
            for n in range(max(1, f["line"] - CONTEXT), min(last, f["line"] + CONTEXT) + 1):
                if n not in shown:
                    a, b = doc.line_text(n)
                    inside, k = [], bisect_right(ends, a)
                    while k < len(spans) and spans[k][0] < b:
                        inside.append((max(spans[k][0], a) - a, min(spans[k][1], b) - a))
                        k += 1
                    shown[n] = redact_spans(doc.data[a:b], inside).decode("utf-8", "replace").rstrip()
                rows.append({"line": n, "content": shown[n]})
            f["context_lines"] = rows

    def scan_and_redact(self, path: str, data: bytes) -> tuple[list[dict], bytes, bool]:
        """(findings up to the cap, redacted bytes of all findings, whether the cap cut findings off)."""
        found = self.scan(path, data)
        redacted = redact_spans(data, self.islands(found, len(data)))
        cap = self.config.max_findings_per_file
        cut = cap is not None and len(found) > cap
        return (found[:cap] if cut else found), redacted, cut
