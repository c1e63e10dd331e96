"""Findings as text for people and as JSON for machines. Rows come from the driver, in order, one after another."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

_NAMED = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", "\\": "\\\\", '"': '\\"'}
TITLES = {"changed-translation-value": "likely stale hardcoded translation", "test-value-mismatch": "translation value mismatch"}


def quote(text: str) -> str:
    """In double quotes, with escapes for quotes, backslashes and what can't be printed."""
    out = []
    for c in text:
        if c in _NAMED:
            out.append(_NAMED[c])
        elif c == " " or unicodedata.category(c)[0] in "LMNPS":
            out.append(c)
        else:
            n = ord(c)
            out.append(f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}")
    return f'"{"".join(out)}"'


def percent(score: float | None) -> int:
    return int((score or 0) * 100 + 0.5)


def title(kind: str) -> str:
    return TITLES.get(kind, "hardcoded translation")


def fix(kind: str, key: str | None) -> str:
    """What to do about a finding; key: of its only match."""
    if kind == "changed-translation-value":
        what = f'replace with t("{key}")' if key is not None else 'choose the correct t("...") key'
        return f"{what}, or mark this literal intentional"
    if kind == "test-value-mismatch":
        return f"update the test literal to the current en.json value for {quote(key)}" if key is not None else "update the test literal to the correct current en.json value for this context"
    return f"""replace with t("{key}") or your project's i18n helper""" if key is not None else 'replace with the correct t("...") key for this context'


def one(f: dict) -> str:
    kind, matches = f["type"], f["matches"]
    only = matches[0] if len(matches) == 1 else None
    to_do = f"  fix: {fix(kind, only['key'] if only else None)}"
    out = [f"{title(kind)}: {f['file']}:{f['line']}"]
    if kind != "changed-translation-value":
        out.append(f"  literal: {quote(f['literal'])}")
        if only:
            out.append(f"  matches en.json key: {quote(only['key'])} value: {quote(only['value'])}")
        else:
            out += ["  matches multiple en.json keys:", *(f"    - {quote(m['key'])} value: {quote(m['value'])}" for m in matches)]
        return "\n".join([*out, to_do, "", ""])
    out += ["  current code string:", f"    {quote(f['literal'])}", ""]
    if only:
        why = only["why"] or "similar to the current en.json value"
        out += ["  similar en.json value:", f"    key: {quote(only['key'])}", f"    value: {quote(only['value'])}", "", f"  similarity: {percent(only['score'])}%", f"  why: {why}"]
    else:
        out.append("  similar en.json values:")
        for i, m in enumerate(matches, 1):
            out.append(f"    {i}. key: {quote(m['key'])} value: {quote(m['value'])} similarity: {percent(m['score'])}%")
            out += [f"       why: {m['why']}"] if m["why"] else []
    return "\n".join([*out, to_do, "", ""])


def text(findings: Iterable[dict], count: int, files: int) -> Iterator[str]:
    for f in findings:
        yield one(f)
    yield f"→ {count} i18n issues found in {files} files.\n" if count else "no i18n issues found.\n"


def as_json(findings: Iterable[dict], count: int, files: int) -> str:
    rows = []
    for f in findings:
        kept = ("reason", "score", "why")  # left out where there is nothing to say
        matches = [{k: m[k] for k in ("key", "value")} | {k: m[k] for k in kept if m[k]} for m in f["matches"]]
        # a whole number has no point
        matches = [m | ({"score": int(m["score"])} if m.get("score") == 1 else {}) for m in matches]
        rows.append({k: f[k] for k in ("file", "line", "column", "literal", "normalizedLiteral", "type")} | {"matches": matches})
    out = json.dumps({"found": count > 0, "count": count, "files": files, "findings": rows}, indent=2, ensure_ascii=False)
    for c in "<>&  ":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out + "\n"
