"""The local configuration file: sections of ``key = value`` lines, a small part of TOML."""

from __future__ import annotations

import re

from ..schema import KEY_INDEX, QUEUE_BYTES, SETTINGS

#: The keys outside of sections, with their types; keys are dotted, [genesis] and [[peers]] are sections.
LOCAL = {"data_dir": str, "member.key_file": str, "listen": str, "log.level": str, "storage.fsync": str, "sync.unslotted_max_bytes": int}
FSYNC = ("every", "batched", "never")


class ConfigError(ValueError):
    """Its first word is the name of what is wrong."""


def value_of(text: str):
    """A quoted string, a number, a boolean, or a list of strings."""
    if m := re.fullmatch(r'"((?:[^"\\]|\\["\\])*)"', text):
        return re.sub(r'\\(["\\])', r"\1", m[1])
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[0-9][0-9_]*", text):
        return int(text.replace("_", ""))
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip().removesuffix(",")
        return [value_of(x.strip()) for x in re.findall(r'"(?:[^"\\]|\\["\\])*"|[^,\s]+', inner)] if inner else []
    raise ConfigError(f"syntax: {text}")


def without_comment(line: str) -> str:
    m = re.match(r'(?:[^"#]|"(?:[^"\\]|\\.)*")*', line)
    return m[0].strip()


def parse(text: str) -> dict:
    """{key: value} with ``genesis`` (settings of the cluster) and ``peers``; refuses unknown and journal-scope keys."""
    out: dict = {"storage.fsync": "every", "sync.unslotted_max_bytes": QUEUE_BYTES, "genesis": {}, "peers": []}
    section, seen = "", set()
    for line in map(without_comment, text.splitlines()):
        if not line:
            continue
        if m := re.fullmatch(r"\[\[\s*peers\s*\]\]", line):
            section = "peers"
            out["peers"].append({})
            continue
        if line.startswith("["):
            if not re.fullmatch(r"\[\s*genesis\s*\]", line):
                raise ConfigError(f"{'unknown_key' if line.endswith(']') else 'syntax'}: {line}")
            section = "genesis"
            continue
        full, eq, value = (x.strip() for x in line.partition("="))
        if not eq or not re.fullmatch(r"[a-z_.]+", full):
            raise ConfigError(f"syntax: {line}")
        value = value_of(value)
        if section == "peers":
            if full not in ("address", "public_key"):
                raise ConfigError(f"unknown_key: peers.{full}")
            if full == "public_key" and not re.fullmatch("[0-9a-fA-F]{64}", str(value)):
                raise ConfigError("invalid_value: peers.public_key")
            out["peers"][-1][full] = value
            continue
        if (section == "genesis", full) in seen:
            raise ConfigError(f"duplicate_key: {full}")
        seen.add((section == "genesis", full))
        if full in KEY_INDEX and SETTINGS[KEY_INDEX[full]][1] == "journal":
            raise ConfigError(f"journal_key_in_local_config: {full}")
        if section == "genesis":
            if full not in KEY_INDEX:
                raise ConfigError(f"unknown_key: {full}")
            allowed = SETTINGS[KEY_INDEX[full]][4]
            if allowed and value not in allowed:
                raise ConfigError(f"invalid_value: {full}")
            out["genesis"][full] = str(value).lower() if isinstance(value, bool) else value if isinstance(value, list) else str(value)
        elif full not in LOCAL:
            raise ConfigError(f"unknown_key: {full}")
        elif not isinstance(value, LOCAL[full]) or isinstance(value, bool):
            raise ConfigError(f"invalid_type: {full}")
        elif full == "storage.fsync" and value not in FSYNC:
            raise ConfigError(f"invalid_value: {full}")
        else:
            out[full] = value
    return out
