"""Taking secrets out of text, as column expressions."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
# The forms of secrets, in the order they are applied.
PRIVATE = [(r"(?is)<private\b[^>]*>.*?</private\s*>", "[EXCLUDED_PRIVATE]"), (r"(?is)<private\b[^>]*>.*$", "[EXCLUDED_PRIVATE]"), (r"(?is)</private\s*>", "")]
SECRETS = [
    r"AKIA[0-9A-Z]{16}",
    r"(?i)aws[_-]?secret[_-]?access[_-]?key\s*[:=]\s*[\"']?[A-Za-z0-9/+=]{40}[\"']?",
    r"gh[opsu]_[A-Za-z0-9]{16,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"sk-(?:proj-)?[A-Za-z0-9_\-]{20,}",
    r"sk-ant-[A-Za-z0-9_\-]{20,}",
    r"xox[abprs]-[0-9]+-[0-9]+-[0-9]+-[A-Za-z0-9]{20,}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"sk_live_[A-Za-z0-9]{20,}",
    r"rk_live_[A-Za-z0-9]{20,}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    r"(?i)(?:authorization\s*:\s*bearer\s+)[A-Za-z0-9_\-\.=]+",
    r"(?s)-----BEGIN [A-Z ]+PRIVATE KEY-----.*?-----END [A-Z ]+PRIVATE KEY-----",
    r"(?i)(?:sig=)[A-Za-z0-9%]{20,}",
    r"(?i)DefaultEndpointsProtocol=https?;AccountName=[A-Za-z0-9]+;AccountKey=[A-Za-z0-9+/=]{20,}",
    r"hf_[A-Za-z0-9]{20,}",
    r"[MN][A-Za-z0-9]{23}\.[A-Za-z0-9_\-]{6}\.[A-Za-z0-9_\-]{20,}",
    r"npm_[A-Za-z0-9]{30,}",
]
CONNECTION = r"(?i)((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://)[^:\s/@]+:[^@\s]+@"
GUESSES = [r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*[\"']?[A-Za-z0-9+/=_\-\.]{8,}[\"']?", r"\b[A-Fa-f0-9]{40,}\b", r"\b[A-Za-z0-9+/]{60,}={0,2}\b"]
DROP_HOSTS = ["pastebin.com", "paste.ee", "ghostbin.com", "transfer.sh", "webhook.site", "requestbin.com", "ngrok.io", "pipedream.net"]

# Keys whose values look like secrets and are none.
EXEMPT = ("vcs.ref.head.revision", "vcs.ref.head.name", "vcs.ref.base.revision", "coding_agent.git.commit.sha")


def replacements(full: bool = False) -> list[tuple[str, str]]:
    """``(pattern, replacement)`` in order; ``$1`` is the first group."""
    hosts = [(h.replace(".", r"\."), "[REDACTED_HOST]") for host in DROP_HOSTS for h in (host, host[0].upper() + host[1:])]
    rules = [*PRIVATE, *hosts, *((p, REDACTED) for p in SECRETS), (CONNECTION, f"$1{REDACTED}:{REDACTED}@")]
    return [*rules, *((p, REDACTED) for p in GUESSES)] if full else rules


def redacted(text: Column, full: bool = False) -> Column:
    """``text`` without secrets; with ``full`` also without what may be one. Null stays null."""
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), replacements(full), text)


def redacted_map(attributes: Column, full: bool = False, keep: tuple[str, ...] = EXEMPT) -> Column:
    """A map with its values redacted, but for those of ``keep``."""
    return F.transform_values(attributes, lambda k, v: F.when(F.trim(k).isin(*keep), v).otherwise(redacted(v, full)))


def redacted_json(text: Column, keep: tuple[str, ...] = EXEMPT) -> Column:
    """JSON text with every string in it redacted in full at any depth, but for the values of the keys ``keep``.

    The result is JSON in short form with sorted keys. What is no JSON is redacted as plain text. Null stays null.
    """
    rules = [(re.compile(p), new.replace("$1", r"\1")) for p, new in replacements(True)]

    def clean(value: str) -> str:
        for pattern, new in rules:
            value = pattern.sub(new, value)
        return value

    def walk(value):
        if isinstance(value, str):
            return clean(value)
        if isinstance(value, list):
            return [walk(v) for v in value]
        if isinstance(value, dict):
            return {k: v if k.strip() in keep and isinstance(v, str) else walk(v) for k, v in value.items()}
        return value

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            return json.dumps(walk(json.loads(value)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return clean(value)

    @F.pandas_udf("string")
    def walked(column: pd.Series) -> pd.Series:
        return column.map(one, na_action="ignore")

    return walked(text)


def estimated_tokens(text: Column) -> Column:
    """The greater of a quarter of the bytes, rounded up, and four thirds of the words, rounded down."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.coalesce(F.greatest(F.ceil(F.octet_length(text) / 4), F.floor(words * 4 / 3)), F.lit(0))
