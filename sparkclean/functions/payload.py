"""Documents kept as JSON text, rewritten at any depth before they are logged or shared.

A cell that holds nothing to treat is recognised inside the JVM and stays as it is written; only the others visit
Python, an Arrow batch at a time, and come back as compact JSON with their order of keys (of repeated keys in one
record the last is kept). NULL stays NULL. A text that is no JSON cannot be searched by path: it is replaced as a whole
where it names something to treat.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkclean.functions.text import EMAIL_PATTERN, PHONE_PATTERN, SENSITIVE_KEYS, TOKEN_PATTERN, UNSAFE_SUBSTRINGS

# --- fixed values -----------------------------------------------------------------------
HIDDEN = "***REDACTED***"
SAMPLES = "samples"
MAX_SAMPLES = 5
# ------------------------------------------------------------------------------------------

_MASKS = [(re.compile(TOKEN_PATTERN), "***"), (re.compile(EMAIL_PATTERN), "***@***"), (re.compile(PHONE_PATTERN), r"***-***-\1")]


def _members(value: Any, per_key: Callable[[str, Any], Any]) -> Any:
    """A copy of ``value`` whose records are rewritten key by key, in lists of lists too."""
    if isinstance(value, dict):
        return {k: per_key(k, v) for k, v in value.items()}
    return [_members(v, per_key) for v in value] if isinstance(value, list) else value


def without_secrets(value: Any) -> Any:
    """Whatever a sensitive key holds is replaced, records and lists included."""
    return _members(value, lambda k, v: HIDDEN if k.lower() in SENSITIVE_KEYS else without_secrets(v))


def _masked(sample: Any) -> Any:
    if not isinstance(sample, str):
        return minimised(sample)
    for pattern, by in _MASKS:
        sample = pattern.sub(by, sample)
    return sample


def _is_unsafe(sample: Any) -> bool:
    if not isinstance(sample, (str, dict, list)):
        return False
    low = (sample if isinstance(sample, str) else json.dumps(sample, ensure_ascii=False)).lower()
    return any(p in low for p in UNSAFE_SUBSTRINGS)


def minimised(value: Any) -> Any:
    """Of each list named ``samples`` the first five; of those no unsafe ones, and personal data masked."""
    return _members(
        value,
        lambda k, v: [_masked(s) for s in v[:MAX_SAMPLES] if not _is_unsafe(s)]
        if k == SAMPLES and isinstance(v, list)
        else minimised(v),
    )


def _rewritten(rewrite: Callable[[Any], Any]):
    @F.pandas_udf("string")
    def apply(cells: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            try:
                return json.dumps(rewrite(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):  # no JSON, or nested too deep to be searched
                return HIDDEN

        return pd.Series([one(t) for t in cells], dtype=object)

    return apply


def _treat(c: Column, concerned: Column, rewrite: Callable[[Any], Any]) -> Column:
    """``concerned`` may take in too much, never too little; a key can be spelt with escapes."""
    concerned = concerned | F.contains(c, F.lit("\\u"))
    return F.when(concerned, _rewritten(rewrite)(F.when(concerned, c))).otherwise(c)


def redact_payload(c: Column) -> Column:
    """JSON text with the values of sensitive keys replaced, at any depth."""
    low = F.lower(c)
    named = F.lit(False)
    for key in sorted(SENSITIVE_KEYS):
        named = named | F.contains(low, F.lit(key))
    return _treat(c, named, without_secrets)


def minimise_payload(c: Column, allow_sharing: bool = False) -> Column:
    """JSON text with every list of samples shortened, filtered and masked, at any depth."""
    return c if allow_sharing else _treat(c, F.contains(c, F.lit(f'"{SAMPLES}"')), minimised)
