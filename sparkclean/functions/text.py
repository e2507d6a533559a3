"""Column functions on text: blanks, case, guards, masking. All run inside the JVM
except :func:`nfkc`, which is only applied to rows that hold foldable characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values -----------------------------------------------------------
# Characters that count as white space when a cell is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Text that addresses a language model instead of being data.
INSTRUCTION_PATTERNS = (
    r"\b(ignore|disregard|forget|override)\b.{0,40}\b(instructions?|prompts?|rules)\b",
    r"<\|?\s*(system|im_start|im_end|assistant)\s*\|?>",
    r"(^|\n)\s*(system|assistant)\s*:",
    r"\byou are now\b",
    r"\b(reveal|print|show)\b.{0,30}\b(system prompt|secrets?|api keys?)\b",
    r"\bdo not follow\b",
    r"\bas an ai\b",
    r"\bdrop\s+table\b",
    r"<script",
    r"```",
)

# Lower-case substrings that mark a sample as unsafe to share.
UNSAFE_SUBSTRINGS = (
    "ignore previous instructions",
    "ignore all instructions",
    "system:",
    "delete all",
    "drop table",
    "disregard",
    "jailbreak",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "do anything now",
    "override instructions",
    "forget all instructions",
    "new instructions:",
)

# Keys whose values are never written to a log.
SENSITIVE_KEYS = (
    "api_key",
    "apikey",
    "authorization",
    "password",
    "credential",
    "credential_ciphertext",
    "token",
    "secret",
)

TOKEN_PATTERN = (
    r"\b(?:sk-[A-Za-z0-9_-]{16,}|gsk_[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9_-]{16,}|"
    r"Bearer\s+[A-Za-z0-9._-]{16,}|ey[A-Za-z0-9_-]{20,}|[A-Za-z0-9_-]{32,})\b"
)
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_PATTERN = r"(?:\+?\d{1,4}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{2,5}[-.\s]?(\d{4})\b"

# Text a spreadsheet would run as a formula; a leading minus is fine before a number.
FORMULA_PATTERN = r"^[=+@\t\r]|^-[^0-9.]"

CODE_PATTERN = r"^[A-Za-z]{1,10}[-_ ]?\d{2,12}$"
CODE_MAX_CHARS = 23
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no", "t", "f", "y", "n")
# --- end of fixed values ----------------------------------------------------

INSTRUCTION_REGEX = "(?is)" + "|".join(f"(?:{p})" for p in INSTRUCTION_PATTERNS)
_INSTRUCTION_JAVA = "(?U)" + INSTRUCTION_REGEX

# Non-ASCII characters that NFKC maps to themselves and that never combine; a text made
# of ASCII and these needs no folding. Everything else goes through the exact fold.
_STABLE = (
    "\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AC\\u00AE\\u00B0-\\u00B1\\u00B6-\\u00B7\\u00BB\\u00BF"
    "\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0180-\\u01C3\\u01CD-\\u01F0"
    "\\u01F4-\\u024F\\u0400-\\u0481\\u2010\\u2013\\u2014\\u2018-\\u201E\\u2020-\\u2022\\u20AC"
    "\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FFF"
)
# The long class is only looked at behind a character that is not ASCII.
_FOLDABLE = f"[^\\x00-\\x7F](?<![{_STABLE}])"


def strip_ws(c: Column) -> Column:
    """Trim every kind of white space (plain ``trim`` only knows the space)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip_ws(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip_ws(c) != "", c)


def title_case(c: Column) -> Column:
    """First letter of every run of cased letters upper, the rest lower
    (``o'neil-smith`` -> ``O'Neil-Smith``; ``initcap`` only looks at spaces)."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(c, F.lit(f"[{cased}]+|[^{cased}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 2**31 - 1))),
        ),
        "",
    )


def remove_chars(c: Column, chars: str) -> Column:
    return F.translate(c.cast("string"), chars, "") if chars else c


def is_trimmed_code(t: Column) -> Column:
    return (F.length(t) <= CODE_MAX_CHARS) & t.rlike(CODE_PATTERN)


def looks_like_code(c: Column) -> Column:
    return is_trimmed_code(strip_ws(c))


def is_trimmed_boolean(t: Column) -> Column:
    return (F.length(t) <= 5) & F.lower(t).isin(*BOOLEAN_WORDS)


def looks_boolean(c: Column) -> Column:
    return is_trimmed_boolean(strip_ws(c))


# --- instruction-like text ----------------------------------------------------


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def drop_format_chars(c: Column) -> Column:
    """Remove zero-width, bidi and other invisible format characters."""
    return F.regexp_replace(c, r"\p{Cf}", "")


_WIDE = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)) + " "


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _hides(c: Column) -> Column:
    """Holds a character that folding could touch; plain ASCII is decided by its length."""
    return ~is_ascii(c) & c.rlike(_FOLDABLE)


def fold_native(c: Column) -> Column:
    """Invisible characters out, full-width ASCII to ASCII."""
    return F.when(_hides(c), F.translate(drop_format_chars(c), _WIDE, _NARROW)).otherwise(c)


def needs_fold(folded: Column) -> Column:
    """Texts that NFKC could still change after :func:`fold_native`."""
    return _hides(folded)


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def _may_instruct(low: Column) -> Column:
    """Cheap necessary condition on the lowered text: the fixed words without which no
    pattern can match. A dotless or dotted i equals i for a case-blind pattern, so a text
    that has one is not decided here."""

    def has(*words: str) -> Column:
        out = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(low, F.lit(w))
        return out

    return (
        has("<script", "```", "you are now", "do not follow", "as an ai", "\u0131", "\u0307")
        | (has("drop") & has("table"))
        | (has("ignore", "disregard", "forget", "override") & has("instruction", "prompt", "rules"))
        | (has("reveal", "print", "show") & has("system prompt", "secret", "api key"))
        | (has("system", "assistant", "im_start", "im_end") & has("<", ":"))
    )


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def instruction_match(folded: Column) -> Column:
    """The matched text, or NULL; ``folded`` is already free of hiding tricks."""
    may = bind(F.lower(folded), _may_instruct)
    hit = F.when(may, F.regexp_extract(folded, _INSTRUCTION_JAVA, 0))
    return F.nullif(hit, F.lit(""))


def has_instruction(folded: Column) -> Column:
    return bind(F.lower(folded), _may_instruct) & folded.rlike(_INSTRUCTION_JAVA)


# --- sharing and export guards --------------------------------------------------


def has_unsafe_substring(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for p in UNSAFE_SUBSTRINGS:
        out = out | low.contains(p)
    return out


def _replace_words(c: Column, pattern: str, by: str) -> Column:
    """Word boundaries and digits follow Unicode, which only matters beyond ASCII."""
    return F.when(is_ascii(c), F.regexp_replace(c, pattern, by)).otherwise(F.regexp_replace(c, "(?U)" + pattern, by))


def redact_pii(c: Column) -> Column:
    """Long tokens first, then e-mail addresses, then telephone numbers. The last two are
    only searched where a sign of them exists."""
    out = _replace_words(c, TOKEN_PATTERN, "***")
    out = F.when(F.contains(out, F.lit("@")), _replace_words(out, EMAIL_PATTERN, "***@***")).otherwise(out)
    return F.when(out.rlike("(?U)\\d{2}[-.\\s]?\\d{4}"), _replace_words(out, PHONE_PATTERN, "***-***-$1")).otherwise(out)


def mask_sample(c: Column, keep: int = 2) -> Column:
    return F.when(F.length(c) > keep + 2, F.concat(F.substring(c, 1, keep), F.lit("***"))).otherwise(c)


def minimise_samples(samples: Column, allow_sharing: bool = False) -> Column:
    """First five samples, unsafe ones dropped, personal data masked (array<string>)."""
    if allow_sharing:
        return samples
    return F.transform(F.filter(F.slice(samples, 1, 5), lambda s: ~has_unsafe_substring(s)), redact_pii)


def redact_keys(m: Column) -> Column:
    """Values of sensitive keys in a ``map<string,string>`` are replaced."""
    return F.transform_values(
        m, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("***REDACTED***")).otherwise(v)
    )


def neutralise_formula(c: Column) -> Column:
    return F.when(c.rlike(FORMULA_PATTERN), F.concat(F.lit("'"), c)).otherwise(c)
