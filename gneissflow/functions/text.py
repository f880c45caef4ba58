"""Text functions: redaction, tokens, clipping, canonical JSON, digests."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Redaction patterns, stop words, security words.  ASCII look-arounds stand for \b.
REDACT_WHOLE = [
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)(?<![A-Za-z0-9_])(Bearer)\s+[A-Za-z0-9._~+/=-]{8,}",
    r"(?<![A-Za-z0-9_])(AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])",
]
REDACT_HINTS = ["private key-----", "bearer", ("akia", "asia"), "eyj"]  # what a text must hold for each, in lower case
ASSIGN_HINTS = ("passw", "pwd", "secret", "token", "key")
REDACT_ASSIGN = r"""(?i)((?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key)\s*)[:=]\s*["']?[^\s"'`,;}\]]{4,}"""
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "be", "it", "this", "that", "which",
    "as", "at", "by", "from", "into", "about", "over", "under", "do", "does", "did",
]
SECURITY_WORDS = ["auth", "token", "secret", "password", "crypto", "credential", "session", "permission"]
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:[a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[a-z0-9]+(?:_[a-z0-9]+)+)(?![A-Za-z0-9_])"
MARKER = "…[truncated]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def redact(text: str | Column) -> Column:
    """Secrets replaced; of ``key = value`` the key stays.

    A pattern is tried only on texts that hold a word it needs, which few do.
    """
    out = _col(text)
    low = F.lower(out)
    holds = lambda words: F.exists(F.array(*[low.contains(w) for w in words]), lambda x: x)
    for rx, hint in zip(REDACT_WHOLE, REDACT_HINTS, strict=True):
        out = F.when(holds([hint] if isinstance(hint, str) else hint), F.regexp_replace(out, rx, F.lit("[REDACTED]"))).otherwise(out)
    return F.when(holds(ASSIGN_HINTS), F.regexp_replace(out, REDACT_ASSIGN, "$1[REDACTED]")).otherwise(out)


def redact_py(text: str) -> str:
    for rx in REDACT_WHOLE:
        text = re.sub(rx, "[REDACTED]", text, flags=re.ASCII)
    return re.sub(REDACT_ASSIGN, r"\1[REDACTED]", text, flags=re.ASCII)


def terms(text: str | Column) -> Column:
    """Lower-case words of 2 and more letters, camel case split, without stop words, each once."""
    words = F.filter(F.split(_col(text), "[^a-zA-Z0-9]+"), lambda w: F.length(w) >= 2)
    parts = F.flatten(F.transform(words, lambda w: F.split(w, "(?=[A-Z][a-z])")))
    low = F.transform(parts, lambda p: F.lower(p))
    return F.array_distinct(F.filter(low, lambda p: (F.length(p) >= 2) & ~p.isin(STOP_WORDS)))


def identifiers(text: str | Column) -> Column:
    """Dotted, Pascal-case and snake-case names, each once."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(IDENTIFIER), F.lit(0)))


def terms_py(text: str) -> tuple[list[str], list[str]]:
    parts = [p.lower() for w in re.split(r"[^a-zA-Z0-9]+", text) if len(w) >= 2 for p in re.split(r"(?=[A-Z][a-z])", w)]
    words = dict.fromkeys(p for p in parts if len(p) >= 2 and p not in STOP_WORDS)
    return list(words), list(dict.fromkeys(re.findall(IDENTIFIER, text)))


def line_count(text: str | Column) -> Column:
    return F.size(F.split(_col(text), "\n", -1))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenization pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def tokenizer(path: str = VOCABULARY):
    """The byte-pair encoding of a vocabulary file; None where the file or the library is missing."""
    try:
        with open(path, "rb") as f:
            return encoding(f.read())
    except (ImportError, OSError):
        return None


def encoding(vocabulary: bytes):
    """The byte-pair encoding of a vocabulary file's bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("estimator", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def estimator(path: str = VOCABULARY) -> str:
    """Name of the way tokens are counted: the vocabulary, or else bytes."""
    return os.path.basename(path).rsplit(".", 1)[0] if tokenizer(path) else "utf8-bytes/4"


def estimate_bytes(text: str | Column) -> Column:
    """Tokens by size, where no vocabulary is at hand: at least 1; a quarter of the UTF-8 bytes, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(_col(text)) / 4)).cast("long")


def estimate_bytes_py(text: str) -> int:
    return max(1, -(-len(text.encode()) // 4))


def estimate_tokens_py(text: str) -> int:
    """At least 1; tokens of the vocabulary, or else by size."""
    enc = tokenizer()
    return max(1, len(enc.encode_ordinary(text))) if enc else estimate_bytes_py(text)


def clip_py(text: str, limit: int, estimate: Callable[[str], int] = estimate_tokens_py) -> str:
    """``text`` cut to ``limit`` tokens with a marker: three bytes for a token, whole characters only;
    less where that still is too much."""
    if limit <= 0:
        return ""
    if estimate(text) <= limit:
        return text
    room = limit - estimate(MARKER)
    if room <= 0:
        return "…" if estimate("…") <= limit else ""
    size = room * 3
    while estimate(out := text.encode()[:size].decode("utf-8", "ignore") + MARKER) > limit and size:
        size = max(0, size - max(1, estimate(out) - limit))
    return out


def security_word(name: str | Column) -> Column:
    return F.lower(_col(name)).rlike("|".join(SECURITY_WORDS))


def utf16_key(text: str | Column) -> Column:
    """Sort key for the order of UTF-16 code units."""
    return F.hex(F.encode(_col(text), "UTF-16BE"))


def _plain(value):
    """Keys sorted by UTF-16 code units at every depth; whole floats as whole numbers."""
    if isinstance(value, dict):
        return {k: _plain(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e21 else value
    return value


def canonical_json(value) -> str:
    """Sorted keys, no white space, no ASCII escapes."""
    return json.dumps(_plain(value), ensure_ascii=False, separators=(",", ":"))


def digest_of(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def round4(x: float) -> float:
    """Four decimals of the exact binary value, ties away from zero."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(x).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))
