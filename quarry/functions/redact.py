"""Redaction of secrets in snippets, as column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark, and the patterns of secrets (.NET's \s and \b in Java's Unicode mode).
MARK = "«REDACTED»"
INTERPOLATED = r'(?iuU)\$"[^"]*\{[^}]*(?:password|secret|token|api[_-]?key)[^}]*\}[^"]*"'
PEM = r"-----BEGIN [A-Z ]+PRIVATE KEY-----[\s\S]+?-----END [A-Z ]+PRIVATE KEY-----"
JWT = r"(?U)\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
GITHUB = r"(?U)\b(?:ghp_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{20,})\b"
AWS = r"(?U)\bAKIA[0-9A-Z]{16}\b"
KEY_VALUE = r"""(?iuU)(password|secret|token|api[_-]?key|connection[_-]?string|client[_-]?secret|private[_-]?key)\s*[:=]\s*(["']?)([^"'\r\n,;]+)\2"""

#: In the order they are replaced.
WHOLE = (("pem_private_key", PEM), ("jwt", JWT), ("github_pat", GITHUB), ("aws_access_key", AWS))
SPELLED = {"connectionstring": "connection_string", "apikey": "api_key", "clientsecret": "client_secret", "privatekey": "private_key"}


#: What a text must hold for any of the patterns to match, as it stands or in lower case; and the letters beyond ASCII that match one of ASCII's in any case.
STANDS = ("-----BEGIN ", "eyJ", "ghp_", "github_pat_", "AKIA")
NAMED = ("password", "secret", "token", *(a + x + b for a, b in (("api", "key"), ("connection", "string"), ("private", "key")) for x in ("", "_", "-")))
ALIKE = ("\u0130", "\u0131", "\u017f", "\u212a")


def _may_match(text: Column) -> Column:
    """False only where no pattern can match: looks for fixed words, which is much cheaper than the patterns."""
    low = F.lower(text)
    return reduce(or_, [*(text.contains(x) for x in (*STANDS, *ALIKE)), *(low.contains(x) for x in NAMED)])


def redact(snippet: Column) -> Column:
    """struct<text, status, hits>. A secret put together in an interpolated string can't be replaced safely: status is
    `failed` and the text as it was. Else each secret is replaced, status is `redacted`, or `no_match` without one."""
    text = F.coalesce(snippet, F.lit(""))
    clean = F.struct(text.alias("text"), F.lit("no_match").alias("status"), F.array().cast("array<string>").alias("hits"))
    return F.when(_may_match(text), _redacted(text)).otherwise(clean)


def _redacted(text: Column) -> Column:
    hits = []
    now = text
    for label, pattern in WHOLE:
        found = F.size(F.regexp_extract_all(now, F.lit(pattern), F.lit(0)))
        hits.append(F.array_repeat(F.lit(label), found))
        now = F.regexp_replace(now, pattern, MARK)
    keys = F.transform(F.regexp_extract_all(now, F.lit(KEY_VALUE), F.lit(1)), F.lower)
    spelled = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    hits.append(F.transform(keys, lambda k: F.concat(F.lit("key_value:"), F.coalesce(F.try_element_at(spelled, k), k))))
    now = F.regexp_replace(now, KEY_VALUE, "$1=$2" + MARK + "$2")
    every = F.concat(*hits)
    failed = text.rlike(INTERPOLATED)
    return F.struct(
        F.when(failed, text).otherwise(now).alias("text"),
        F.when(failed, "failed").when(F.size(every) > 0, "redacted").otherwise("no_match").alias("status"),
        F.when(failed, F.array(F.lit("interpolated_secret"))).otherwise(every).alias("hits"),
    )
