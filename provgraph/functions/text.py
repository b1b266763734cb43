"""Text functions as columns: shingles, references, redaction, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# Values that are secret by the word before them, keys of metadata that are, credentials in URLs.
SECRET = r"(?i)(password|passwd|token|secret|api[-_]?key|authorization)(\s*[:=]\s*)([^\s,;]+)"
SENSITIVE = r"(?i)(conversation|transcript|messages?|prompt|environment|env|password|passwd|token|secret|api[-_]?key|authorization|cookie)"
CREDENTIAL = r"(?i)([a-z][a-z0-9+.-]*://[^:/\s]+:)([^@/\s]+)(@)"
# Literal references in texts: links, attributes, style sheets, quoted strings.
REFERENCES = {
    "link": r"!?\[[^\]]*\]\(([^)]+)\)",
    "attribute": r"(?i)(?:href|src)\s*=\s*[\"']([^\"']+)[\"']",
    "css": r"(?i)url\(\s*[\"']?([^)\"']+)[\"']?\s*\)",
    "double": r'"([^\x22\x27\r\n]{1,1024})"',
    "single": r"'([^\x22\x27\r\n]{1,1024})'",
}


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def shingle_hashes(found: Column, width: int = 5) -> Column:
    """Distinct hashes of runs of words; none of a text that has fewer. No run is built as a string."""
    runs = F.transform(F.sequence(F.lit(0), F.size(found) - width), lambda i: F.xxhash64(*(F.get(found, i + k) for k in range(width))))
    return F.when(F.size(found) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def shingles(found: Column, width: int = 5) -> Column:
    """Distinct runs of words; none of a text that has fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(found) - (width - 1)), lambda i: F.array_join(F.slice(found, i, width), " "))
    return F.when(F.size(found) >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1$2[REDACTED]")


def summary(text: Column) -> Column:
    """One line, secrets redacted, at most 240 characters."""
    line = redacted(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(F.length(line) > 240, F.concat(F.left(line, F.lit(239)), F.lit("…"))).otherwise(line)


def private_reference(value: Column, prefix: str) -> Column:
    """An id that does not tell what it stands for."""
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(F.coalesce(value, F.lit(prefix)), 256), F.lit(16)))


def safe_metadata(metadata: Column) -> Column:
    """map<string, string> without sensitive keys, secrets and credentials in values redacted."""
    kept = F.map_filter(metadata, lambda k, v: ~k.rlike(SENSITIVE))
    return F.transform_values(kept, lambda k, v: F.regexp_replace(redacted(v), CREDENTIAL, "$1[REDACTED]$3"))


def cleaned_reference(raw: Column) -> Column:
    """A reference without fragment and query; null for anchors and other schemes."""
    cut = F.substring_index(F.substring_index(raw, "#", 1), "?", 1)
    return F.when(~raw.rlike(r"^(#|data:|mailto:|javascript:|[A-Za-z][A-Za-z0-9+.-]*://)") & (cut != ""), cut)


def safe_url(url: Column) -> Column:
    """Scheme, lowered host and path of web and ftp addresses; no credentials, query or fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://([^?#]*)", 1), r"^[^/@]*@", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    path = F.regexp_extract(rest, r"^[^/]*(.*)$", 1)
    return F.when(scheme.isin("http", "https", "ftp"), F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path)))).when(scheme == "file", F.lit("file:///[local-path-redacted]"))


def redacted_command(args: Column) -> Column:
    """Arguments with secret values hidden: after ``--password`` and the like the next one is."""
    flag = r"(?i)^--?(password|passwd|token|secret|api[_-]?key)$"

    def step(acc, arg):
        plain = F.regexp_replace(F.regexp_replace(arg, r"(?i)^(--?(?:password|passwd|token|secret|api[_-]?key)=).*$", "$1[REDACTED]"), r"(://[^/:@]+:)[^@/]+@", "$1[REDACTED]@")
        shown = F.when(acc["hide"], F.lit("[REDACTED]")).otherwise(plain)
        return F.struct(F.concat(acc["out"], F.array(shown)).alias("out"), (~acc["hide"] & arg.rlike(flag)).alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))
    return F.aggregate(args, start, step, lambda acc: acc["out"])
