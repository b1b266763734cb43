"""Names, relation sets and thresholds."""

from __future__ import annotations

# Relations by which one artifact produces another.
PRODUCERS = ["was_generated_by", "confirmed_export", "can_generate", "content_matches", "embedded_bytes_match", "candidate_export", "derived_from", "generated", "exported_to", "candidate_source", "embedded_in", "observed_created_during", "observed_modified_during", "created_during", "modified_during"]
# Relations that tell a cause if they are verified.
VERIFIED_CAUSAL = ["was_generated_by", "confirmed_export"]
# Relations along which staleness is passed on.
STALE = [*PRODUCERS, "declares_read", "observed_used_during", "read_by", "used", "imports"]
# Relations whose claims on one target compete.
COMPETING = ["was_generated_by", "confirmed_export", "can_generate", "generated", "content_matches", "embedded_bytes_match", "candidate_export", "exported_to", "observed_created_during", "observed_modified_during", "created_during", "modified_during"]
# Least score of each confidence label, and the assurance that goes with it.
CONFIDENCE = [("exact", 1.0), ("strong", 0.8), ("probable", 0.55), ("weak", 0.3)]
ASSURANCE = {"exact": "verified", "strong": "strong-candidate", "probable": "candidate", "weak": "weak-signal", "unknown": "insufficient"}
# How evidence of each mode came to be known.
BASIS = {"captured": "observation", "metadata": "observation", "git": "observation", "imported": "observation", "explicit": "declaration", "static": "inference", "content": "inference", "heuristic": "inference", "confirmed": "confirmation"}
# Kinds of files by suffix.
KINDS = {
    "code": ["py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "sh", "bash", "zsh", "ps1", "bat", "cmd", "sql", "r", "m", "java", "c", "h", "cc", "cpp", "cxx", "hpp", "hxx", "cs", "go", "rs", "rb", "php", "swift", "kt", "kts", "scala", "sc", "jl"],
    "notebook": ["ipynb"],
    "data": ["csv", "tsv", "parquet", "feather", "json", "jsonl", "sqlite", "db", "npy", "npz", "pkl"],
    "document": ["docx", "pptx", "xlsx", "pdf", "odt", "odp", "ods", "epub", "md", "rst", "adoc", "org", "tex", "html", "htm", "rtf", "txt", "log"],
    "image": ["png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "bmp", "svg"],
    "configuration": ["toml", "yaml", "yml", "ini", "cfg", "xml"],
}
# Suffixes of documents that others are exported from, and of exports.
EDITABLE = ["docx", "pptx", "xlsx", "odt", "odp", "ods", "epub", "md", "html", "htm", "svg"]
EXPORTED = ["pdf", "png", "jpg", "jpeg"]
# Suffixes that a literal reference may end in, by group of text files and others.
TEXTS = ["txt", "log", "md", "rst", "adoc", "org", "tex", "json", "jsonl", "yaml", "yml", "toml", "ini", "cfg", "xml", "csv", "tsv", "html", "htm", "css", "scss", "svg", *KINDS["code"], "ipynb"]
REFERRED = [*TEXTS, "docx", "pptx", "xlsx", "pdf", "odt", "odp", "ods", "epub", "png", "jpg", "jpeg", "tif", "tiff", "webp", "gif", "bmp", "parquet", "feather", "sqlite", "db", "npy", "npz", "pkl", "bin", "model", "onnx", "pt", "pth"]
# Classes of relations in a provenance export; all others are Influence.
CLASSES = {
    "Usage": ["used", "read_by", "imports", "references"],
    "Generation": ["generated", "created_during", "modified_during", "renamed_during", "expected_output"],
    "Derivation": ["derived_from", "exported_to", "candidate_source", "similar_to", "embedded_in"],
    "Association": ["was_associated_with"],
}
# Every relation that claims have.
RELATIONS = sorted({*PRODUCERS, *STALE, *COMPETING, *(r for v in CLASSES.values() for r in v), "downloaded_from", "observed_rename", "observed_rename_during", "observed_deleted_during", "run_of", "calls"})
# Relations along which the origin of a candidate is followed.
UPSTREAM = ["read_by", "generated", "derived_from", "exported_to"]
DEFAULT_MIN, DEFAULT_DEPTH = 0.3, 5
