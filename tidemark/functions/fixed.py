"""Values that must be as they are for results to agree."""

from __future__ import annotations

# Suffixes of files that shouldn't be published at all.
HIGH_RISK_SUFFIXES = (".doc", ".docx", ".pdf", ".xls", ".rar", ".7z", ".db", ".sqlite", ".log")
# Suffixes of files whose text is read.
TEXT_SUFFIXES = (".py", ".md", ".txt", ".json", ".js", ".html", ".css", ".yaml", ".yml", ".sh", ".command", ".bat", ".gitignore")
# Names that are read although they have no suffix.
TEXT_NAMES = (".gitignore",)
# A suffix that needs approval, and the approved paths.
SHEET_SUFFIX = ".xlsx"
APPROVED_SHEETS = ("input/简称.xlsx",)
# Path components below which nothing is scanned.
EXCLUDED_COMPONENTS = (".git", "__pycache__")
# Least length of an account name.
LEAST_NAME = 3
# Fixed values: (rule, pattern as reported, pattern for java.util.regex).
# White space is Unicode's and U+001C to U+001F.
HOME_RULE = ("home", r"/Users/[^/\s]+/", r"(?U)/Users/[^/\s\x1c-\x1f]+/")
PEM_RULE = ("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----")
KEY_RULE = ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", r"(?U)\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")
# The five states, worst last, and the three elements.
STATES = ("pass", "missing", "mismatch", "unreadable", "engine_error")
ELEMENTS = ("subject", "time", "result")
# States that people decide.
REVIEW_STATES = ("unreadable", "engine_error")
