"""Path predicates and the access rules built from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names left out, by use.
SKELETON_DIRS = [
    "bin", "obj", ".vs", ".git", "node_modules", "packages", ".idea", ".vscode", "TestResults",
]
INDEX_DIRS = ["bin", "obj", ".git", ".vs", "node_modules"]
WATCH_DIRS = ["bin", "obj", ".vs", ".git", "node_modules", "packages"]
BUILD_DIRS = ["bin", "obj"]
BLOCKED_DIRS = [
    ".git", ".ssh", "node_modules", "bin", "obj", "packages", ".vs", ".idea", "backups", "logs",
]

# File names that may not be read.
BLOCKED_NAMES = [
    "appsettings.json", "appsettings.Development.json", "appsettings.Production.json",
    "appsettings.Staging.json", "secrets.json", "user-secrets.json",
    "connectionstrings.config", "web.config", "app.config",
    ".env", ".env.local", ".env.development", ".env.production",
    "id_rsa", "id_rsa.pub", "*.pem", "*.pfx", "*.p12", "*.key", "*.cert",
    ".aws/credentials", ".azure/credentials", "gcp-key.json",
    "*.db", "*.sqlite", "*.mdf", "*.ldf",
]

# Name patterns that may not be read or written.
BLOCKED_PATTERNS = [
    "*secret*", "*password*", "*apikey*", "*credential*", "*token*", "*.private.*", ".git/config",
]

# Extensions that may be read.
ALLOWED_EXTENSIONS = [
    ".cs", ".vb", ".fs",
    ".csproj", ".vbproj", ".fsproj", ".sln", ".slnx",
    ".md", ".txt", ".rst",
    ".html", ".htm", ".css", ".js", ".ts", ".jsx", ".tsx",
    ".ps1", ".sh", ".bat", ".cmd",
    "Dockerfile", ".dockerignore",
    ".xml", ".yml", ".yaml", ".toml",
]

# Words that make a path sensitive.
SENSITIVE_WORDS = ["secret", "password", "credential", "apikey", "token", "private"]

# What a file is, by extension.
FILE_TYPES = {
    ".cs": "C# Source File",
    ".csproj": "C# Project File",
    ".sln": "Visual Studio Solution",
    ".slnx": "Visual Studio Solution (XML)",
    ".json": "JSON Configuration",
    ".xml": "XML Document",
    ".toml": "TOML Configuration",
    ".md": "Markdown Document",
    ".txt": "Text File",
    ".ps1": "PowerShell Script",
    ".yml": "YAML Configuration",
    ".yaml": "YAML Configuration",
    ".dockerfile": "Docker Configuration",
}

# Identifier, version and path formats.
PACKAGE_ID = r"^[A-Za-z0-9._\-]+$"
PACKAGE_VERSION = r"^[0-9]+\.[0-9]+(\.[0-9]+)?(\.[0-9]+)?(-[A-Za-z0-9\.]+)?$"
PROJECT_PATH = r"^[a-zA-Z0-9\\/:\\_\-\.\s]+$"


def norm_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_key(path: Column) -> Column:
    """Key of a path: forward slashes, lower case."""
    return F.lower(norm_path(path))


def segments(path: Column) -> Column:
    return F.split(norm_path(path), "/")


def file_name(path: Column) -> Column:
    return F.substring_index(norm_path(path), "/", -1)


def extension(path: Column) -> Column:
    """Extension with its dot, lower case; empty when the name has none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(norm_path(path), r"^(.*)/[^/]*$", 1)


def in_dirs(path: Column, dirs: list[str], case_sensitive: bool = False) -> Column:
    if case_sensitive:
        return F.arrays_overlap(segments(path), F.array(*[F.lit(d) for d in dirs]))
    return F.arrays_overlap(
        F.split(path_key(path), "/"), F.array(*[F.lit(d.lower()) for d in dirs])
    )


def not_excluded_dir(path: Column, dirs: list[str], case_sensitive: bool = False) -> Column:
    return ~in_dirs(path, dirs, case_sensitive)


def blocked_file_name(name: Column) -> Column:
    return F.lower(name).isin([n.lower() for n in BLOCKED_NAMES])


def glob_regex(pattern: str) -> str:
    parts = [{"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern]
    return "(?id)^" + "".join(parts) + "$"


def glob_match(name: Column, pattern: str) -> Column:
    """``*`` and ``?`` over the whole name, ignoring case."""
    return F.rlike(name, F.lit(glob_regex(pattern)))


def loose_glob(name: Column, pattern: str) -> Column:
    """``*`` only; the parts must occur in order anywhere. Without ``*`` the name must be equal."""
    if "*" not in pattern:
        return F.lower(name) == pattern.lower()
    body = ".*".join(re.escape(p) for p in pattern.split("*") if p)
    return F.rlike(name, F.lit("(?is)" + body))


def allowed_extension(ext: Column) -> Column:
    return (ext == "") | F.lower(ext).isin([e.lower() for e in ALLOWED_EXTENSIONS])


def sensitive_keyword(text: Column) -> Column:
    return F.rlike(F.lower(text), F.lit("|".join(SENSITIVE_WORDS)))


def read_reason(path: Column) -> Column:
    """First rule a read breaks, or null when the file may be read."""
    name = file_name(path)
    rules = [
        F.when(in_dirs(path, BLOCKED_DIRS), F.lit("blocked_dir")),
        F.when(blocked_file_name(name), F.lit("blocked_name")),
    ]
    rules += [F.when(glob_match(name, p), F.lit(f"blocked_pattern:{p}")) for p in BLOCKED_PATTERNS]
    rules += [
        F.when(~allowed_extension(extension(path)), F.lit("extension_not_allowed")),
        F.when(sensitive_keyword(path), F.lit("sensitive_keyword")),
    ]
    return F.coalesce(*rules)


def depth_floor(path: Column) -> Column:
    """Lowest depth reached while walking the path; negative when it leaves its root."""
    step = (
        lambda part: F.when(part == "..", F.lit(-1))
        .when((part == "") | (part == "."), F.lit(0))
        .otherwise(F.lit(1))
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("floor"))

    def walk(state: Column, part: Column) -> Column:
        depth = state["depth"] + step(part)
        return F.struct(depth.alias("depth"), F.least(state["floor"], depth).alias("floor"))

    return F.aggregate(segments(path), start, walk)["floor"]


def inside_root(path: Column) -> Column:
    # few paths have a step upwards, and only those are walked
    return F.when(F.contains(path, F.lit("..")), depth_floor(path) >= 0).otherwise(F.lit(True))


def write_reason(path: Column) -> Column:
    """First rule a write breaks, or null. Names and extensions are not checked."""
    name = file_name(path)
    rules = [
        F.when(~inside_root(path), F.lit("path_traversal")),
        F.when(in_dirs(path, BLOCKED_DIRS), F.lit("blocked_dir")),
    ]
    rules += [F.when(loose_glob(name, p), F.lit(f"blocked_pattern:{p}")) for p in BLOCKED_PATTERNS]
    return F.coalesce(*rules)


def is_test_path(path: Column) -> Column:
    key = norm_path(path)
    return F.contains(key, F.lit("/Tests/")) | F.contains(key, F.lit("/Test/"))


def file_type_label(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(ext)), F.lit("Unknown"))


def valid_id(text: Column) -> Column:
    return F.rlike(text, F.lit(PACKAGE_ID)) & (F.length(text) <= 200)


def valid_version(text: Column) -> Column:
    return F.rlike(text, F.lit(PACKAGE_VERSION))


def valid_path(text: Column) -> Column:
    return F.rlike(text, F.lit(PROJECT_PATH))


def environment_reason(name: Column, url: Column, auth: Column, secret: Column) -> Column:
    """Why an environment may not be stored, or null."""
    host = F.try_parse_url(F.trim(url), F.lit("HOST"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank(name), F.lit("name required"))
        .when(blank(url), F.lit("url required"))
        .when(
            host.isNull() | ~F.rlike(F.trim(url), F.lit("(?i)^https?://")),
            F.lit("url must be http or https"),
        )
        .when((auth == "Bearer") & blank(secret), F.lit("token required"))
        .when((auth == "Basic") & blank(secret), F.lit("username required"))
    )
