"""Which file names are work, noise or sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import extension

# Extensions of code, documents and data.
CODE = [
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "vue", "svelte", "py", "java", "kt", "go", "rs", "rb", "php", "cs", "cpp", "c", "h", "swift", "scala",
    "sh", "ps1", "lua", "dart",
]
DOCUMENT = [
    "md", "markdown", "txt", "rst", "adoc", "docx", "doc", "pdf", "pptx", "ppt", "rtf", "odt", "tex",
]
DATA = [
    "sql", "csv", "tsv", "xlsx", "xls", "ods", "json", "jsonl", "yaml", "yml", "xml",
]
#: One of these alone is a piece of work.
DOCUMENT_WORK = [*DOCUMENT, "xlsx", "xls", "ods", "csv"]
# Extensions of work.
WORK = [
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "vue", "svelte", "py", "ipynb", "java", "kt", "kts", "go", "rs", "rb", "php", "cs", "cpp", "cc", "c", "h",
    "hpp", "swift", "m", "mm", "scala", "sh", "bash", "zsh", "ps1", "bat", "lua", "pl", "r", "dart", "ex", "exs", "clj", "hs", "html", "htm", "css",
    "scss", "sass", "less", "ejs", "hbs", "pug", "astro", "md", "markdown", "txt", "rst", "adoc", "org", "tex", "docx", "doc", "pdf", "rtf", "odt",
    "pptx", "ppt", "key", "numbers", "pages", "sql", "csv", "tsv", "xlsx", "xls", "ods", "json", "jsonl", "yaml", "yml", "toml", "ini", "conf", "cfg",
    "properties", "env-example", "xml", "proto", "graphql", "gql", "drawio", "excalidraw", "fig", "sketch", "psd", "ai", "svg", "png", "jpg", "jpeg",
    "gif", "webp",
]
# Names of work without a telling extension.
WORK_NAMES = [
    "Dockerfile", "Makefile", "Justfile", "Rakefile", "Gemfile", "Procfile", "Brewfile", "README", "LICENSE", "CHANGELOG", "CONTRIBUTING", "AGENTS",
    "CLAUDE", "requirements.txt", "go.mod", "go.sum", "Cargo.toml", "pom.xml", "build.gradle",
]
# Names that are noise whatever their extension.
NOISE = [
    r"^~\$",
    r"^\.~lock\.",
    r"(?i)\.db(-shm|-wal|-journal)?$",
    r"(?i)^NTUSER\.DAT",
    r"(?i)\.(regtrans-ms|blf|pma|etl|evtx|dmp|crdownload|part|partial|swp|swo|orig|rej)$",
    r"(?i)^(Thumbs\.db|desktop\.ini|\.DS_Store|lockfile|\.lock)$",
    r"(?i)\.(lock|pid|tmp|temp|bak|old|cache)$",
    r"(?i)^(pg_control|pg_internal\.init|postmaster\.(pid|opts)|current_logfiles)$",
    r"(?i)^(Config\.cfg|Local State|Last Browser|Variations|Preferences)$",
    r"(?i)\.(lnk|url|webloc|exe|msi|dmg|pkg|deb|rpm|appimage|zip|7z|rar|tar|gz|xz|iso)$",
    r"(?i)^BrowserMetrics",
    r"(?i)\.log(\.\d+)?$",
]
# Names that are not even recorded.
SENSITIVE = [
    r"(?i)^\.env(\..+)?$",
    r"(?i)\.(pem|key|p12|pfx|keystore|jks|asc|gpg)$",
    r"(?i)^id_(rsa|dsa|ecdsa|ed25519)(\.pub)?$",
    r"(?i)^credentials?\.(json|ya?ml|ini|toml)$",
    r"(?i)^\.?(npmrc|netrc|pgpass|htpasswd)$",
    r"(?i)^(service-account|gcp-key|aws-credentials).*\.json$",
    r"(?i)\.kdbx$",
]


def _any(name: Column, patterns: list[str]) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in patterns))


def is_noise(name: Column) -> Column:
    return _any(name, NOISE)


def is_sensitive(name: Column) -> Column:
    return _any(name, SENSITIVE)


def is_work(name: Column, everything: bool = False, extra: tuple[str, ...] = ()) -> Column:
    good = F.lit(True) if everything else extension(name).isin([*WORK, *extra]) | name.isin(WORK_NAMES)
    return ~is_noise(name) & good
