"""Concepts that a query can name and the words that documents about them use."""

from __future__ import annotations

#: id: (label, triggers, words to search for as well). Written for software collections; edit freely.
CONCEPTS = {
    "auth": ("Authentication", ["auth", "login", "oauth", "sso", "authentication", "authorization"], ["authentication", "oauth", "session", "identity", "access control", "jwt"]),
    "http-client": ("HTTP clients", ["http client", "fetch", "http-client", "rest client"], ["http client", "request", "fetch", "retry"]),
    "jobs": ("Background jobs", ["jobs", "queue", "background jobs", "workflow", "scheduler"], ["queue", "workflow", "worker", "scheduler", "durable"]),
    "database": ("Databases", ["database", "sql", "orm", "db"], ["database", "sql", "query", "orm", "storage"]),
    "vector-search": ("Vector search", ["vector", "embedding", "embeddings", "vector search", "vector-database"], ["vector", "embedding", "similarity", "semantic search"]),
    "tui": ("Terminal interfaces", ["tui", "terminal ui", "terminal"], ["terminal", "tui", "console", "curses"]),
    "rate-limit": ("Rate limits", ["rate limit", "rate-limit", "throttle", "throttling"], ["rate limit", "throttle", "token bucket", "quota"]),
    "state": ("State management", ["state", "store", "state management"], ["state management", "store", "reactive"]),
    "testing": ("Testing", ["test", "testing", "mock"], ["testing", "mock", "assertion", "fixture"]),
    "caching": ("Caching", ["cache", "caching"], ["cache", "memoize", "lru"]),
    "cli": ("Command lines", ["cli", "command line"], ["command line", "argument parser", "shell"]),
    "observability": ("Observability", ["observability", "tracing", "metrics", "logging"], ["tracing", "metrics", "logging", "telemetry"]),
    "validation": ("Validation", ["validation", "schema", "validate"], ["schema", "validation", "parser"]),
    "editor": ("Editors", ["editor", "ide", "text editor"], ["editor", "syntax highlighting", "language server"]),
    "ui": ("Interface kits", ["ui", "components", "design system"], ["component", "design system", "widget"]),
}

#: The lab profile: fewer concepts, single-word triggers, no cap.
LAB_CONCEPTS = {k: (v[0], [t for t in v[1] if " " not in t and "-" not in t], v[2]) for k, v in CONCEPTS.items() if k in ("auth", "http-client", "jobs", "vector-search", "tui", "rate-limit", "database")}
