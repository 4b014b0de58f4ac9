"""Options of an admission check or a traversal (driver side only)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from pagemill.functions.patterns import PatternError, spark_regex

SCOPES = ("site", "host", "any")
PATTERN_KINDS = ("regex", "glob")

# Option names of a crawl configuration file that describe
# fetching, pacing or output and so have no meaning for tables.
FETCH_ONLY_OPTIONS = frozenset(
    {
        "auto_detect_content",
        "delay_range",
        "extract_all_pages",
        "headers",
        "llm_api_key",
        "output_path",
        "save_html",
        "threads",
        "use_selenium",
    }
)


@dataclass(frozen=True)
class CrawlOptions:
    """What may be visited, and how far.

    ``scope``: ``site`` keeps every host of the seed's base domain, ``host``
    only the seed's own host, ``any`` switches the check off.
    """

    start_url: str
    max_pages: int = 100
    max_depth: int = 3
    scope: str = "site"
    respect_robots: bool = True
    user_agent: str = "Pagemill/1.0"
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    pattern_kind: str = "regex"
    page_types: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "include_patterns", tuple(self.include_patterns))
        object.__setattr__(self, "exclude_patterns", tuple(self.exclude_patterns))
        if self.page_types is not None:
            object.__setattr__(self, "page_types", tuple(self.page_types))
        if self.scope not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}, got {self.scope!r}")
        if self.pattern_kind not in PATTERN_KINDS:
            raise ValueError(f"pattern_kind must be one of {PATTERN_KINDS}, got {self.pattern_kind!r}")
        if self.max_pages < 0 or self.max_depth < 0:
            raise ValueError("max_pages and max_depth must not be negative")
        self.include_regexes, self.exclude_regexes  # noqa: B018  (fail early on a bad pattern)

    @property
    def include_regexes(self) -> tuple[str, ...]:
        return tuple(as_regex(p, self.pattern_kind) for p in self.include_patterns)

    @property
    def exclude_regexes(self) -> tuple[str, ...]:
        return tuple(as_regex(p, self.pattern_kind) for p in self.exclude_patterns)

    @classmethod
    def from_mapping(cls, config: Mapping) -> CrawlOptions:
        """Build options from a parsed configuration file; unknown keys raise ``TypeError``."""
        known = {f.name for f in fields(cls)}
        kwargs = {}
        for key, value in config.items():
            if key in known:
                kwargs[key] = value
            elif key == "stay_on_subdomains":
                kwargs.setdefault("scope", "site" if value else "any")
            elif key == "page_types_to_extract":
                kwargs.setdefault("page_types", tuple(value))
            elif key not in FETCH_ONLY_OPTIONS:
                raise TypeError(f"unknown option {key!r}")
        return cls(**kwargs)


def as_regex(pattern: str, kind: str = "regex") -> str:
    """Turn a URL pattern into a regex of Spark for an unanchored search.

    Regex patterns are those of Python's ``re`` and find what ``re.search`` finds.  Glob patterns cover the whole URL,
    ``*`` stands for any run and ``?`` for one character.  Where a session runs, its own compiler has the last word.
    """
    if kind == "glob":
        pieces = {"*": ".*", "?": "."}
        pattern = r"(?s)\A" + "".join(pieces.get(ch, re.escape(ch)) for ch in pattern) + r"\Z"
    try:
        translated = spark_regex(pattern)
    except PatternError as err:
        raise ValueError(f"URL pattern {pattern!r} is not a regular expression that can be used ({err}); use pattern_kind='glob' for wildcards") from err
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(translated)
        except Exception as err:
            raise ValueError(f"Spark does not take the URL pattern {pattern!r}, which it reads as {translated!r}") from err
    return translated
