"""Provider errors as data: their kind, the text shown for it, whether to retry and after how long. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by which provider errors are told apart, in the order in which they are tried.
ERROR_KEYWORDS = {
    "rate_limit": ["rate limit", "too many requests", "quota exceeded", "requests per minute", "rpm exceeded", "rate_limit_exceeded", "quota_exceeded"],
    "auth": ["unauthorized", "authentication", "invalid api key", "api key", "forbidden", "access denied"],
    "network": ["network", "connection", "timeout", "econnrefused", "fetch failed", "offline"],
    "server_error": ["internal server error", "service unavailable", "500", "502", "503", "504"],
}
# Words that a message must all have to be an error of web search, in the order in which they are tried.
SEARCH_KEYWORDS = {
    "search_rate_limit": ["web_search", "rate"],
    "search_quota_exceeded": ["grounding", "quota"],
    "search_timeout": ["search", "timeout"],
    "search_provider_error": ["search", "error"],
}
# What users read for each kind, title and description.
ERROR_TEXTS = {
    "search_no_results": ("No search results", "Web search found no relevant information for this query."),
    "search_rate_limit": ("Search rate limited", "Too many search requests in a short time."),
    "search_timeout": ("Search timed out", "The web search took too long to complete."),
    "search_quota_exceeded": ("Search quota exceeded", "You have reached the search API limit for this period."),
    "search_provider_error": ("Search service error", "The search provider encountered an error."),
    "rate_limit": ("Rate limit exceeded", "Too many requests to the AI provider."),
    "auth": ("Authentication failed", "Invalid or expired API key."),
    "network": ("Network error", "Could not connect to the AI provider."),
    "server_error": ("Server error", "The AI provider is experiencing issues."),
    "invalid_request": ("Invalid request", "The request could not be processed."),
}
UNKNOWN_TEXT = "An unknown error occurred."
# Seconds to wait before a retry, 0 for all other kinds, and the kinds that a retry can't mend.
RETRY_WAIT_SECONDS = {"rate_limit": 60, "search_rate_limit": 60, "search_timeout": 5, "search_provider_error": 5, "server_error": 30}
NOT_RETRYABLE = ["auth", "invalid_request", "search_quota_exceeded"]


def error_class(message: Column, status: Column | None = None) -> Column:
    """rate_limit, auth, server_error, network or invalid_request, by status, else by keywords."""
    low = F.lower(message)
    out = F.when(F.lit(False), F.lit(""))
    if status is not None:
        out = out.when(status == 429, "rate_limit").when(status.isin(401, 403), "auth").when(status >= 500, "server_error")
    for name, keywords in ERROR_KEYWORDS.items():
        out = out.when(reduce(lambda a, b: a | b, [low.contains(k) for k in keywords]), name)
    return out.otherwise("invalid_request")


def search_error_class(message: Column) -> Column:
    """The kind of a web search error, null if it is none."""
    low = F.lower(message)
    tests = [F.when(reduce(lambda a, b: a & b, [low.contains(k) for k in words]), name) for name, words in SEARCH_KEYWORDS.items()]
    return F.coalesce(*tests)


def _looked_up(kind: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[kind]


def retry_wait(kind: Column) -> Column:
    return F.coalesce(_looked_up(kind, RETRY_WAIT_SECONDS), F.lit(0))


def retryable(kind: Column) -> Column:
    """Whether a retry can help; an unknown kind is worth one."""
    return F.coalesce(~kind.isin(NOT_RETRYABLE), F.lit(True))


def error_text(kind: Column, fallback: Column | None = None) -> Column:
    """Title and description of a kind; the fallback, or a general text, for others."""
    known = _looked_up(kind, {k: f"{title}: {text}" for k, (title, text) in ERROR_TEXTS.items()})
    return F.coalesce(known, *([] if fallback is None else [F.nullif(fallback, F.lit(""))]), F.lit(UNKNOWN_TEXT))
