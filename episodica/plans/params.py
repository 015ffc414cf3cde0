"""Parameters of searches and updates, and their validation at the two entrances."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

MODES = ("vector", "keyword", "hybrid")
DEFAULT_RESULTS, DEFAULT_ALPHA = 10, 0.7
UNSET: Any = object()


@dataclass(frozen=True)
class SearchParams:
    query: str = ""
    vector: list[float] | None = None
    mode: str = ""
    group_id: str = ""
    source: str = ""
    tags: list[str] = field(default_factory=list)
    before: datetime | None = None
    after: datetime | None = None
    include_expired: bool = False
    max_results: int = 0
    alpha: float = 0.0
    tag_boost: float = 0.0
    min_similarity: float = 0.0

    @property
    def limit(self) -> int:
        return self.max_results if self.max_results > 0 else DEFAULT_RESULTS

    @property
    def weight(self) -> float:
        """Weight of the vector side; 0 counts as not given."""
        return round(self.alpha, 6) if self.alpha else DEFAULT_ALPHA


@dataclass(frozen=True)
class UpdateParams:
    """Fields left UNSET stay as they are."""

    tags: Any = UNSET
    expired_at: Any = UNSET
    metadata: Any = UNSET

    def given(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if v is not UNSET}


def parse_time(text: str | None, strict: bool) -> datetime | None:
    """An RFC 3339 time; a bad one is an error at the strict entrance and ignored at the lenient one."""
    import re

    if not text:
        return None
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        try:
            head, _, rest = text.partition(".")
            if rest:
                digits = re.match(r"\d+", rest)[0]
                text = f"{head}.{digits[:6]:0<6}{rest[len(digits):]}"
            return datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            pass
    if strict:
        raise ValueError(f"not an RFC 3339 time: {text}")
    return None


def request_params(profile: str, raw: dict[str, Any]) -> SearchParams:
    """Search parameters from a request at entrance ``rest`` (group default, strict times) or ``mcp`` (no default, lenient)."""
    if profile not in ("rest", "mcp"):
        raise ValueError(f"unknown profile: {profile}")
    mode = raw.get("search_mode") or ""
    if mode and mode not in MODES:
        raise ValueError(f"search_mode must be one of {', '.join(MODES)}")
    alpha = raw.get("alpha") or 0.0
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    strict = profile == "rest"
    group = raw.get("group_id") or ("default" if strict else "")
    return SearchParams(query=raw.get("query") or "", vector=raw.get("vector"), mode=mode, group_id=group, source=raw.get("source") or "", tags=list(raw.get("tags") or []), before=parse_time(raw.get("before"), strict), after=parse_time(raw.get("after"), strict), include_expired=bool(raw.get("include_expired")), max_results=raw.get("max_results") or DEFAULT_RESULTS, alpha=alpha, tag_boost=raw.get("tag_boost") or 0.0, min_similarity=raw.get("min_similarity") or 0.0)


def memory_request(profile: str, raw: dict[str, Any]) -> dict[str, Any]:
    """The fields of a new episode from a request; content and source are required."""
    for name in ("content", "source"):
        if not raw.get(name):
            raise ValueError(f"{name} is required")
    strict = profile == "rest"
    keep = ("content", "name", "source", "source_model", "source_description", "group_id", "tags", "metadata")
    return {k: raw.get(k) for k in keep} | {"valid_at": parse_time(raw.get("valid_at"), strict)}


def update_request(profile: str, raw: dict[str, Any]) -> UpdateParams:
    """An update from a request. ``rest`` calls the expiry ``expires_at`` and can clear tags; ``mcp`` calls it
    ``expired_at``, takes empty tags as no change and ignores a bad time."""
    strict = profile == "rest"
    tags = raw.get("tags", UNSET)
    if tags is None or not strict and not tags:
        tags = UNSET
    when = parse_time(raw.get("expires_at" if strict else "expired_at"), strict)
    metadata = raw.get("metadata") or UNSET
    out = UpdateParams(tags=tags, expired_at=when if when is not None else UNSET, metadata=metadata)
    if not out.given():
        raise ValueError("nothing to update")
    return out
