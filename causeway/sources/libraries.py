"""Search functions for ``LiteratureSource`` over two public paper indexes. ``fetch(url)`` is what gets JSON; tests and
offline runs give their own."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import urlencode

from causeway.sources.models import fetch_json

#: The public addresses of the two indexes.
OPENALEX = "https://api.openalex.org/works"
SEMANTIC_SCHOLAR = "https://api.semanticscholar.org/graph/v1/paper/search"
FIELDS = "title,abstract,url,year,citationCount,authors"
Fetch = Callable[[str], dict]


def openalex(query: str, most: int = 10, fetch: Fetch = fetch_json, email: str = "") -> list[dict]:
    """Papers of OpenAlex, most cited first."""
    found = fetch(f"{OPENALEX}?{urlencode({'search': query, 'per_page': most, 'mailto': email, 'sort': 'cited_by_count:desc'})}")
    return [
        {
            "title": w.get("title") or "Untitled", "abstract": w.get("abstract") or "", "url": w.get("id") or "", "year": w.get("publication_year"), "citations": w.get("cited_by_count") or 0,
            "authors": [(a.get("author") or {}).get("display_name") or "Unknown" for a in (w.get("authorships") or [])[:3]], "source": "OpenAlex",
        }
        for w in found.get("results") or []
    ]


def semantic_scholar(query: str, most: int = 10, fetch: Fetch = fetch_json) -> list[dict]:
    """Papers of Semantic Scholar in its own order."""
    found = fetch(f"{SEMANTIC_SCHOLAR}?{urlencode({'query': query, 'limit': most, 'fields': FIELDS})}")
    return [
        {
            "title": p.get("title") or "Untitled", "abstract": p.get("abstract") or "", "url": p.get("url") or "", "year": p.get("year"), "citations": p.get("citationCount") or 0,
            "authors": [a.get("name") or "Unknown" for a in (p.get("authors") or [])[:3]], "source": "Semantic Scholar",
        }
        for p in found.get("data") or []
    ]


class Search:
    """Both indexes, half of the papers from each (or one of them): one of each title, most cited first. An index that
    fails gives none; calls keep ``least_seconds`` apart in a worker."""

    def __init__(self, both: bool = True, fetch: Fetch = fetch_json, email: str = "", least_seconds: float = 0.1):
        self.both, self.fetch, self.email, self.least_seconds, self.last = both, fetch, email, least_seconds, 0.0

    def _get(self, url: str) -> dict:
        time.sleep(max(0.0, self.last + self.least_seconds - time.monotonic()))
        self.last = time.monotonic()
        return self.fetch(url)

    def __call__(self, query: str, most: int) -> list[dict]:
        each = -(-most // 2) if self.both else most
        parts = [lambda: openalex(query, each, self._get, self.email)] + ([lambda: semantic_scholar(query, each, self._get)] if self.both else [])
        found: dict[str, dict] = {}
        for part in parts:
            try:
                for paper in part():
                    found.setdefault(paper["title"].lower(), paper)
            except Exception:  # noqa: BLE001 - an index that fails gives no papers
                continue
        return sorted(found.values(), key=lambda p: -p["citations"])[:most]
